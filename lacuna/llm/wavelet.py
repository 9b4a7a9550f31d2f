"""Token ids in wavelet matrices, one compressed file per shard.

A shard holds whole documents in ascending doc_id order. Its ids are cut into bit-planes from the
highest bit down; each plane is stored in blocks that are compressed one by one, next to the number
of set bits before each block (rank directory). From the one file one can read a token by position,
count a token in a range, and find its n-th occurrence, by unpacking only the blocks on the way;
or read all ids back.

File: ``WVM1``, the length of a JSON header, the header (tokens, planes, block bits, zeros per plane,
sizes of what follows), then doc ids with NULL flags, document ends, and per plane its directory,
block sizes and blocks. All numbers are little-endian.

NULL text is the empty text (its end id only). Rows with equal ids follow each other in the order of
their text; NULL ids come first. Extra columns are ignored. An empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.base import documents, keep, scratch_name, small_batches, table
from lacuna.llm.files import read_file, write_file
from lacuna.llm.tokens import encoder, vocabulary_path, with_end
from lacuna.session import new_table_path

MAGIC = b"WVM1"
BLOCK_BITS = 1 << 16
STRETCH = 1 << 15
SHARD_TOKENS = 1 << 21
PART_CHARS = 16 << 20
END = 2


def pack_shard(ids: np.ndarray, ends: np.ndarray, doc_ids: pa.Array) -> list[bytes]:
    """The parts of a shard file of ``ids``; document i ends before ``ends[i]``."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    order = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    squeeze = zstandard.ZstdCompressor(level=1)
    zeros, bodies = [], []
    for p in range(planes - 1, -1, -1):
        bits = (order >> order.dtype.type(p)) & order.dtype.type(1) != 0
        packed = np.packbits(bits)
        blocks = [packed[i : i + BLOCK_BITS // 8] for i in range(0, len(packed), BLOCK_BITS // 8)]
        ones = np.array([int(np.bitwise_count(b).sum(dtype=np.int64)) for b in blocks], "<i8")
        before = (np.cumsum(ones) - ones).astype("<i8")
        blocks = [squeeze.compress(b.tobytes()) for b in blocks]
        bodies += [before.tobytes(), np.array([len(b) for b in blocks], "<i8").tobytes(), *blocks]
        zeros.append(len(order) - int(ones.sum()))
        order = _split(order, bits, zeros[-1])
    null = np.asarray(doc_ids.is_null().to_numpy(zero_copy_only=False), np.uint8)
    named = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    header = json.dumps({"tokens": len(ids), "docs": len(ends), "planes": planes, "block_bits": BLOCK_BITS, "zeros": zeros}).encode()
    return [MAGIC, len(header).to_bytes(4, "little"), header, named.tobytes(), null.tobytes(), np.asarray(ends, "<i8").tobytes(), *bodies]


def _spans(bits: np.ndarray, zeros: int) -> Iterator[tuple[slice, np.ndarray, slice, np.ndarray, slice]]:
    """Per stretch of a plane: itself, its clear bits and their place in the next plane, its set bits and theirs.

    Stretches are short, so that their positions stay in the processor's cache.
    """
    low, high = 0, zeros
    for at in range(0, len(bits), STRETCH):
        some = bits[at : at + STRETCH]
        clear, up = np.flatnonzero(~some), np.flatnonzero(some)
        yield slice(at, at + STRETCH), clear, slice(low, low + len(clear)), up, slice(high, high + len(up))
        low, high = low + len(clear), high + len(up)


def _split(order: np.ndarray, bits: np.ndarray, zeros: int) -> np.ndarray:
    """Those with a clear bit, then those with a set one, either in their order."""
    out = np.empty_like(order)
    for here, clear, low, up, high in _spans(bits, zeros):
        some = order[here]
        out[low], out[high] = some.take(clear), some.take(up)
    return out


class Shard:
    """A shard file's content: token access, counting and occurrence lookup; blocks unpack on use."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        at = 8 + int.from_bytes(data[4:8], "little")
        self.header = json.loads(data[8:at])
        self.tokens, docs = self.header["tokens"], self.header["docs"]

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        named, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = pa.array(named, pa.int64(), mask=null.astype(bool))
        self.ends = take("<i8", docs)
        self.planes = []
        blocks = -(-self.tokens // BLOCK_BITS)
        for _ in range(self.header["planes"]):
            before, sizes = take("<i8", blocks), take("<i8", blocks)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            self.planes.append((before, starts, sizes))
        self.data = data
        self.unpack = zstandard.ZstdDecompressor()
        self.cache: dict[tuple[int, int], np.ndarray] = {}

    def block(self, plane: int, b: int) -> np.ndarray:
        """Set-bit flags of a block."""
        if (plane, b) not in self.cache:
            _, starts, sizes = self.planes[plane]
            raw = self.unpack.decompress(self.data[starts[b] : starts[b] + sizes[b]], max_output_size=BLOCK_BITS // 8)
            self.cache[plane, b] = np.unpackbits(np.frombuffer(raw, np.uint8))[: min(BLOCK_BITS, self.tokens - b * BLOCK_BITS)]
        return self.cache[plane, b]

    def ones(self, plane: int, i: int) -> int:
        """Set bits of a plane before position i."""
        b, rest = divmod(i, BLOCK_BITS)
        if rest == 0 and b == len(self.planes[plane][0]):
            if not b:
                return 0
            b, rest = b - 1, BLOCK_BITS
        return int(self.planes[plane][0][b]) + int(self.block(plane, b)[:rest].sum())

    def token(self, i: int) -> int:
        """The id at position i."""
        out = 0
        for p in range(len(self.planes)):
            bit = int(self.block(p, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self.ones(p, i)
            out = out << 1 | bit
            i = self.header["zeros"][p] + ones if bit else i - ones
        return out

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of a token from [lo, hi) lie after the last plane."""
        n = len(self.planes)
        if token >> n:
            return 0, 0
        for p in range(n):
            a, z = self.ones(p, lo), self.ones(p, hi)
            if token >> (n - 1 - p) & 1:
                lo, hi = self.header["zeros"][p] + a, self.header["zeros"][p] + z
            else:
                lo, hi = lo - a, hi - z
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in positions [lo, hi)."""
        a, z = self._span(token, lo, self.tokens if hi is None else hi)
        return z - a

    def select(self, token: int, n: int) -> int:
        """Position of the n-th occurrence (from 0) of a token."""
        lo, hi = self._span(token, 0, self.tokens)
        if not 0 <= n < hi - lo:
            raise IndexError("no such occurrence")
        i = lo + n
        for p in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - p) & 1
            i = self._select_bit(p, bit, i - self.header["zeros"][p] if bit else i)
        return i

    def _select_bit(self, plane: int, bit: int, n: int) -> int:
        before = self.planes[plane][0]
        had = before if bit else np.arange(len(before)) * BLOCK_BITS - before
        b = int(np.searchsorted(had, n, "right")) - 1
        return b * BLOCK_BITS + int(np.flatnonzero(self.block(plane, b) == bit)[n - int(had[b])])

    def ids(self) -> np.ndarray:
        """All ids, in order."""
        n = len(self.planes)
        out = np.zeros(self.tokens, np.uint16 if n <= 16 else np.uint32)
        for p in range(n - 1, -1, -1):
            _, starts, sizes = self.planes[p]
            raw = b"".join(self.unpack.decompress(self.data[a : a + s], max_output_size=BLOCK_BITS // 8) for a, s in zip(starts, sizes))
            bits = np.unpackbits(np.frombuffer(raw, np.uint8))[: self.tokens].astype(bool)
            zeros = self.header["zeros"][p]
            out[zeros:] |= out.dtype.type(1 << (n - 1 - p))
            up = np.empty_like(out)
            for here, clear, low, set_, high in _spans(bits, zeros):
                some = up[here]
                some[clear], some[set_] = out[low], out[high]
            out = up
        return out


def write_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END) -> DataFrame:
    """Encode all documents and write the shard files. The manifest: one row per file in document
    order, with folder, name, docs, tokens, bytes and start (tokens of all files before it)."""
    spark = df.sparkSession
    small_batches(spark)
    path = path or vocabulary_path()
    folder = new_table_path(spark, scratch_name("wavelet"))
    docs = documents(df, id_col, text_col)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    order = ["doc_id", "tie", "text"]
    ranged = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(1 + chars // PART_CHARS, "doc_id", "tie").sortWithinPartitions(*order)

    def write(batches) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        encode = encoder(path)
        held: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, shard
            ids = np.concatenate([x[0] for x in held])
            ends = np.cumsum(np.concatenate([np.diff(x[1]) for x in held]))
            named = pa.concat_arrays([x[2] for x in held])
            name = f"part-{part:06d}-{shard:06d}.wvm"
            written = write_file(folder, name, pack_shard(ids, ends, named))
            row = [part, shard, folder, name, len(ends), len(ids), written]
            held, size, shard = [], 0, shard + 1
            return pa.RecordBatch.from_pylist([dict(zip(("part", "shard", "folder", "name", "docs", "tokens", "bytes"), row))], schema=schema)

        schema = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("folder", pa.string()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
        for batch in batches:
            for lo, hi, ids, offsets in encode(batch.column("text").cast(pa.string())):
                ids, offsets = with_end(ids, offsets, end)
                held.append((ids, offsets, batch.column("doc_id").slice(lo, hi - lo)))
                size += len(ids)
                if size >= SHARD_TOKENS:
                    yield flush()
        if held:
            yield flush()

    written = ranged.select("doc_id", "text").mapInArrow(write, "part long, shard long, folder string, name string, docs long, tokens long, bytes long")
    files = keep(written, "manifest")
    return files.selectExpr("*", "sum(tokens) OVER (ORDER BY part, shard) - tokens AS start")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, ids."""

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name, start in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "start"))):
                shard = Shard(read_file(folder, name))
                ids = shard.ids().astype("<u4")
                view = memoryview(ids).cast("B")
                firsts = np.concatenate([[0], shard.ends[:-1]])
                crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(firsts.tolist(), shard.ends.tolist())]
                columns = [shard.doc_ids, pa.array(firsts + start), pa.array(shard.ends - firsts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("folder", "name", "start")
    spread = spread.repartition(max(1, spread.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(manifest: DataFrame, token: int) -> DataFrame:
    """Every place of a token id: doc_id and position among all ids of the corpus."""

    def find(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name, start in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "start"))):
                shard = Shard(read_file(folder, name))
                at = np.array([shard.select(token, i) for i in range(shard.count(token))], np.int64)
                doc = np.searchsorted(shard.ends, at, "right")
                yield pa.RecordBatch.from_arrays([shard.doc_ids.take(pa.array(doc)), pa.array(at + start)], names=["doc_id", "position"])

    return manifest.select("folder", "name", "start").mapInArrow(find, "doc_id long, position long")


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, lengths and checksums of all documents, read back from the shard files."""
    return read_shards(write_shards(table(spark, sf_dir, "documents")))
