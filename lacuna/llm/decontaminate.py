"""Benchmark decontamination by greedy string tiling.

Texts are words in lower case. The five-word seeds of the benchmark are joined with those of every
document inside the scan; a document that shares a seed with a test item is tiled against it: the
longest run of words that both have and no tile covers yet is marked in both, found by Karp-Rabin
hashes and halving of the length, again and again until no run of five words is left. Tiles may lie
in any order, so a test whose sentences were moved about is found as well. A document is
contaminated when tiles cover at least ``coverage`` of the words of some item. An item of fewer than
five words is one tile and one seed: it is found where a document holds all of it in a row.

The benchmark is taken in blocks of about ``block_bytes`` of text (an item that is longer makes its
block longer). Every block is one pass over the documents, whose findings are written before the next
block is broadcast, so one block is alive at a time. No document leaves its task.

NULL texts are empty; an item without words matches nothing. Items with a NULL id count like others
and are reported with a NULL item and their coverage. Equal items are reported by their least id, NULL
last; ties of coverage likewise. Rows and ids may repeat or be NULL; other columns are ignored. Without
documents or without items there are no rows or no findings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.base import documents, keep, small_batches, table
from lacuna.llm.words import MULTIPLIER, SHINGLE, runs, shingles, word_hashes

COVERAGE = 0.8
BLOCK_BYTES = 16 << 20
BUCKETS = 1 << 14  # what blocks are put together from; one row each reaches the driver
SIEVE_BITS = 22
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


class Rolling:
    """Karp-Rabin hashes of all runs of a length in a sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, MULTIPLIER)]))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, INVERSE)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:n], dtype=np.uint64)])

    def runs(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length]


def _free(covered: np.ndarray, length: int) -> np.ndarray:
    """Starts of the runs of a length that no tile touches."""
    before = np.concatenate([[0], np.cumsum(covered)])
    return np.flatnonzero(before[length:] == before[:-length])


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SHINGLE) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, words) of the tiles, longest first, leftmost first among equals."""
    found: list[tuple[int, int, int]] = []
    a, b = Rolling(doc), Rolling(item)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)

    def common(length: int):
        x, y = _free(in_doc, length), _free(in_item, length)
        hx, hy = a.runs(length)[x], b.runs(length)[y]
        return x, hx, y, hy, np.isin(hx, hy)

    most = min(len(doc), len(item))
    while most >= least:
        lo, hi = least - 1, most
        while lo < hi:  # a shared run has shared runs of every smaller length
            mid = (lo + hi + 1) // 2
            if common(mid)[4].any():
                lo = mid
            else:
                hi = mid - 1
        if lo < least:
            break
        x, hx, y, hy, same = common(lo)
        places: dict[int, list[int]] = {}
        for at, h in zip(y[::-1].tolist(), hy[::-1].tolist()):
            places.setdefault(h, []).append(at)
        for at, h in zip(x[same].tolist(), hx[same].tolist()):
            if in_doc[at] or in_doc[at + lo - 1]:
                continue
            spots = places.get(h, [])
            while spots and (in_item[spots[-1]] or in_item[spots[-1] + lo - 1]):
                spots.pop()
            if spots and np.array_equal(doc[at : at + lo], item[spots[-1] : spots[-1] + lo]):
                i = spots.pop()
                in_doc[at : at + lo] = in_item[i : i + lo] = True
                found.append((at, i, lo))
        most = lo - 1
    return found


class Seeds:
    """Hashes of runs of ``length`` words of the items, and a sieve that most other runs do not pass."""

    def __init__(self, length: int, items: list[np.ndarray], numbers: list[int]):
        self.length = length
        values = [shingles(w, np.array([0, len(w)]), length)[0] for w in items]
        flat = np.concatenate([np.zeros(0, np.uint64), *values])
        item = np.repeat(np.array(numbers, np.int64), [len(v) for v in values])
        order = np.argsort(flat, kind="stable")
        self.values, self.item = flat[order], item[order]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.values >> np.uint64(64 - SIEVE_BITS)] = True

    def hits(self, hashed: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word in the row, item) of every seed that a text and an item have."""
        values, ends = shingles(hashed, offsets, self.length)
        at = np.flatnonzero(self.sieve[values >> np.uint64(64 - SIEVE_BITS)])
        lo, hi = (np.searchsorted(self.values, values[at], side) for side in ("left", "right"))
        n = hi - lo
        where = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        at = np.repeat(at, n)
        row = np.searchsorted(ends, at, "right") - 1
        whole = np.diff(offsets)[row] >= self.length  # a text that is shorter has no run of that length
        return row[whole], (at - ends[row])[whole], self.item[where][whole]


class Block:
    """Test items in the order of their ids, NULL last, with their seeds by length."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        order = sorted(range(len(ids)), key=lambda i: _place(ids[i]))
        self.ids = [ids[i] for i in order]
        hashed, offsets = word_hashes(pa.array([texts[i] for i in order], pa.string()))
        self.items = [hashed[a:z] for a, z in zip(offsets[:-1], offsets[1:])]
        lengths: dict[int, list[int]] = {}
        for i, words in enumerate(self.items):
            if len(words):
                lengths.setdefault(min(SHINGLE, len(words)), []).append(i)
        self.seeds = [Seeds(n, [self.items[i] for i in some], some) for n, some in sorted(lengths.items())]

    def hits(self, hashed: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        parts = [s.hits(hashed, offsets) for s in self.seeds]
        none = (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(p) for p in zip(none, *parts))


def _place(item_id: int | None) -> tuple:
    return item_id is None, item_id or 0


def _best(words: np.ndarray, starts: np.ndarray, items: np.ndarray, block: Block) -> tuple[int, float, list]:
    """The item of which the most is covered: (index, coverage, tiles)."""
    best = (-1, 0.0, [])
    for i in np.unique(items):
        item = block.items[i]
        least = min(SHINGLE, len(item))
        # only words within a shared seed can lie in a tile: tile those stretches, kept apart
        own = np.unique(starts[items == i])
        inside = np.unique((own[:, None] + np.arange(least)).ravel())
        inside = inside[inside < len(words)]
        gap = np.flatnonzero(np.diff(inside) > 1) + 1
        apart = np.arange(1, len(gap) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        text = np.insert(words[inside], gap, apart)
        place = np.insert(inside, gap, -1)
        got = [(int(place[d]), t, n) for d, t, n in tiles(text, item, least)]
        covered = sum(n for _, _, n in got) / len(item)
        if covered > best[1]:
            best = (int(i), covered, got)
    return best


def _pass(docs: DataFrame, block) -> DataFrame:
    def scan(batches):
        b: Block = block.value
        for batch in batches:
            texts = batch.column("text").cast(pa.string())
            item, cover, spans = (batch.column(c).to_pylist() for c in ("item_id", "coverage", "tiles"))
            for lo, hi in runs(texts):
                hashed, offsets = word_hashes(texts.slice(lo, hi - lo))
                row, starts, items = b.hits(hashed, offsets)
                order = np.argsort(row, kind="stable")
                row, starts, items = row[order], starts[order], items[order]
                heads = np.flatnonzero(np.diff(row, prepend=-1))
                for h, t in zip(heads, np.append(heads[1:], len(row))):
                    r = int(row[h])
                    i, covered, got = _best(hashed[offsets[r] : offsets[r + 1]], starts[h:t], items[h:t], b)
                    j = lo + r
                    if i >= 0 and (covered > cover[j] or covered == cover[j] and _place(b.ids[i]) < _place(item[j])):
                        item[j], cover[j], spans[j] = b.ids[i], covered, [dict(zip(("doc_word", "item_word", "words"), t)) for t in got]
            kind = pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))
            fixed = {"item_id": pa.array(item, pa.int64()), "coverage": pa.array(cover, pa.float64()), "tiles": pa.array(spans, kind)}
            yield pa.RecordBatch.from_arrays([fixed.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], names=batch.schema.names)

    return docs.mapInArrow(scan, docs.schema)


def _blocks(tests: DataFrame, block_bytes: int) -> list[tuple[int, int]]:
    """Ranges [lo, hi) of buckets that hold about ``block_bytes`` of text each."""
    sizes = tests.groupBy("bucket").agg(F.sum(F.octet_length("text")).alias("n")).orderBy("bucket").collect()  # at most BUCKETS rows
    out, held = [], block_bytes
    for bucket, n in sizes:
        if held + n > block_bytes:
            out.append((bucket, bucket + 1))
            held = n
        else:
            out[-1] = (out[-1][0], bucket + 1)
            held += n
    return out


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, the item most covered, its coverage, the tiles (in words),
    and whether it is contaminated. ``carry`` names columns of ``df`` to pass along, in a struct."""
    spark = df.sparkSession
    small_batches(spark)
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    tests = tests.groupBy("text").agg(F.min("item_id").alias("item_id")).withColumn("bucket", F.pmod(F.xxhash64("text"), F.lit(BUCKETS)))
    out = documents(df, id_col, text_col) if carry is None else df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.struct(*carry).alias("carried"))
    out = out.selectExpr("*", "CAST(NULL AS LONG) item_id", "0D coverage", "CAST(NULL AS ARRAY<STRUCT<doc_word: BIGINT, item_word: BIGINT, words: BIGINT>>) tiles")
    blocks = _blocks(tests, block_bytes)
    for k, (lo, hi) in enumerate(blocks):
        rows = tests.filter(F.col("bucket").between(lo, hi - 1)).select("item_id", "text").collect()  # about block_bytes
        shared = spark.sparkContext.broadcast(Block([r.item_id for r in rows], [r.text for r in rows]))
        out = _pass(out, shared)
        if k < len(blocks) - 1:
            out = keep(out, "contamination")
            shared.unpersist()
    return out.withColumn("contaminated", F.col("coverage") >= coverage).drop("text")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the benchmark item that each document covers most."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "contaminated", F.coalesce(F.size("tiles"), F.lit(0)).cast("long").alias("n_tiles"))
