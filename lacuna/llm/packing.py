"""Best-fit packing with large-item matching.

Documents become token sequences with an end id; only those longer than the capacity are cut, into
pieces of the capacity. How many pieces there are of each length (a table of at most ``capacity``
rows, whatever the corpus) fixes the packing:

* pieces above a third of the capacity go at most two to a bin: from the longest down, each is
  matched with the longest other one that fits;
* the smaller ones, from the longest down, go to the smallest gap that takes them, and open a bin
  where none does.

Equal lengths are handled as one number, so the plan takes steps in the order of the distinct
lengths and is exactly what placing piece after piece gives. The plan says, for the n-th piece of
each length, its bin and place. Pieces are numbered within their length by a range-partitioned sort
with pre-counted parts, so a length that a third of all pieces share spreads over many tasks.

NULL text is the empty text: one piece that holds the end id only. Rows may repeat (equal rows take
places of their own), ids may be NULL, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lacuna.llm.base import documents, keep, small_batches, table
from lacuna.llm.tokens import encoder, vocabulary_path, with_end

CAPACITY = 2048
END = 0


@dataclass(frozen=True)
class Plan:
    """Row i: the pieces of ``length[i]`` numbered ``first[i]`` and on, ``count[i]`` of them, take the
    bins from ``bin[i]`` on, one each, at ``offset[i]``. Sorted by length, then number."""

    length: np.ndarray
    first: np.ndarray
    count: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of ``counts[length]`` pieces of each length."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    groups: dict[int, list] = {}  # gap -> [(items, number of bins)]; items: ((length, times), ...)
    done: list[tuple[tuple, int]] = []

    def put(gap: int, items: tuple, n: int) -> None:
        if n and gap:
            groups.setdefault(gap, []).append((items, n))
        elif n:
            done.append((items, n))

    large = [x for x in range(capacity, 0, -1) if left[x] and 3 * x > capacity]
    for i, x in enumerate(large):
        for y in large[i:]:
            if not left[x]:
                break
            if x + y > capacity:
                continue
            n = left[x] // 2 if x == y else min(left[x], left[y])
            if n:
                left[x] -= n
                left[y] -= n
                put(capacity - x - y, ((x, 2),) if x == y else ((x, 1), (y, 1)), n)
        put(capacity - x, ((x, 1),), left[x])
        left[x] = 0
    for x in range(capacity // 3, 0, -1):
        n = left[x]
        while n:
            gap = next((g for g in range(x, capacity) if groups.get(g)), capacity)
            items, bins = groups[gap].pop() if gap < capacity else ((), n)
            fit = gap // x
            full = min(bins, n // fit)  # bins that take all the pieces of this length they have room for
            put(gap - fit * x, items + ((x, fit),), full)
            n -= full * fit
            rest = bins - full
            if rest and n:  # fewer pieces than one more bin takes
                put(gap - n * x, items + ((x, n),), 1)
                rest -= 1
                n = 0
            if gap < capacity:
                put(gap, items, rest)
    for found in groups.values():
        done += found
    used = [0] * (capacity + 1)
    rows, bins = [], 0
    for items, n in done:
        offset = 0
        for length, times in items:
            for _ in range(times):
                rows.append((length, used[length], n, bins, offset))
                used[length] += n
                offset += length
        bins += n
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*columns, bins)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (and the ids, if asked for)."""

    def cut(batches):
        encode = encoder(path)
        for batch in batches:
            for lo, hi, flat, offsets in encode(batch.column("text").cast(pa.string())):
                flat, offsets = with_end(flat, offsets, end)
                n = np.diff(offsets)
                times = -(-n // capacity)
                row = np.repeat(np.arange(hi - lo), times)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                view = memoryview(flat).cast("B")
                first = offsets[row] + start
                crc = [zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(first.tolist(), length.tolist())]
                columns = [batch.column("doc_id").slice(lo, hi - lo).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    bounds = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return docs.mapInArrow(cut, schema)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``number``: 0, 1, ... within each length, in the order of doc_id and piece.

    The rows are sorted into ranges and written with their position; the first position of each
    length in each range, a table of at most ranges + lengths rows, turns positions into numbers.
    """
    order = ["length", "doc_id", "piece", "ids_crc32"]
    rows = keep(rows, "cut")  # read twice by the range partitioning, encoded once
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = keep(spread.withColumn("position", F.monotonically_increasing_id()).withColumn("part", F.shiftright("position", 33)), "pieces")
    heads = spread.groupBy("length", "part").agg(F.min("position").alias("head"), F.count("*").alias("n"))
    heads = heads.selectExpr("length", "part", "head - (sum(n) OVER (PARTITION BY length ORDER BY part) - n) AS head")
    return spread.join(heads, ["length", "part"]).withColumn("number", F.col("position") - F.col("head")).drop("position", "part", "head")


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (doc_id, piece, length, ids_crc32, more) with sequence_id and offset."""
    spark = rows.sparkSession
    rows = numbered(rows)
    counts = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    shared = spark.sparkContext.broadcast(plan(counts, capacity))

    def place(batches):
        p = shared.value
        wide = np.int64(1) << 48
        keys = p.length * wide + p.first
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = np.searchsorted(keys, length * wide + number, "right") - 1
            sequence = p.bin[at] + number - p.first[at]
            kept = [i for i, c in enumerate(batch.schema.names) if c != "number"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(sequence), pa.array(p.offset[at])],
                names=[batch.schema.names[i] for i in kept] + ["sequence_id", "offset"],
            )

    schema = StructType([f for f in rows.schema if f.name != "number"]).add("sequence_id", "long").add("offset", "long")
    return rows.mapInArrow(place, schema)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    small_batches(df.sparkSession)
    cut = pieces(documents(df, id_col, text_col), path or vocabulary_path(), capacity, end, ids)
    out = packed(cut, capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
