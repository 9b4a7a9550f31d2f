"""Filter interaction audit: what every filter does at every place of every order, by wide counters.

A row's filters that fail it make a mask of five bits. For each mask (and the two labels) there is
one big integer: 600 steps (all orders of the five filters, five steps each) by six outcomes, a field
of 64 bits for each, which holds 1 where the outcome happens to such a row. Every task sums the
integers of the rows it reads, times how often they occur, per part; the sums of the tasks are added
in two rounds; and the fields of one sum per part are the counts. Counts of rows stay below 2^63, so
no field reaches the next.

Four filters look at one text. The fifth, a copy of a text with a smaller id, needs the whole table:
rows are counted by text hash, part, mask, labels and id, and the least id of each hash tells how
many of a group's rows are copies of it. All shuffles carry narrow counted rows, so copies of one text
or rows of one part meet as a few rows only.

NULL text is the empty text, NULL part the empty string. A row with a NULL id has no label, is no
copy of a smaller id and makes no other row one. Rows that repeat count each; two rows with the same
id and text are no copies of each other. A label that is listed more than once counts as 1 if any row
says so. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.base import small_batches, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, 6)]
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD_BYTES = 8
FIELDS = len(STEPS) * len(OUTCOMES)
HELD_PARTS = 64  # sums of this many parts are held by a task before it passes them on
COPY = 1 << 4
CAPITALS = bytes(range(65, 91))
SIGNS = frozenset(b"#$%&*|")


def wide(mask: int, good: int, toxic: int) -> int:
    """The integer of a row that fails the filters in ``mask`` (bit i: the i-th filter)."""
    fields = np.zeros((len(OUTCOMES), len(STEPS)), "<u8")
    for at, (order, step) in enumerate(STEPS):
        fails = [mask >> FILTERS.index(f) & 1 for f in order[:step]]
        earlier, here = any(fails[:-1]), fails[-1]
        gone = here and not earlier
        fields[:, at] = [not any(fails), gone, here and earlier, here and mask.bit_count() == 1, gone and good, gone and toxic]
    return int.from_bytes(fields.tobytes(), "little")


def pack(number: int) -> bytes:
    return number.to_bytes(FIELDS * FIELD_BYTES, "little")


def unpack(data: bytes) -> np.ndarray:
    """Counts by outcome and step."""
    return np.frombuffer(data, "<u8").reshape(len(OUTCOMES), len(STEPS)).astype(np.int64)


def own_mask(text: bytes) -> int:
    """The filters A to D that a text fails, on its own."""
    words = text.split()  # bytes split at exactly the six characters that separate words
    points = len(text) if text.isascii() else len(text.decode())
    capitals = len(text) - len(text.translate(None, CAPITALS))
    signs = not SIGNS.isdisjoint(text)
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * points) << 2 | signs << 3


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, part) as (doc_id, part, mask, node); node names the text."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            masks = pa.array([own_mask(t) for t in texts], pa.int32())
            nodes = pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), masks, nodes], names=["doc_id", "part", "mask", "node"])

    return docs.mapInArrow(look, "doc_id long, part string, mask int, node binary")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic`` (0 or 1); rows without an id match nothing and spread by text."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    known = known.filter("good + toxic > 0").withColumn("salt", F.lit(0))
    salted = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.hash("node")).otherwise(0))
    return salted.join(known, ["doc_id", "salt"], "left").drop("salt").fillna(0, ["good", "toxic"])


def counted(rows: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n) with the bit of copies in the mask; several rows a combination."""
    kind = ["node", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    groups = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    groups = groups.withColumn("least", F.expr("min(first.doc_id) OVER (PARTITION BY node)"))
    first = groups.withColumn("own", F.expr("nameless + IF(first.doc_id = least, first.n, 0)"))
    return first.selectExpr("part", "good", "toxic", f"inline(array(struct(mask, own AS n), struct(mask + {COPY} AS mask, n - own AS n)))").filter("n > 0")


def packed_sums(rows: DataFrame) -> DataFrame:
    """(part, task, packed): the sum of the integers of each part's rows in each task."""
    schema = pa.schema([("part", pa.string()), ("task", pa.int64()), ("packed", pa.binary())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        integers: dict[tuple, int] = {}
        sums: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(sums)), pa.array([task] * len(sums), pa.int64()), pa.array([pack(x) for x in sums.values()], pa.binary())]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            seen: Counter = Counter()
            part, *kinds, times = (batch.column(c).to_pylist() for c in ("part", "mask", "good", "toxic", "n"))
            for p, kind, n in zip(part, zip(*kinds), times):
                seen[p, kind] += n
            for (p, kind), n in seen.items():
                if kind not in integers:
                    integers[kind] = wide(*kind)
                sums[p] = sums.get(p, 0) + n * integers[kind]
                if len(sums) > HELD_PARTS:
                    yield out()
        if sums:
            yield out()

    return rows.mapInArrow(add, "part string, task long, packed binary")


def added(sums: DataFrame, keys: list[str]) -> DataFrame:
    """The sums of the packed integers of each group of ``keys``."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(int.from_bytes(x, "little") for x in group.column("packed").to_pylist())
        return pa.table({**{k: group.column(k).slice(0, 1) for k in keys}, "packed": pa.array([pack(total)], pa.binary())})

    kinds = dict(sums.dtypes)
    return sums.select(*keys, "packed").groupBy(*keys).applyInArrow(add, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", packed binary")


def unpacked(sums: DataFrame) -> DataFrame:
    """One row per part and step."""
    orders, steps = pa.array([o for o, _ in STEPS]), pa.array([s for _, s in STEPS], pa.int32())
    letters = np.array([o[s - 1] for o, s in STEPS])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist()):
                counts = unpack(data)
                removed = counts[OUTCOMES.index("removed")]
                shares = {f: removed[letters == f].sum() for f in FILTERS}
                columns = [pa.array([part] * len(STEPS)), orders, steps, *map(pa.array, counts), pa.array([shares[f] for f in letters], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *OUTCOMES, "shapley"])

    return sums.mapInArrow(read, "part string, filter_order string, step int, " + ", ".join(f"{o} long" for o in OUTCOMES) + ", shapley long")


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", salts: int = 64) -> DataFrame:
    """600 rows per part: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. The sums of tasks are added in ``salts`` groups a part first."""
    small_batches(df.sparkSession)
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), part)
    sums = packed_sums(counted(with_labels(masked(docs), labels)))
    some = added(sums.withColumn("task", F.col("task") % salts), ["part", "task"])
    return unpacked(added(some, ["part"]))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all 120 orders, per language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
words AS (
    SELECT *, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
           min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
marked AS (
    SELECT doc_id, part,
           (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
           (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT AS c,
           regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(doc_id > least, false)::INT AS e
    FROM words),
known AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
kinds AS (
    SELECT part, [a, b, c, d, e] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
    FROM marked LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
    SELECT p.f || q.f || r.f || s.f || t.f AS filter_order
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
steps AS (
    SELECT filter_order, s.step::INT AS step, substr(filter_order, s.step::INT, 1) AS f,
           list_transform(string_split(substr(filter_order, 1, s.step::INT - 1), ''), lambda x: ascii(x) - 64) AS earlier
    FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
cases AS (
    SELECT part, filter_order, step, f, n, good, toxic, list_sum(fails) = 1 AS only_one,
           fails[ascii(f) - 64] = 1 AS here,
           coalesce(list_sum(list_transform(list_filter(earlier, lambda x: x > 0), lambda x: fails[x])), 0) > 0 AS before
    FROM kinds, steps),
counts AS (
    SELECT part, filter_order, step, f,
           coalesce(sum(n) FILTER (WHERE NOT here AND NOT before), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (WHERE here AND NOT before), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (WHERE here AND before), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (WHERE here AND only_one), 0)::BIGINT AS unique_fails,
           coalesce(sum(n) FILTER (WHERE here AND NOT before AND good), 0)::BIGINT AS good_lost,
           coalesce(sum(n) FILTER (WHERE here AND NOT before AND toxic), 0)::BIGINT AS toxic_lost
    FROM cases GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counts
"""
