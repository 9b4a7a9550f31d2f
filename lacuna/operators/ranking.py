"""Ranks, running sums and exact cut points that do not put a whole group into one task.

A window partitioned by a label or an entity sends all its rows to one task. Here the order column
is first cut into ranges holding about equally many rows; windows then run per (group, range), and
ranges are connected by the small table of per-range totals.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.session import broadcast_if_small

MAX_RANGES = 4096
MAX_GROUPS = 1000
ROWS_PER_RANGE = 500_000


def _numeric(df: DataFrame, col: str) -> Column:
    kind = df.schema[col].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(col)).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    return F.col(col).cast("double")


def range_cuts(df: DataFrame, order: str, ranges: int | None = None) -> list[float]:
    """Increasing bounds that cut ``order`` into ranges of about equally many rows.

    One aggregate counts the rows and sketches the quantiles; at most ``MAX_RANGES`` literals come
    back. A table of up to ``ROWS_PER_RANGE`` rows is one range.
    """
    most = ranges or MAX_RANGES
    probs = ", ".join(repr(i / most) for i in range(1, most)) or "0.5"
    sketch = F.expr(f"percentile_approx(__key, array({probs}), {10 * MAX_RANGES})")
    n, found = df.select(_numeric(df, order).alias("__key")).agg(F.count(F.lit(1)), sketch).first()
    wanted = ranges or min(MAX_RANGES, n // ROWS_PER_RANGE)
    if wanted <= 1 or not found:
        return []
    picked = [found[round(i * most / wanted) - 1] for i in range(1, wanted)]
    return sorted({v for v in picked if v is not None and math.isfinite(v)})


def with_range(df: DataFrame, order: str, cuts: list[float], name: str = "__range") -> DataFrame:
    """Add the number of the range ``order`` falls in, ranges increasing with the order.

    A value lies in exactly one range, so equal values stay together.
    """
    if not cuts:
        return df.withColumn(name, F.lit(0))
    bucketed = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")],
        inputCol="__key",
        outputCol="__bucket",
        handleInvalid="keep",
    ).transform(df.withColumn("__key", _numeric(df, order)))
    return bucketed.withColumn(name, F.col("__bucket").cast("int")).drop("__key", "__bucket")


def join_totals(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    renamed = totals.select(*[F.col(k).alias(f"__j_{k}") for k in keys], *[
        c for c in totals.columns if c not in keys
    ])
    cond = [df[k].eqNullSafe(F.col(f"__j_{k}")) for k in keys]
    return df.join(broadcast_if_small(renamed), cond, "left").drop(*[f"__j_{k}" for k in keys])


def grouped_rank(
    df: DataFrame, group: list[str], order: str, name: str, tie: str | None = None, ranges: int | None = None
) -> DataFrame:
    """Exact 1-based ``row_number`` within ``group`` by ``order`` (then ``tie``)."""
    cuts = range_cuts(df, order, ranges)
    if not cuts:
        local = W.partitionBy(*group).orderBy(order, *([tie] if tie else []))
        return df.withColumn(name, F.row_number().over(local).cast("bigint"))
    ranged = with_range(df, order, cuts)
    keys = [*group, "__range"]
    totals = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = W.partitionBy(*keys).orderBy(order, *([tie] if tie else []))
    ranked = ranged.withColumn("__local", F.row_number().over(local))
    out = join_totals(ranked, totals, keys)
    return out.withColumn(name, F.col("__local") + F.col("__before")).drop(
        "__range", "__local", "__before"
    )


def running_sums(
    df: DataFrame, group: list[str], order: str, sums: dict[str, str], descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Inclusive running totals within ``group``; ``sums`` maps a new name to its column.

    ``order`` must be unique within a group: aggregate by it first.
    """
    by_order = F.col(order).desc() if descending else F.col(order)
    cuts = range_cuts(df, order, ranges)
    if not cuts:
        whole = W.partitionBy(*group).orderBy(by_order).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(whole).alias(n) for n, c in sums.items()])
    ranged = with_range(df, order, cuts)
    keys = [*group, "__range"]
    totals = ranged.groupBy(*keys).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    by_range = F.col("__range").desc() if descending else F.col("__range")
    before = W.partitionBy(*group).orderBy(by_range).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *keys, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums]
    )
    local = W.partitionBy(*keys).orderBy(by_order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(c).over(local).alias(f"__l_{n}") for n, c in sums.items()])
    out = join_totals(out, totals, keys)
    for n in sums:
        out = out.withColumn(n, F.col(f"__l_{n}") + F.col(f"__b_{n}"))
    return out.drop("__range", *[f"__{x}_{n}" for n in sums for x in "lb"])


def carry(
    df: DataFrame, entity: str, time: str, columns: list[str], forward: bool, cuts: list[float]
) -> DataFrame:
    """Struct ``__from_{c}`` (time, value): the nearest observation at or before (after) each row.

    Time is cut into ranges: windows run per (entity, range) and what crosses a range border is
    carried by the table of per-range edge values, so one long sequence is spread over many tasks.
    """
    ranged = with_range(df, time, cuts)
    keys = [entity, "__range"]
    seen = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(time).alias("at"), F.col(c).alias("v"))) for c in columns}
    edge = F.max if forward else F.min
    edges = ranged.groupBy(*keys).agg(*[edge(seen[c]).alias(f"__e_{c}") for c in columns])
    order = F.col("__range") if forward else F.col("__range").desc()
    before = W.partitionBy(entity).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(
        *keys, *[F.last(f"__e_{c}", ignorenulls=True).over(before).alias(f"__p_{c}") for c in columns]
    )
    by_time = F.col(time) if forward else F.col(time).desc()
    local = W.partitionBy(*keys).orderBy(by_time).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.select(
        "*", *[F.last(seen[c], ignorenulls=True).over(local).alias(f"__l_{c}") for c in columns]
    )
    if cuts:
        out = join_totals(out, edges, keys)
        kept = [F.coalesce(f"__l_{c}", f"__p_{c}").alias(f"__from_{c}") for c in columns]
    else:  # a single range: nothing crosses a border
        kept = [F.col(f"__l_{c}").alias(f"__from_{c}") for c in columns]
    return out.select(*df.columns, *kept)


def _bucket_match(group: str, prefix: Column, targets: set) -> Column:
    """Rows whose group and leading key bits are among ``targets``."""
    cond = F.lit(False)
    for g, p in sorted(targets, key=repr):
        cond = cond | (F.col(group).eqNullSafe(F.lit(g)) & (prefix == p))
    return cond


class TooManyGroups(ValueError):
    """More groups than the driver should hold histograms of."""


def hash_cuts(
    df: DataFrame, group: str, key: str, tie: str, ranks_of: Callable[[dict], dict], bits: int = 32, step: int = 12
) -> tuple[dict, dict]:
    """The (key, tie) found at given 1-based ranks of each group, without sorting the table.

    ``key`` is an integer in [0, 2**bits). A histogram of its leading bits gives the group sizes and
    the bucket that holds each rank; buckets still large are refined by their next bits, and only
    the last few rows are sorted. The driver sees histograms and those rows, never the table.

    ``ranks_of`` turns {group: size} into {group: [rank, ...]}. Returns the sizes and
    {(group, rank): (key, tie)}.
    """
    sizes: dict = {}
    cuts: dict = {}
    wanted: dict = {}  # (group, rank) -> (prefix, rows below the prefix)
    rest = bits
    while rest == bits or wanted:
        take = min(step, rest)
        prefix, rest = F.shiftright(key, rest), rest - take
        rows = df if not wanted else df.filter(
            _bucket_match(group, prefix, {(g, p) for (g, _), (p, _) in wanted.items()})
        )
        buckets = rows.groupBy(F.col(group).alias("g"), F.shiftright(key, rest).alias("b")).count()
        # the first histogram may show too many groups; later ones have 2**step rows per wanted bucket at most
        hist = (buckets if wanted else buckets.limit((MAX_GROUPS << step) + 1)).collect()
        by_group: dict = {}
        for row in sorted(hist, key=lambda x: x.b):
            by_group.setdefault(row.g, []).append((row.b, row["count"]))
        if not sizes:
            if len(hist) > MAX_GROUPS << step or len(by_group) > MAX_GROUPS:
                raise TooManyGroups("group by a column with fewer values")
            sizes = {g: sum(n for _, n in rows) for g, rows in by_group.items()}
            wanted = {(g, r): (0, 0) for g, rs in ranks_of(sizes).items() for r in rs}
        located = {}
        for (g, r), (p, below) in wanted.items():
            for bucket, n in by_group[g]:
                if bucket >> take == p:
                    if below + n >= r:
                        located[g, r] = (bucket, below, n)
                        break
                    below += n
        ready = {k: v for k, v in located.items() if v[2] <= 10_000 or rest == 0}
        if ready:
            match = _bucket_match(group, F.shiftright(key, rest), {(g, v[0]) for (g, _), v in ready.items()})
            few = df.filter(match).select(
                F.col(group).alias("g"), F.col(key).alias("k"), F.col(tie).alias("t")
            )
            few = few.orderBy("k", "t").collect()
            for (g, r), (bucket, below, _) in ready.items():
                mine = [x for x in few if x.g == g and x.k >> rest == bucket]
                cuts[g, r] = (mine[r - below - 1].k, mine[r - below - 1].t)
        wanted = {k: v[:2] for k, v in located.items() if k not in ready}
    return sizes, cuts


def at_or_before(key: Column, tie: Column, cut: tuple) -> Column:
    k, t = cut
    return (key < F.lit(k)) | ((key == F.lit(k)) & (tie <= F.lit(t)))
