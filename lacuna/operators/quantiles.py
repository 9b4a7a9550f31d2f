"""Exact quantiles and distribution distances without holding a group in one buffer.

Rows are counted per group and distinct value before any ordering, so repeated values shrink in the
task that reads them. Running sums over ranges of the values (see ``ranking``) give each value its
last rank in its group; a quantile is then two conditional minima: the values at the two ranks around
its position. However large a group is, no task holds more of it than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.ranking import join_totals, running_sums
from lacuna.session import materialize

SERIES_TERMS = 140
FLAT_BEYOND = 8.0


def value_ranks(df: DataFrame, keys: list[str], columns: list[str], ranges: int | None = None) -> DataFrame:
    """(keys, feature, v, n, upto, total): per distinct value of each column its rows, the rows up to
    and including it and all rows of its group. Missing values count nothing; a group that has only
    those keeps one row with a NULL value and total 0."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    by = [*keys, "feature"]
    counts = df.select(*keys, F.inline(cells)).groupBy(*by, "v").agg(F.count("v").alias("n"))
    counts = materialize(counts, "value-counts")  # read for the ranges, the sums and the totals
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return join_totals(running_sums(counts, by, "v", {"upto": "n"}, ranges=ranges), totals, by)


def exact_percentiles(
    df: DataFrame, keys: list[str], columns: list[str], probs: list[float], ranges: int | None = None
) -> DataFrame:
    """(keys, feature, p): per group and column the percentiles, an array in the order of ``probs``,
    with linear interpolation between the two neighbours of a position; NULL without values."""
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probabilities lie in [0, 1]")
    ranked = value_ranks(df, keys, columns, ranges)
    picked = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("total") - 1)
        share = at - F.floor(at)
        for name, rank in (("lo", F.floor(at) + 1), ("hi", F.ceil(at) + 1)):
            picked.append(F.min(F.when(F.col("upto") >= rank, F.col("v"))).alias(f"__{name}{i}"))
        picked.append(F.max(share).alias(f"__share{i}"))
    found = ranked.groupBy(*keys, "feature").agg(*picked)
    between = [
        F.col(f"__lo{i}") * (1 - F.col(f"__share{i}")) + F.col(f"__hi{i}") * F.col(f"__share{i}") for i in range(len(probs))
    ]
    exact = [F.when(F.col(f"__lo{i}") == F.col(f"__hi{i}"), F.col(f"__lo{i}")).otherwise(b) for i, b in enumerate(between)]
    return found.select(*keys, "feature", F.array(*exact).alias("p"))


def normal_cdf(x: Column) -> Column:
    """Distribution function of the standard normal, by its power series (Marsaglia, 2004)."""
    state = F.struct(F.lit(0.0).alias("sum"), x.alias("term"))
    step = lambda s, k: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * x * x / (2 * k + 1)).alias("term"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), state, step, lambda s: s["sum"])
    inside = 0.5 + total * F.exp(-x * x / 2) / F.sqrt(2 * F.pi())
    return F.when(x > FLAT_BEYOND, 1.0).when(x < -FLAT_BEYOND, 0.0).otherwise(inside)


def ks_normal(df: DataFrame, keys: list[str], value: str = "val", level: float = 0.95, ranges: int | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance of each group to the normal distribution with its mean and standard
    deviation: keys, n, statistic, p, isnormal.

    ``p`` is the asymptotic tail of the Kolmogorov distribution at ``sqrt(n) * statistic``. It takes
    the two parameters as given, so it is too large where they are estimated, as they are here.
    Groups of one value, repeated or not, have no spread: statistic, p NULL and not normal.
    """
    ranked = value_ranks(df, keys, [value], ranges).filter("v IS NOT NULL").drop("feature")
    stats = ranked.groupBy(*keys).agg(F.sum("n").alias("__n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("__mean"))
    ranked = join_totals(ranked, stats, keys)
    # deviations from the known mean, so that a large mean does not cancel the spread
    spread = ranked.groupBy(*keys).agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("__mean"), F.lit(2.0)) * F.col("n")) / (F.max("__n") - 1)).alias("__sd"), (F.min("v") < F.max("v")).alias("__varies"))
    ranked = join_totals(ranked, spread, keys).filter("__varies")
    cdf = normal_cdf((F.col("v") - F.col("__mean")) / F.col("__sd"))
    n = F.col("total")
    gap = F.greatest(F.col("upto") / n - F.col("__cdf"), F.col("__cdf") - (F.col("upto") - F.col("n")) / n)
    found = ranked.withColumn("__cdf", cdf).groupBy(*keys).agg(F.max(gap).alias("statistic"))
    base = df.groupBy(*keys).agg(F.count(value).alias("n"))
    out = join_totals(base, found, keys)
    z = F.sqrt("n") * F.col("statistic")
    terms = lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * z * z)
    tail = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(100)), terms), F.lit(0.0), lambda a, b: a + b)
    p = F.when(z < 0.2, 1.0).when(z.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * tail)))
    return out.withColumn("p", p).withColumn("isnormal", F.coalesce(F.col("p") > 1 - level, F.lit(False)))
