"""Column profiles, intervals, normality and classification scores, as exact aggregates."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.quantiles import exact_percentiles
from lacuna.operators.ranking import join_totals, running_sums
from lacuna.session import materialize


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: missing share, min, max, mean; one pass over all columns."""
    stats = df.agg(
        *[
            F.struct(
                F.avg(F.col(c).isNull().cast("double")).alias("missing_share"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                F.avg(c).alias("mean"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("s")) for i, c in enumerate(columns)]
    )
    return stats.select(F.inline(rows)).select("feature", "s.*")


def column_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent observed value per column as a string, the smallest on ties.

    Values are counted before the shuffle, so any number of distinct values is fine.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in columns])
    counts = df.select(F.inline(cells)).filter("v IS NOT NULL").groupBy("feature", "v").count()
    return counts.groupBy("feature").agg(
        F.min(F.struct(-F.col("count"), F.col("v").alias("mode")))["mode"].alias("mode")
    )


def percentile_ci(df: DataFrame, keys: list[str], value: str = "val", level: float = 0.95) -> DataFrame:
    """Percentile interval with linear interpolation."""
    alpha = 1 - level
    found = exact_percentiles(df, keys, [value], [alpha / 2, alpha / 2 + level])
    return found.select(*keys, F.col("p")[0].alias("lower"), F.col("p")[1].alias("upper"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return total


def _student_cdf(t: float, df: int) -> float:
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
        if 0 < x < 1
        else -math.inf
    )
    if x < (a + 1) / (a + b + 2):
        tail = math.exp(log_front) * _beta_fraction(a, b, x) / a
    else:
        tail = 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1 - x) / b
    return 1.0 - tail / 2 if t >= 0 else tail / 2


def student_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection of its distribution function."""
    lo, hi = 0.0, 1.0
    while _student_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _student_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


#: Up to this many rows a quantile is found by bisection, beyond it by expansion (error below 1e-12).
EXACT_QUANTILES = 1_000


def _quantile_expansion(p: float, df: Column) -> Column:
    """Quantile of Student's t as the normal one plus four powers of 1 / df (Abramowitz and Stegun, 26.7.5)."""
    z = NormalDist().inv_cdf(p)
    powers = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    total = F.lit(z)
    for k, a in enumerate(powers, start=1):
        total = total + a / F.pow(df.cast("double"), F.lit(float(k)))
    return total


def t_ci(df: DataFrame, keys: list[str], value: str = "val", level: float = 0.95) -> DataFrame:
    """mean and half width ``sem * t((1 + level) / 2, n - 1)`` per group.

    Quantiles of groups of at most ``EXACT_QUANTILES`` rows come from a table of those sizes, larger
    groups take the expansion. A group of one row has no half width.
    """
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")
    )
    sizes = stats.filter(F.col("n").between(2, EXACT_QUANTILES)).select("n").distinct().collect()
    rows = [(n, student_quantile((1 + level) / 2, n - 1)) for (n,) in sizes]
    table = df.sparkSession.createDataFrame(rows, "__n bigint, q double")
    joined = stats.join(F.broadcast(table), F.col("n") == F.col("__n"), "left")
    beyond = F.when(F.col("n") > EXACT_QUANTILES, _quantile_expansion((1 + level) / 2, F.col("n") - 1))
    half = F.col("sd") / F.sqrt("n") * F.coalesce("q", beyond)
    return joined.select(*keys, "mean", half.alias("half_width"))


def jarque_bera(df: DataFrame, keys: list[str], value: str = "val", level: float = 0.95) -> DataFrame:
    """Normality per group from skewness and kurtosis; the statistic is chi-squared with 2 degrees."""
    n = F.count(value).cast("double")
    jb = n / 6 * (F.pow(F.skewness(value), F.lit(2.0)) + F.pow(F.kurtosis(value), F.lit(2.0)) / 4)
    out = df.groupBy(*keys).agg(jb.alias("statistic"))
    p = F.exp(-F.col("statistic") / 2)
    return out.withColumns({"p": p, "isnormal": F.coalesce(p > 1 - level, F.lit(False))})


def rollup_rows(df: DataFrame, keys: list[str], value: str = "val", level: float = 0.95) -> DataFrame:
    """mean, isnormal, lowerci, upperci as long rows: one grouping, and the percentiles by rank."""
    alpha = 1 - level
    n = F.count(value).cast("double")
    jb = n / 6 * (F.pow(F.skewness(value), F.lit(2.0)) + F.pow(F.kurtosis(value), F.lit(2.0)) / 4)
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.coalesce(F.exp(-jb / 2) > alpha, F.lit(False)).cast("double").alias("isnormal")
    )
    ends = exact_percentiles(df, keys, [value], [alpha / 2, alpha / 2 + level]).drop("feature")
    stats = join_totals(stats, ends, keys)
    cells = {"mean": F.col("mean"), "isnormal": F.col("isnormal"), "lowerci": F.col("p")[0], "upperci": F.col("p")[1]}
    rows = F.array(*[F.struct(F.lit(k).alias("aggregate_type"), c.alias("val")) for k, c in cells.items()])
    return stats.select(*keys, F.inline(rows))


def confusion_metrics(
    scored: DataFrame, label: str = "label", pred: str = "pred", by: list[str] = (), weight: str | None = None
) -> DataFrame:
    """TP, TN, FP, FN and F1, recall, precision of class 1; a ratio without cases is 0."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    count = lambda y, p: F.sum(F.when((F.col(label) == y) & (F.col(pred) == p), w).otherwise(0))
    out = scored.groupBy(*by).agg(
        count(1, 1).alias("TP"), count(0, 0).alias("TN"), count(0, 1).alias("FP"), count(1, 0).alias("FN")
    )
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.withColumns(
        {
            "precision_score": ratio(tp, tp + fp),
            "recall_score": ratio(tp, tp + fn),
            "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def brier(scored: DataFrame, label: str = "label", prob: str = "prob", by: list[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.avg(F.pow(F.col(prob) - F.col(label), F.lit(2.0))).alias("brier_score")
    )


def _by_score(scored: DataFrame, label: str, prob: str, by: list[str], weight: str | None) -> DataFrame:
    """Positives and negatives per distinct score: ties and hot scores shrink before any ordering."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    return scored.groupBy(*by, prob).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("neg"),
    )


def roc_auc(
    scored: DataFrame, label: str = "label", prob: str = "prob", by: list[str] = (), weight: str | None = None
) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties counting half."""
    cum = running_sums(_by_score(scored, label, prob, by, weight), list(by), prob, {"neg_upto": "neg"})
    below = F.col("neg_upto") - F.col("neg")
    won = F.sum((F.col("pos") * (below + F.col("neg") / 2)).cast("double"))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return cum.groupBy(*by).agg(F.when(pairs > 0, won / pairs).alias("roc_auc"))


def average_precision(
    scored: DataFrame, label: str = "label", prob: str = "prob", by: list[str] = (), weight: str | None = None
) -> DataFrame:
    """Sum over distinct scores, from high to low, of recall gain times precision; NULL without positives."""
    cum = running_sums(
        _by_score(scored, label, prob, by, weight),
        list(by),
        prob,
        {"tp": "pos", "fp": "neg"},
        descending=True,
    )
    gain = F.try_divide(F.col("pos") * F.col("tp"), F.col("tp") + F.col("fp"))
    return cum.groupBy(*by).agg(F.try_divide(F.sum(gain), F.sum("pos")).alias("average_precision"))


def classification_report(
    scored: DataFrame, label="label", pred="pred", prob="prob", by: list[str] = (), weight: str | None = None
) -> DataFrame:
    """All ten scores per group as long rows: metric_name, val.

    The input is read once: every score follows from counts per distinct (group, score, class, label).
    """
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    counts = scored.groupBy(*by, label, pred, prob).agg(F.sum(w).alias("__w"))
    scored, weight = materialize(counts, "score-counts"), "__w"
    parts = confusion_metrics(scored, label, pred, by, weight)
    err = F.pow(F.col(prob) - F.col(label), F.lit(2.0))
    extra = scored.groupBy(*by).agg((F.sum(err * F.col(weight)) / F.sum(weight)).alias("brier_score"))
    tables = [
        extra,
        roc_auc(scored, label, prob, by, weight),
        average_precision(scored, label, prob, by, weight),
    ]
    for t in tables:  # one row a group; a crossed table is a single row
        t = t.withColumnsRenamed({c: f"__{c}" for c in by})
        keys = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
        parts = parts.join(t, keys).drop(*[f"__{c}" for c in by]) if by else parts.crossJoin(t)
    names = [c for c in parts.columns if c not in by]
    rows = F.array(*[F.struct(F.lit(c).alias("metric_name"), F.col(c).cast("double").alias("val")) for c in names])
    return parts.select(*by, F.inline(rows))
