"""Supervised discretisation by minimum description length (Fayyad and Irani, 1993).

Class counts are taken per distinct value and accumulated once. Each round then finds the best cut
of all open segments of all columns in a single aggregate, so no task holds a whole column.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.ranking import running_sums
from lacuna.operators.transforms import FixedBins
from lacuna.session import materialize

MAX_CLASSES = 100


def _entropy(counts: list[float]) -> float:
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts if c > 0) if n else 0.0


def _information(counts: list[Column]) -> Column:
    """n times the entropy of the counts: n log n minus the sum of c log c."""
    xlogx = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    total = reduce(lambda a, b: a + b, counts)
    return xlogx(total) - reduce(lambda a, b: a + b, [xlogx(c) for c in counts])


def _accepted(whole: list[float], left: list[float], right: list[float]) -> bool:
    n, nl, nr = sum(whole), sum(left), sum(right)
    k, kl, kr = (sum(c > 0 for c in x) for x in (whole, left, right))
    e, el, er = _entropy(whole), _entropy(left), _entropy(right)
    gain = e - nl / n * el - nr / n * er
    delta = math.log2(3**k - 2) - (k * e - kl * el - kr * er)
    return gain > (math.log2(n - 1) + delta) / n if n > 1 else False


def mdl_cuts(df: DataFrame, columns: list[str], label: str, force: bool = True) -> dict[str, list[float]]:
    """Cut points per column, half-way between neighbouring values; at least one if ``force``."""
    classes = [r[0] for r in df.select(label).filter(F.col(label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()]
    if len(classes) > MAX_CLASSES:
        raise ValueError("too many classes")
    names = [f"c{i}" for i in range(len(classes))]
    tables = []
    for c in columns:
        counted = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("value")).agg(
            *[F.count(F.when(F.col(label) == y, 1)).alias(f"n{i}") for i, y in enumerate(classes)]
        )
        counted = materialize(counted.withColumn("col", F.lit(c)), "mdl-values")
        tables.append(running_sums(counted, ["col"], "value", {n: f"n{i}" for i, n in enumerate(names)}))
    prefix = materialize(reduce(DataFrame.unionByName, tables), "mdl-prefix")
    ends = prefix.groupBy("col").agg(F.max("value").alias("hi"), F.max(F.struct("value", *names)).alias("all")).collect()
    # A segment: column, value below it (excluded), last value, counts up to either end.
    zero = [0.0] * len(classes)
    segments = [(r.col, -math.inf, r.hi, zero, [float(r["all"][n]) for n in names]) for r in ends]
    cuts: dict[str, list[float]] = {c: [] for c in columns}
    top = True
    while segments:
        number, base, total = F.lit(-1), [F.lit(0.0)] * len(names), [F.lit(0.0)] * len(names)
        for s, (c, lo, hi, before, upto) in enumerate(segments):
            inside = (F.col("col") == c) & (F.col("value") > lo) & (F.col("value") < hi)
            number = F.when(inside, s).otherwise(number)
        tagged = prefix.withColumn("seg", number).filter("seg >= 0")
        for i in range(len(names)):
            for s, seg in enumerate(segments):
                base[i] = F.when(F.col("seg") == s, seg[3][i]).otherwise(base[i])
                total[i] = F.when(F.col("seg") == s, seg[4][i]).otherwise(total[i])
        left = [F.col(n) - b for n, b in zip(names, base)]
        right = [t - F.col(n) for n, t in zip(names, total)]
        cost = F.round(_information(left) + _information(right), 9)
        best = tagged.groupBy("seg").agg(F.min(F.struct(cost.alias("cost"), "value", *names)).alias("b")).collect()
        chosen = []
        for r in best:
            c, lo, hi, before, upto = segments[r.seg]
            at = [float(r.b[n]) for n in names]
            l, w = [a - b for a, b in zip(at, before)], [u - b for u, b in zip(upto, before)]
            if (top and force) or _accepted(w, l, [u - a for u, a in zip(upto, at)]):
                chosen.append((c, lo, hi, before, upto, r.b["value"], at))
                if top and not _accepted(w, l, [u - a for u, a in zip(upto, at)]):
                    chosen[-1] = (*chosen[-1], "forced")
        if not chosen:
            break
        above = F.lit(None)
        for s, item in enumerate(chosen):
            above = F.when((F.col("col") == item[0]) & (F.col("value") > item[5]) & (F.col("value") <= item[2]), s).otherwise(above)
        following = {
            r.s: r.v
            for r in prefix.withColumn("s", above).filter("s IS NOT NULL").groupBy("s").agg(F.min("value").alias("v")).collect()
        }
        segments = []
        for s, item in enumerate(chosen):
            c, lo, hi, before, upto, value, at = item[:7]
            cuts[c].append((value + following[s]) / 2)
            if len(item) == 7:  # a forced cut is not refined
                segments += [(c, lo, value, before, at), (c, value, hi, at, upto)]
        top = False
    return {c: sorted(v) for c, v in cuts.items()}


def mdl_bins(df: DataFrame, columns: list[str], label: str, force: bool = True) -> FixedBins:
    """Bins from the cuts, closed by the observed minimum and maximum.

    The last bin is left out if the maximum equals the last cut. Columns without values get none.
    """
    cuts = mdl_cuts(df, columns, label, force)
    row = df.agg(
        *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(columns)],
    ).first()
    bins = {}
    for i, c in enumerate(columns):
        lo, hi = row[f"lo_{i}"], row[f"hi_{i}"]
        if lo is None:
            continue
        points = [float(lo), *cuts[c]] + ([float(hi)] if not cuts[c] or hi != cuts[c][-1] else [])
        bins[c] = list(zip(points[:-1], points[1:])) or [(float(lo), float(hi))]
    return FixedBins(bins)
