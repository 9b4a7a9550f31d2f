"""Exact quantiles, normality distances and panel features against numpy and closed forms."""

import math
import random

import numpy as np
import pytest

from lacuna.operators import predict as P
from lacuna.operators import quantiles as Q
from lacuna.operators import stats as ST


def rows(seed=0, n=600):
    rng = random.Random(seed)
    out = [(None if g == 3 else f"g{g}", rng.choice([None, rng.gauss(0, 1), float(rng.randrange(5))])) for g in (0, 0, 0, 1, 2, 3) for _ in range(n // 6)]
    return [*out, ("empty", None), ("one", 4.0), ("big", 1e300), ("big", -1e300)]


@pytest.mark.parametrize("ranges", [None, 7])
def test_percentiles(spark, ranges):
    data = rows()
    df = spark.createDataFrame(data, "g string, x double").repartition(3)
    probs = [0.0, 0.025, 0.3, 0.5, 0.975, 1.0]
    got = {(r.g, r.feature): r.p for r in Q.exact_percentiles(df.withColumn("y", -df.x), ["g"], ["x", "y"], probs, ranges).collect()}
    groups = {g for g, _ in data}
    assert set(got) == {(g, c) for g in groups for c in "xy"}
    for g in groups:
        for c, sign in (("x", 1), ("y", -1)):
            values = [sign * x for k, x in data if k == g and x is not None]
            if not values:
                assert got[g, c] == [None] * len(probs)
            else:
                assert got[g, c] == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12, abs=1e-12)
    assert Q.exact_percentiles(df.limit(0), ["g"], ["x"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        Q.exact_percentiles(df, ["g"], ["x"], [1.5])


def test_no_group_buffers(spark):
    df = spark.createDataFrame(rows(), "g string, x double")
    for out in (ST.percentile_ci(df, ["g"], "x"), ST.rollup_rows(df, ["g"], "x"), P.panel_features(df.withColumn("t", df.x), "g", "t", ["x"])):
        assert "percentile(" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("ranges", [None, 5])
def test_ks_normal(spark, ranges):
    data = [(g, x) for g, x in rows(1) if g != "big"] + [("flat", 2.0)] * 5 + [("far", 1e6 + i * 1e-3) for i in range(40)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: r for r in Q.ks_normal(df, ["g"], "x", ranges=ranges).collect()}
    assert set(got) == {g for g, _ in data}
    for g, r in got.items():
        values = np.sort([x for k, x in data if k == g and x is not None])
        n = len(values)
        assert r.n == n
        if n < 2 or values[0] == values[-1]:
            assert r.statistic is None and r.p is None and not r.isnormal
            continue
        cdf = np.array([0.5 * math.erfc(-(x - values.mean()) / values.std(ddof=1) / math.sqrt(2)) for x in values])
        last = np.searchsorted(values, values, "right") / n
        first = np.searchsorted(values, values, "left") / n
        d = max((last - cdf).max(), (cdf - first).max())
        z = math.sqrt(n) * d
        p = 1.0 if z < 0.2 else min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101)))
        assert r.statistic == pytest.approx(d, abs=1e-9) and r.p == pytest.approx(p, abs=1e-7)
        assert r.isnormal == (p > 0.05)


def test_normal_cdf(spark):
    xs = [-40.0, -8.0, -3.0, -1e-9, 0.0, 0.5, 2.0, 7.99, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.c for r in df.select("x", Q.normal_cdf(df.x).alias("c")).sort("x").collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], abs=1e-13)


def test_panel_shape_features(spark):
    data = [("a", t, float(x)) for t, x in enumerate([3, 1, 4, 1, 5, 9, 2, 6])] + [("b", 0, 7.0), ("b", 3, 7.0), ("c", 1, None)]
    df = spark.createDataFrame(data, "e string, t int, x double")
    f = {r.e: r for r in P.panel_features(df, "e", "t", ["x"]).collect()}
    c = {r.e: r for r in P.change_features(df, "e", "t", ["x"]).collect()}
    x = np.array([3, 1, 4, 1, 5, 9, 2, 6.0])
    dev = x - x.mean()
    assert f["a"].x_skew == pytest.approx((dev**3).mean() / (dev**2).mean() ** 1.5)
    assert f["a"].x_kurtosis == pytest.approx((dev**4).mean() / (dev**2).mean() ** 2 - 3)
    assert [f["a"].x_q25, f["a"].x_median, f["a"].x_q75] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75]).tolist())
    assert c["a"].x_autocorr == pytest.approx((dev[1:] * dev[:-1]).mean() / (dev**2).mean())
    assert f["b"].x_skew is None and f["b"].x_kurtosis is None and f["b"].x_median == 7 and c["b"].x_autocorr is None
    assert f["c"].x_median is None and f["c"].x_count == 0
