"""Inverse codes of many categories, extreme rows and user metrics against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import metrics as M
from lacuna.operators import transforms as X
from lacuna.operators import user_metrics as U
from tests.data import SCHEMA, frames


def encoder(spark, codes, literal):
    model = spark.createDataFrame([("c", k, e) for k, e in codes], "col string, category string, encoded double")
    return X.TargetEncoder(["c"], 0.5, model, {"c": dict(codes)} if literal else None)


@pytest.mark.parametrize("ranges", [None, 9])
def test_inverse_by_ranges_equals_literals(spark, ranges):
    rng = random.Random(4)
    codes = [(f"k{i}", rng.randrange(60) / 8) for i in range(120)]  # many categories share a code, midpoints tie
    values = [(i, None if i % 17 == 0 else rng.randrange(-20, 160) / 16, "x") for i in range(400)]
    df = spark.createDataFrame(values, "id int, c double, one string")
    few = encoder(spark, codes, True).inverse(df).collect()
    many = encoder(spark, codes, False).inverse(df, ranges=ranges).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, many))
    assert encoder(spark, codes, False).inverse(df.limit(0)).count() == 0
    assert {r.c for r in encoder(spark, [], False).inverse(df).collect()} == {None}


def test_inverse_gives_onehots_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, c string")
    enc = X.TargetEncoder.fit(df.withColumn("y", (F.col("id") == 1).cast("int")), ["c"], "y")
    enc.codes = None
    back = enc.inverse(enc.transform(df), {"c": ["a", "b"]}).orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, 1, 0), (2, 0, 1), (3, None, None)]


def test_inverse_of_a_hundred_thousand_categories(spark):
    df = spark.range(100_000).select(F.format_string("k%06d", "id").alias("c"), (F.col("id") % 2).alias("y"))
    enc = X.TargetEncoder.fit(df, ["c"], "y")
    assert enc.codes is None
    spread = enc.model.withColumn("encoded", F.xxhash64("category") / 2.0**63)
    enc.model = spread
    coded = df.select("c").join(spread.select(F.col("category").alias("c"), "encoded"), "c").select("c", F.col("encoded").alias("x"))
    back = enc.inverse(coded.select(F.col("c").alias("was"), F.col("x").alias("c")))
    assert back.filter("was <> c").isEmpty() and back.count() == 100_000


def test_extreme_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i % 90, rng.choice([None, 0.0, float(rng.randrange(6)), rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id int, err double").repartition(7)
    got = [tuple(r) for r in M.extreme_rows(df, ["g"], "id", 4, groups=2).collect()]
    want = []
    for g in {r[0] for r in rows}:
        mine = [(e, i) for h, i, e in rows if h == g and e is not None]
        for kind, some in (("best", sorted(mine)), ("worst", sorted(mine, key=lambda x: (-x[0], x[1])))):
            want += [(g, kind, k + 1, i, e) for k, (e, i) in enumerate(some[:4])]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert M.extreme_rows(df.limit(0), ["g"], "id", 4).count() == 0
    assert M.extreme_rows(df.limit(3), ["g"], "id", 10).count() <= 6
    with pytest.raises(ValueError):
        M.extreme_rows(df, ["g"], "id", 0)


MAE = U.UserMetric("MAE", lambda: (0.0, 0.0), lambda s, t, p, w: (s[0] + float((np.abs(t - p) * w).sum()), s[1] + float(w.sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[0] / s[1] if s[1] else None)
SPAN = U.UserMetric("span", lambda: set(), lambda s, t, p, w: s | set(np.round(t - p, 6).tolist()), lambda a, b: a | b, lambda s: float(len(s)))


def scored(spark):
    return spark.range(600).select(
        "id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") % 4).alias("times"),
        F.struct((F.col("id") * 0.5).alias("x")).alias("truth"),
        F.struct(F.when(F.col("id") % 10 > 0, F.col("id") * 0.5 + (F.col("id") % 7)).alias("x")).alias("pred"),
        F.struct((F.col("id") % 5 == 0).alias("x")).alias("missing"),
    )


def test_user_metrics_by_group_and_weight(spark):
    df = scored(spark)
    got = {(r.g, r.filter_subgroup, r.metric_name): r.val for r in U.score_user_metrics(df.repartition(5), ["x"], [MAE, SPAN], ["g"], "times").collect()}
    rows = [(i % 3 or None, i % 4, i % 7, i % 5 == 0) for i in range(600) if i % 10]
    for g in (None, 1, 2):
        for sub in ("all", "missingonly"):
            mine = [(w, e) for h, w, e, gone in rows if h == g and (sub == "all" or gone)]
            assert got[g, sub, "MAE"] == pytest.approx(sum(w * e for w, e in mine) / sum(w for w, _ in mine))
            assert got[g, sub, "span"] == len({e for _, e in mine})
    assert U.score_user_metrics(df.limit(0), ["x"], [MAE]).count() == 0


def test_user_metrics_on_a_stream(spark, tmp_path):
    df = scored(spark)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = U.score_user_stream(stream, ["x"], [MAE, SPAN], ["g"])
    want = U.score_user_metrics(df, ["x"], [MAE, SPAN], ["g"])
    key = lambda out: sorted((r.g or 0, r.filter_subgroup, r.metric_name, round(r.val, 9)) for r in out.collect())
    assert key(got) == key(want)


def test_row_errors_without_missing_cells(spark):
    truth, *_ = frames(spark)
    frame = truth.select(truth.columns[0], F.struct(*SCHEMA.features).alias("truth"), F.struct(*SCHEMA.features).alias("pred"), F.struct(*[F.lit(False).alias(c) for c in SCHEMA.features]).alias("missing"))
    out = M.best_worst_by_metric(frame, SCHEMA, truth.columns[0], 2).collect()
    assert {r.filter_subgroup for r in out} == {"all"} and all(r.err == 0 for r in out)


def test_hot_deck(spark):
    from lacuna.operators.impute_simple import hot_deck

    rows = [(i, float(i) if i % 3 else None, i if i % 2 else None, None) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, x double, n int, never double").repartition(4)
    out = hot_deck(df, "id", ["x", "n", "never"], 4).collect()
    assert len(out) == 1200 and {r["copy"] for r in out} == {0, 1, 2, 3}
    seen = {i for i in range(300) if i % 3}
    for r in out:
        assert r.x in seen and (r.id % 3 == 0 or r.x == r.id) and r.n % 2 == 1 and r.never is None
    assert len({r.x for r in out if r.id % 3 == 0}) > 100
    by_id = {}
    for r in out:
        by_id.setdefault(r.id, set()).add(r.x)
    assert np.mean([len(v) > 1 for i, v in by_id.items() if i % 3 == 0]) > 0.9
    assert hot_deck(df.limit(0), "id", ["x"], 2).count() == 0
