import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.operators import ampute as A
from lacuna.operators import autoencoder as AE
from lacuna.operators import clean as C
from lacuna.operators import discretize as D
from lacuna.operators import encode as E
from lacuna.operators import impute_simple as I
from lacuna.operators import joins as J
from lacuna.operators import knn as KN
from lacuna.operators import metrics as M
from lacuna.operators import mice as MI
from lacuna.operators import predict as PR
from lacuna.operators import ranking as R
from lacuna.operators import reshape as RS
from lacuna.operators import results as RE
from lacuna.operators import splits as SP
from lacuna.operators import stats as ST
from lacuna.operators import transforms as X
from lacuna.schema import FeatureSchema
from tests.data import BINS, SCHEMA, frames, wrong

GROUPS = {k: list(v) for k, v in SCHEMA.onehot.items()}


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def metrics(spark, pred, mask_from=None):
    data, truth = frames(spark)
    frame = J.scoring_frame(truth, pred, mask_from if mask_from is not None else data, ["id"], SCHEMA.features)
    out = M.score_imputation(frame, SCHEMA).collect()
    return {(r.filter_subgroup, r.reduction, r.feature_type, r.metric_name): r.val for r in out}


def test_metrics_closed_forms(spark):
    m = metrics(spark, wrong(spark))
    se = {"age": 4.0, "weight": 36.0}
    assert m["all", "EW", "continuous", "RMSE"] == pytest.approx(math.sqrt((4 + 36) / 12))
    assert m["all", "CW", "continuous", "RMSE"] == pytest.approx(sum(math.sqrt(e / 6) for e in se.values()) / 2)
    assert m["missingonly", "CW", "continuous", "RMSE"] == pytest.approx((2 + 6) / 2)
    assert m["all", "EW", "categorical", "RMSE"] == pytest.approx(2 / 12)
    # The observed binary that is wrong does not count, and the column then has no counted cell.
    assert m["missingonly", "CW", "categorical", "RMSE"] == pytest.approx(1.0)
    maape = (math.atan(2 / 13) + math.atan(6 / 15.1)) / 12 * 2 / math.pi
    assert m["all", "CW", "continuous", "MAAPE"] == pytest.approx(maape)
    assert m["all", "EW", "mixed", "MAAPE"] == pytest.approx(maape + 2 / 12)


def test_missing_only_without_gaps_is_over_all(spark):
    _, truth = frames(spark)
    m = metrics(spark, wrong(spark), mask_from=truth)
    assert m["missingonly", "EW", "mixed", "RMSE"] == m["all", "EW", "mixed", "RMSE"]


def test_metrics_refuse_missing(spark):
    data, _ = frames(spark)
    with pytest.raises(Exception, match="missing values"):
        metrics(spark, data)


def test_merged_batches_equal_whole(spark):
    data, truth = frames(spark)
    frame = J.scoring_frame(truth, wrong(spark), data, ["id"], SCHEMA.features)
    whole = M.metric_states(frame, SCHEMA)
    parts = M.metric_states(frame.filter("id < 2"), SCHEMA).unionByName(M.metric_states(frame.filter("id >= 2"), SCHEMA))
    merged = M.merge_states(parts)
    key = ["filter_subgroup", "reduction", "feature_type", "metric_name"]
    for a, b in zip(rows(M.metrics_long(whole), *key), rows(M.metrics_long(merged), *key)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])


def test_discretize_uniform_and_inverse(spark):
    data, _ = frames(spark)
    bins = X.FixedBins(BINS)
    mapped = bins.transform(data)
    assert mapped.columns[-7:-4] == ["age_0 - 20", "age_20 - 40", "age_40 - 80"]
    first = mapped.orderBy("id").first()
    assert tuple(first)[-7:] == (0, 0, 1, None, None, None, None)
    groups = {**GROUPS, **bins.names()}
    soft = E.uniform_probability(mapped, groups, ["ismale"]).orderBy("id").collect()
    assert tuple(soft[0])[-4:] == (0.25,) * 4 and soft[2]["fries_s"] == pytest.approx(1 / 3)
    back = bins.inverse(mapped, data.columns).orderBy("id").collect()
    assert [r.age for r in back] == [60.0, 60.0, 30.0, 10.0, None, 60.0] and back[0].weight is None
    extreme = spark.createDataFrame([(-5e6, 5e6)], "age double, weight double")
    edge = tuple(bins.transform(extreme).first())
    assert edge[0] == 1 and edge[-1] == 1 and sum(edge) == 2


def test_combine_onehots_round_trip(spark):
    data, _ = frames(spark)
    combined = E.combine_onehots(data, GROUPS)
    assert [r.fries for r in combined.orderBy("id").collect()] == [1, 2, None, 0, 1, 0]
    assert rows(E.uncombine_onehots(combined, GROUPS, data.columns), "id") == rows(data, "id")
    logits = spark.createDataFrame([(0.0, 1.0, 3.4, 9.0), (2.0, 5.0, 3.4, 9.0), (1.0, 1.0, 0.0, 0.0)], "a double, b double, c double, d double")
    hard = E.onehot_threshold(logits, {"x": ["a", "b"], "y": ["c", "d"]}).collect()
    assert [tuple(r) for r in hard] == [(0, 1, 0, 1), (0, 1, 0, 1), (1, 0, 1, 0)]


def test_explode_nulls_all_or_none(spark):
    df = spark.createDataFrame([(1, None, 0), (0, 1, 0)], "a int, b int, c int")
    out = E.explode_nulls(df, {"g": ["a", "b", "c"]}).collect()
    assert tuple(out[0]) == (None, None, None) and tuple(out[1]) == (0, 1, 0)


def test_target_encoding(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 1), (None, 0)], "c string, y int")
    enc = X.TargetEncoder.fit(df, ["c"], "y", 1.0, 1.0)
    w = 1 / (1 + math.exp(-1))
    out = enc.transform(df).collect()
    assert out[0].c == pytest.approx(0.6 * (1 - w) + w) and out[4].c is None
    assert [r.c for r in enc.inverse(enc.transform(df)).collect()] == ["a", "a", "b", "b", None]
    new = spark.createDataFrame([("z", 1)], "c string, y int")
    assert enc.transform(new).first().c == pytest.approx(0.6)
    by_join = X.TargetEncoder(enc.columns, enc.prior, enc.model, None).transform(df)
    assert sorted(r.c or -1 for r in by_join.collect()) == pytest.approx(sorted(r.c or -1 for r in out))


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "a double")
    assert [r.a for r in X.MinMaxScaler.fit(df, ["a"]).transform(df).collect()] == [0.0, 0.0, None]


def test_simple_imputer(spark):
    data, _ = frames(spark)
    out = {r.id: r for r in I.SimpleImputer.fit(data, SCHEMA).transform(data).collect()}
    assert out[0].weight == pytest.approx((57.2 + 26.3 + 73.4 + 56.5 + 29.6) / 5)
    assert out[4].age == pytest.approx((44 + 49 + 26 + 16 + 57) / 5)
    # Two s and two m: the first category wins the tie.
    assert (out[2].fries_s, out[2].fries_m, out[2].fries_l) == (1, 0, 0)


@pytest.mark.parametrize("ranges", [None, 4])
def test_panel_fills_do_not_depend_on_ranges(spark, ranges):
    rng = np.random.default_rng(0)
    table = [(int(e), t, None if rng.random() < 0.6 else float(t * t + e)) for e in range(3) for t in range(40)]
    df = spark.createDataFrame(table, "e int, t int, x double")
    last, want = {}, []
    for e, t, x in table:
        last[e] = x if x is not None else last.get(e)
        want.append((e, t, last[e]))
    assert rows(I.fill_forward(df, "e", "t", ["x"], ranges), "e", "t") == want
    filled = rows(I.interpolate(df, "e", "t", ["x"], ranges), "e", "t")
    for e in range(3):
        seen = [(t, x) for k, t, x in table if k == e and x is not None]
        got = [x for k, _, x in filled if k == e]
        assert got == pytest.approx(list(np.interp(range(40), *zip(*seen))))


@pytest.mark.parametrize("ranges", [None, 5])
def test_ranks_and_running_sums(spark, ranges):
    df = spark.range(200).selectExpr("id", "id % 3 as g", "(id * 37) % 101 as o")
    got = {r.id: r.rk for r in R.grouped_rank(df, ["g"], "o", "rk", tie="id", ranges=ranges).collect()}
    data = [(r.g, r.o, r.id) for r in df.collect()]
    for g in range(3):
        for i, (_, i_d) in enumerate(sorted((o, k) for gg, o, k in data if gg == g), start=1):
            assert got[i_d] == i
    sums = R.running_sums(df, ["g"], "id", {"s": "o"}, ranges=ranges).collect()
    for r in sums:
        assert r.s == sum(o for g, o, k in data if g == r.g and k <= r.id)


def test_stratified_split_shares(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 10 = 0 as int) as label")
    out = SP.stratified_split(df, "id", "label", seed=3).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in out} == {
        (0, "train"): 270, (0, "val"): 270, (0, "test"): 360, (1, "train"): 30, (1, "val"): 30, (1, "test"): 40,
    }


@pytest.mark.parametrize("external", [False, True])
def test_stratified_split_of_many_labels(spark, monkeypatch, external):
    few = spark.range(600).selectExpr("id", "nullif(id % 7, 3) as label")
    plain = {r.id: r.split for r in SP.stratified_split(few, "id", "label", seed=4, external_test=external).collect()}
    monkeypatch.setattr("lacuna.operators.ranking.MAX_GROUPS", 3)
    ranked = SP.stratified_split(few, "id", "label", seed=4, external_test=external)
    assert ranked.columns == ["id", "label", "split"] and {r.id: r.split for r in ranked.collect()} == plain
    monkeypatch.undo()
    many = spark.range(12000).selectExpr("id", "id % 3000 as label")
    shares = {(r.label, r.split): r["count"] for r in SP.stratified_split(many, "id", "label", external_test=external).groupBy("label", "split").count().collect()}
    want = {"val": 2, "train": 2} if external else {"test": 2, "val": 1, "train": 1}
    assert shares == {(g, p): n for g in range(3000) for p, n in want.items()}


def test_hash_cuts_refine(spark):
    df = spark.range(5000).selectExpr("id", "0 as g", "id % 7 as k")
    _, cuts = R.hash_cuts(df, "g", "k", "id", lambda s: {0: [1, 2500, 5000]}, bits=32, step=4)
    order = sorted((i % 7, i) for i in range(5000))
    assert [cuts[0, r] for r in (1, 2500, 5000)] == [order[r - 1] for r in (1, 2500, 5000)]


def test_semi_observed_split(spark):
    df = spark.range(100).selectExpr("id", "id % 4 div 2 as label", "case when id % 2 = 0 then 1.0 end as x")
    out = SP.semi_observed_split(df, ["x"], "id", "label")
    odd = {r.split for r in out.filter("id % 2 = 1").collect()}
    even = {r.split for r in out.filter("id % 2 = 0").collect()}
    assert odd == {"test"} and even == {"train", "val"}


def test_bootstraps(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 5 = 0 as int) as label", "1.0 as one")
    drawn = SP.bootstrap(df, "id", 3).groupBy("replicate").agg(F.sum("times").alias("n"), F.count("id").alias("k")).collect()
    assert all(r.n == 500 and 270 < r.k < 360 for r in drawn) and len(drawn) == 3
    by_label = SP.stratified_bootstrap(df, "id", "label", 2).groupBy("replicate", "label").agg(F.sum("times").alias("n"))
    assert {(r.replicate, r.label): r.n for r in by_label.collect()} == {(0, 0): 400, (1, 0): 400, (0, 1): 100, (1, 1): 100}
    sums = SP.poisson_sums(df, "id", ["one"], 50).collect()
    assert np.mean([r.n for r in sums]) == pytest.approx(500, rel=0.03)
    assert np.var([r.n for r in sums]) == pytest.approx(500, rel=0.6) and all(r.n == r.one for r in sums)


def test_bootstrap_draws_are_not_broadcast(spark):
    df = spark.range(20_000).selectExpr("id", "cast(id % 5 = 0 as int) as label")
    for drawn in (SP.bootstrap(df, "id", 40), SP.stratified_bootstrap(df, "id", "label", 40)):
        assert "Broadcast" not in drawn._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_by_block(spark, monkeypatch):
    """Sums and groups by block are those of the drawn rows; many blocks, missing and infinite terms, a missing label."""
    monkeypatch.setattr(SP, "BLOCK_ROWS", 256)
    df = spark.range(3000).selectExpr(
        "id * 3 as id", "if(id % 7 = 0, null, cast(id % 5 = 0 as int)) as label", "if(id % 3 = 0, null, id / 7) as x",
        "if(id = 11, double('infinity'), 1) as y", "if(id < 2000, null, 'c' || id % 4) as c", "if(id = 5, 1.0, null) as few",
    )
    for label, drawn in ((None, SP.bootstrap(df, "id", 9, 4)), ("label", SP.stratified_bootstrap(df, "id", "label", 9, 4))):
        by = ["replicate", *([label] if label else [])]
        aggs = [F.sum("times").cast("double").alias("n"), *[F.sum(F.col(t) * F.col("times")).alias(t) for t in ("x", "y", "few")]]
        want = {tuple(r[k] for k in by): r for r in drawn.groupBy(*by).agg(*aggs).collect()}
        got = {tuple(r[k] for k in by): r for r in SP.bootstrap_sums(df, "id", ["x", "y", "few"], 9, 4, label).collect()}
        assert want.keys() == got.keys()
        for k, r in want.items():
            assert got[k].n == r.n and got[k].x == pytest.approx(r.x) and got[k].y == r.y and got[k].few == r.few
        cells = [*by, "c"]
        want = {tuple(r[k] for k in cells): r.t for r in drawn.groupBy(*cells).agg(F.sum("times").alias("t")).collect()}
        found = SP.bootstrap_groups(df, "id", ["c"], 9, 4, label).groupBy(*cells).agg(F.sum("times").alias("t"))
        assert {tuple(r[k] for k in cells): r.t for r in found.collect()} == want


@pytest.mark.parametrize("ranges", [1, 7])
def test_epoch_batches(spark, ranges):
    df = spark.range(1000).selectExpr("id", "if(id % 4 = 0, 'test', 'train') as split")
    out = SP.epoch_batches(df, "id", 2, 64, 5, "split", ranges).collect()
    orders = [[r.id for r in sorted((r for r in out if r.epoch == e), key=lambda r: r.position)] for e in range(2)]
    assert all(sorted(o) == [i for i in range(1000) if i % 4] for o in orders) and orders[0] != orders[1]
    assert all(r.batch == r.position // 64 for r in out) and max(r.batch for r in out) == 749 // 64
    again = SP.epoch_batches(df.repartition(3), "id", 2, 64, 5, "split", 8 - ranges).collect()
    assert {(r.epoch, r.id, r.position) for r in again} == {(r.epoch, r.id, r.position) for r in out}
    assert abs(np.corrcoef(orders[0], range(750))[0, 1]) < 0.15
    odd = spark.createDataFrame([(None, "train"), (3, "train"), (3, "train"), (None, "train")], "id long, split string")
    got = sorted((r.position, r.id or -1) for r in SP.epoch_batches(odd, "id", 1, 2, ranges=ranges).collect())
    assert got == [(0, -1), (1, -1), (2, 3), (3, 3)]
    assert SP.epoch_batches(odd.limit(0), "id", 2, 2, ranges=ranges).count() == 0


def test_epoch_shuffle_keeps_every_train_row(spark):
    df = spark.range(200).selectExpr("id", "if(id < 150, 'train', 'val') as split")
    first, second = ([r.id for r in SP.shuffle_rows(df, "id", e, train_only="split").collect()] for e in (0, 1))
    assert sorted(first) == sorted(second) == list(range(150)) and first != second


def test_intervals(spark):
    values = [45, 55, 67, 45, 68, 79, 98, 87, 84, 82]
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, val double")
    assert ST.t_ci(df, ["k"], level=0.98).first().half_width == pytest.approx(16.22075, rel=1e-3)
    ci = ST.percentile_ci(df, ["k"]).first()
    assert (ci.lower, ci.upper) == pytest.approx(tuple(np.percentile(values, [2.5, 97.5])))


def test_auc_and_average_precision(spark):
    data = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.2), (0, 0.1)]
    df = spark.createDataFrame(data, "label int, prob double")
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert ST.roc_auc(df).first().roc_auc == pytest.approx(want)
    assert ST.average_precision(df).first().average_precision == pytest.approx((1 * 1 + 1 * 2 / 3 + 1 * 3 / 5) / 3)


@pytest.mark.parametrize("weights,chunk,direct", [("uniform", 7, False), ("distance", 50, False), ("uniform", 7, True), ("distance", 50, True)])
def test_knn_equals_brute_force(spark, weights, chunk, direct):
    rng = np.random.default_rng(1)
    x = np.round(rng.random((150, 3)), 3)
    x[rng.random(x.shape) < 0.25] = np.nan
    x[10:40] = x[9]  # many equal vectors
    table = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(table, "id bigint, a double, b double, c double")
    donors = df.filter("id < 100")
    got = np.array([tuple(r)[1:] for r in KN.knn_impute(df, ["a", "b", "c"], "id", donors, 3, weights, chunk, direct).orderBy("id").collect()])
    want, base = x.copy(), x[:100]
    for i, j in zip(*np.where(np.isnan(x))):
        cand = []
        for d in base:
            both = ~np.isnan(x[i]) & ~np.isnan(d)
            if not np.isnan(d[j]) and both.any():
                cand.append((np.sum((x[i] - d)[both] ** 2) * 3 / both.sum(), d[j]))
        cand = sorted(cand)[:3]
        if not cand:
            want[i, j] = np.nanmean(base[:, j])
        elif weights == "uniform":
            want[i, j] = np.mean([v for _, v in cand])
        elif cand[0][0] == 0:
            want[i, j] = np.mean([v for d, v in cand if d == 0])
        else:
            w = [1 / math.sqrt(d) for d, _ in cand]
            want[i, j] = np.average([v for _, v in cand], weights=w)
    assert np.allclose(got, want)


def test_many_bins_are_looked_up_once(spark):
    nan = float("nan")
    for uppers in ([], [1.0], [float(k) for k in range(60)], [3.0, 1.0, 5.0, 5.0, 2.0]):
        bins = X.FixedBins({"a": [(hi - 1, hi) for hi in uppers] + [(9.0, 99.0)]})
        bins.names = lambda n=len(uppers) + 1: {"a": [f"b{k}" for k in range(n)]}
        values = [None, nan, -1.0, 0.5, 1.0, 2.0, 2.5, 4.0, 5.0, 58.5, 1e9]
        df = spark.createDataFrame(list(enumerate(values)), "id int, a double")
        out = bins.transform(df)
        for r in out.collect():
            v = values[r.id]
            code = None if v is None else next((k for k, u in enumerate(uppers) if v <= u), len(uppers))
            assert [*r[1:]] == [None if v is None else int(k == code) for k in range(len(uppers) + 1)]
        shown = E.onehot_threshold(out, bins.names())
        for frame, word, most in ((out, "CASE WHEN", 70), (shown, "array_max", 2)):
            assert frame._jdf.queryExecution().optimizedPlan().toString().count(word) <= most
        assert shown.filter("id > 0").collect() == out.filter("id > 0").collect()


def test_mdl_cuts(spark):
    table = [(float(i), float((i * 7) % 40), int(i >= 25)) for i in range(40)]
    df = spark.createDataFrame(table, "a double, noise double, y int")
    assert D.mdl_cuts(df, ["a"], "y") == {"a": [24.5]}
    assert len(D.mdl_cuts(df, ["noise"], "y")["noise"]) == 1
    assert D.mdl_cuts(df.withColumn("y", F.lit(1)), ["noise"], "y", force=False)["noise"] == []
    assert D.mdl_bins(df, ["a"], "y").bins == {"a": [(0.0, 24.5), (24.5, 39.0)]}


def test_matching_draws_from_all_observed_values(spark):
    observed = spark.range(300).select("id", F.col("id").cast("double").alias("y"), (F.col("id") >= 200).cast("double").alias("pred"))
    matching = MI.fit_matching(observed, "y", "pred", "id")
    rows = spark.range(1000, 7000).select("id", (F.col("id") % 2).cast("double").alias("pred"), (F.col("id") % 3 > 0).alias("gap"))
    out = MI.match_means(rows, matching, "id", "pred", F.col("gap")).collect()
    assert len(out) == 6000 and all(r.pred == r.id % 2 for r in out if not r.gap)
    low, high = [{r.pred for r in out if r.gap and r.id % 2 == k} for k in (0, 1)]
    assert low <= set(range(200)) and high == set(range(200, 300)) and len(low) > 190


def test_matching_draws_differ_by_stream_and_copy(spark):
    observed = spark.range(500).select("id", F.col("id").cast("double").alias("y"), F.lit(0.0).alias("pred"))
    matching = MI.fit_matching(observed, "y", "pred", "id")
    rows = spark.range(2000).select("id", F.lit(0.0).alias("pred"), F.explode(F.array(F.lit(0), F.lit(1))).alias(MI.COPY))
    drawn = {s: {(r.id, r[MI.COPY]): r.pred for r in MI.match_means(rows, matching, "id", "pred", stream=s).collect()} for s in (1, 2)}
    assert all(len(d) == 4000 and set(d.values()) <= set(range(500)) and len(set(d.values())) > 480 for d in drawn.values())
    same = lambda pairs: sum(a == b for a, b in pairs)
    assert same((drawn[1][i, 0], drawn[1][i, 1]) for i in range(2000)) < 40
    assert same((drawn[1][k], drawn[2][k]) for k in drawn[1]) < 60
    assert drawn[1] == {(r.id, r[MI.COPY]): r.pred for r in MI.match_means(rows.repartition(3), matching, "id", "pred", stream=1).collect()}


def test_boosted_chain_completes_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, 2))
    y = np.where(x[:, 0] > 0.5, 10.0, 0.0) + x[:, 1]
    kind = (x[:, 0] * 3).astype(int)
    gone = rng.random((300, 2)) < 0.3
    table = [(i, float(a), None if g else float(v), int(a * 3), None if h else int(k)) for i, ((a, _), v, k, (g, h)) in enumerate(zip(x, y, kind, gone))]
    df = spark.createDataFrame(table, "id bigint, a double, y double, third int, kind int")
    model = MI.ChainedImputer.fit(df, "id", ["a", "y"], ["third", "kind"], max_iter=2, learner="boosted", copies=3)
    out = model.transform(df).collect()
    assert len(out) == 900 and {r["copy"] for r in out} == {0, 1, 2}
    observed = {v for _, _, v, _, _ in table if v is not None}
    for r in out:
        _, a, v, third, k = table[r.id]
        assert (r.a, r.third) == (a, third) and r.y in observed and r.kind in (0, 1, 2)
        assert v is None or r.y == v
        assert k is None or r.kind == k
    filled = [(r.y, y[r.id]) for r in out if table[r.id][2] is None]
    assert np.mean([abs(a - b) < 3 for a, b in filled]) > 0.9
    assert np.mean([r.kind == kind[r.id] for r in out if table[r.id][4] is None]) > 0.9
    by_row = {}
    for r in out:
        by_row.setdefault(r.id, set()).add(r.y)
    assert np.mean([len(v) > 1 for i, v in by_row.items() if table[i][2] is None]) > 0.8
    pooled = {r.feature: r for r in MI.pool_copies(model.transform(df), ["y", "a"]).collect()}
    means = [np.mean([r.y for r in out if r["copy"] == k]) for k in range(3)]
    within = np.mean([np.var([r.y for r in out if r["copy"] == k], ddof=1) / 300 for k in range(3)])
    assert pooled["y"].mean == pytest.approx(np.mean(means)) and pooled["y"].between == pytest.approx(np.var(means, ddof=1))
    assert pooled["y"].within == pytest.approx(within) and pooled["y"].total == pytest.approx(within + 4 / 3 * np.var(means, ddof=1))
    assert pooled["a"].between == 0 and pooled["a"].share == 0
    with pytest.raises(ValueError):
        MI.ChainedImputer.fit(df, "id", ["a"], learner="other")


def test_tree_steps_write_only_rows_that_lack_their_column(spark, monkeypatch):
    """Each step writes the rows with a gap in its column, and the table keeps every row once."""
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000.0
    full = spark.range(600).select("id", (F.col("id") % 7).alias("extra"), u(1).alias("a"), u(2).alias("b"), (u(1) + u(2)).alias("c"))
    df = full.select("id", "extra", *[F.when(u(s) >= 0.2, F.col(c)).alias(c) for s, c in enumerate("abc", 5)])
    gaps = {c: df.filter(F.col(c).isNull()).count() for c in "abc"}
    sizes, write = [], MI.materialize

    def counted(frame, name):
        out = write(frame, name)
        if name == "mice-step":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(MI, "materialize", counted)
    model = MI.ChainedImputer.fit(df, "id", ["a", "b", "c"], learner="boosted", max_iter=2, copies=2)
    out = model.transform(df)
    assert len(sizes) == 12 and set(sizes) <= {2 * n for n in gaps.values()}
    assert out.count() == 1200 and out.select("id", "copy").distinct().count() == 1200 and out.columns == [*df.columns, "copy"]
    both = out.withColumnsRenamed({c: f"f_{c}" for c in "abc"}).join(df, ["id", "extra"])
    assert both.count() == 1200 and both.filter(" OR ".join(f"f_{c} IS NULL OR {c} <> f_{c}" for c in "abc")).isEmpty()


def test_mice_recovers_linear_structure(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 3))
    x[:, 2] = 2 * x[:, 0] - x[:, 1] + 0.01 * rng.standard_normal(400)
    gone = rng.random(x.shape) < 0.15
    table = [(i, *[None if g else float(v) for v, g in zip(r, gr)]) for i, (r, gr) in enumerate(zip(x, gone))]
    df = spark.createDataFrame(table, "id bigint, a double, b double, c double")
    model = MI.ChainedImputer.fit(df, "id", ["a", "b", "c"], max_iter=4)
    got = np.array([tuple(r)[1:] for r in model.transform(df).orderBy("id").collect()])
    assert np.allclose(got[~gone], x[~gone])
    only_c = gone[:, 2] & ~gone[:, 0] & ~gone[:, 1]
    assert np.sqrt(np.mean((got - x)[only_c, 2] ** 2)) < 0.3 * np.std(x[:, 2])


def test_bayesian_ridge_matches_least_squares():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 2))
    y = x @ [1.5, -2.0] + 0.3 + 0.01 * rng.standard_normal(300)
    z = np.column_stack([np.ones(300), x, y])
    coef, intercept = MI.bayesian_ridge(z.T @ z)
    assert coef == pytest.approx([1.5, -2.0], abs=0.01) and intercept == pytest.approx(0.3, abs=0.01)


def test_ampute(spark):
    df = spark.range(4000).selectExpr("id", "cast(id as double) as a", "cast(id * 7 % 4000 as double) as b")
    for p in [
        {"mechanism": "MCAR"},
        {"mechanism": "MAR", "weights": {"b": 1.0}},
        {"mechanism": "MNAR", "score_to_probability_func": "sigmoid-tail"},
        {"mechanism": "MNAR(G)", "score_to_probability_func": "sigmoid-mid"},
        {"mechanism": "MNAR(Y)"},
    ]:
        pattern = {"incomplete_vars": ["a"], **p}
        out = A.ampute(df, 0.4, [pattern], "id", ["a", "b"], seed=1)
        share, other = out.agg(F.avg(F.col("a").isNull().cast("double")), F.count("b")).first()
        assert share == pytest.approx(0.4, abs=0.04) and other == 4000 and out.columns == df.columns
        assert pattern["mechanism"] == p["mechanism"]
    tail = A.ampute(df, 0.4, [{"incomplete_vars": ["a"], "mechanism": "MNAR", "score_to_probability_func": "sigmoid-right"}], "id", ["a"], 1)
    top, low = (tail.filter(c).agg(F.avg(F.col("a").isNull().cast("double"))).first()[0] for c in ("id >= 2000", "id < 2000"))
    assert top > low + 0.1


def test_patterns():
    given = [{"incomplete_vars": ["a"], "mechanism": "MNAR(G, Y)"}, {"incomplete_vars": ["a"], "mechanism": "MNAR(yule)", "weights": [0]}]
    first, second = (A.Pattern.parse(p, i, ["a"]) for i, p in enumerate(given))
    assert [x.column for p in (first, second) for x in p.latents] == ["latent_p0_g0", "latent_p0_y1", "latent_p1_yule0"]
    assert [x.distribution for x in first.latents] == ["normal", "yulesimon"]
    assert first.weights == {"latent_p0_g0": 1, "latent_p0_y1": 1} and second.weights == {"latent_p1_yule0": 1}
    assert given == [{"incomplete_vars": ["a"], "mechanism": "MNAR(G, Y)"}, {"incomplete_vars": ["a"], "mechanism": "MNAR(yule)", "weights": [0]}]
    assert A.Pattern.parse({"incomplete_vars": ["a"], "mechanism": "MAR"}, 0, ["a", "b"]).weights == {"b": 1.0}
    assert A.Pattern.parse({"incomplete_vars": ["a"], "mechanism": "MNAR"}, 0, ["a", "b"]).weights == {"a": 1.0}
    with pytest.raises(ValueError):
        A.Pattern.parse({"incomplete_vars": ["a"], "mechanism": "MNAR(zeta)"}, 0, ["a"])
    assert [p["mechanism"] for p in A.scenario_grid(["a"], ["b"])] == 2 * ["MCAR", "MAR", "MNAR(G)", "MNAR(Y)", "MNAR"]


def test_ampute_groups_and_scenarios(spark):
    """A one-hot member takes its whole group along; scenarios are those of single calls; odd rows stay."""
    df = spark.range(3000).selectExpr("id", "cast(id as double) as a", "id % 2 as g_x", "1 - id % 2 as g_y")
    grid = A.scenario_grid(["a", "g_x"], ["a"])
    out = A.ampute_scenarios(df, 0.3, grid, "id", ["a", "g_x", "g_y"], groups={"g": ["g_x", "g_y"]})
    shares = out.groupBy("scenario").agg(
        F.avg(F.expr("cast(a IS NULL AND g_x IS NULL AND g_y IS NULL as double)")).alias("all"),
        F.avg(F.expr("cast(a IS NULL OR g_x IS NULL OR g_y IS NULL as double)")).alias("any"),
    ).collect()
    assert len(shares) == 10 and all(r["all"] == r["any"] and abs(r["all"] - 0.3) < 0.04 for r in shares)
    one = A.ampute(df, 0.3, [grid[3]], "id", ["a", "g_x", "g_y"], 30_000, {"g": ["g_x", "g_y"]})
    assert out.filter("scenario = 3").drop("scenario").exceptAll(one).count() == 0
    odd = spark.createDataFrame([(None, 1.0, 2.0), (1, None, 2.0)], "id long, a double, b double")
    pattern = {"incomplete_vars": ["a"], "mechanism": "MNAR"}
    kept = A.ampute(odd, 0.5, [pattern], "id", ["a", "b"])
    assert kept.filter("id IS NULL AND a = 1.0").count() == 1 and kept.count() == 2
    assert A.ampute(odd.limit(0), 0.5, [pattern], "id", ["a", "b"]).count() == 0


def test_swap_noise(spark):
    df = spark.createDataFrame([(i, float(i), None if i % 5 == 0 else i * 10) for i in range(400)] + [(None, -1.0, -1)], "id long, a double, b long")
    out = {r.id: r for r in AE.swap_noise(df, ["a", "b"], 0.3).collect()}
    assert len(out) == 401 and out[None].a == -1.0 and out[None].b == -1
    changed = sum(out[i].a != i for i in range(400))
    assert 80 < changed < 160 and all(out[i].a in range(-1, 400) for i in range(400))
    assert out == {r.id: r for r in AE.swap_noise(df.repartition(7), ["a", "b"], 0.3).collect()}
    assert AE.swap_noise(df.limit(0), ["a", "b"], 0.3).count() == 0


def test_tune_without_positives(spark):
    rows = [(i, float(i % 7), i % 2 if i % 3 else 0, "val" if i % 3 == 0 else "train") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, label int, split string")
    best, scored = PR.tune(df, ["x"], "lr", [{"regParam": 0.1}, {"regParam": 1.0}])
    assert best == {"regParam": 0.1} and scored.count() == 60


def test_student_expansion(spark):
    got = spark.range(1000, 1003).select(ST._quantile_expansion(0.975, F.col("id"))).collect()
    assert [r[0] for r in got] == pytest.approx([ST.student_quantile(0.975, n) for n in range(1000, 1003)], abs=1e-9)


def test_autoencoder_gradient():
    rng = np.random.default_rng(0)
    for variational in (False, True):
        net = AE.Network([4, 3, 4], "tanh", variational)
        lay = AE.Layout([0], [1], [[2, 3]], "CEMSE")
        w, x = net.initial(0), rng.random((5, 4))
        t, s = rng.integers(0, 2, (5, 4)).astype(float), np.ones((5, 4))

        def loss(v):
            out, back, kl = net.run(v, x, np.random.default_rng(1))
            value, grad = AE.loss_and_gradient(out, t, s, lay)
            return value + AE.KL_WEIGHT * kl, back(grad)

        _, g = loss(w)
        for i in range(0, len(w), 3):
            e = np.zeros_like(w)
            e[i] = 1e-6
            assert (loss(w + e)[0] - loss(w - e)[0]) / 2e-6 == pytest.approx(g[i], abs=1e-5)
    assert AE.layer_sizes(6, [0.6, 0.1, 0.05])[1:4] == [4, 1, 1]


def test_autoencoder_epochs_read_packed_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    odd = np.column_stack([rng.random(700), rng.integers(0, 2, 700), np.where(rng.random(700) < 0.5, np.nan, 0.2)])
    assert np.array_equal(AE._unpack(AE._pack(odd), 1)[0], odd, equal_nan=True)
    cells = rng.random((300, 2))
    splits = ["train", "val", "test", None]
    rows = [(i, splits[i % 4], float(a), None if i % 8 == 0 else float(b)) for i, (a, b) in enumerate(cells)]
    df = spark.createDataFrame(rows, "id long, split string, a double, b double").coalesce(1)
    schema = FeatureSchema(ids=("id",), continuous=("a", "b"), split="split", order=("a", "b"))
    monkeypatch.setattr(AE, "BLOCK_BYTES", 8 * 6 * 20)
    model = AE.AutoencoderImputer(schema, hidden_layers=[2], batch_size=16, max_epochs=2)
    table = model._training_table(df, None)
    blocks = table.collect()
    assert len(blocks) > 2  # a batch of many bytes is several blocks
    for val, split in ((True, "val"), (False, "train")):
        x, t, s = np.concatenate([AE._unpack(r.cells, 3) for r in blocks if r.val is val], axis=1)
        want = {(a, b or 0.0, 1.0, float(b is not None)) for _, w, a, b in rows if w == split}
        assert {(*r, *f) for r, f in zip(x.tolist(), s.tolist())} == want and np.array_equal(x, t)
    flat = model._net.initial(0)
    out, _, _ = model._net.run(flat, np.concatenate([AE._unpack(r.cells, 3) for r in blocks if r.val], axis=1)[0])
    t, s = np.concatenate([AE._unpack(r.cells, 3)[1:] for r in blocks if r.val], axis=1)
    new, loss = model._epoch(table, flat, 0)
    assert loss == pytest.approx(AE.loss_and_gradient(out, t, s, model._layout)[0]) and not np.array_equal(new, flat)
    none = model._training_table(df.filter("split = 'test'"), None)
    assert none.count() == 0 and model._epoch(none, flat, 0) == (None, math.inf)


def test_autoencoder_learns_and_reloads(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.random(600)
    split = np.where(rng.random(600) < 0.7, "train", "val")
    table = [(i, str(s), float(b), None if rng.random() < 0.2 else float(1 - b), int(b > 0.5)) for i, (b, s) in enumerate(zip(base, split))]
    df = spark.createDataFrame(table, "id bigint, split string, a double, b double, c int")
    schema = FeatureSchema(ids=("id",), continuous=("a", "b"), binary=("c",), split="split", order=("a", "b", "c"))
    model = AE.AutoencoderImputer(schema, hidden_layers=[4], activation="tanh", replace_nan_with="simple", max_epochs=15, batch_size=32).fit(df)
    assert model.history[-1] < model.history[0]
    out = {r.id: r for r in model.transform(df).collect()}
    assert all(out[i].a == a and out[i].c == c and (b is None or out[i].b == b) for i, _, a, b, c in table)
    assert all(r.b is not None for r in out.values())
    model.save(spark, str(tmp_path / "model"))
    again = AE.AutoencoderImputer.load(spark, str(tmp_path / "model"))
    assert {r.id: r.b for r in again.transform(df).collect()} == {i: r.b for i, r in out.items()}


def test_flat_to_long_and_padding(spark):
    df = spark.createDataFrame([(1, 1.0, None, 3.0, 9)], "id int, x_entry_mean double, x_year1_mean double, y_year1_max double, z int")
    long = RS.flat_to_long(df, "id", r"(?P<lab>[a-z]+)_(?P<time>entry|year\d+)_(?P<stat>mean|max)")
    assert rows(long, "time") == [(1, "entry", 1.0, None), (1, "year1", None, 3.0)]
    panel = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0), (2, 5, 4.0)], "id int, t int, x double")
    padded = RS.pad_sequences(panel, "id", "t", ["x"])
    got = {(r.id, r.step): (r.x, r.seq_len) for r in padded.collect()}
    assert got[0, 1] == (None, 3) and got[2, 0] == (4.0, 1) and got[2, 2] == (-1.0, 1) and len(got) == 6


def test_cleaning(spark):
    assert C.time_window_columns(["a_entry_period_x", "a_year1_x", "a_year10_x", "b"], 1, 2) == ["a_year1_x", "b"]
    df = spark.createDataFrame([(1.0, True), (float("nan"), False)], "`a,b` double, flag boolean")
    assert C.clean_names(df).columns == ["ab", "flag"]
    odd = spark.createDataFrame([(1, 2)], "`a&b+c` int, `x (mg), % 'raw'` int")
    assert C.clean_names(odd).columns == ["aandbplusc", "x __mg__ _PRCNT raw"]
    out = C.bools_to_int(C.nan_to_null(C.clean_names(df))).collect()
    assert [tuple(r) for r in out] == [(1.0, 1), (None, 0)]
    with pytest.raises(KeyError):
        C.drop_listed(df, ["nope"])
    same = C.filter_subgroup(df, None)
    assert same is df
    flags = spark.createDataFrame([("yes",), ("F",), ("1",), ("?",)], "s string").select(C.parse_bool(F.col("s")).alias("b"))
    assert [r.b for r in flags.collect()] == [True, False, True, None]


def test_results(spark):
    df = spark.createDataFrame([(1, "a", 0, None), (1, "a", 1, 2.0), (1, "a", 2, 1.0), (None, "b", 0, 5.0), (None, "b", 1, 7.0)], "run int, m string, step int, val double")
    first = {r.run: r.val for r in RE.first_last_per_group(df, ["run"], "val", ["step"]).collect()}
    assert first == {1: 2.0, None: 5.0}
    assert RE.duplicates(df, ["run", "m"]).count() == 5
    best = RE.best_per_group(df.select("m", "val", "step"), ["m"], "val", "step").collect()
    assert {r.m: r.val for r in best} == {"a": 1.0, "b": 5.0}


def test_schema_json_and_mapping():
    assert FeatureSchema.from_json(SCHEMA.to_json()) == SCHEMA
    assert SCHEMA.after_combine().features == ["age", "weight", "ismale", "fries"]
    assert set(SCHEMA.after_target_encode().continuous) == {"age", "weight", "ismale", "fries"}
    mapped = SCHEMA.after_discretize({"age": ["age_0 - 1"]})
    assert mapped.features[-1] == "age_0 - 1" and mapped.continuous == ("weight",)
    typed = FeatureSchema.infer(["id", "bp", "bp2", "r_a", "r_b", "y"], ["id"], ["bp"], ["r", "q"], "y")
    assert typed.binary == ("bp2",) and typed.onehot == {"r": ("r_a", "r_b")}


def test_weights_of_many_classes(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 174 = 0 THEN NULL ELSE id % 174 END AS label")
    got = PR.balanced_weights(df, "label").groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert len(got) == 174 and all(abs(r.w - 3000 / 174) < 1e-6 for r in got)


def test_rows_without_entity_stay(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), (1, 4.0), (1, None), (2, None)], "id int, x double")
    got = sorted((r.id or 0, r.x) for r in I.fill_entity_mean(df, "id", ["x"]).collect())
    assert got == [(0, 1.0), (0, 1.0), (1, 4.0), (1, 4.0), (2, 2.5)]


def test_neighbours_of_negative_zero(spark):
    donors = spark.createDataFrame([(1, 0.0, 7.0), (2, 9.0, 70.0)], "id int, a double, b double")
    df = spark.createDataFrame([(3, 0.0, None), (4, -0.0, None), (5, 1.0, 2.0)], "id int, a double, b double")
    got = {r.id: r.b for r in KN.knn_impute(df, ["a", "b"], "id", donors, k=1).collect()}
    assert got == {3: 7.0, 4: 7.0, 5: 2.0}


def test_knn_compares_few_pairs_and_takes_empty_tables(spark):
    rng = np.random.default_rng(5)
    v = rng.random((3000, 2))
    v[::3, 0] = np.nan
    rows = [(i, None if np.isnan(a) else float(a), float(b)) for i, (a, b) in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    assert KN.compared_pairs(df, ["a", "b"], df, 3).first().share < 0.2
    filled = [KN.knn_impute(df, ["a", "b"], "id", df, 3, direct=way) for way in (True, False)]
    assert filled[0].exceptAll(filled[1]).isEmpty()
    none = df.limit(0)
    assert KN.knn_impute(none, ["a", "b"], "id", df, 3).count() == 0
    assert KN.knn_impute(df, ["a", "b"], "id", none, 3).filter("a IS NULL").count() == 1000


def test_knn_refuses_donors_that_no_task_should_hold(spark, monkeypatch):
    monkeypatch.setattr(KN, "DIRECT_BYTES", 100)
    df = spark.range(50).selectExpr("id", "IF(id % 2 = 0, NULL, id * 1.0D) AS a", "id * 2.0D AS b")
    with pytest.raises(ValueError):
        KN.knn_impute(df, ["a", "b"], "id", df, direct=True)
    assert KN.knn_impute(df, ["a", "b"], "id", df).filter("a IS NULL").isEmpty()


@pytest.mark.parametrize("n", [3, 10])
def test_knn_compares_in_parts(spark, monkeypatch, n):
    """Donors beyond one broadcast are compared part by part, with the neighbours of a brute force; ties included."""
    monkeypatch.setattr(KN, "DIRECT_BYTES", 20_000)
    monkeypatch.setattr(KN, "TILE_ROWS", 32)
    rng = np.random.default_rng(n)
    v = rng.integers(0, 12, (900, n)).astype(float)
    v[rng.random(v.shape) < 0.15] = np.nan
    names = [f"c{i}" for i in range(n)]
    rows = [(i, *[None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names))
    found = KN._found(*KN._vectors(df, names, df), names, 3, KN.CHUNK, None)
    assert "CoGroups" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r for r in KN.knn_impute(df, names, "id", df, 3).collect()}
    for i, q in enumerate(v):
        common = (~np.isnan(q) & ~np.isnan(v)).sum(axis=1)
        dist = np.where(common > 0, np.nansum((q - v) ** 2, axis=1) * n / np.maximum(common, 1), np.inf)
        for f in np.flatnonzero(np.isnan(q)):
            have = np.flatnonzero(~np.isnan(v[:, f]) & (common > 0))
            near = have[np.lexsort((v[have, f], dist[have]))][:3]
            if len(near):
                assert got[i][f"c{f}"] == pytest.approx(v[near, f].mean())


@pytest.mark.parametrize("kind", ["spread", "ties", "rare"])
def test_knn_meets_in_slabs(spark, monkeypatch, kind):
    """Beyond one broadcast a task holds a slab of the donors; fills are those of a brute force, ties and copies included."""
    monkeypatch.setattr(KN, "DIRECT_BYTES", 12_000)
    monkeypatch.setattr(KN, "SLAB_ROWS", 60)
    monkeypatch.setattr(KN, "SLAB_VISITS", 50)
    monkeypatch.setattr(KN, "TILE_ROWS", 16)
    monkeypatch.setattr(KN, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(4)
    v = rng.random((1200, 3))
    if kind == "ties":
        v = np.column_stack([rng.integers(0, 12, 1200), rng.integers(-40, 40, 1200), np.round(v[:, 2], 1)]).astype(float)
    gone = rng.random(v.shape) < 0.25
    if kind == "rare":  # one column is observed in few donors of one corner
        gone[:, 2] |= v[:, 0] > 0.04
    v[gone] = np.nan
    v[900:930] = v[899]
    rows = [(i, *[None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    donors, names = df.filter("id < 1000"), ["a", "b", "c"]
    used, slabs = [], KN._by_slabs
    monkeypatch.setattr(KN, "_by_slabs", lambda *a: used.append(slabs(*a)) or used[-1])
    choices = [(4, "uniform"), (2, "uniform"), (4, "distance")]
    got = {(r.id, r.n): r for r in KN.knn_impute_all(df, names, donors, choices, "n").collect()}
    assert used[0] is not None and len(got) == 3 * 1200
    base = v[:1000]
    for i, q in enumerate(v):
        common = (~np.isnan(q) & ~np.isnan(base)).sum(axis=1)
        dist = np.where(common > 0, np.nansum((q - base) ** 2, axis=1) * 3 / np.maximum(common, 1), np.inf)
        for f in np.flatnonzero(np.isnan(q)):
            have = np.flatnonzero(~np.isnan(base[:, f]) & (common > 0))
            near = have[np.lexsort((base[have, f], dist[have]))][:4]
            value, d = base[near, f], dist[near]
            if not len(near):
                want = [np.nanmean(base[:, f])] * 3
            else:
                weights = (d == 0).astype(float) if d[0] == 0 else 1 / np.sqrt(d)
                want = [value.mean(), value[:2].mean(), np.average(value, weights=weights)]
            assert [got[i, n][names[f]] for n in range(3)] == pytest.approx(want)


@pytest.mark.parametrize("window", [0, 1 << 20])
def test_knn_finds_single_shared_columns_by_bisection(spark, monkeypatch, window):
    """Few pairs are compared where one column is shared, ties go to the smaller value, and tiles give the same."""
    monkeypatch.setattr(KN, "WINDOW_PAIRS", window)
    rng = np.random.default_rng(8)
    y = np.round(rng.random(20_000), 3)
    value = rng.permutation(20_000).astype(float)
    q = np.round(rng.random(100), 3)
    q[:2] = -5.0, 7.0

    class Held:
        value = None

    Held.value = [(np.array([True, True]), np.column_stack([y, value]), np.ones(len(y), np.int64))]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(100)), pa.array(q), pa.array(np.full(100, np.nan))], names=["qid", "a", "b"])
    compared = []
    unique = np.unique
    monkeypatch.setattr(KN.np, "unique", lambda *a, **k: compared.append(1) or unique(*a, **k))
    rows = pa.Table.from_batches(KN._nearest_of_all(["a", "b"], 3, Held, KN.CHUNK)(iter([batch]))).to_pandas()
    assert (len(compared) <= 3) == (window > 0)
    for i, x in enumerate(q):
        dist = (y - x) ** 2 * 2
        best = np.lexsort((value, dist))[:3]
        mine = rows[rows.qid == i]
        assert mine.v.tolist() == value[best].tolist() and np.allclose(mine.d2, dist[best])


def test_prepare_keeps_the_truth_and_fits_on_train_only(spark):
    from lacuna.operators.prepare import Step, prepare

    schema = FeatureSchema(ids=("id",), continuous=("a",), onehot={"g": ("g_x", "g_y")}, label="y", split="split", order=("a", "g_x", "g_y"))
    rows = [(i, float(i), i % 2, 1 - i % 2, i % 2) for i in range(200)] + [(200, None, 1, 0, 1), (201, 5.0, None, 1, 0)]
    df = spark.createDataFrame(rows, "id long, a double, g_x int, g_y int, y int")
    split = lambda d: d.withColumn("split", F.when(F.col("id") < 100, "train").otherwise("val"))
    pattern = {"incomplete_vars": ["g_x"], "mechanism": "MCAR"}
    made = prepare(df, schema, "id", split, [Step(lambda d: X.MinMaxScaler.fit(d, ["a"]))], [pattern], 0.5, True, True)
    data, truth = (made.view("original", r).orderBy("id").collect() for r in ("data", "ground_truth"))
    assert [r.split for r in data[-2:]] == ["test", "test"] and data[-1].g_y is None
    assert abs(data[150].a - 150 / 99) < 1e-12
    assert all((r.g_x is None) == (r.g_y is None) for r in data)
    assert 50 < sum(r.g_x is None for r in data[:200]) < 150
    assert all(r.g_x is not None for r in truth[:200])
    assert prepare(df.limit(0), schema, "id", split).view("mapped", "data").count() == 0
