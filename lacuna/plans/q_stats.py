"""Profiles, intervals, classification scores, result tables and their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import invariants as V
from lacuna.operators import results as R
from lacuna.operators import splits as SP
from lacuna.operators import quantiles as Q
from lacuna.operators import stats as ST
from lacuna.plans import sql as S
from lacuna.plans import tables as T
from lacuna.plans.registry import query

CTN = T.CONTINUOUS


@query(
    f"WITH {S.MIXED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share, "
        f"min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean FROM mixed"
        for c in CTN
    )
)
def column_profile(spark, d):
    out = ST.column_profile(T.mixed(spark, d), CTN)
    return out.withColumns({"missing_share": F.round("missing_share", 6), "mean": F.round("mean", 4)})


_MODES = ["priority", "segment", "recent", "day"]


@query(
    f"WITH {S.MIXED} "
    + " UNION ALL ".join(
        f"(SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS mode FROM mixed WHERE {c} IS NOT NULL "
        f"GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)"
        for c in _MODES
    )
)
def column_mode(spark, d):
    return ST.column_mode(T.mixed(spark, d), _MODES)


@query("SELECT count(DISTINCT user_id) AS entities FROM events")
def entity_count(spark, d):
    return T.read(spark, d, "events").agg(F.countDistinct("user_id").alias("entities"))


_LOGKEYS = ["run_id", "split", "metric_name", "reduction"]
_LK = ", ".join(_LOGKEYS)
_ORD = "step, feature_space, filter_subgroup, feature_type"


@query(f"WITH {S.LOG} SELECT {_LK}, arg_min(val, ({_ORD})) AS val FROM metric_log GROUP BY {_LK}")
def first_per_group(spark, d):
    return R.first_last_per_group(T.metric_log(spark, d), _LOGKEYS, "val", _ORD.split(", "))


@query(f"WITH {S.LOG} SELECT {_LK}, arg_max(val, ({_ORD})) AS val FROM metric_log GROUP BY {_LK}")
def last_per_group(spark, d):
    return R.first_last_per_group(T.metric_log(spark, d), _LOGKEYS, "val", _ORD.split(", "), last=True)


_CIK = ["method", "mechanism", "split", "metric_name"]
_CI = f"""WITH {S.LOG} SELECT {', '.join(_CIK)}, round(avg(val), 6) AS mean,
  round(stddev_samp(val) / sqrt(count(val)), 6) AS sem, max(step) AS max_step,
  round(avg(val) - 1.96 * stddev_samp(val) / sqrt(count(val)), 6) AS lower,
  round(avg(val) + 1.96 * stddev_samp(val) / sqrt(count(val)), 6) AS upper FROM metric_log GROUP BY {', '.join(_CIK)}"""


def _ci(spark, d):
    out = R.ci_by_group(T.metric_log(spark, d), _CIK)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sem", "lower", "upper")})


@query(_CI)
def ci_by_group(spark, d):
    return _ci(spark, d)


@query(_CI + " HAVING max(step) = 7")
def ci_full_bootstrap(spark, d):
    return R.full_bootstrap_only(_ci(spark, d), 7)


_TEST_RMSE = "split = 'test' AND metric_name = 'RMSE' AND reduction = 'CW' AND feature_type = 'mixed' AND filter_subgroup = 'missingonly'"


@query(
    f"""WITH {S.LOG} SELECT mechanism, percent_missing, val, run_id, method, feature_map FROM (
    SELECT *, row_number() OVER (PARTITION BY mechanism, percent_missing ORDER BY val, run_id) AS rn
    FROM metric_log WHERE method NOT IN ('simple', 'knn') AND {_TEST_RMSE}) WHERE rn = 1"""
)
def best_per_group(spark, d):
    kept = T.metric_log(spark, d).filter(~F.col("method").isin("simple", "knn")).filter(_TEST_RMSE)
    kept = kept.select("mechanism", "percent_missing", "val", "run_id", "method", "feature_map")
    return R.best_per_group(kept, ["mechanism", "percent_missing"], "val", "run_id")


@query(
    f"""WITH {S.LOG} SELECT run_id, method, round(val, 6) AS val FROM (SELECT run_id, method, avg(val) AS val
    FROM metric_log WHERE {_TEST_RMSE.replace("'test'", "'train'")} GROUP BY 1, 2) ORDER BY val, run_id LIMIT 1"""
)
def best_candidate(spark, d):
    """The candidate with the lowest mean tuning metric."""
    kept = T.metric_log(spark, d).filter(_TEST_RMSE.replace("'test'", "'train'"))
    means = kept.groupBy("run_id", "method").agg(F.round(F.avg("val"), 6).alias("val"))
    return R.best_per_group(means, [], "val", "run_id").select("run_id", "method", "val")


@query(
    f"""WITH {S.LOG} SELECT method, split, count(*) AS n,
    string_agg(DISTINCT metric_name, ',' ORDER BY metric_name) AS items FROM metric_log GROUP BY 1, 2"""
)
def group_sizes(spark, d):
    return R.group_sizes(T.metric_log(spark, d), ["method", "split"], "metric_name")


@query(
    f"""WITH {S.RUNS} SELECT run_id, method, mechanism, feature_map FROM (SELECT *, count(*) OVER (
    PARTITION BY method, mechanism, feature_map) AS n FROM runs) WHERE n > 1"""
)
def duplicate_rows(spark, d):
    runs = T.runs(spark, d).select("run_id", "method", "mechanism", "feature_map")
    return R.duplicates(runs, ["method", "mechanism", "feature_map"])


def _rmse_by_method(spark, d):
    return T.metric_log(spark, d).filter("metric_name = 'RMSE'")


_CELLS = "SELECT * FROM metric_log WHERE metric_name = 'RMSE'"


@query(
    f"""WITH {S.LOG} SELECT method, split, round(quantile_cont(val, 0.025), 6) AS lower,
    round(quantile_cont(val, 0.975), 6) AS upper FROM ({_CELLS}) GROUP BY 1, 2"""
)
def percentile_ci(spark, d):
    out = ST.percentile_ci(_rmse_by_method(spark, d), ["method", "split"])
    return out.withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


# Student's t for whole degrees of freedom as finite sums of powers of a cosine; inverted by bisection.
_T_AREA = """CASE WHEN nu % 2 = 1 THEN 2 / pi() * (theta + sin(theta) * list_sum(list_transform(range(0, (nu - 1) // 2),
    lambda k: exp(lgamma(k + 1) + lgamma(1.5::DOUBLE) - lgamma(k + 1.5::DOUBLE)) * pow(cos(theta), 2 * k + 1))))
  ELSE sin(theta) * list_sum(list_transform(range(0, nu // 2),
    lambda k: exp(lgamma(k + 0.5::DOUBLE) - lgamma(0.5::DOUBLE) - lgamma(k + 1)) * pow(cos(theta), 2 * k))) END"""


@query(
    f"""WITH RECURSIVE {S.LOG}, g AS (SELECT method, mechanism, split, avg(val) AS mean, stddev_samp(val) AS sd, count(*) AS n
      FROM ({_CELLS}) GROUP BY 1, 2, 3),
    q AS (SELECT DISTINCT (n - 1)::BIGINT AS nu, 0 AS step, 0::DOUBLE AS lo, 50::DOUBLE AS hi FROM g WHERE n > 3 UNION ALL
      SELECT nu, step + 1, CASE WHEN area < 0.95 THEN mid ELSE lo END, CASE WHEN area < 0.95 THEN hi ELSE mid END
      FROM (SELECT *, {_T_AREA} AS area FROM (SELECT *, (lo + hi) / 2 AS mid, atan((lo + hi) / 2 / sqrt(nu)) AS theta FROM q))
      WHERE step < 60)
    SELECT method, mechanism, split, round(mean, 6) AS mean, round(sd / sqrt(n) * (lo + hi) / 2, 6) AS half_width
    FROM g LEFT JOIN q ON nu = n - 1 AND step = 60"""
)
def t_ci(spark, d):
    out = ST.t_ci(_rmse_by_method(spark, d), ["method", "mechanism", "split"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "half_width")})


def _moments(keys: str) -> str:
    """Mean and central moments per group, from deviations."""
    return f"""c AS (SELECT *, val - avg(val) OVER (PARTITION BY {keys}) AS dv FROM ({_CELLS})),
    m AS (SELECT {keys}, count(*) AS n, avg(val) AS mean, avg(pow(dv, 2)) AS m2, avg(pow(dv, 3)) AS m3,
      avg(pow(dv, 4)) AS m4, quantile_cont(val, 0.025) AS lo, quantile_cont(val, 0.975) AS hi FROM c GROUP BY {keys}),
    jb AS (SELECT *, n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / pow(m2, 2) - 3, 2) / 4) AS jb FROM m)"""


@query(
    f"""WITH {S.LOG}, {_moments('method, split')} SELECT method, split, round(jb, 4) AS statistic,
    round(exp(-jb / 2), 6) AS p, exp(-jb / 2) > 0.05 AS isnormal FROM jb"""
)
def jarque_bera(spark, d):
    out = ST.jarque_bera(_rmse_by_method(spark, d), ["method", "split"])
    return out.withColumns({"statistic": F.round("statistic", 4), "p": F.round("p", 6)})


# The normal distribution function as a power series; the terms of one value by their logarithms.
_NORMAL = """0.5::DOUBLE + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 140),
    lambda k: exp((2 * k + 1) * ln(abs(z)) - (k + 1) * ln(2::DOUBLE) - lgamma(k + 1.5::DOUBLE) + ln(pi()) / 2)))"""


@query(
    f"""WITH {S.LOG}, cells AS ({_CELLS}),
    s AS (SELECT method, split, count(val) AS n, avg(val) AS mean, stddev_samp(val) AS sd, min(val) < max(val) AS varies FROM cells GROUP BY 1, 2),
    z AS (SELECT *, (val - mean) / sd AS z, rank() OVER (PARTITION BY method, split ORDER BY val) AS below,
      count(*) OVER (PARTITION BY method, split ORDER BY val) AS upto FROM cells JOIN s USING (method, split) WHERE varies),
    f AS (SELECT *, CASE WHEN z > 8 THEN 1 WHEN z < -8 THEN 0 WHEN z = 0 THEN 0.5 ELSE {_NORMAL} END AS cdf FROM z),
    d AS (SELECT method, split, max(greatest(upto / n - cdf, cdf - (below - 1) / n)) AS d FROM f GROUP BY 1, 2),
    p AS (SELECT method, split, n, d, CASE WHEN sqrt(n) * d < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101),
      lambda k: pow(-1, k - 1) * exp(-2.0::DOUBLE * k * k * n * d * d))))) END AS p FROM s LEFT JOIN d USING (method, split))
    SELECT method, split, n, round(d, 6) AS statistic, round(p, 5) AS p, coalesce(p > 0.05, false) AS isnormal FROM p"""
)
def ks_normal(spark, d):
    """Distance of each method's errors to the normal distribution, next to ``jarque_bera``."""
    out = Q.ks_normal(_rmse_by_method(spark, d), ["method", "split"])
    return out.withColumns({"statistic": F.round("statistic", 6), "p": F.round("p", 5)})


@query(
    f"""WITH {S.LOG}, {_moments('method, split')}
    SELECT method, split, 'mean' AS aggregate_type, round(mean, 6) AS val FROM jb
    UNION ALL SELECT method, split, 'isnormal', CASE WHEN exp(-jb / 2) > 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE FROM jb
    UNION ALL SELECT method, split, 'lowerci', round(lo, 6) FROM jb
    UNION ALL SELECT method, split, 'upperci', round(hi, 6) FROM jb"""
)
def predict_rollup(spark, d):
    out = ST.rollup_rows(_rmse_by_method(spark, d), ["method", "split"])
    return out.withColumn("val", F.round("val", 6))


def scored(spark, d):
    """Label with a score in [0, 1] on a grid of a thousandth, so that scores tie."""
    df = T.mixed_truth(spark, d)
    p = F.floor(F.col("totalprice") / (F.col("totalprice") + 250000) * 1000) / 1000
    return df.select("id", "split", "label", p.alias("prob"), (p >= 0.5).cast("int").alias("pred"))


SCORED = f"""{S.TRUTH}, scored AS (SELECT id, split, label, p AS prob, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred
  FROM (SELECT *, floor(totalprice / (totalprice + 250000) * 1000) / 1000 AS p FROM mixed_truth))"""
_COUNTS = """sum(CASE WHEN label = 1 AND pred = 1 THEN {w} ELSE 0 END)::BIGINT AS tp,
  sum(CASE WHEN label = 0 AND pred = 0 THEN {w} ELSE 0 END)::BIGINT AS tn,
  sum(CASE WHEN label = 0 AND pred = 1 THEN {w} ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN label = 1 AND pred = 0 THEN {w} ELSE 0 END)::BIGINT AS fn"""
_PRF = """round(tp / (tp + fp), 6) AS precision_score, round(tp / (tp + fn), 6) AS recall_score,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1_score"""
_TEN = ["TP", "TN", "FP", "FN", "precision_score", "recall_score", "f1_score", "brier_score", "roc_auc", "average_precision"]


@query(
    f"""WITH {SCORED}, c AS (SELECT split, {_COUNTS.format(w=1)} FROM scored GROUP BY split)
    SELECT split, tp AS "TP", tn AS "TN", fp AS "FP", fn AS "FN", {_PRF} FROM c"""
)
def confusion_metrics(spark, d):
    out = ST.confusion_metrics(scored(spark, d), by=["split"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision_score", "recall_score", "f1_score")})


@query(f"WITH {SCORED} SELECT split, round(avg(pow(prob - label, 2)), 6) AS brier_score FROM scored GROUP BY split")
def brier(spark, d):
    return ST.brier(scored(spark, d), by=["split"]).withColumn("brier_score", F.round("brier_score", 6))


_RANKS = """r AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY prob) + (count(*) OVER (PARTITION BY {k}, prob) - 1) / 2.0 AS mid
  FROM scored)"""


@query(
    f"""WITH {SCORED}, {_RANKS.format(k='split')}, s AS (SELECT split, sum(mid) FILTER (WHERE label = 1) AS rs,
    count(*) FILTER (WHERE label = 1) AS np, count(*) FILTER (WHERE label = 0) AS nn FROM r GROUP BY split)
    SELECT split, round((rs - np * (np + 1) / 2.0) / (np::DOUBLE * nn), 6) AS roc_auc FROM s"""
)
def roc_auc(spark, d):
    return ST.roc_auc(scored(spark, d), by=["split"]).withColumn("roc_auc", F.round("roc_auc", 6))


@query(
    f"""WITH {SCORED}, g AS (SELECT split, prob, sum(label) AS pos, count(*) AS n FROM scored GROUP BY 1, 2),
    c AS (SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY prob DESC) AS tp,
      sum(n) OVER (PARTITION BY split ORDER BY prob DESC) AS seen FROM g)
    SELECT split, round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM c GROUP BY split"""
)
def average_precision(spark, d):
    out = ST.average_precision(scored(spark, d), by=["split"])
    return out.withColumn("average_precision", F.round("average_precision", 6))


@query(
    f"""WITH {SCORED}, numbered AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS row_no FROM scored),
    b AS (SELECT replicate, l, n, salt, i FROM (SELECT r AS replicate, l, n, {S.h('r + l * 1000000')} AS salt
        FROM range(0, 99) t(r), (SELECT label AS l, count(*) AS n FROM scored GROUP BY 1)),
        (SELECT unnest(range(0, (SELECT count(*) FROM scored))) AS i) WHERE i < n),
    d AS (SELECT replicate, l, j FROM {S.drawn_rows('b')}),
    s AS (SELECT replicate, label, prob, pred FROM numbered JOIN d ON label = l AND row_no = j),
    c AS (SELECT replicate, {_COUNTS.format(w=1)}, avg(pow(prob - label, 2)) AS br FROM s GROUP BY 1),
    g AS (SELECT replicate, prob, sum(label) AS pos, count(*) - sum(label) AS neg FROM s GROUP BY 1, 2),
    u AS (SELECT *, sum(pos) OVER w AS up, sum(neg) OVER w AS un FROM g WINDOW w AS (PARTITION BY replicate ORDER BY prob DESC)),
    a AS (SELECT replicate, sum(pos * up / (up + un)) / sum(pos) AS ap,
      1 - sum(pos * (un - neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM u GROUP BY 1),
    w AS (SELECT CAST(replicate AS INTEGER) AS replicate, tp AS "TP", tn AS "TN", fp AS "FP", fn AS "FN", {_PRF}, br AS brier_score,
      auc AS roc_auc, ap AS average_precision FROM c JOIN a USING (replicate))
    """ + " UNION ALL ".join(f"""SELECT replicate, '{m}' AS metric_name, round("{m}"::DOUBLE, 6) AS val FROM w""" for m in _TEN)
)
def bootstrap_predict(spark, d):
    """All ten scores of 99 replicates, drawn within each label."""
    drawn = SP.bootstrap_groups(scored(spark, d).select("id", "label", "prob", "pred"), "id", ["prob", "pred"], 99, label="label")
    out = ST.classification_report(drawn, by=["replicate"], weight="times")
    return out.withColumn("val", F.round("val", 6))



@query(
    f"""WITH {SCORED}, c AS (SELECT split, {_COUNTS.format(w=1)}, avg(pow(prob - label, 2)) AS br FROM scored GROUP BY split),
    {_RANKS.format(k='split')}, s AS (SELECT split, sum(mid) FILTER (WHERE label = 1) AS rs,
      count(*) FILTER (WHERE label = 1) AS np, count(*) FILTER (WHERE label = 0) AS nn FROM r GROUP BY split),
    g AS (SELECT split, prob, sum(label) AS pos, count(*) AS n FROM scored GROUP BY 1, 2),
    u AS (SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY prob DESC) AS up,
      sum(n) OVER (PARTITION BY split ORDER BY prob DESC) AS seen FROM g),
    ap AS (SELECT split, sum(pos * up / seen) / sum(pos) AS ap FROM u GROUP BY split),
    w AS (SELECT split, tp AS "TP", tn AS "TN", fp AS "FP", fn AS "FN", {_PRF}, br AS brier_score,
      (rs - np * (np + 1) / 2.0) / (np::DOUBLE * nn) AS roc_auc, ap AS average_precision
      FROM c JOIN s USING (split) JOIN ap USING (split))
    """ + " UNION ALL ".join(f"""SELECT split, '{m}' AS metric_name, round("{m}"::DOUBLE, 6) AS val FROM w""" for m in _TEN)
)
def classification_report(spark, d):
    out = ST.classification_report(scored(spark, d), by=["split"])
    return out.withColumn("val", F.round("val", 6))


_RUN = "run_id, split, step"
_SLOT = "feature_space, reduction, feature_type, metric_name"


@query(
    f"""WITH {S.LOG} SELECT {_RUN}, {_SLOT}, max(val) FILTER (WHERE filter_subgroup = 'all') AS v_all,
    max(val) FILTER (WHERE filter_subgroup = 'missingonly') AS v_missing FROM metric_log GROUP BY {_RUN}, {_SLOT}
    HAVING NOT coalesce(max(val) FILTER (WHERE filter_subgroup = 'all') <
      max(val) FILTER (WHERE filter_subgroup = 'missingonly'), false)"""
)
def invariant_all_below_missing(spark, d):
    return V.all_below_missing_only(T.metric_log(spark, d))


@query(
    f"""WITH {S.LOG} SELECT {_RUN}, filter_subgroup, {_SLOT} FROM metric_log
    WHERE feature_type = 'mixed' AND val = 0"""
)
def invariant_no_zero_mixed(spark, d):
    return V.no_zero_mixed(T.metric_log(spark, d))


_K5 = f"{_RUN}, filter_subgroup, feature_space, reduction, feature_type"


@query(
    f"""WITH {S.LOG}, p AS (SELECT {_K5}, max(val) FILTER (WHERE metric_name = 'RMSE') AS rmse,
    max(val) FILTER (WHERE metric_name = 'MAAPE') AS maape FROM metric_log GROUP BY {_K5})
    SELECT * FROM p WHERE rmse = maape AND rmse <> 0"""
)
def invariant_rmse_maape(spark, d):
    return V.rmse_differs_from_maape(T.metric_log(spark, d))


_K4 = f"{_RUN}, filter_subgroup, feature_space, feature_type"


@query(
    f"""WITH {S.LOG}, p AS (SELECT {_K4}, max(val) FILTER (WHERE reduction = 'CW') AS cw,
    max(val) FILTER (WHERE reduction = 'EW') AS ew FROM metric_log WHERE metric_name = 'RMSE' GROUP BY {_K4})
    SELECT round(avg(CASE WHEN cw = ew THEN 1.0 ELSE 0.0 END), 6) AS share FROM p WHERE cw IS NOT NULL AND ew IS NOT NULL"""
)
def invariant_cw_ew_share(spark, d):
    return V.share_cw_equals_ew(T.metric_log(spark, d)).select(F.round("share", 6).alias("share"))


def _mapped_sql(feature_map: str, zero: str, equal: str) -> str:
    k = f"{_RUN}, filter_subgroup, reduction, metric_name"
    return f"""WITH {S.LOG}, p AS (SELECT {k}, max(val) FILTER (WHERE feature_type = '{zero}') AS v_zero,
    max(val) FILTER (WHERE feature_type = '{equal}') AS v_equal, max(val) FILTER (WHERE feature_type = 'mixed') AS v_mixed
    FROM metric_log WHERE feature_map = '{feature_map}' AND feature_space = 'mapped' GROUP BY {k})
    SELECT * FROM p WHERE coalesce(v_zero <> 0, false) OR coalesce(v_mixed <> v_equal, false)"""


@query(_mapped_sql("discretize_continuous", "continuous", "categorical"))
def invariant_discretized(spark, d):
    return V.discretized(T.metric_log(spark, d))


@query(_mapped_sql("target_encode_categorical", "categorical", "continuous"))
def invariant_target_encoded(spark, d):
    return V.target_encoded(T.metric_log(spark, d))


@query(
    f"""WITH {S.LOG}, n AS (SELECT run_id, split, count(*) AS n FROM metric_log GROUP BY 1, 2)
    SELECT run_id, split, n, (SELECT max(n) FROM n) AS most FROM n WHERE n <= 1 OR n <> (SELECT max(n) FROM n)"""
)
def invariant_log_counts(spark, d):
    return V.equal_log_counts(T.metric_log(spark, d), ["run_id", "split"])


@query(
    f"""WITH {S.LOG}, t AS (SELECT *, concat_ws('/', filter_subgroup, {_SLOT}) AS slot FROM metric_log),
    g AS (SELECT run_id, step, split, count(DISTINCT slot) AS n_metrics FROM t GROUP BY 1, 2, 3)
    SELECT *, (SELECT count(DISTINCT slot) FROM t) AS n_full FROM g WHERE n_metrics <> (SELECT count(DISTINCT slot) FROM t)"""
)
def invariant_metric_set(spark, d):
    return V.same_metric_set(T.metric_log(spark, d), ["run_id", "step", "split"])


@query(
    f"""WITH {S.MIXED}, keyed AS (
    {' UNION ALL '.join(f"SELECT id, {e} AS epoch, {S.h(S.key('id', 70 + e))} AS h FROM mixed WHERE split = 'train'" for e in range(3))}),
    placed AS (SELECT epoch, id, row_number() OVER (PARTITION BY epoch ORDER BY h, id) - 1 AS position FROM keyed)
    SELECT epoch, id, position, position // 128 AS batch FROM placed"""
)
def epoch_batches(spark, d):
    """The train rows in the order of three epochs, in batches of 128."""
    out = SP.epoch_batches(T.mixed(spark, d).select("id", "split"), "id", 3, 128, 70, "split")
    return out.select("epoch", "id", "position", "batch")
