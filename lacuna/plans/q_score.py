"""Imputation errors, the metric matrix, losses and bootstraps of them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lacuna.operators import impute_simple as I
from lacuna.operators import joins as J
from lacuna.operators import metrics as M
from lacuna.operators import splits as SP
from lacuna.operators import transforms as X
from lacuna.operators.user_metrics import UserMetric, score_user_metrics
from lacuna.plans import sql as S
from lacuna.plans import tables as T
from lacuna.plans.q_transform import BOUNDS, CTN, GROUPS, SCALED, imputed_sql, train
from lacuna.plans.registry import query

SCHEMA = T.MIXED_SCHEMA
CODED = T.CODED_SCHEMA
_IMP = f"""{S.BOTH_OH}, {SCALED}, {imputed_sql('soh', "AND split = 'train'")}"""


def scoring_frame(spark, d):
    """Scale and impute with statistics of the train rows; truth, prediction and mask in one row.

    Truth and data come from the same scan, so no join is needed to score.
    """
    pair = T.mixed_pair(spark, d)
    data = pair.select(*CODED.keys, "truth", "data.*")
    scaler, imputer = I.fit_scaler_and_imputer(train(data), CODED)
    mask = F.struct(*[F.col(c).isNull().alias(c) for c in CODED.features])
    truth = [
        scaler.scale(c, F.col(f"truth.{c}")).alias(c) if c in CTN else F.col(f"truth.{c}").alias(c)
        for c in CODED.features
    ]
    masked = data.withColumns({"missing": mask, "truth": F.struct(*truth)})
    filled = scaler.transform(imputer.transform(masked))
    return filled.select(*CODED.keys, "truth", "missing", F.struct(*CODED.features).alias("pred"))


def _terms_sql() -> str:
    cells = []
    for i, c in enumerate(CTN):
        cells.append(f"(t.{c} - p.{c}) * (t.{c} - p.{c}) AS se{i}")
        cells.append(f"atan(abs((t.{c} - p.{c}) / (t.{c} + 1e-10))) * 2 / pi() AS ae{i}")
        cells.append(f"CASE WHEN m.{c} IS NULL THEN 1 ELSE 0 END AS mc{i}")
    cells.append("CASE WHEN t.recent <> p.recent THEN 1 ELSE 0 END AS w0")
    cells.append("CASE WHEN m.recent IS NULL THEN 1 ELSE 0 END AS mw0")
    for i, cols in enumerate(GROUPS.values(), start=1):
        same = " OR ".join(f"(t.{c} = 1 AND p.{c} = 1)" for c in cols)
        cells.append(f"CASE WHEN {same} THEN 0 ELSE 1 END AS w{i}")
        cells.append(f"CASE WHEN m.{cols[0]} IS NULL THEN 1 ELSE 0 END AS mw{i}")
    return (
        f"terms AS (SELECT id, t.split, {', '.join(cells)} FROM struth t JOIN imp p USING (id) JOIN oh m USING (id))"
    )


_TERMS = f"{_IMP}, {_terms_sql()}"


def _metric_sql(kind: str, reduction: str, sub: str, w: str = "1") -> str:
    """kind: se (RMSE), ae (MAAPE) or w (categorical error)."""
    root = "sqrt" if kind == "se" else ""
    mask = "mw" if kind == "w" else "mc"
    parts = []
    for i in range(3):
        flag = f"{mask}{i}" if sub == "missingonly" else "1"
        parts.append((f"sum({kind}{i} * {flag} * {w})", f"sum({flag} * {w})"))
    if reduction == "EW":
        return f"coalesce({root}(({' + '.join(a for a, _ in parts)}) / nullif({' + '.join(b for _, b in parts)}, 0)), 0.0)"
    cols = [f"{root}({a} / nullif({b}, 0))" for a, b in parts]
    total = " + ".join(f"coalesce({c}, 0.0)" for c in cols)
    n = " + ".join(f"CASE WHEN {b} > 0 THEN 1 ELSE 0 END" for _, b in parts)
    return f"coalesce(({total}) / nullif({n}, 0), 0.0)"


def _one(spark, d, tag, name, by=()):
    """A single metric, ``subgroup/reduction/type/metric``."""
    long = M.metrics_long(M.metric_states(scoring_frame(spark, d), CODED, by), by)
    return M.pick_metric(long, *tag.split("/"), name, by).withColumn(name, F.round(name, 6))


@query(f"""WITH {_TERMS} SELECT split, round({_metric_sql('se', 'CW', 'missingonly')}
  + {_metric_sql('w', 'CW', 'missingonly')}, 6) AS mixed_error FROM terms GROUP BY split""")
def impute_score(spark, d):
    return _one(spark, d, "missingonly/CW/mixed/RMSE", "mixed_error", ["split"])


@query(f"WITH {_TERMS} SELECT round({_metric_sql('se', 'EW', 'all')}, 6) AS rmse_ew FROM terms")
def rmse_ew(spark, d):
    return _one(spark, d, "all/EW/continuous/RMSE", "rmse_ew")


@query(f"WITH {_TERMS} SELECT round({_metric_sql('se', 'CW', 'all')}, 6) AS rmse_cw FROM terms")
def rmse_cw(spark, d):
    return _one(spark, d, "all/CW/continuous/RMSE", "rmse_cw")


@query(f"WITH {_TERMS} SELECT round({_metric_sql('ae', 'EW', 'all')}, 6) AS maape_ew FROM terms")
def maape_ew(spark, d):
    return _one(spark, d, "all/EW/continuous/MAAPE", "maape_ew")


@query(f"WITH {_TERMS} SELECT round({_metric_sql('ae', 'CW', 'all')}, 6) AS maape_cw FROM terms")
def maape_cw(spark, d):
    return _one(spark, d, "all/CW/continuous/MAAPE", "maape_cw")


@query(f"WITH {_TERMS} SELECT round({_metric_sql('w', 'EW', 'all')}, 6) AS cat_error_ew FROM terms")
def cat_error_ew(spark, d):
    return _one(spark, d, "all/EW/categorical/RMSE", "cat_error_ew")


@query(f"WITH {_TERMS} SELECT round({_metric_sql('w', 'CW', 'all')}, 6) AS cat_error_cw FROM terms")
def cat_error_cw(spark, d):
    return _one(spark, d, "all/CW/categorical/RMSE", "cat_error_cw")


@query(
    f"""WITH {_TERMS} SELECT round({_metric_sql('se', 'EW', 'missingonly')}, 6) AS rmse_ew,
    round({_metric_sql('se', 'CW', 'missingonly')}, 6) AS rmse_cw,
    round({_metric_sql('ae', 'EW', 'missingonly')}, 6) AS maape_ew,
    round({_metric_sql('ae', 'CW', 'missingonly')}, 6) AS maape_cw,
    round({_metric_sql('w', 'EW', 'missingonly')}, 6) AS cat_ew,
    round({_metric_sql('w', 'CW', 'missingonly')}, 6) AS cat_cw FROM terms"""
)
def metrics_missing_only(spark, d):
    long = M.metrics_long(M.metric_states(scoring_frame(spark, d), CODED))
    long = long.filter("filter_subgroup = 'missingonly' AND feature_type <> 'mixed'")
    slot = F.concat_ws("/", "feature_type", "metric_name", "reduction")
    kinds = {"rmse": "continuous/RMSE", "maape": "continuous/MAAPE", "cat": "categorical/RMSE"}
    cells = [
        F.round(F.max(F.when(slot == f"{k}/{r}", F.col("val"))), 6).alias(f"{n}_{r.lower()}")
        for n, k in kinds.items()
        for r in ("EW", "CW")
    ]
    return long.agg(*cells)


def _matrix_sql() -> str:
    rows = []
    for s in ("all", "missingonly"):
        for r in ("CW", "EW"):
            for m, kind in (("RMSE", "se"), ("MAAPE", "ae")):
                num, cat = _metric_sql(kind, r, s), _metric_sql("w", r, s)
                for t, e in (("continuous", num), ("categorical", cat), ("mixed", f"{num} + {cat}")):
                    rows.append(
                        f"SELECT split, '{s}' AS filter_subgroup, '{r}' AS reduction, '{t}' AS feature_type, "
                        f"'{m}' AS metric_name, round({e}, 6) AS val FROM terms GROUP BY split"
                    )
    return " UNION ALL ".join(rows)


@query(f"WITH {_TERMS.replace('terms AS (', 'terms AS MATERIALIZED (')} {_matrix_sql()}")
def metric_matrix(spark, d):
    long = M.score_imputation(scoring_frame(spark, d), CODED, ["split"])
    return long.withColumn("val", F.round("val", 6))


@query(f"""WITH {_TERMS} SELECT split, round(-({_metric_sql('ae', 'CW', 'missingonly')}
  + {_metric_sql('w', 'CW', 'missingonly')}), 6) AS score FROM terms GROUP BY split""")
def tune_metric(spark, d):
    scores = M.tune_metric(scoring_frame(spark, d), CODED, ["split"])
    return scores.withColumn("score", F.round("score", 6))


@query(
    f"WITH {_TERMS} SELECT "
    + ", ".join(
        f"round(sqrt(sum(se{i} * mc{i}) / sum(mc{i})) / (max(s.{c}) FILTER (WHERE mc{i} = 1) - "
        f"min(s.{c}) FILTER (WHERE mc{i} = 1)), 6) AS {c}"
        for i, c in enumerate(CTN)
    )
    + " FROM terms JOIN struth s USING (id)"
)
def nrmse(spark, d):
    out = M.normalised_rmse(scoring_frame(spark, d), CODED, "range")
    return out.select(*[F.round(c, 6).alias(c) for c in CTN])


@query(f"""WITH {_TERMS} SELECT round({_metric_sql('se', 'CW', 'missingonly')}
  + {_metric_sql('w', 'CW', 'missingonly')}, 6) AS mixed_error FROM terms""")
def join_scoring(spark, d):
    """Truth, prediction and mask as three tables, joined by id."""
    data, truth = T.mixed_onehot(spark, d), T.truth_onehot(spark, d)
    scaler = X.MinMaxScaler.fit(train(data), CTN)
    scaled = scaler.transform(data)
    pred = I.SimpleImputer.fit(train(scaled), SCHEMA).transform(scaled)
    frame = J.scoring_frame(scaler.transform(truth), pred, scaled, ["id"], SCHEMA.features)
    long = M.metrics_long(M.metric_states(frame, SCHEMA))
    picked = M.pick_metric(long, "missingonly", "CW", "mixed", "RMSE", "mixed_error")
    return picked.withColumn("mixed_error", F.round("mixed_error", 6))


_BCE = "greatest(p.recent, 0) - p.recent * t.recent + ln(1 + exp(-abs(p.recent)))"


def _ce(cols: list[str]) -> str:
    total = " + ".join(f"exp(p.{c})" for c in cols)
    chosen = " + ".join(f"p.{c} * t.{c}" for c in cols)
    return f"avg(ln({total}) - ({chosen}))"


@query(
    f"""WITH {_IMP} SELECT round({' + '.join(_ce(c) for c in GROUPS.values())}, 6) AS onehot,
    round(avg({_BCE}), 6) AS "binary",
    round(({' + '.join(f'avg((t.{c} - p.{c}) * (t.{c} - p.{c}))' for c in CTN)}) / 3, 6) AS continuous,
    round({' + '.join(_ce(c) for c in GROUPS.values())} + avg({_BCE})
      + ({' + '.join(f'avg((t.{c} - p.{c}) * (t.{c} - p.{c}))' for c in CTN)}) / 3, 6) AS loss
    FROM struth t JOIN imp p USING (id)"""
)
def mixed_loss(spark, d):
    data = T.mixed_onehot(spark, d)
    scaler, imputer = I.fit_scaler_and_imputer(train(data), SCHEMA)
    pred = scaler.transform(imputer.transform(data))
    frame = J.scoring_frame(scaler.transform(T.truth_onehot(spark, d)), pred, data, ["id"], SCHEMA.features)
    out = M.mixed_loss(frame, SCHEMA)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_ERR = f"sqrt(({' + '.join(f'se{i}' for i in range(3))}) / 3)"


@query(
    f"""WITH {_TERMS}, e AS (SELECT id, {_ERR} AS err FROM terms)
    SELECT id, round(err, 9) AS err, 'best' AS kind FROM (SELECT * FROM e ORDER BY err, id LIMIT 10)
    UNION ALL SELECT id, round(err, 9) AS err, 'worst' AS kind FROM (SELECT * FROM e ORDER BY err DESC, id LIMIT 10)"""
)
def best_worst_rows(spark, d):
    out = M.best_worst_rows(scoring_frame(spark, d), CODED, "id")
    return out.withColumn("err", F.round("err", 9))


def _row_error_sql() -> str:
    rows = []
    for sub in ("all", "missingonly"):
        for name, kind, mask in (("RMSE", "se", "mc"), ("MAAPE", "ae", "mc"), ("wrong", "w", "mw")):
            flag = [f"{mask}{i}" if sub == "missingonly" else "1" for i in range(3)]
            total = " + ".join(f"{kind}{i} * {f}" for i, f in enumerate(flag))
            mean = f"({total})::DOUBLE / nullif({' + '.join(flag)}, 0)"
            rows.append(f"SELECT id, '{sub}' AS filter_subgroup, '{name}' AS metric_name, {f'sqrt({mean})' if name == 'RMSE' else mean} AS err FROM terms")
    return " UNION ALL ".join(rows)


@query(
    f"""WITH {_TERMS.replace('terms AS (', 'terms AS MATERIALIZED (')}, e AS ({_row_error_sql()}),
    r AS (SELECT *, row_number() OVER (PARTITION BY filter_subgroup, metric_name ORDER BY err, id) AS b,
      row_number() OVER (PARTITION BY filter_subgroup, metric_name ORDER BY err DESC, id) AS w FROM e WHERE err IS NOT NULL)
    SELECT filter_subgroup, metric_name, 'best' AS kind, b::INTEGER AS rank, id, round(err, 9) AS err FROM r WHERE b <= 10
    UNION ALL SELECT filter_subgroup, metric_name, 'worst', w::INTEGER, id, round(err, 9) FROM r WHERE w <= 10"""
)
def best_worst_by_metric(spark, d):
    """The ten best and worst rows of each metric, over all cells and over those that were missing."""
    out = M.best_worst_by_metric(scoring_frame(spark, d), CODED, "id")
    return out.withColumn("err", F.round("err", 9))


_USER = [
    UserMetric("MAE", lambda: (0.0, 0.0), lambda s, t, p, w: (s[0] + float((np.abs(t - p) * w).sum()), s[1] + float(w.sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[0] / s[1] if s[1] else None),
    UserMetric("largest", lambda: None, lambda s, t, p, w: max([x for x in (s, float(np.abs(t - p)[w > 0].max(initial=-1.0))) if x is not None]), lambda a, b: b if a is None else a if b is None else max(a, b), lambda s: s if s is not None and s >= 0 else None),
]


def _user_sql() -> str:
    rows = []
    for i, c in enumerate(CTN):
        for sub, where in (("all", "true"), ("missingonly", f"mc{i} = 1")):
            rows += [
                f"SELECT split, '{c}' AS feature, '{sub}' AS filter_subgroup, '{m}' AS metric_name, round({f}(sqrt(se{i})) FILTER (WHERE {where}), 9) AS val FROM terms GROUP BY 1"
                for m, f in (("MAE", "avg"), ("largest", "max"))
            ]
    return " UNION ALL ".join(rows)


@query(f"WITH {_TERMS.replace('terms AS (', 'terms AS MATERIALIZED (')} {_user_sql()}")
def user_metrics(spark, d):
    """Two metrics that a user gives as mergeable states: mean and largest absolute error."""
    out = score_user_metrics(scoring_frame(spark, d), CTN, _USER, ["split"])
    return out.withColumn("val", F.round("val", 9))


def _ceil_split(test: str) -> str:
    return f"""WITH {S.MIXED}, r AS (SELECT id, label,
      row_number() OVER (PARTITION BY label ORDER BY {S.h(S.key('id', 11))}, id) AS rn,
      count(*) OVER (PARTITION BY label) AS n FROM mixed)
    SELECT id, label, {test} FROM r"""


@query(
    _ceil_split(
        "CASE WHEN rn <= ceil(0.4::DOUBLE * n) THEN 'test' "
        "WHEN rn <= ceil(0.4::DOUBLE * n) + ceil(0.5::DOUBLE * (n - ceil(0.4::DOUBLE * n))) THEN 'val' ELSE 'train' END AS split"
    )
)
def stratified_split(spark, d):
    df = T.mixed(spark, d).select("id", "label")
    return SP.stratified_split(df, "id", "label", seed=11)


@query(f"WITH {S.MIXED} SELECT split, label, count(*) AS n FROM mixed GROUP BY 1, 2")
def column_split(spark, d):
    return T.mixed(spark, d).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in T.NULL_COLUMNS)


@query(
    f"""WITH {S.MIXED}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label
      ORDER BY {S.h(S.key('id', 5))}, id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM mixed WHERE {_COMPLETE})
    SELECT id, CASE WHEN rn <= ceil(0.4::DOUBLE * n) THEN 'val' ELSE 'train' END AS split FROM r
    UNION ALL SELECT id, 'test' AS split FROM mixed WHERE NOT ({_COMPLETE})"""
)
def semi_observed_split(spark, d):
    df = T.mixed(spark, d).drop("split")
    return SP.semi_observed_split(df, T.NULL_COLUMNS, "id", "label", seed=5).select("id", "split")


@query(f"WITH {S.MIXED} SELECT id, CASE WHEN split = 'train' THEN -1 ELSE 0 END AS fold FROM mixed WHERE split <> 'test'")
def holdout_folds(spark, d):
    return SP.holdout_folds(T.mixed(spark, d)).select("id", "fold")


B = 99
_MIX_CW = "round({a} + {b}, 6) AS mixed_error"


def _draws_sql(n: str, b: int, seed: int = 0) -> str:
    salts = f"SELECT r AS replicate, {S.h(f'r + {seed}')} AS salt FROM range(0, {b}) t(r)"
    numbers = f"SELECT replicate, salt, i, {n} AS n FROM ({salts}), (SELECT unnest(range(0, {n})) AS i)"
    return f"draws AS (SELECT replicate, j FROM {S.drawn_rows(f'({numbers})')})"


@query(
    f"""WITH {_TERMS}, numbered AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS row_no FROM terms),
    {_draws_sql('(SELECT count(*) FROM terms)', B)}
    SELECT CAST(replicate AS INTEGER) AS replicate, round({_metric_sql('se', 'CW', 'missingonly')}
      + {_metric_sql('w', 'CW', 'missingonly')}, 6) AS mixed_error
    FROM numbered JOIN draws ON row_no = j GROUP BY replicate"""
)
def bootstrap_metric(spark, d):
    """Error per bootstrap replicate. Rows are reduced to their error terms, which are summed as drawn."""
    terms = M.wide_terms(CODED)
    wide = scoring_frame(spark, d).select("id", *[c.alias(k) for k, c in terms.items()])
    sums = SP.bootstrap_sums(wide, "id", list(terms), B)
    long = M.metrics_long(M.states_from_wide(sums, CODED, ["replicate"]), ["replicate"])
    picked = M.pick_metric(long, "missingonly", "CW", "mixed", "RMSE", "mixed_error", ["replicate"])
    return picked.withColumn("mixed_error", F.round("mixed_error", 6))


def _poisson_sql(replicates: int) -> str:
    """Rows of ``terms`` repeated as often as each replicate draws them."""
    upto, total = [], 0.0
    for k in range(13):  # the distribution function of Poisson(1)
        total += math.exp(-1) / math.factorial(k)
        upto.append(total)
    times = " + ".join(f"CASE WHEN u >= {x!r}::DOUBLE THEN 1 ELSE 0 END" for x in upto)
    salts = f"SELECT r AS replicate, {S.h('salt')} AS high FROM (SELECT r, {S.h('r')} AS salt FROM range(0, {replicates}) t(r))"
    draws = f"SELECT terms.*, replicate, {S.u('xor(high, id)')} AS u FROM terms, ({salts})"
    return f"drawn AS (SELECT *, unnest(range(0, {times})) FROM ({draws}))"


@query(
    f"""WITH {_TERMS}, {_poisson_sql(99)}
    SELECT CAST(replicate AS INTEGER) AS replicate, round({_metric_sql('se', 'CW', 'missingonly')}
      + {_metric_sql('w', 'CW', 'missingonly')}, 6) AS mixed_error FROM drawn GROUP BY replicate"""
)
def poisson_bootstrap(spark, d):
    """The single-pass form of the same, for 99 replicates."""
    terms = M.wide_terms(CODED)
    wide = scoring_frame(spark, d).select("id", *[c.alias(k) for k, c in terms.items()])
    sums = SP.poisson_sums(wide, "id", list(terms), 99)
    long = M.metrics_long(M.states_from_wide(sums, CODED, ["replicate"]), ["replicate"])
    picked = M.pick_metric(long, "missingonly", "CW", "mixed", "RMSE", "mixed_error", ["replicate"])
    return picked.withColumn("mixed_error", F.round("mixed_error", 6))


@query(
    f"""WITH {S.MIXED}, numbered AS (SELECT label, totalprice, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS row_no
      FROM mixed),
    {_draws_sql('(SELECT count(*) FROM mixed WHERE label = 0)', B).replace('draws AS', 'd0 AS')},
    {_draws_sql('(SELECT count(*) FROM mixed WHERE label = 1)', B, 1000000).replace('draws AS', 'd1 AS')}
    SELECT CAST(replicate AS INTEGER) AS replicate, label, count(*) AS n, round(avg(totalprice), 4) AS mean FROM numbered JOIN
    (SELECT 0 AS l, * FROM d0 UNION ALL SELECT 1 AS l, * FROM d1) ON label = l AND row_no = j GROUP BY replicate, label"""
)
def stratified_bootstrap(spark, d):
    df = T.mixed(spark, d).select("id", "label", "totalprice")
    df = df.withColumn("seen", F.when(F.col("totalprice").isNotNull(), 1.0))
    sums = SP.bootstrap_sums(df, "id", ["totalprice", "seen"], B, label="label")
    return sums.select(
        "replicate", "label", F.col("n").cast("bigint").alias("n"), F.round(F.col("totalprice") / F.col("seen"), 4).alias("mean")
    )
