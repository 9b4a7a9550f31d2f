"""Scaling, encoding, binning and their inverses; mean/mode and panel imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions.hashing import stream_key, uniform
from lacuna.operators import encode as E
from lacuna.operators import impute_simple as I
from lacuna.operators import transforms as X
from lacuna.plans import sql as S
from lacuna.plans import tables as T
from lacuna.plans.registry import query
from lacuna.schema import FeatureSchema

GROUPS = T.ONEHOT_COLUMNS
CTN = T.CONTINUOUS
_K = "id, split, label"
_REST = ", ".join([c for c in S.FEATS if c not in CTN])


def train(df):
    return df.filter(F.col("split") == "train")


BOUNDS = (
    "bounds AS (SELECT "
    + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in CTN)
    + " FROM oh WHERE split = 'train')"
)


def _scale(c: str) -> str:
    return f"({c} - lo_{c}) / (CASE WHEN hi_{c} = lo_{c} THEN 1.0 ELSE hi_{c} - lo_{c} END) AS {c}"


SCALED = (
    f"{BOUNDS}, soh AS (SELECT {_K}, {', '.join(_scale(c) for c in CTN)}, {_REST} FROM oh, bounds), "
    f"struth AS (SELECT {_K}, {', '.join(_scale(c) for c in CTN)}, {_REST} FROM truth_oh, bounds)"
)


@query(
    f"WITH {S.BOTH_OH}, {SCALED} SELECT id, split, "
    + ", ".join(f"round({c}, 9) AS {c}" for c in CTN)
    + " FROM soh"
)
def minmax_scale(spark, d):
    df = T.mixed_onehot(spark, d)
    scaled = X.MinMaxScaler.fit(train(df), CTN).transform(df)
    return scaled.select("id", "split", *[F.round(c, 9).alias(c) for c in CTN])


@query(f"WITH {S.BOTH_OH} SELECT id, " + ", ".join(f"round({c}, 4) AS {c}" for c in CTN) + " FROM oh")
def minmax_inverse(spark, d):
    df = T.mixed_onehot(spark, d)
    model = X.MinMaxScaler.fit(train(df), CTN)
    back = model.inverse(model.transform(df))
    return back.select("id", *[F.round(c, 4).alias(c) for c in CTN])


BINS = {
    "totalprice": [(0.0, 100000.0), (100000.0, 250000.0), (250000.0, 400000.0), (400000.0, 500000.0)],
    "day": [(0.0, 700.0), (700.0, 1400.0), (1400.0, 2400.0)],
}


def _bin_cols(source: str) -> list[tuple[str, str, str, int]]:
    out = []
    for c, bs in BINS.items():
        for k, (lo, hi) in enumerate(bs):
            low = f"{c} > {lo}" if k else "TRUE"
            high = f"{c} <= {hi}" if k < len(bs) - 1 else "TRUE"
            expr = f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN {low} AND {high} THEN 1 ELSE 0 END END"
            out.append((c, f"{c}_{lo} - {hi}", expr, k))
    return out


@query(
    f"WITH {S.MIXED} SELECT id, acctbal, "
    + ", ".join(f'{e} AS "{n}"' for _, n, e, _ in _bin_cols("mixed"))
    + " FROM mixed"
)
def discretize_fixed_bins(spark, d):
    return X.FixedBins(BINS).transform(T.mixed(spark, d).select("id", *CTN))


def _middle(c: str) -> str:
    whens = " ".join(f"WHEN {c} <= {hi} THEN {(lo + hi) / 2}" for lo, hi in BINS[c][:-1])
    lo, hi = BINS[c][-1]
    return f"CAST(CASE WHEN {c} IS NULL THEN NULL {whens} ELSE {(lo + hi) / 2} END AS DOUBLE) AS {c}"


@query(f"WITH {S.MIXED} SELECT id, {_middle('totalprice')}, acctbal, {_middle('day')} FROM mixed")
def invert_discretize(spark, d):
    bins = X.FixedBins(BINS)
    return bins.inverse(bins.transform(T.mixed(spark, d).select("id", *CTN)), ["id", *CTN])


@query(
    f"WITH {S.BOTH_OH} SELECT id, coalesce(CAST(recent AS DOUBLE), 0.5) AS recent, "
    + ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), {1 / len(cols)}) AS {c}" for cols in GROUPS.values() for c in cols
    )
    + " FROM oh"
)
def uniform_prob(spark, d):
    df = T.mixed_onehot(spark, d).drop("split", "label", *CTN)
    return E.uniform_probability(df, GROUPS, ["recent"])


_CATS = ["recent", "priority", "segment"]
ENCODED = (
    "prior AS (SELECT avg(label) AS prior FROM mixed WHERE split = 'train'), "
    + ", ".join(
        f"enc_{c} AS (SELECT {c} AS k_{c}, prior * (1 - 1 / (1 + exp(-(n - 20.0) / 10.0))) + m * (1 / (1 + exp(-(n - 20.0) / 10.0))) AS e_{c}"
        f" FROM (SELECT {c}, count(*) AS n, avg(label) AS m FROM mixed WHERE split = 'train' AND {c} IS NOT NULL"
        f" GROUP BY 1), prior)"
        for c in _CATS
    )
)


def _encoder(spark, d):
    df = T.mixed(spark, d)
    return df, X.TargetEncoder.fit(train(df), _CATS, "label", 20.0, 10.0)


@query(
    f"WITH {S.MIXED}, {ENCODED} SELECT id, "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN round(coalesce(e_{c}, prior), 9) END AS {c}" for c in _CATS)
    + " FROM mixed CROSS JOIN prior "
    + " ".join(f"LEFT JOIN enc_{c} ON {c} = k_{c}" for c in _CATS)
)
def target_encode(spark, d):
    df, enc = _encoder(spark, d)
    return enc.transform(df).select("id", *[F.round(c, 9).alias(c) for c in _CATS])


@query(f"WITH {S.MIXED} SELECT id, CAST(recent AS VARCHAR) AS recent, priority, segment FROM mixed")
def invert_target_encode(spark, d):
    df, enc = _encoder(spark, d)
    return enc.inverse(enc.transform(df)).select("id", *_CATS)


@query(
    f"""WITH o AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS cust, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, {S.u(S.key('o_orderkey', 71))} AS u FROM orders),
    prior AS (SELECT avg(label) AS prior FROM o), c AS (SELECT cust, count(*) AS n, avg(label) AS mean FROM o GROUP BY 1),
    codes AS (SELECT e, min(cust) AS cust FROM (SELECT cust, prior * (1 - w) + mean * w AS e FROM (SELECT *, 1 / (1 + exp(-(n - 2) / 3.0::DOUBLE)) AS w FROM c), prior) GROUP BY e),
    x AS (SELECT id, e + (u - 0.5) / 20 AS x FROM o JOIN c USING (cust), prior, LATERAL (SELECT prior * (1 - 1 / (1 + exp(-(n - 2) / 3.0::DOUBLE))) + mean / (1 + exp(-(n - 2) / 3.0::DOUBLE)) AS e))
    SELECT id, arg_min(cust, (abs(x - e), cust)) AS cust FROM x, codes GROUP BY id"""
)
def invert_many_codes(spark, d):
    """The customer whose code is nearest to an order's code, moved a little: no limit on the categories."""
    orders = T.read(spark, d, "orders")
    df = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("cust"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    enc = X.TargetEncoder.fit(df, ["cust"], "label", 2.0, 3.0)
    enc.codes = None  # by joins at any number of categories
    moved = enc.transform(df).withColumn("cust", F.col("cust") + (uniform(stream_key(F.col("id"), 71)) - 0.5) / 20)
    return enc.inverse(moved).select("id", "cust")


_LOGITS = ["totalprice", "acctbal", "day"]


def _logits(spark, d):
    """Seeded integer logits in -10..10 for the binary column and the group ``priority``."""
    cols = ["recent", *GROUPS["priority"]]
    df = T.mixed_truth(spark, d)
    return df.select(
        "id",
        *[(F.floor(uniform(stream_key(F.col("id"), 40 + i)) * 21) - 10).alias(c) for i, c in enumerate(cols)],
    )


_LOGIT_SQL = "logits AS (SELECT id, " + ", ".join(
    f"CAST(floor({S.u(S.key('id', 40 + i))} * 21) - 10 AS BIGINT) AS {c}"
    for i, c in enumerate(["recent", *GROUPS["priority"]])
) + " FROM mixed_truth)"


@query(f"WITH {S.TRUTH}, {_LOGIT_SQL} SELECT id, CASE WHEN recent >= 0 THEN 1 ELSE 0 END AS recent FROM logits")
def binary_threshold(spark, d):
    return E.binary_threshold(_logits(spark, d).select("id", "recent"), ["recent"])


_P = GROUPS["priority"]


@query(
    f"WITH {S.TRUTH}, {_LOGIT_SQL} SELECT id, "
    + ", ".join(
        "CASE WHEN "
        + " AND ".join(f"{c} {'>' if j < i else '>='} {o}" for j, o in enumerate(_P) if o != c)
        + f" THEN 1 ELSE 0 END AS {c}"
        for i, c in enumerate(_P)
    )
    + " FROM logits"
)
def onehot_threshold(spark, d):
    return E.onehot_threshold(_logits(spark, d).select("id", *_P), {"priority": _P})


def _mode(c: str, where: str) -> str:
    return (
        f"(SELECT {c} FROM mixed WHERE {c} IS NOT NULL {where} GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)"
    )


def imputed_sql(source: str, where: str) -> str:
    """Mean of continuous columns, mode of categories over the rows of ``where``, as ``imp``."""
    fill = (
        f"fill AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in CTN)}, "
        f"{', '.join(f'{_mode(c, where)} AS m_{c}' for c in _CATS)} FROM {source} WHERE TRUE {where})"
    )
    cells = [f"coalesce({c}, m_{c}) AS {c}" for c in CTN] + ["coalesce(recent, m_recent) AS recent"]
    for p, cols in GROUPS.items():
        for c in cols:
            cells.append(f"coalesce({c}, CASE WHEN m_{p} = '{c[len(p) + 1:]}' THEN 1 ELSE 0 END) AS {c}")
    return f"{fill}, imp AS (SELECT {_K}, {', '.join(cells)} FROM {source}, fill)"


_ROUNDED = ", ".join([*[f"round({c}, 6) AS {c}" for c in CTN], "recent", *[c for g in GROUPS.values() for c in g]])


def _rounded(df, *keys):
    cells = [F.round(c, 6).alias(c) if c in CTN else F.col(c) for c in S.FEATS]
    return df.select(*keys, *cells)


@query(f"""WITH {S.BOTH_OH}, {SCALED}, {imputed_sql('soh', "AND split = 'train'")} SELECT id, split, {_ROUNDED} FROM imp""")
def impute_simple(spark, d):
    df = T.mixed_onehot(spark, d)
    scaler, imputer = I.fit_scaler_and_imputer(train(df), T.MIXED_SCHEMA)
    return _rounded(scaler.transform(imputer.transform(df)), "id", "split")


@query(f"WITH {S.BOTH_OH}, {imputed_sql('oh', '')} SELECT id, {_ROUNDED} FROM imp")
def warm_start_simple(spark, d):
    return _rounded(I.warm_start(T.mixed_onehot(spark, d), T.MIXED_SCHEMA, "simple"), "id")


@query(f"WITH {S.BOTH_OH} SELECT id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in S.FEATS) + " FROM oh")
def warm_start_const(spark, d):
    return I.warm_start(T.mixed_onehot(spark, d), T.MIXED_SCHEMA, 0).select("id", *S.FEATS)


_EV = T.EVENT_TYPES
_LAST = "last_value({c} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)"
_NEXT = "first_value({c} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(f"WITH {S.PANEL} SELECT user_id, t, " + ", ".join(f"{_LAST.format(c=c)} AS {c}" for c in _EV) + " FROM panel")
def impute_locf(spark, d):
    return I.fill_forward(T.panel(spark, d), "user_id", "t", _EV)


@query(f"WITH {S.PANEL} SELECT user_id, t, " + ", ".join(f"{_NEXT.format(c=c)} AS {c}" for c in _EV) + " FROM panel")
def impute_nocb(spark, d):
    return I.fill_backward(T.panel(spark, d), "user_id", "t", _EV)


def _lin(c: str) -> str:
    t_seen = f"CASE WHEN {c} IS NOT NULL THEN t END"
    p, n = _LAST.format(c=c), _NEXT.format(c=c)
    tp, tn = _LAST.format(c=t_seen), _NEXT.format(c=t_seen)
    return f"round(coalesce({c}, {p} + ({n} - {p}) * (t - {tp}) / CAST({tn} - {tp} AS DOUBLE), {p}, {n}) + 1e-11, 8) AS {c}"


@query(f"WITH {S.PANEL} SELECT user_id, t, {', '.join(_lin(c) for c in _EV)} FROM panel")
def impute_interpolate(spark, d):
    filled = I.interpolate(T.panel(spark, d), "user_id", "t", _EV)
    return filled.select("user_id", "t", *[F.round(F.col(c) + 1e-11, 8).alias(c) for c in _EV])


@query(
    f"WITH {S.PANEL} SELECT user_id, t, "
    + ", ".join(
        f"round(coalesce({c}, avg({c}) OVER (PARTITION BY user_id), (SELECT avg({c}) FROM panel)) + 1e-11, 8) AS {c}" for c in _EV
    )
    + " FROM panel"
)
def impute_entity_mean(spark, d):
    filled = I.fill_entity_mean(T.panel(spark, d), "user_id", _EV)
    return filled.select("user_id", "t", *[F.round(F.col(c) + 1e-11, 8).alias(c) for c in _EV])
