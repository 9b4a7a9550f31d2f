"""Classifiers on imputed features and per-entity panel features."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import impute_simple as I
from lacuna.operators import predict as P
from lacuna.plans import sql as S
from lacuna.plans import tables as T
from lacuna.plans.q_transform import train
from lacuna.plans.registry import query
from lacuna.session import materialize

_EV = T.EVENT_TYPES


def _imputed(spark, d):
    """Scaled and filled features, written once: every fit reads them several times."""
    df = T.mixed_onehot(spark, d)
    scaler, imputer = I.fit_scaler_and_imputer(train(df), T.MIXED_SCHEMA)
    return materialize(scaler.transform(imputer.transform(df)), "imputed")


def _scored(spark, d, kind, **params):
    out = P.fit_predict(_imputed(spark, d), S.FEATS, kind, **params)
    return out.select("id", "split", "label", "pred", "prob")


@query()
def predict_lr(spark, d):
    return _scored(spark, d, "lr")


@query()
def predict_rf(spark, d):
    return _scored(spark, d, "rf")


@query()
def predict_gbt(spark, d):
    return _scored(spark, d, "gbt")


@query()
def predict_mlp(spark, d):
    return _scored(spark, d, "mlp")


def _single(c: str):
    """To single precision: sums taken in another order agree there, decimals of halves would not."""
    return F.round(F.col(c).cast("float").cast("double"), 9)


def _feat(c: str) -> str:
    """Moments as sums of deviations from the mean; the deviations are columns of ``dev``."""
    return f"""count({c}) AS {c}_count, round(CAST(avg({c}) AS FLOAT)::DOUBLE, 9) AS {c}_mean, round(CAST(stddev_pop({c}) AS FLOAT)::DOUBLE, 9) AS {c}_std,
    round(CAST(var_pop({c}) AS FLOAT)::DOUBLE, 9) AS {c}_var, min({c}) AS {c}_min, max({c}) AS {c}_max, round(CAST(sum({c}) AS FLOAT)::DOUBLE, 9) AS {c}_sum,
    round(CAST(sum({c} * {c}) AS FLOAT)::DOUBLE, 9) AS {c}_abs_energy,
    round(CAST(quantile_cont({c}, 0.25) AS FLOAT)::DOUBLE, 9) AS {c}_q25, round(CAST(quantile_cont({c}, 0.5) AS FLOAT)::DOUBLE, 9) AS {c}_median, round(CAST(quantile_cont({c}, 0.75) AS FLOAT)::DOUBLE, 9) AS {c}_q75,
    arg_min({c}, t) AS {c}_first, arg_max({c}, t) AS {c}_last, round(CAST(regr_slope({c}, t) AS FLOAT)::DOUBLE, 9) AS {c}_slope,
    CASE WHEN min({c}) < max({c}) THEN round(CAST(avg(pow(d_{c}, 3)) / pow(avg(d_{c} * d_{c}), 1.5) AS FLOAT)::DOUBLE, 9) END AS {c}_skew,
    CASE WHEN min({c}) < max({c}) THEN round(CAST(avg(pow(d_{c}, 4)) / pow(avg(d_{c} * d_{c}), 2) - 3 AS FLOAT)::DOUBLE, 9) END AS {c}_kurtosis"""


_DEV = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY user_id) AS d_{c}" for c in _EV)
_COMPUTED = ["mean", "std", "var", "sum", "abs_energy", "q25", "median", "q75", "slope", "skew", "kurtosis"]


@query(f"WITH {S.PANEL}, dev AS (SELECT *, {_DEV} FROM panel) SELECT user_id, {', '.join(_feat(c) for c in _EV)} FROM dev GROUP BY user_id")
def panel_features(spark, d):
    """Moments, quartiles, ends and slope of all five series of every user."""
    out = P.panel_features(T.panel(spark, d), "user_id", "t", _EV)
    return out.withColumns({f"{c}_{k}": _single(f"{c}_{k}") for c in _EV for k in _COMPUTED})


def _lagged(c: str) -> str:
    return (
        f"l_{c} AS (SELECT user_id, t, {c} AS x, lag({c}) OVER (PARTITION BY user_id ORDER BY t) AS p, "
        f"avg({c}) OVER (PARTITION BY user_id) AS m, var_pop({c}) OVER (PARTITION BY user_id) AS v, "
        f"min({c}) OVER (PARTITION BY user_id) < max({c}) OVER (PARTITION BY user_id) AS varies FROM panel WHERE {c} IS NOT NULL), "
        f"f_{c} AS (SELECT user_id, round(CAST(avg(abs(x - p)) AS FLOAT)::DOUBLE, 9) AS {c}_mean_abs_change, "
        f"round(CAST(avg((x - m) * (p - m)) AS FLOAT)::DOUBLE, 9) AS {c}_autocov, "
        f"CASE WHEN bool_or(varies) THEN round(CAST(avg((x - m) * (p - m)) / max(v) AS FLOAT)::DOUBLE, 9) END AS {c}_autocorr, "
        f"sum(CASE WHEN (x > m) <> (p > m) THEN 1 ELSE 0 END)::BIGINT AS {c}_crossings FROM l_{c} GROUP BY 1)"
    )


@query(
    f"WITH {S.PANEL}, {', '.join(_lagged(c) for c in _EV)} SELECT u.user_id, "
    + ", ".join(f"{c}_mean_abs_change, {c}_autocov, {c}_autocorr, coalesce({c}_crossings, 0) AS {c}_crossings" for c in _EV)
    + " FROM (SELECT DISTINCT user_id FROM panel) u "
    + " ".join(f"LEFT JOIN f_{c} ON u.user_id = f_{c}.user_id" for c in _EV)
)
def panel_changes(spark, d):
    """Changes between successive observations of all five series of every user."""
    out = P.change_features(T.panel(spark, d), "user_id", "t", _EV)
    return out.withColumns({f"{c}_{k}": _single(f"{c}_{k}") for c in _EV for k in ("mean_abs_change", "autocov", "autocorr")})
