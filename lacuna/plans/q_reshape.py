"""One-hot forms, panels, joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import encode as E
from lacuna.operators import joins as J
from lacuna.operators import reshape as R
from lacuna.operators import results as RS
from lacuna.plans import sql as S
from lacuna.plans import tables as T
from lacuna.plans.q_clean import FLAT, FLAT_PATTERN, PERIODS, flat_registry
from lacuna.plans.registry import query

GROUPS = T.ONEHOT_COLUMNS
_EV = ", ".join(T.EVENT_TYPES)


@query(f"WITH {S.BOTH_OH} SELECT * FROM oh")
def onehot_nullsafe(spark, d):
    return E.onehot(T.mixed(spark, d), ["priority", "segment"])


@query(
    f"WITH {S.MIXED} SELECT id, split, label, totalprice, acctbal, day, recent, {S.ONEHOT_PLAIN} FROM mixed"
)
def onehot_plain(spark, d):
    return E.onehot(T.mixed(spark, d), ["priority", "segment"], keep_null=False)


def _some_nulls(spark, d):
    """Single one-hot members removed, so that groups are partly missing."""
    from lacuna.functions.hashing import stream_uniforms

    df = T.truth_onehot(spark, d)
    cols = [c for cs in GROUPS.values() for c in cs]
    drawn = stream_uniforms(df, "id", {f"__u_{c}": 20 + i for i, c in enumerate(cols)})
    return drawn.withColumns({c: F.when(F.col(f"__u_{c}") >= 0.1, F.col(c)) for c in cols})


_MEMBERS = [c for cs in GROUPS.values() for c in cs]
_PARTLY = (
    "partly AS (SELECT id, "
    + ", ".join(
        f"CASE WHEN {S.u(S.key('id', 20 + i))} >= 0.1 THEN {c} END AS {c}"
        for i, c in enumerate(_MEMBERS)
    )
    + " FROM truth_oh)"
)


@query(
    f"WITH {S.BOTH_OH}, {_PARTLY} SELECT id, "
    + ", ".join(
        f"CASE WHEN {' AND '.join(f'{m} IS NOT NULL' for m in cols)} THEN {c} END AS {c}"
        for cols in GROUPS.values()
        for c in cols
    )
    + " FROM partly"
)
def explode_nulls(spark, d):
    return E.explode_nulls(_some_nulls(spark, d), GROUPS).select("id", *_MEMBERS)


_CODES = ", ".join(
    f"CAST(CASE WHEN {cols[0]} IS NOT NULL THEN CASE "
    + " ".join(f"WHEN {c} = 1 THEN {k}" for k, c in enumerate(cols))
    + f" ELSE 0 END END AS INTEGER) AS {p}"
    for p, cols in GROUPS.items()
)


@query(f"WITH {S.BOTH_OH} SELECT id, split, label, totalprice, acctbal, day, recent, {_CODES} FROM oh")
def combine_onehots(spark, d):
    return E.combine_onehots(T.mixed_onehot(spark, d), GROUPS)


@query(f"WITH {S.BOTH_OH} SELECT * FROM oh")
def uncombine_onehots(spark, d):
    df = T.mixed_onehot(spark, d)
    return E.uncombine_onehots(E.combine_onehots(df, GROUPS), GROUPS, df.columns)


_LONG = " UNION ALL ".join(
    f"SELECT user_id, '{p}' AS time, "
    + ", ".join(f"{e}_{p}_{s} AS {e}_{s}" for e in T.EVENT_TYPES for s in ("count", "max"))
    + " FROM flat"
    for p in PERIODS
)


@query(f"WITH {FLAT} {_LONG}")
def flat_to_long(spark, d):
    return R.flat_to_long(flat_registry(spark, d), "user_id", FLAT_PATTERN)


@query(f"WITH {FLAT} SELECT user_id FROM flat")
def static_subset(spark, d):
    return R.static_part(flat_registry(spark, d), FLAT_PATTERN)


@query(
    f"""WITH {S.PANEL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS step,
      count(*) OVER (PARTITION BY user_id) AS seq_len FROM panel),
    grid AS (SELECT user_id, seq_len, step FROM (SELECT DISTINCT user_id, seq_len FROM ranked),
      (SELECT unnest(range(0, (SELECT max(seq_len) FROM ranked))) AS step))
    SELECT g.user_id, CAST(g.seq_len AS INTEGER) AS seq_len, CAST(g.step AS INTEGER) AS step,
      {', '.join(f'CASE WHEN g.step >= g.seq_len THEN -1.0 ELSE r.{e} END AS {e}' for e in T.EVENT_TYPES)}
    FROM grid g LEFT JOIN ranked r ON g.user_id = r.user_id AND g.step = r.step"""
)
def pad_sequences(spark, d):
    return R.pad_sequences(T.panel(spark, d), "user_id", "t", T.EVENT_TYPES)


def _listed(c: str) -> str:
    return f"string_agg(CAST(CAST(round(coalesce({c}, 0) * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY t) AS {c}"


@query(
    f"WITH {S.PANEL} SELECT user_id, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS steps, "
    f"{', '.join(map(_listed, T.EVENT_TYPES))} FROM panel GROUP BY user_id"
)
def nest_sequences(spark, d):
    """All series of a user as ordered arrays, written as lists of whole hundredths."""
    cents = {c: F.round(F.coalesce(c, F.lit(0.0)) * 100).cast("bigint").cast("string") for c in T.EVENT_TYPES}
    panel = T.panel(spark, d).withColumns({**cents, "steps": F.col("t").cast("string")})
    nested = R.nest_sequences(panel, "user_id", "t", ["steps", *T.EVENT_TYPES])
    return nested.select("user_id", *[F.concat_ws(",", c).alias(c) for c in ("steps", *T.EVENT_TYPES)])


@query(f"WITH {S.PANEL} SELECT user_id, t, {_EV} FROM panel")
def long_to_wide(spark, d):
    """Melt and back: the panel itself."""
    panel = T.panel(spark, d)
    long = R.melt(panel, ["user_id", "t"], T.EVENT_TYPES)
    return R.long_to_wide(long, ["user_id", "t"], "feature", "value", T.EVENT_TYPES)


@query(
    f"""WITH {S.PANEL}, n AS (SELECT count(*) AS n FROM panel GROUP BY user_id)
    SELECT min(n) AS min_len, max(n) AS max_len, min(n) = max(n) AS equal_length FROM n"""
)
def seq_len_check(spark, d):
    return R.sequence_length_check(T.panel(spark, d), "user_id")


@query(
    f"""WITH {S.SCALARS} SELECT run_id, step, val, p[1] AS split, p[2] AS feature_space,
    p[3] AS filter_subgroup, p[4] AS reduction, p[5] AS feature_type, p[6] AS metric_name
    FROM (SELECT *, str_split(tag, '/') AS p FROM scalars) WHERE len(p) = 6"""
)
def split_tag(spark, d):
    return RS.split_tag(T.scalars(spark, d))


@query(
    f"""WITH {S.RUNS} SELECT run_id, mechanism, 'totalprice,day' AS incomplete_vars,
    2 AS n_incomplete, CASE WHEN pattern LIKE '%recent%' THEN 2 ELSE 1 END AS n_observed FROM runs"""
)
def expand_pattern(spark, d):
    return RS.expand_pattern(T.runs(spark, d).select("run_id", "pattern"))


@query(
    f"""WITH {S.LOG} SELECT mechanism, percent_missing, metric_name,
    {', '.join(f"round(avg(val) FILTER (WHERE method = '{m}'), 6) AS {m}" for m in T.METHODS)}
    FROM metric_log GROUP BY ALL"""
)
def results_pivot(spark, d):
    out = RS.results_pivot(
        T.metric_log(spark, d), ["mechanism", "percent_missing", "metric_name"], "method", T.METHODS
    )
    return out.withColumns({m: F.round(m, 6) for m in T.METHODS})


def _by_type(spark, d, event):
    return T.panel(spark, d).filter(F.col(event).isNotNull()).select("user_id", "t", event)


def _outer_sql() -> str:
    frames = [f"(SELECT user_id, t, {c} FROM panel WHERE {c} IS NOT NULL)" for c in T.EVENT_TYPES]
    return frames[0] + "".join(f" FULL JOIN {f} USING (user_id, t)" for f in frames[1:])


@query(f"WITH {S.PANEL} SELECT user_id, t, {_EV} FROM {_outer_sql()}")
def outer_join_panel(spark, d):
    """One table per event type, put together again: every (user, day) that any of the five has."""
    return J.outer_join_panels([_by_type(spark, d, c) for c in T.EVENT_TYPES], ["user_id", "t"])


@query(
    f"""WITH {S.PANEL} SELECT user_id, t, {_EV}, c_acctbal, c_mktsegment FROM panel
    JOIN (SELECT c_custkey AS user_id, c_acctbal, c_mktsegment FROM customer) USING (user_id)"""
)
def static_broadcast_join(spark, d):
    static = T.read(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_acctbal", "c_mktsegment"
    )
    return J.static_join(static, T.panel(spark, d), "user_id")


@query(f"WITH {S.RUNS}, {S.SCALARS} SELECT run_id, method, step, tag, val FROM runs LEFT JOIN scalars USING (run_id)")
def runs_left_join(spark, d):
    joined = RS.join_runs(T.runs(spark, d), T.scalars(spark, d))
    return joined.select("run_id", "method", "step", "tag", "val")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders")
def concat_columns(spark, d):
    orders = T.read(spark, d, "orders")
    left = orders.select("o_orderkey", "o_totalprice")
    return J.concat_columns(left, orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"])


@query(f"WITH {S.MIXED} SELECT id, totalprice FROM mixed WHERE split = 'val'")
def rows_of_split(spark, d):
    return J.rows_of_split(T.mixed(spark, d), "val").select("id", "totalprice")


@query(
    f"""WITH {S.BOTH_OH} SELECT o.id, coalesce(o.totalprice, 2 * t.totalprice) AS totalprice,
    coalesce(o.acctbal, 2 * t.acctbal) AS acctbal FROM oh o JOIN truth_oh t USING (id)"""
)
def keep_observed(spark, d):
    cols = ["totalprice", "acctbal"]
    data = T.mixed(spark, d).select("id", *cols)
    filled = T.mixed_truth(spark, d).select("id", *[(F.col(c) * 2).alias(c) for c in cols])
    return J.keep_observed(data, filled, ["id"], cols)


@query(f"WITH {S.MIXED} SELECT * FROM mixed WHERE split IN ('train', 'val')")
def union_train_val(spark, d):
    """Two slices of one scan: a single filter, so the source is read once."""
    return T.mixed(spark, d).filter(F.col("split").isin("train", "val"))


_ORDER = ["MNAR(Y)", "MNAR(G)", "MNAR", "MAR", "MCAR"]


@query(
    f"""WITH {S.LOG} SELECT row_number() OVER (ORDER BY list_position({_ORDER!r}, mechanism), metric_name) AS pos,
    mechanism, metric_name, mean FROM (SELECT mechanism, metric_name, round(avg(val), 6) AS mean
    FROM metric_log GROUP BY 1, 2)"""
)
def custom_sort(spark, d):
    from lacuna.operators.ranking import grouped_rank

    means = T.metric_log(spark, d).groupBy("mechanism", "metric_name").agg(F.round(F.avg("val"), 6).alias("mean"))
    ordered = means.withColumn("o", RS.custom_order(F.col("mechanism"), _ORDER)).withColumn("one", F.lit(1))
    ranked = grouped_rank(ordered, ["one"], "o", "pos", tie="metric_name")
    return ranked.select("pos", "mechanism", "metric_name", "mean")
