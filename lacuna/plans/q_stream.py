"""Sequences as vectors, and fitted models on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions.hashing import stream_key, uniform
from lacuna.operators.knn import knn_impute
from lacuna.operators.metrics import metrics_long
from lacuna.operators.reshape import flatten_panel
from lacuna.operators.transforms import MinMaxScaler
from lacuna.plans import sql as S
from lacuna.plans import tables as T
from lacuna.plans.q_score import CODED, scoring_frame
from lacuna.plans.registry import ORACLES, query
from lacuna.session import materialize, new_table_path
from lacuna.streaming.incremental import apply_fitted, read_stream, run_to_table
from lacuna.streaming.stateful import as_stream, closing_row, locf_stream, metrics_stream, missing_share_stream


@query(
    f"""WITH {S.PANEL}, days AS (SELECT unnest(range(0, (SELECT max(t) FROM panel) + 1)) AS t),
    users AS (SELECT user_id, (avg(view) > avg(click))::INTEGER::DOUBLE AS label FROM panel GROUP BY 1),
    seqs AS (SELECT u.user_id, {' || '.join(f"list(coalesce(p.{c}, -1) ORDER BY d.t)" for c in T.EVENT_TYPES)} AS s FROM users u CROSS JOIN days d
      LEFT JOIN panel p ON p.user_id = u.user_id AND p.t = d.t GROUP BY 1),
    known AS (SELECT user_id, s, CASE WHEN {S.u(S.key('user_id', 60))} < 0.6 THEN label END AS label FROM users JOIN seqs USING (user_id)),
    near AS (SELECT q.user_id, min({{'d': list_sum(list_transform(list_zip(q.s, x.s), lambda e: (e[1] - e[2]) * (e[1] - e[2])))
      * (len(q.s) + 1) / len(q.s), 'v': x.label}}, 5) AS five
      FROM known q JOIN known x ON q.label IS NULL AND x.label IS NOT NULL GROUP BY 1)
    SELECT user_id, p AS prob, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM (SELECT k.user_id,
      round(coalesce(k.label, list_avg(list_transform(five, lambda e: e.v))), 6) AS p FROM known k LEFT JOIN near USING (user_id))"""
)
def predict_knn_ts(spark, d):
    """Nearest-neighbour classification of padded sequences of all series: the label is the value to fill."""
    panel = T.panel(spark, d)
    days = list(range(panel.agg(F.max("t")).first()[0] + 1))  # as many columns as the longest sequence has days
    wide = flatten_panel(panel, "user_id", "t", T.EVENT_TYPES, days)
    steps = [f"{c}_t{x}" for c in T.EVENT_TYPES for x in days]
    wide = wide.withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in steps})
    labels = panel.groupBy("user_id").agg((F.avg("view") > F.avg("click")).cast("double").alias("label"))
    table = materialize(wide.join(labels, "user_id"), "sequences")
    # Every user is scored; those drawn for training keep their known label.
    known = F.when(uniform(stream_key(F.col("user_id"), 60)) < 0.6, F.col("label"))
    train = table.withColumn("label", known).filter("label IS NOT NULL")
    scored = knn_impute(table.withColumn("label", known), [*steps, "label"], "user_id", train, k=5)
    return scored.select("user_id", F.round("label", 6).alias("prob"), (F.col("label") >= 0.5).cast("int").alias("pred"))


@query("""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 9) AS o_totalprice FROM orders, b""")
def stream_fitted_transform(spark, d):
    """A scaler fitted on the table, applied to the same files as a stream."""
    scaler = MinMaxScaler.fit(T.read(spark, d, "orders"), ["o_totalprice"])
    stream = read_stream(spark, f"{d}/orders.parquet").select("o_orderkey", "o_totalprice")
    out = apply_fitted(stream, scaler.transform, "stream-scaled")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 9))


_EV = T.EVENT_TYPES
SLICES = 4


def _slices(spark, d):
    """The panel in slices of days, each row of every fifth user one slice late, and a closing row."""
    panel = T.panel(spark, d).withColumn("at", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t")).cast("timestamp")).drop("t")
    days = F.datediff("at", F.lit("2024-01-01").cast("date"))
    span = panel.agg(F.max(days) + 1).first()[0]
    late = (F.col("user_id") % 5 == 0).cast("int")
    cut = materialize(panel.withColumn("slice", F.floor(days * SLICES / span) + late), "panel-slices", ["slice"])
    parts = [cut.filter(F.col("slice") == s).drop("slice") for s in range(SLICES + 1)]
    delay = f"{2 * (span // SLICES + 1)} days"
    return [*parts, closing_row(cut.drop("slice"), "at", f"{2 * span} days")], delay


def _day(c: str = "at"):
    return F.datediff(c, F.lit("2024-01-01").cast("date"))


_LAST = "last_value({c} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {S.PANEL} SELECT user_id, t, " + ", ".join(f"{_LAST.format(c=c)} AS {c}" for c in _EV) + " FROM panel")
def stream_locf(spark, d):
    """The panel as a stream, partly out of order, filled forward with state per user: equals ``impute_locf``."""
    slices, delay = _slices(spark, d)
    filled = locf_stream(as_stream(slices, "stream-panel"), "user_id", "at", _EV, delay)
    return run_to_table(filled, "stream-locf").select("user_id", _day().alias("t"), *_EV)


@query(
    f"WITH {S.PANEL} SELECT (t - (t + 4) % 7)::INTEGER AS first_day, feature, count(*) AS n, sum(gone)::BIGINT AS missing, "
    f"round(avg(gone), 9) AS missing_share FROM ("
    + " UNION ALL ".join(f"SELECT t, '{c}' AS feature, CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS gone FROM panel" for c in _EV)
    + ") GROUP BY 1, 2"
)
def stream_missing_share(spark, d):
    """Missing cells of each series per week (weeks start on Thursdays, as the epoch), from a stream."""
    slices, delay = _slices(spark, d)
    shares = run_to_table(missing_share_stream(as_stream(slices, "stream-panel"), "at", _EV, "7 days", delay), "stream-missing")
    return shares.select(_day("window_start").alias("first_day"), "feature", "n", "missing", F.round("missing_share", 9).alias("missing_share"))


@query(ORACLES["metric_matrix"])
def stream_metrics(spark, d):
    """The metrics of ``metric_matrix`` from one streaming aggregate over several batches."""
    scored = materialize(scoring_frame(spark, d).withColumn("part", F.col("id") % 3), "scored", ["part"])
    stream = as_stream([scored.filter(F.col("part") == i).drop("part") for i in range(3)], "stream-scored", batches=3)
    states = metrics_stream(stream, CODED, ["split"], new_table_path(spark, "stream-metrics"))
    return metrics_long(states, ["split"]).withColumn("val", F.round("val", 6))
