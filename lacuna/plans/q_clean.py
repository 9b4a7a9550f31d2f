"""Sources, filters, flags and labels."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lacuna.operators import clean as C
from lacuna.operators import results as R
from lacuna.operators.reshape import melt
from lacuna.plans import sql as S
from lacuna.plans import tables as T
from lacuna.plans.registry import query
from lacuna.session import new_table_path
from lacuna.sources.files import read_feather, write_feather
from lacuna.sources.loader import FeatureSource

_F = ", ".join(S.FEATS)


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def scan_features(spark, d):
    return T.read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, l_returnflag FROM lineitem")
def arrow_scan(spark, d):
    """Line items written as Arrow files and read again by record batch, five of their columns."""
    folder = new_table_path(spark, "arrow")
    write_feather(T.read(spark, d, "lineitem"), folder)
    kinds = {f.name: f for f in T.read(spark, d, "lineitem").schema}
    return read_feather(spark, folder, StructType([kinds[c] for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag")]))


@query(f"WITH {S.MIXED} SELECT id, label FROM mixed")
def split_label(spark, d):
    source = FeatureSource(
        T.mixed(spark, d), ["id"], "label", continuous=T.CONTINUOUS, split_col="split"
    )
    return source.labels()


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 21 AND s_acctbal < 5000")
def filter_range(spark, d):
    s = T.read(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return C.filter_range(s, "s_acctbal", at_least=21, below=5000)


@query(f"WITH {S.MIXED} SELECT id, totalprice FROM mixed WHERE totalprice < 200000")
def filter_range_nulls(spark, d):
    return C.filter_range(T.mixed(spark, d), "totalprice", below=200000).select("id", "totalprice")


@query(
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,"
    " l_tax FROM lineitem"
)
def select_numeric(spark, d):
    return C.select_numeric(T.read(spark, d, "lineitem"))


@query(
    f"WITH {S.BOTH_OH} SELECT "
    + ", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS {c}" for c in S.FEATS)
    + " FROM oh"
)
def missing_share(spark, d):
    shares = C.missing_shares(T.mixed_onehot(spark, d), S.FEATS)
    return shares.select(*[F.round(c, 6).alias(c) for c in S.FEATS])


@query(
    f"""WITH {S.PANEL}, long AS (UNPIVOT panel ON {', '.join(T.EVENT_TYPES)} INTO NAME feature VALUE v),
    n AS (SELECT count(*) AS n FROM panel)
    SELECT feature, count(*) AS observed FROM long, n GROUP BY 1 HAVING 1 - count(*) / max(n.n) < 0.6"""
)
def drop_highly_missing(spark, d):
    """Observed cells of the panel columns kept under a missing share of 0.6."""
    kept = C.drop_highly_missing(T.panel(spark, d).select(*T.EVENT_TYPES), 0.6)
    long = melt(kept, [], kept.columns).filter(F.col("value").isNotNull())
    return long.groupBy("feature").agg(F.count("value").alias("observed"))


@query(
    f"WITH {S.MIXED} SELECT id, totalprice, acctbal, day, priority, label, split FROM mixed "
    "WHERE segment = 'BUILDING' AND recent = 1"
)
def filter_subgroup(spark, d):
    return C.filter_subgroup(T.mixed(spark, d), {"segment": "BUILDING", "recent": 1})


FLAT = (
    "flat AS (SELECT user_id, "
    + ", ".join(
        f"round(max(CASE WHEN event_type = '{e}' AND w = {w} THEN value END), 6) AS {e}_{p}_max, "
        f"CAST(count(CASE WHEN event_type = '{e}' AND w = {w} THEN value END) AS DOUBLE) AS {e}_{p}_count"
        for e in T.EVENT_TYPES
        for w, p in enumerate(["entry_period", "year1", "year2", "year10"])
    )
    + " FROM (SELECT user_id, event_type, value, least(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 8, 3) AS w"
    " FROM events) GROUP BY user_id)"
)
PERIODS = ["entry_period", "year1", "year2", "year10"]
FLAT_PATTERN = r"^(?P<lab>[a-z]+)_(?P<time>entry_period|year\d+)_(?P<stat>max|count)$"


def flat_registry(spark, d):
    """One wide row per user, columns ``{lab}_{time}_{stat}``; the last period has no end."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    events = T.read(spark, d, "events").withColumn("w", F.least(F.floor(day / 8), F.lit(len(PERIODS) - 1)))
    cells = []
    for e in T.EVENT_TYPES:
        for w, p in enumerate(PERIODS):
            v = F.when((F.col("event_type") == e) & (F.col("w") == w), F.col("value"))
            cells.append(F.round(F.max(v), 6).alias(f"{e}_{p}_max"))
            cells.append(F.count(v).cast("double").alias(f"{e}_{p}_count"))
    return events.groupBy("user_id").agg(*cells)


@query(
    f"WITH {FLAT} SELECT user_id, "
    + ", ".join(f"{e}_{p}_{s}" for e in T.EVENT_TYPES for p in ("year1", "year2") for s in ("max", "count"))
    + " FROM flat"
)
def time_window_cols(spark, d):
    return C.filter_time_window(flat_registry(spark, d), 1, 2)


@query(
    f"WITH {FLAT} SELECT user_id, "
    + ", ".join(
        f"{e}_{p}_{s} AS {e}_{p}_{'click_max' if (e, s) == ('click', 'max') else s}"
        for e in T.EVENT_TYPES
        for p in PERIODS
        for s in ("max", "count")
    )
    + " FROM flat"
)
def rename_columns(spark, d):
    return C.rename_by_regex(flat_registry(spark, d), r"^click_(\w+)_max$", r"click_\1_click_max")


@query("SELECT user_id AS patient_id, ts AS \"Time\", value FROM events")
def canonical_keys(spark, d):
    events = T.read(spark, d, "events").select("user_id", "ts", "value")
    return C.canonical_keys(events, "user_id", "ts")


@query(f"WITH {S.BOTH_OH} SELECT * FROM oh WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in S.FEATS))
def fully_observed(spark, d):
    return C.fully_observed(T.mixed_onehot(spark, d), S.FEATS)


@query(f"WITH {S.BOTH_OH} SELECT * FROM oh WHERE " + " OR ".join(f"{c} IS NULL" for c in S.FEATS))
def semi_observed(spark, d):
    return C.semi_observed(T.mixed_onehot(spark, d), S.FEATS)


@query(
    f"WITH {S.BOTH_OH} SELECT bool_or("
    + " OR ".join(f"{c} IS NULL" for c in S.FEATS)
    + ") AS semi_observed FROM oh"
)
def any_missing(spark, d):
    return C.any_missing(T.mixed_onehot(spark, d), S.FEATS)


@query(
    f"""WITH {S.MIXED} SELECT id, label, totalprice FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS rn FROM mixed) WHERE rn <= 500"""
)
def balanced_limit(spark, d):
    from lacuna.operators.splits import balanced_limit as limit

    return limit(T.mixed(spark, d), "label", "id", 1000).select("id", "label", "totalprice")


@query(
    f"""WITH {S.BOTH_OH} SELECT id, CASE WHEN coalesce(recent = 1, false) OR coalesce(priority_1 = 1, false)
    THEN 1 ELSE 0 END AS flagged FROM oh"""
)
def any_flag(spark, d):
    df = T.mixed_onehot(spark, d).select("id", "recent", "priority_1")
    return C.any_flag(df, ["recent", "priority_1"], "flagged")


@query(
    f"""WITH {FLAT} SELECT user_id, CASE WHEN coalesce(click_year2_max <= 0.6 * click_entry_period_max, false)
    THEN 1 ELSE 0 END AS decline FROM flat"""
)
def derived_label(spark, d):
    label = C.decline_label(F.col("click_year2_max"), F.col("click_entry_period_max"))
    return flat_registry(spark, d).select("user_id", label.alias("decline"))


@query(
    f"""WITH {S.MIXED} SELECT id, label FROM mixed WHERE id IN
    (SELECT id FROM mixed WHERE totalprice >= 100000)"""
)
def align_labels(spark, d):
    df = T.mixed(spark, d)
    return C.align_labels(df.select("id", "label"), C.filter_range(df, "totalprice", 100000), "id")


@query(f"WITH {S.BOTH_OH} SELECT id, " + ", ".join(f"{c} IS NULL AS {c}" for c in S.FEATS) + " FROM oh")
def missing_mask(spark, d):
    return C.missing_mask(T.mixed_onehot(spark, d), S.FEATS, ["id"])


@query("SELECT DISTINCT user_id FROM events")
def entity_ids(spark, d):
    return C.entity_ids(T.read(spark, d, "events"), "user_id")


@query(
    f"""WITH {S.RUNS}, {S.SCALARS} SELECT run_id, step, tag, val FROM runs LEFT JOIN scalars USING (run_id)
    WHERE status = 'FINISHED' AND val IS NOT NULL AND regexp_matches(tag, 'RMSE$|MAAPE$')
    AND NOT regexp_matches(tag, '^system/|epoch_duration') AND bootstrap = 'True'"""
)
def filter_metrics(spark, d):
    joined = R.join_runs(T.runs(spark, d), T.scalars(spark, d)).filter(
        C.parse_bool(F.col("bootstrap"))
    )
    kept = R.filter_metrics(
        joined, include=["RMSE$", "MAAPE$"], exclude=["^system/", "epoch_duration"]
    )
    return kept.select("run_id", "step", "tag", "val")


@query(
    f"""WITH {S.RUNS} SELECT run_id, start_time FROM runs
    WHERE start_time >= TIMESTAMP '2024-01-01 12:00:00' AND start_time < TIMESTAMP '2024-01-03 00:00:00'"""
)
def time_range(spark, d):
    runs = T.runs(spark, d).select("run_id", "start_time")
    return C.filter_time_range(runs, "start_time", datetime(2024, 1, 1, 12), datetime(2024, 1, 3))


@query(
    f"""WITH {S.RUNS} SELECT run_id, CASE method WHEN 'simple' THEN 'Mean/Mode' WHEN 'knn' THEN 'KNN'
    WHEN 'vae' THEN 'VAE' ELSE method END AS method FROM runs"""
)
def value_map(spark, d):
    names = {"simple": "Mean/Mode", "knn": "KNN", "vae": "VAE"}
    return C.map_values(T.runs(spark, d).select("run_id", "method"), "method", names)


@query(
    f"""WITH {FLAT} SELECT user_id, {', '.join(f'{e}_year1_{s}' for e in T.EVENT_TYPES for s in ('max', 'count'))}
    FROM flat WHERE click_entry_period_count = 1"""
)
def prepare_adhoc(spark, d):
    """Subgroup, then time window, then highly missing columns (shares after the row filter)."""
    flat = C.filter_subgroup(flat_registry(spark, d), {"click_entry_period_count": 1.0})
    return C.drop_highly_missing(C.filter_time_window(flat, 1, 1), 0.95)


@query(
    f"""WITH {S.MIXED} SELECT id, CASE WHEN coalesce(recent = 1, false) THEN 1 ELSE 0 END AS any_recent,
    {S.ONEHOT_PLAIN}, CASE WHEN coalesce(totalprice <= 0.6 * 300000, false) THEN 1 ELSE 0 END AS low_price
    FROM mixed WHERE acctbal < 5000"""
)
def prepare_table(spark, d):
    """Any-of flag, plain one-hot, range filter, derived label, in that order."""
    from lacuna.operators.encode import onehot

    df = C.any_flag(T.mixed(spark, d), ["recent"], "any_recent")
    df = onehot(df, ["priority", "segment"], keep_null=False)
    df = C.filter_range(df, "acctbal", below=5000)
    df = df.withColumn("low_price", C.decline_label(F.col("totalprice"), F.lit(300000.0)))
    return df.drop("totalprice", "acctbal", "day", "label", "split")
