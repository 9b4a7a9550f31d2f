"""The tables the registered queries work on, derived from the given parquet files.

``mixed``   orders joined to customers: continuous, binary and multi-category features with seeded
            nulls, next to the complete truth.
``panel``   events averaged by user and day, one column per event type: sparse by nature.
``runs`` / ``scalars``  a metric log shaped like the output of many imputation runs.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.hashing import stream_key, stream_uniforms, uniform
from lacuna.operators.encode import onehot
from lacuna.schema import FeatureSchema

CONTINUOUS = ["totalprice", "acctbal", "day"]
PRIORITIES = ["1", "2", "3", "4", "5"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NULL_COLUMNS = ["totalprice", "acctbal", "day", "recent", "priority", "segment"]
NULL_SHARE = 0.2
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

ONEHOT_COLUMNS = {
    "priority": [f"priority_{p}" for p in PRIORITIES],
    "segment": [f"segment_{s}" for s in SEGMENTS],
}
MIXED_SCHEMA = FeatureSchema(
    ids=("id",),
    continuous=tuple(CONTINUOUS),
    binary=("recent",),
    onehot={k: tuple(v) for k, v in ONEHOT_COLUMNS.items()},
    label="label",
    split="split",
    order=(*CONTINUOUS, "recent", *ONEHOT_COLUMNS["priority"], *ONEHOT_COLUMNS["segment"]),
)


@lru_cache(maxsize=None)
def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Kept per session: finding the schema of a parquet file costs a job."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mixed_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    customer = read(spark, sf_dir, "customer")
    u = uniform(stream_key(F.col("o_orderkey"), 7))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("totalprice"),
        F.col("c_acctbal").alias("acctbal"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
        .cast("double")
        .alias("day"),
        (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
        .cast("int")
        .alias("recent"),
        F.substring("o_orderpriority", 1, 1).alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.when(u < 0.30, "train").when(u < 0.60, "val").otherwise("test").alias("split"),
    )


def with_draws(truth: DataFrame) -> DataFrame:
    streams = {f"__u_{c}": 100 + i for i, c in enumerate(NULL_COLUMNS, start=1)}
    return stream_uniforms(truth, "id", streams)


def with_nulls(truth: DataFrame) -> DataFrame:
    """Remove a fifth of the cells of every feature, each by its own seeded draw."""
    drawn = with_draws(truth)
    kept = {c: F.when(F.col(f"__u_{c}") >= NULL_SHARE, F.col(c)) for c in NULL_COLUMNS}
    return drawn.withColumns(kept).select(*truth.columns)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_nulls(mixed_truth(spark, sf_dir))


def to_onehot(df: DataFrame) -> DataFrame:
    categories = {"priority": PRIORITIES, "segment": SEGMENTS}
    return onehot(df, ["priority", "segment"], categories)


def mixed_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_onehot(mixed(spark, sf_dir)).select(*MIXED_SCHEMA.keys, *MIXED_SCHEMA.features)


def truth_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_onehot(mixed_truth(spark, sf_dir)).select(*MIXED_SCHEMA.keys, *MIXED_SCHEMA.features)


def onehot_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mixed_onehot`` with the features of ``truth_onehot`` as a struct ``truth``, from a single pass over the sources."""
    truth = mixed_truth(spark, sf_dir)
    groups = {"priority": PRIORITIES, "segment": SEGMENTS}
    hits = [(F.col(c) == F.lit(v)).cast("int").alias(f"{c}_{v}") for c, values in groups.items() for v in values]
    whole = truth.withColumn("truth", F.struct(*CONTINUOUS, "recent", *hits))
    return to_onehot(with_nulls(whole)).select(*MIXED_SCHEMA.keys, *MIXED_SCHEMA.features, "truth")


CODED_SCHEMA = MIXED_SCHEMA.after_combine()


def mixed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys plus structs ``data`` (with nulls) and ``truth`` from a single pass over the sources.

    Multi-category features are ordinal codes: as one-hot columns they would take an arg-max over
    the group in every error term.
    """
    segments = F.array(*[F.lit(s) for s in SEGMENTS])
    truth = with_draws(mixed_truth(spark, sf_dir)).withColumns(
        {
            "priority": F.col("priority").cast("int") - 1,
            "segment": F.array_position(segments, F.col("segment")).cast("int") - 1,
        }
    )
    feats = CODED_SCHEMA.features
    kept = [F.when(F.col(f"__u_{c}") >= NULL_SHARE, F.col(c)).alias(c) for c in feats]
    return truth.select(*CODED_SCHEMA.keys, F.struct(*kept).alias("data"), F.struct(*feats).alias("truth"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    t = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return events.groupBy("user_id", t.alias("t")).agg(
        *[
            F.round(F.avg(F.when(F.col("event_type") == e, F.col("value"))), 6).alias(e)
            for e in EVENT_TYPES
        ]
    )


METHODS = ["simple", "knn", "vanilla", "vae"]
FEATURE_MAPS = ["none", "discretize_continuous", "target_encode_categorical"]
MECHANISMS = ["MCAR", "MAR", "MNAR", "MNAR(G)", "MNAR(Y)"]


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    mechanism = _pick(MECHANISMS, n % 5)
    return s.select(
        k.alias("run_id"),
        F.when(k % 10 == 0, "FAILED").otherwise("FINISHED").alias("status"),
        _pick(METHODS, k % 4).alias("method"),
        _pick(FEATURE_MAPS, F.floor(k / 4) % 3).alias("feature_map"),
        mechanism.alias("mechanism"),
        F.when(n % 2 == 0, "sigmoid-mid").otherwise("sigmoid-tail").alias("score_fn"),
        F.when(k % 2 == 0, 0.33).otherwise(0.66).alias("percent_missing"),
        F.when(k % 3 == 0, "True").otherwise("False").alias("bootstrap"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=k.cast("int"))).alias(
            "start_time"
        ),
        F.concat(
            F.lit("[{'incomplete_vars': ['totalprice', 'day'], 'mechanism': '"),
            mechanism,
            F.lit("', 'weights': {'acctbal': 1"),
            F.when(n % 2 == 0, ", 'recent': 0.5").otherwise(""),
            F.lit("}}]"),
        ).alias("pattern"),
    )


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, step, tag, val: one row per logged scalar."""
    li = read(spark, sf_dir, "lineitem")
    r = F.col("l_returnflag") == "R"
    wide = li.groupBy(
        F.col("l_suppkey").alias("run_id"),
        F.col("l_linenumber").alias("step"),
        F.when(F.col("l_linestatus") == "O", "train").otherwise("test").alias("part"),
    ).agg(
        F.round(F.avg("l_discount"), 6).alias("original/all/CW/mixed/RMSE"),
        F.round(F.avg("l_tax"), 6).alias("original/all/EW/mixed/RMSE"),
        F.round(F.avg(F.when(r, F.col("l_discount"))), 6).alias("original/missingonly/CW/mixed/RMSE"),
        F.round(F.avg(F.when(r, F.col("l_tax"))), 6).alias("original/missingonly/EW/mixed/RMSE"),
        F.round(F.avg("l_discount") * 2, 6).alias("original/all/CW/mixed/MAAPE"),
        F.round(F.avg(F.col("l_quantity") / 50), 6).alias("original/all/CW/continuous/RMSE"),
        F.round(F.avg(F.when(r, F.col("l_quantity") / 50)), 6).alias("mapped/all/CW/categorical/MAAPE"),
        F.round(F.min("l_tax"), 6).alias("mapped/all/CW/mixed/MAAPE"),
        F.round(F.max("l_extendedprice") / 1000, 6).alias("epoch_duration_sec"),
        F.round(F.avg("l_extendedprice") / 100000, 6).alias("system/cpu_utilization"),
    )
    names = [c for c in wide.columns if c not in ("run_id", "step", "part")]
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("val")) for c in names])
    long = wide.select("run_id", "step", "part", F.inline(pairs))
    return long.select(
        "run_id",
        "step",
        F.when(F.col("name").startswith("system/"), F.col("name"))
        .otherwise(F.concat_ws("/", "part", "name"))
        .alias("tag"),
        "val",
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished runs joined to their scalars, tag parts as columns."""
    from lacuna.operators.results import join_runs, split_tag

    joined = join_runs(runs(spark, sf_dir), scalars(spark, sf_dir))
    return split_tag(joined.filter((F.col("status") == "FINISHED") & F.col("val").isNotNull()))
