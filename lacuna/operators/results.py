"""Result tables: runs joined to scalars, tags, patterns, pivots, interval roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG_PARTS = ["split", "feature_space", "filter_subgroup", "reduction", "feature_type", "metric_name"]


def join_runs(runs: DataFrame, scalars: DataFrame) -> DataFrame:
    """One run to many scalars. Runs without scalars are kept.

    The scalars side holds the volume and the skew, so it stays where it is when the run table is
    small enough to be sent to it; Catalyst decides by the size of the scan.
    """
    return runs.join(scalars, "run_id", "left")


def filter_metrics(
    df: DataFrame,
    status: str | None = "FINISHED",
    include: list[str] = (),
    exclude: list[str] = (),
    tag: str = "tag",
    value: str = "val",
) -> DataFrame:
    out = df.filter(F.col(value).isNotNull())
    if status is not None:
        out = out.filter(F.col("status") == status)
    if include:
        out = out.filter(F.col(tag).rlike("|".join(include)))
    if exclude:
        out = out.filter(~F.col(tag).rlike("|".join(exclude)))
    return out


def split_tag(df: DataFrame, tag: str = "tag", parts: list[str] = TAG_PARTS) -> DataFrame:
    """Packed tag to columns; tags with another number of parts are dropped."""
    pieces = F.split(F.col(tag), "/")
    out = df.filter(F.size(pieces) == len(parts))
    return out.withColumns({p: pieces.getItem(i) for i, p in enumerate(parts)}).drop(tag)


def expand_pattern(df: DataFrame, pattern: str = "pattern") -> DataFrame:
    """First scenario of a quoted pattern list as columns, with counts of its variables."""
    schema = "array<struct<incomplete_vars:array<string>,mechanism:string,score_to_probability_func:string,weights:map<string,double>>>"
    first = F.from_json(F.regexp_replace(F.col(pattern), "'", '"'), schema).getItem(0)
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return df.withColumn("__p", first).select(
        *[c for c in df.columns if c not in (pattern, "mechanism")],
        F.col("__p.mechanism").alias("mechanism"),
        F.concat_ws(",", "__p.incomplete_vars").alias("incomplete_vars"),
        n(F.col("__p.incomplete_vars")).alias("n_incomplete"),
        n(F.col("__p.weights")).alias("n_observed"),
    )


def results_pivot(df: DataFrame, rows: list[str], column: str, values: list[str], value: str = "val") -> DataFrame:
    """Mean of ``value`` per cell. Listing the columns saves the extra pass that would find them."""
    return df.groupBy(*rows).agg(
        *[F.avg(F.when(F.col(column) == v, F.col(value))).alias(v) for v in values]
    )


def custom_order(col: Column, order: list[str]) -> Column:
    """1-based position in ``order``; values not listed come last."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), col)
    return F.when(F.coalesce(pos, F.lit(0)) == 0, F.lit(len(order) + 1)).otherwise(pos).cast("int")


def first_last_per_group(
    df: DataFrame, keys: list[str], value: str, order: list[str], last: bool = False
) -> DataFrame:
    """First (or last) non-missing value of each group by an explicit order; missing keys are kept."""
    rank = F.struct(*order)
    pick = F.max_by if last else F.min_by
    chosen = F.when(F.col(value).isNotNull(), rank)
    return df.groupBy(*keys).agg(pick(value, chosen).alias(value))


def ci_by_group(df: DataFrame, keys: list[str], value: str = "val", z: float = 1.96) -> DataFrame:
    """mean, standard error and mean +/- z standard errors per group; missing keys are kept."""
    sem = F.stddev_samp(value) / F.sqrt(F.count(value))
    out = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), sem.alias("sem"), F.max("step").alias("max_step")
    )
    return out.withColumns(
        {"lower": F.col("mean") - z * F.col("sem"), "upper": F.col("mean") + z * F.col("sem")}
    )


def full_bootstrap_only(ci: DataFrame, last_step: int = 99) -> DataFrame:
    return ci.filter(F.col("max_step") == last_step)


def best_per_group(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The row with the smallest value of each group, smallest ``tie`` on equal values.

    A minimum over structs aggregates before the shuffle, so a large group costs nothing extra.
    """
    others = [c for c in df.columns if c not in {*keys, value, tie}]
    best = F.min(F.struct(value, tie, *others)).alias("best")
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(best).select(*keys, "best.*")


def group_sizes(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.concat_ws(",", F.sort_array(F.collect_set(item))).alias("items"),
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All copies of rows sharing a key, missing keys being equal.

    Counting aggregates before the shuffle; the semi join keeps a hot key splittable, which a
    window over the key would not.
    """
    many = df.groupBy(*keys).count().filter("count > 1")
    many = many.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return df.join(many, cond, "left_semi")
