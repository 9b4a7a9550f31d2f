"""Checks on a metric log; each returns the violating rows, so an empty result means it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = ["run_id", "split", "step"]
SLOT = ["feature_space", "reduction", "feature_type", "metric_name"]


def _cell(column: str, value: str):
    """The value where ``column`` is ``value``; one grouping replaces a self join."""
    return F.max(F.when(F.col(column) == value, F.col("val")))


def all_below_missing_only(log: DataFrame) -> DataFrame:
    """The error over all cells is below the one over missing cells, and both are logged."""
    out = log.groupBy(*RUN, *SLOT).agg(
        _cell("filter_subgroup", "all").alias("v_all"),
        _cell("filter_subgroup", "missingonly").alias("v_missing"),
    )
    return out.filter(~F.coalesce(F.col("v_all") < F.col("v_missing"), F.lit(False)))


def no_zero_mixed(log: DataFrame) -> DataFrame:
    return log.filter((F.col("feature_type") == "mixed") & (F.col("val") == 0)).select(
        *RUN, "filter_subgroup", *SLOT
    )


def rmse_differs_from_maape(log: DataFrame) -> DataFrame:
    """The two errors are never equal, unless both are 0."""
    keys = [*RUN, "filter_subgroup", "feature_space", "reduction", "feature_type"]
    out = log.groupBy(*keys).agg(
        _cell("metric_name", "RMSE").alias("rmse"), _cell("metric_name", "MAAPE").alias("maape")
    )
    return out.filter((F.col("rmse") == F.col("maape")) & (F.col("rmse") != 0))


def share_cw_equals_ew(log: DataFrame) -> DataFrame:
    keys = [*RUN, "filter_subgroup", "feature_space", "feature_type"]
    out = log.filter(F.col("metric_name") == "RMSE").groupBy(*keys).agg(
        _cell("reduction", "CW").alias("cw"), _cell("reduction", "EW").alias("ew")
    )
    both = out.filter(F.col("cw").isNotNull() & F.col("ew").isNotNull())
    return both.agg(F.avg((F.col("cw") == F.col("ew")).cast("double")).alias("share"))


def mapped_space(log: DataFrame, feature_map: str, zero_type: str, equal_type: str) -> DataFrame:
    """In mapped space ``zero_type`` errors are 0 and the mixed error equals the one of ``equal_type``.

    Discretised data is all categorical, target-encoded data all continuous.
    """
    kept = log.filter((F.col("feature_map") == feature_map) & (F.col("feature_space") == "mapped"))
    out = kept.groupBy(*RUN, "filter_subgroup", "reduction", "metric_name").agg(
        _cell("feature_type", zero_type).alias("v_zero"),
        _cell("feature_type", equal_type).alias("v_equal"),
        _cell("feature_type", "mixed").alias("v_mixed"),
    )
    return out.filter(
        F.coalesce(F.col("v_zero") != 0, F.lit(False))
        | F.coalesce(F.col("v_mixed") != F.col("v_equal"), F.lit(False))
    )


def discretized(log: DataFrame) -> DataFrame:
    return mapped_space(log, "discretize_continuous", "continuous", "categorical")


def target_encoded(log: DataFrame) -> DataFrame:
    return mapped_space(log, "target_encode_categorical", "categorical", "continuous")


def equal_log_counts(log: DataFrame, keys: list[str]) -> DataFrame:
    """Groups logged once only, or less often than the most often logged one."""
    n = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return n.join(F.broadcast(most)).filter((F.col("n") <= 1) | (F.col("n") != F.col("most")))


def same_metric_set(log: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose set of metrics is not the full set."""
    slot = F.concat_ws("/", "filter_subgroup", *SLOT)
    per_group = log.groupBy(*keys).agg(F.countDistinct(slot).alias("n_metrics"))
    full = log.agg(F.countDistinct(slot).alias("n_full"))
    return per_group.join(F.broadcast(full)).filter("n_metrics != n_full")
