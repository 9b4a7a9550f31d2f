"""Joins between panels, static tables and aligned copies of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.session import materialize


def outer_join_panels(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join on (entity, time): every key present in any frame is kept.

    All joins share the keys, so the partitioning of the first is reused by the others.
    """
    return reduce(lambda a, b: a.join(b, keys, "full"), frames)


def static_join(static: DataFrame, panel: DataFrame, key: str) -> DataFrame:
    """Inner join of a static table with its panel; static rows repeat.

    No hint: Catalyst broadcasts the static side when its size allows, and AQE splits hot keys of
    the panel side otherwise.
    """
    return panel.join(static, key, "inner")


def concat_columns(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "inner")


def self_joined(df: DataFrame, keys: list[str], sides: list[list[str]]) -> DataFrame:
    """The join by ``keys`` of the column lists ``sides`` of one table, together all its other columns.

    A row whose key comes once is its own partner; only keys that repeat are joined.
    """
    df = df.dropna(subset=keys)
    many = materialize(df.groupBy(*keys).count().filter("count > 1").select(*keys), "many-keys")
    if many.isEmpty():
        return df
    repeated = df.join(many, keys, "left_semi")
    parts = [repeated.select(*keys, *side) for side in sides]
    return df.join(many, keys, "left_anti").unionByName(reduce(lambda a, b: a.join(b, keys), parts).select(*df.columns))


def rows_of_split(df: DataFrame, split: str, split_col: str = "split") -> DataFrame:
    return df.filter(F.col(split_col) == split)


def keep_observed(data: DataFrame, filled: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Cellwise: the observed value where there is one, else the value of ``filled``."""
    other = filled.select(*keys, *[F.col(f).alias(f"__f_{f}") for f in features])
    carried = [c for c in data.columns if c not in {*keys, *features}]
    return data.join(other, keys, "inner").select(
        *keys, *carried, *[F.coalesce(F.col(f), F.col(f"__f_{f}")).alias(f) for f in features]
    )


def scoring_frame(
    truth: DataFrame, pred: DataFrame, data: DataFrame, keys: list[str], features: list[str]
) -> DataFrame:
    """keys plus structs ``truth``, ``pred`` and ``missing`` for the metrics."""
    t = truth.select(*keys, F.struct(*features).alias("truth"))
    p = pred.select(*keys, F.struct(*features).alias("pred"))
    m = data.select(*keys, F.struct(*[F.col(f).isNull().alias(f) for f in features]).alias("missing"))
    return t.join(p, keys).join(m, keys)
