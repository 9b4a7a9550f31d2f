"""Wide, long, padded and nested forms of panels."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD_VALUE = -1


def parse_panel_columns(columns: list[str], pattern: str) -> dict[str, tuple[str, str]]:
    """Column name -> (time, feature) for names that carry a time point; others are left out.

    ``pattern`` has the named groups ``time``, ``lab`` and ``stat``.
    """
    out = {}
    for c in columns:
        m = re.search(pattern, c)
        if m and m.group("time"):
            parts = [m.group("lab"), m.group("stat")]
            out[c] = (m.group("time"), "_".join(p for p in parts if p))
    return out


def flat_to_long(df: DataFrame, entity: str, pattern: str) -> DataFrame:
    """One row per (entity, time) with one column per feature.

    All values of a row are emitted as one narrow array and regrouped by (entity, time): a single
    pass, instead of one melt and one outer join per feature. Every time point a feature has a
    column for yields a row, also when its value is missing.
    """
    parsed = parse_panel_columns(df.columns, pattern)
    times = sorted({t for t, _ in parsed.values()})
    features = sorted({f for _, f in parsed.values()})
    source = {tf: c for c, tf in parsed.items()}
    rows = [
        F.struct(
            F.lit(t).alias("time"),
            *[
                (F.col(f"`{source[t, f]}`") if (t, f) in source else F.lit(None))
                .cast("double")
                .alias(f)
                for f in features
            ],
        )
        for t in times
    ]
    # A flat row already holds all the features of its time points: no shuffle is needed.
    return df.select(entity, F.inline(F.array(*rows)))


def static_part(df: DataFrame, pattern: str) -> DataFrame:
    longitudinal = parse_panel_columns(df.columns, pattern)
    return df.select(*[c for c in df.columns if c not in longitudinal])


def flatten_panel(
    df: DataFrame, entity: str, time: str, features: list[str], times: list, label: str = "t"
) -> DataFrame:
    """(entity, time) rows to one wide row per entity, ``{feature}_{label}{time}``."""
    cells = [
        F.max(F.when(F.col(time) == F.lit(x), F.col(f))).alias(f"{f}_{label}{x}")
        for f in features
        for x in times
    ]
    return df.groupBy(entity).agg(*cells)


def melt(df: DataFrame, keys: list[str], features: list[str], name: str = "feature") -> DataFrame:
    return df.unpivot(keys, features, name, "value")


def long_to_wide(
    df: DataFrame, keys: list[str], feature: str, value: str, features: list[str]
) -> DataFrame:
    """One row per key, features as columns; partial aggregation happens before the shuffle."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(feature) == f, F.col(value))).alias(f) for f in features]
    )


def pad_sequences(
    df: DataFrame, entity: str, time: str, features: list[str], length: int | None = None
) -> DataFrame:
    """Every entity gets steps 0..length-1; steps past its last row hold the pad value.

    Adds ``step`` and ``seq_len``. Missing values inside a sequence stay missing. The step of a row
    is its rank within the entity, taken with ``dense_steps``.
    """
    ranked = dense_steps(df, entity, time)
    lengths = df.groupBy(entity).agg(F.count(F.lit(1)).cast("int").alias("seq_len"))
    if length is None:
        length = lengths.agg(F.max("seq_len")).first()[0] or 0
    # Only the padding rows are generated; existing rows are passed through without a join.
    padding = lengths.filter(F.col("seq_len") < length).select(
        entity,
        "seq_len",
        F.explode(F.sequence(F.col("seq_len"), F.lit(length - 1))).alias("step"),
        *[F.lit(float(PAD_VALUE)).alias(f) for f in features],
    )
    body = ranked.join(lengths, entity).select(
        entity, "seq_len", "step", *[F.col(f).cast("double").alias(f) for f in features]
    )
    return body.unionByName(padding)


def dense_steps(df: DataFrame, entity: str, time: str) -> DataFrame:
    """``step``: 0-based rank of a row within its entity by time."""
    from lacuna.operators.ranking import grouped_rank

    return grouped_rank(df, [entity], time, "step").withColumn(
        "step", (F.col("step") - 1).cast("int")
    )


def nest_sequences(df: DataFrame, entity: str, time: str, features: list[str]) -> DataFrame:
    """One row per entity, an ordered array per feature.

    The nested row is the result asked for, so its size is the length of the sequence.
    """
    seq = F.sort_array(F.collect_list(F.struct(time, *features)))
    nested = df.groupBy(entity).agg(seq.alias("seq"))
    return nested.select(entity, *[F.col(f"seq.{f}").alias(f) for f in features])


def sequence_length_check(df: DataFrame, entity: str) -> DataFrame:
    """min and max length and whether all sequences are equally long."""
    n = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("min_len"), F.max("n").alias("max_len")).withColumn(
        "equal_length", F.col("min_len") == F.col("max_len")
    )
