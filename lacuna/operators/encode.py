"""One-hot columns and their inverses, as plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CATEGORIES = 10_000


def categories_of(df: DataFrame, columns: list[str]) -> dict[str, list]:
    """Sorted distinct values of each column, in one pass.

    The values become column names, so a column with more than ``MAX_CATEGORIES`` is refused
    before anything is collected.
    """
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    wide = [c for c in columns if row[c] > MAX_CATEGORIES]
    if wide:
        raise ValueError(f"too many categories to one-hot: {wide}")
    pairs = F.array(
        *[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]
    )
    found = df.select(F.inline(pairs)).filter(F.col("v").isNotNull()).distinct().collect()
    return {c: sorted(r.v for r in found if r.c == c) for c in columns}


def onehot(
    df: DataFrame,
    columns: list[str],
    categories: dict[str, list] | None = None,
    keep_null: bool = True,
) -> DataFrame:
    """Replace columns by ``prefix_value`` indicators appended at the end.

    ``keep_null`` leaves the whole group missing where the source is missing; otherwise the group
    is all zeros there.
    """
    categories = categories or categories_of(df, columns)
    indicators = []
    for c in columns:
        for v in categories[c]:
            hit = (F.col(c).cast("string") == F.lit(str(v))).cast("int")
            indicators.append((hit if keep_null else F.coalesce(hit, F.lit(0))).alias(f"{c}_{v}"))
    return df.select(*[c for c in df.columns if c not in columns], *indicators)


def explode_nulls(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Any member of a one-hot group missing makes the whole group missing."""
    out = {}
    for cols in groups.values():
        complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        out.update({c: F.when(complete, F.col(c)) for c in cols})
    return df.withColumns(out) if out else df


def argmax(cols: list[Column]) -> Column:
    """Position of the largest value, the first on ties; missing if any member is missing."""
    complete = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    values = F.array(*[c.cast("double") for c in cols])
    return F.when(complete, F.array_position(values, F.array_max(values)) - 1).cast("int")


def combine_onehots(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """One ordinal column per group, appended at the end; an all-zero group gives 0."""
    members = {c for cols in groups.values() for c in cols}
    codes = [argmax([F.col(c) for c in cols]).alias(p) for p, cols in groups.items()]
    return df.select(*[c for c in df.columns if c not in members], *codes)


def uncombine_onehots(
    df: DataFrame, groups: dict[str, list[str]], order: list[str] | None = None
) -> DataFrame:
    """Inverse of ``combine_onehots``, in the original column order if given."""
    indicators = [
        (F.col(p) == F.lit(k)).cast("int").alias(c)
        for p, cols in groups.items()
        for k, c in enumerate(cols)
    ]
    out = df.select(*[c for c in df.columns if c not in groups], *indicators)
    return out.select(*order) if order else out


def uniform_probability(df: DataFrame, groups: dict[str, list[str]], binary: list[str] = ()) -> DataFrame:
    """Missing groups become 1/k on each of their k members, missing binaries 0.5."""
    out = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.5)) for c in binary}
    for cols in groups.values():
        share = F.lit(1.0 / len(cols))
        out.update({c: F.coalesce(F.col(f"`{c}`").cast("double"), share) for c in cols})
    return df.withColumns(out)


def binary_threshold(df: DataFrame, columns: list[str]) -> DataFrame:
    """sigmoid(x) >= 0.5, which is x >= 0."""
    return df.withColumns({c: (F.col(f"`{c}`") >= 0).cast("int") for c in columns})


def onehot_threshold(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """The largest logit of each group becomes 1, the first one on ties."""
    best = {f"__best{i}": argmax([F.col(f"`{c}`") for c in cols]) for i, cols in enumerate(groups.values())}
    out = {c: (F.col(f"__best{i}") == k).cast("int") for i, cols in enumerate(groups.values()) for k, c in enumerate(cols)}
    # The positions are columns of their own: one search a row and group, however many members it has.
    return df.withColumns(best).withColumns(out).drop(*best)
