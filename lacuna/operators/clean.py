"""Row filters, column filters, renames, flags and labels.

NULL is the only missing marker inside the library; ``nan_to_null`` is the one place where NaN from
files is converted. A comparison with a missing value counts as false.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column-name characters and what replaces them.
NAME_REPLACEMENTS = {"&": "and", "+": "plus", ",": "", "'": "", "(": "__", ")": "__", "%": "_PRCNT"}


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats})


def bools_to_int(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: F.col(c).cast("int") for c in names}) if names else df


def drop_listed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns; naming one that is not there is an error."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"columns not found: {absent}")
    return df.drop(*columns)


def drop_matching(df: DataFrame, pattern: str = r"^Unnamed") -> DataFrame:
    return df.select(*[c for c in df.columns if not re.search(pattern, c)])


def _false_if_null(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def filter_range(
    df: DataFrame, col: str, at_least: float | None = None, below: float | None = None
) -> DataFrame:
    """Keep ``at_least <= col < below``. Rows with a missing value go."""
    if at_least is not None:
        df = df.filter(F.col(col) >= at_least)
    if below is not None:
        df = df.filter(F.col(col) < below)
    return df


def filter_time_range(
    df: DataFrame, col: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Half-open time range; an absent bound is open."""
    kind = df.schema[col].dataType
    if start is not None:
        df = df.filter(F.col(col) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.filter(F.col(col) < F.lit(end).cast(kind))
    return df


def select_numeric(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    return df.select(
        *[f.name for f in df.schema if f.name in keep or isinstance(f.dataType, T.NumericType)]
    )


def missing_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, one share per column, in a single pass."""
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])


def drop_highly_missing(
    df: DataFrame, threshold: float = 0.8, columns: list[str] | None = None
) -> DataFrame:
    """Keep a column if its share of missing values is strictly below ``threshold``."""
    columns = columns or df.columns
    shares = missing_shares(df, columns).first().asDict()
    # A table without rows has no share; nothing is dropped then.
    gone = {c for c, s in shares.items() if s is not None and s >= threshold}
    return df.select(*[c for c in df.columns if c not in gone])


def filter_subgroup(df: DataFrame, conditions: dict[str, object] | None) -> DataFrame:
    """Keep rows equal on every condition and drop the columns used. No condition: unchanged."""
    if not conditions:
        return df
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in conditions.items()])
    return df.filter(cond).drop(*conditions)


def time_window_columns(columns: list[str], first: int, last: int) -> list[str]:
    """Columns to keep: those naming a year outside [first, last] go; entry is year 0.

    The time point is matched as a whole name token, so ``year1`` is not part of ``year10``.
    """
    keep = []
    for c in columns:
        years = [int(y) for y in re.findall(r"(?:^|_)year(\d+)(?=_|$)", c)]
        if re.search(r"(?:^|_)entry_period(?=_|$)", c):
            years.append(0)
        if all(first <= y <= last for y in years):
            keep.append(c)
    return keep


def filter_time_window(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.select(*time_window_columns(df.columns, first, last))


def rename_by_regex(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    return df.withColumnsRenamed({c: re.sub(pattern, replacement, c) for c in df.columns})


def clean_names(df: DataFrame, strip_all: bool = False) -> DataFrame:
    """Replace special characters in column names, or strip everything but letters, digits, ``_``."""
    names = []
    for c in df.columns:
        for old, new in NAME_REPLACEMENTS.items():
            c = c.replace(old, new)
        names.append(re.sub(r"[^A-Za-z0-9_]+", "", c) if strip_all else c)
    if len(set(names)) != len(names):
        raise ValueError("cleaned column names collide")
    return df.toDF(*names)


def canonical_keys(
    df: DataFrame, entity: str, time: str | None = None, entity_name="patient_id", time_name="Time"
) -> DataFrame:
    df = df.withColumnRenamed(entity, entity_name)
    return df.withColumnRenamed(time, time_name) if time else df


def fully_observed(df: DataFrame, features: list[str]) -> DataFrame:
    return df.na.drop("any", subset=features)


def semi_observed(df: DataFrame, features: list[str]) -> DataFrame:
    """The complement: rows with at least one missing feature."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in features]))


def any_missing(df: DataFrame, features: list[str]) -> DataFrame:
    """One boolean for the table."""
    row_flag = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in features])
    return df.agg(F.coalesce(F.bool_or(row_flag), F.lit(False)).alias("semi_observed"))


def any_flag(df: DataFrame, flags: list[str], name: str, drop: bool = True) -> DataFrame:
    """1 if any of the flags is 1; a missing flag counts as not set."""
    hit = reduce(lambda a, b: a | b, [_false_if_null(F.col(c) == 1) for c in flags])
    out = df.withColumn(name, hit.cast("int"))
    return out.drop(*[c for c in flags if c != name]) if drop else out


def decline_label(later: Column, entry: Column, factor: float = 0.6) -> Column:
    """1 if the later value fell to ``factor`` of the entry value; missing counts as 0."""
    return _false_if_null(later <= entry * F.lit(factor)).cast("int")


def align_labels(labels: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Labels whose id is among the features."""
    return labels.join(features.select(key), key, "left_semi")


def missing_mask(df: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    return df.select(*keys, *[F.col(c).isNull().alias(c) for c in features])


def entity_ids(df: DataFrame, entity: str) -> DataFrame:
    return df.select(entity).distinct()


def parse_bool(col: Column) -> Column:
    """String flags: yes, true, t, y, 1 and their negatives; anything else is missing."""
    text = F.lower(col)
    return F.when(text.isin("yes", "true", "t", "y", "1"), True).when(
        text.isin("no", "false", "f", "n", "0"), False
    )


def map_values(df: DataFrame, col: str, names: dict[str, str]) -> DataFrame:
    """Replace listed values, keep the others."""
    return df.replace(names, subset=[col])
