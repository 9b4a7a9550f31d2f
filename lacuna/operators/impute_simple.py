"""Mean and mode imputation, constants, and fills along the time of a panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.hashing import salt, with_uniform53
from lacuna.operators.encode import argmax
from lacuna.operators.ranking import carry, grouped_rank, join_totals, range_cuts, with_range
from lacuna.operators.transforms import MinMaxScaler
from lacuna.schema import FeatureSchema
from lacuna.session import materialize


@dataclass
class SimpleImputer:
    """Mean for continuous, most frequent value for binary columns and whole one-hot groups.

    The smallest value wins a tie. Fitted in one aggregate, applied as literals.
    """

    schema: FeatureSchema
    fill: dict[str, float]

    @staticmethod
    def statistics(schema: FeatureSchema) -> list[Column]:
        groups = {p: argmax([F.col(c) for c in cols]) for p, cols in schema.onehot.items()}
        return [
            *[F.avg(c).alias(f"mean_{c}") for c in schema.continuous],
            *[F.mode(c, True).alias(f"mode_{c}") for c in (*schema.binary, *schema.categorical)],
            *[F.mode(code, True).alias(f"mode_{p}") for p, code in groups.items()],
        ]

    @staticmethod
    def from_row(row, schema: FeatureSchema) -> "SimpleImputer":
        fill = {c: row[f"mean_{c}"] for c in schema.continuous}
        fill.update({c: row[f"mode_{c}"] for c in (*schema.binary, *schema.categorical)})
        for p, cols in schema.onehot.items():
            best = row[f"mode_{p}"]
            fill.update({c: None if best is None else int(k == best) for k, c in enumerate(cols)})
        return SimpleImputer(schema, fill)

    @staticmethod
    def fit(df: DataFrame, schema: FeatureSchema) -> "SimpleImputer":
        return SimpleImputer.from_row(df.agg(*SimpleImputer.statistics(schema)).first(), schema)

    def transform(self, df: DataFrame) -> DataFrame:
        """A column never observed in training stays missing."""
        out = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.fill.items() if v is not None}
        return df.withColumns(out)


def fit_scaler_and_imputer(df: DataFrame, schema: FeatureSchema) -> tuple[MinMaxScaler, SimpleImputer]:
    """Both models from one pass. The fill values are those of the unscaled table: impute, then scale."""
    ctn = list(schema.continuous)
    row = df.agg(*MinMaxScaler.statistics(ctn), *SimpleImputer.statistics(schema)).first()
    return MinMaxScaler.from_row(row, ctn), SimpleImputer.from_row(row, schema)


def warm_start(df: DataFrame, schema: FeatureSchema, how: str | float = 0) -> DataFrame:
    """Replace missing cells by a number, or by ``simple`` statistics of the rows given."""
    if how == "simple":
        return SimpleImputer.fit(df, schema).transform(df)
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(how)) for c in schema.features})


def fill_forward(df: DataFrame, entity: str, time: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Last observation carried forward; missing before the first one."""
    out = carry(df, entity, time, columns, True, range_cuts(df, time, ranges))
    return out.withColumns({c: F.col(f"__from_{c}.v") for c in columns}).select(*df.columns)


def fill_backward(df: DataFrame, entity: str, time: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Next observation carried backward; missing after the last one."""
    out = carry(df, entity, time, columns, False, range_cuts(df, time, ranges))
    return out.withColumns({c: F.col(f"__from_{c}.v") for c in columns}).select(*df.columns)


def interpolate(df: DataFrame, entity: str, time: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Linear in time between the neighbours; the nearest observation outside of them."""
    cuts = range_cuts(df, time, ranges)
    both = carry(df, entity, time, columns, True, cuts)
    both = both.withColumnsRenamed({f"__from_{c}": f"__prev_{c}" for c in columns})
    both = carry(both, entity, time, columns, False, cuts)
    out = {}
    for c in columns:
        prev, nxt = F.col(f"__prev_{c}"), F.col(f"__from_{c}")
        span = nxt["at"].cast("double") - prev["at"].cast("double")
        between = prev["v"] + (nxt["v"] - prev["v"]) * (F.col(time).cast("double") - prev["at"]) / span
        out[c] = F.coalesce(F.col(c), between, prev["v"], nxt["v"])
    return both.withColumns(out).select(*df.columns)


def fill_entity_mean(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """Mean of the entity, else the overall mean."""
    means = df.groupBy(F.col(entity).alias("__entity")).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns])
    overall = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    joined = df.join(means, F.col(entity).eqNullSafe(F.col("__entity")), "left")
    out = {c: F.coalesce(F.col(c), F.col(f"__m_{c}"), F.lit(overall[c])) for c in columns}
    return joined.withColumns(out).select(*df.columns)


def previous_observation(
    df: DataFrame, entity: str, time: str, columns: list[str], ranges: int | None = None
) -> DataFrame:
    """Add ``prev_{c}``: the last observed value strictly before each observed one."""
    long = df.select(
        entity, time, F.inline(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in columns]))
    ).filter("v IS NOT NULL")
    cuts = range_cuts(long, time, ranges)
    ranged = with_range(long, time, cuts)
    keys = [entity, "f", "__range"]
    local = F.lag("v").over(W.partitionBy(*keys).orderBy(time))
    ranged = ranged.withColumn("__prev", local)
    if cuts:
        edges = ranged.groupBy(*keys).agg(F.max_by("v", time).alias("__last"))
        before = W.partitionBy(entity, "f").orderBy("__range")
        edges = edges.select(*keys, F.lag("__last").over(before).alias("__carry"))
        ranged = join_totals(ranged, edges, keys).withColumn("__prev", F.coalesce("__prev", "__carry"))
    prev = ranged.groupBy(entity, time).agg(
        *[F.max(F.when(F.col("f") == c, F.col("__prev"))).alias(f"prev_{c}") for c in columns]
    )
    return df.join(prev, [entity, time], "left")


def hot_deck(df: DataFrame, id_col: str, columns: list[str], copies: int = 1, seed: int = 0) -> DataFrame:
    """``copies`` completed tables, told apart by ``copy``: a missing cell takes the value of an observed
    row of its column, drawn by a hash of id, column and copy. A column never observed stays missing.

    Observed cells are numbered across ranges of the id and met by number, so donors are neither
    collected nor sampled, and no number is hotter than chance makes it.
    """
    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    long = df.select(F.col(id_col).cast("bigint").alias("id"), F.inline(cells))
    donors = materialize(grouped_rank(long.filter("v IS NOT NULL"), ["f"], "id", "j"), "hot-deck-donors")
    sizes = donors.groupBy("f").agg(F.count("*").alias("n"))  # one row a column
    gaps = long.filter("v IS NULL").select("id", "f").join(F.broadcast(sizes), "f")
    gaps = gaps.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    salts = F.array(*[F.lit(salt(deck_stream(seed, k, i))).cast("bigint") for k in range(copies) for i in range(len(columns))])
    gaps = with_uniform53(gaps.withColumn("s", F.get(salts, F.col("copy") * len(columns) + F.col("f"))), "id", F.col("s"), "u")
    gaps = gaps.withColumn("j", F.least(F.floor(F.col("u") * F.col("n")), F.col("n") - 1) + 1)
    found = gaps.join(donors.select("f", "j", "v"), ["f", "j"])
    wide = found.groupBy(F.col("id").alias("__id"), "copy").agg(*[F.max(F.when(F.col("f") == i, F.col("v"))).alias(f"__fill{i}") for i in range(len(columns))])
    wide = wide.withColumnRenamed("copy", "__copy")
    out = rows.join(wide, (F.col(id_col).cast("bigint") == F.col("__id")) & (F.col("copy") == F.col("__copy")), "left")
    fills = {c: F.coalesce(F.col(c).cast("double"), F.col(f"__fill{i}")).cast(df.schema[c].dataType) for i, c in enumerate(columns)}
    return out.withColumns(fills).select(*df.columns, "copy")


def deck_stream(seed: int, copy: int, column: int) -> int:
    """The stream of draws of one column in one copy."""
    return 7000 + 100_000 * seed + 1000 * copy + column
