"""Fitted feature maps with inverses.

Every fit is one aggregate over the training rows; the model is a handful of numbers per column and
is applied as literals, so a transform is a projection. A map over more categories than
``MAX_LITERALS`` is applied by a join instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.encode import argmax, onehot
from lacuna.operators.ranking import carry, range_cuts
from lacuna.session import materialize

MAX_LITERALS = 1000


@dataclass
class MinMaxScaler:
    """Scale to [0, 1] by the observed range of the training rows.

    Missing stays missing, later rows may leave the range, a constant column maps to 0.
    """

    bounds: dict[str, tuple[float, float]]

    @staticmethod
    def statistics(columns: list[str]) -> list[Column]:
        return [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]

    @staticmethod
    def from_row(row, columns: list[str]) -> "MinMaxScaler":
        return MinMaxScaler({c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns})

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> "MinMaxScaler":
        return MinMaxScaler.from_row(df.agg(*MinMaxScaler.statistics(columns)).first(), columns)

    def scale(self, name: str, value: Column) -> Column:
        lo, hi = self.bounds[name]
        return value if lo is None else (value - F.lit(lo)) / F.lit((hi - lo) or 1.0)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scale(c, F.col(c)) for c in self.bounds})

    def inverse(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (lo, hi) in self.bounds.items():
            if lo is not None:
                out[c] = F.col(c) * F.lit((hi - lo) or 1.0) + F.lit(lo)
        return df.withColumns(out)


def bin_label(lo: float, hi: float) -> str:
    return f"{lo} - {hi}"


def first_bin(value: Column, uppers: list[float]) -> Column:
    """Position of the first bound that is not below the value, else the number of bounds, by bisection."""
    highest = np.maximum.accumulate(uppers).tolist() if uppers else []

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(value <= F.lit(highest[middle]), search(lo, middle)).otherwise(search(middle + 1, hi))

    return search(0, len(highest))


@dataclass
class FixedBins:
    """Continuous columns to one-hot bins, right-closed, outer bins unbounded.

    ``bins`` maps a column to its (lo, hi) pairs. Bin columns are appended in column order and
    named ``{column}_{lo} - {hi}``; the source column is dropped.
    """

    bins: dict[str, list[tuple[float, float]]]

    def names(self) -> dict[str, list[str]]:
        return {c: [f"{c}_{bin_label(lo, hi)}" for lo, hi in bs] for c, bs in self.bins.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        codes, cells = {}, []
        for i, (c, names) in enumerate(self.names().items()):
            uppers = [float(hi) for _, hi in self.bins[c]][:-1]
            codes[f"__code{i}"] = F.when(F.col(c).isNotNull(), first_bin(F.col(c), uppers))
            cells += [(F.col(f"__code{i}") == k).cast("int").alias(n) for k, n in enumerate(names)]
        # The codes are columns of their own: one look-up a row, however many bins there are.
        return df.withColumns(codes).select(*[x for x in df.columns if x not in self.bins], *cells)

    def inverse(self, df: DataFrame, order: list[str] | None = None) -> DataFrame:
        """Largest bin, first on ties, to the middle of its range; original order if given."""
        names = self.names()
        members = {n for ns in names.values() for n in ns}
        cells = []
        for c, ns in names.items():
            best = argmax([F.col(f"`{n}`") for n in ns])
            middles = F.array(*[F.lit((lo + hi) / 2.0) for lo, hi in self.bins[c]])
            cells.append(F.get(middles, best).alias(c))
        out = df.select(*[F.col(f"`{x}`") for x in df.columns if x not in members], *cells)
        return out.select(*order) if order else out


@dataclass
class TargetEncoder:
    """Category codes to the smoothed mean of the label.

    ``w = 1 / (1 + exp(-(n - min_samples_leaf) / smoothing))`` weighs the mean of a category with n
    rows against the overall mean. Missing stays missing; a category not seen in training gets the
    overall mean. ``model`` is the table (col, category, encoded).
    """

    columns: list[str]
    prior: float
    model: DataFrame
    codes: dict[str, dict[str, float]] | None

    @staticmethod
    def fit(
        df: DataFrame,
        columns: list[str],
        label: str,
        min_samples_leaf: float = 1.0,
        smoothing: float = 1.0,
    ) -> "TargetEncoder":
        prior = df.agg(F.avg(label)).first()[0]
        pairs = F.array(
            *[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("category")) for c in columns]
        )
        stats = (
            df.select(F.col(label).alias("y"), F.inline(pairs))
            .filter(F.col("category").isNotNull())
            .groupBy("col", "category")
            .agg(F.count("y").alias("n"), F.avg("y").alias("mean"))
        )
        w = 1 / (1 + F.exp(-(F.col("n") - min_samples_leaf) / F.lit(float(smoothing))))
        model = stats.select(
            "col", "category", (F.lit(prior) * (1 - w) + F.col("mean") * w).alias("encoded")
        )
        rows = model.limit(MAX_LITERALS + 1).collect()
        codes = None
        if len(rows) <= MAX_LITERALS:
            codes = {c: {} for c in columns}
            for r in sorted(rows):
                codes[r.col][r.category] = r.encoded
        return TargetEncoder(columns, prior, model, codes)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.codes is not None:
            out = {}
            for c in self.columns:
                value = F.lit(self.prior)
                for category, encoded in self.codes[c].items():
                    hit = F.col(c).cast("string") == category
                    value = F.when(hit, F.lit(encoded)).otherwise(value)
                out[c] = F.when(F.col(c).isNotNull(), value)
            return df.withColumns(out)
        for c in self.columns:
            table = self.model.filter(F.col("col") == c).select(
                F.col("category").alias("__cat"), F.col("encoded").alias("__enc")
            )
            joined = df.join(table, F.col(c).cast("string") == F.col("__cat"), "left")
            value = F.coalesce(F.col("__enc"), F.lit(self.prior))
            df = joined.withColumn(c, F.when(F.col(c).isNotNull(), value)).drop("__cat", "__enc")
        return df

    def inverse(self, df: DataFrame, onehots: dict[str, list[str]] | None = None, ranges: int | None = None) -> DataFrame:
        """The category whose code is nearest, the first by category name on ties.

        Few categories are compared as literals, many are found by ``_nearest``. ``onehots`` maps a
        column to its categories and gives it back as the indicators ``{column}_{category}``.
        """
        if self.codes is None:
            for c in self.columns:
                found = self._nearest(df, c, ranges)
                joined = df.join(found, F.col(c).cast("double") == F.col("__x"), "left")
                df = joined.withColumn(c, F.col("__cat")).select(*[F.col(f"`{n}`") for n in df.columns])
        else:
            out = {}
            for c in self.columns:
                entries = [
                    F.struct(F.abs(F.col(c) - F.lit(e)).alias("d"), F.lit(k).alias("cat"))
                    for k, e in self.codes[c].items()
                ]
                nearest = F.array_min(F.array(*entries))["cat"] if entries else F.lit(None).cast("string")
                out[c] = F.when(F.col(c).isNotNull(), nearest)
            df = df.withColumns(out)
        return onehot(df, list(onehots), onehots) if onehots else df

    def _nearest(self, df: DataFrame, c: str, ranges: int | None) -> DataFrame:
        """(__x, __cat): the category of every distinct value of column ``c``.

        Values and codes are put into one order; the last code before and the first one after each
        value are carried to it across ranges of the order, so no task holds all codes.
        """
        codes = self.model.filter(F.col("col") == c).groupBy("encoded").agg(F.min("category").alias("cat"))
        values = df.select(F.col(c).cast("double").alias("x")).filter("x IS NOT NULL").distinct()
        both = codes.select(F.col("encoded").alias("x"), F.lit(False).alias("asked"), "cat").unionAll(
            values.select("x", F.lit(True), F.lit(None).cast("string"))
        )
        # a code and an equal value are two rows of one place: bring them together first
        placed = both.groupBy("x").agg(F.max("asked").alias("asked"), F.min("cat").alias("cat")).withColumn("one", F.lit(1))
        placed = materialize(placed, "target-codes")
        cuts = range_cuts(placed, "x", ranges)
        near = carry(placed, "one", "x", ["cat"], True, cuts).withColumnRenamed("__from_cat", "lo")
        near = carry(near, "one", "x", ["cat"], False, cuts).withColumnRenamed("__from_cat", "hi")
        either = F.array_min(F.filter(
            F.array(*[F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col("x") - F.col(s)["at"]).alias("d"), F.col(s)["v"].alias("cat"))) for s in ("lo", "hi")]),
            lambda e: e.isNotNull(),
        ))
        return near.filter("asked").select(F.col("x").alias("__x"), either["cat"].alias("__cat"))
