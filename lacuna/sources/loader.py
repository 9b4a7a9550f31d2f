"""Where features and labels come from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lacuna.operators.clean import bools_to_int, filter_subgroup, nan_to_null
from lacuna.schema import FeatureSchema


@dataclass
class FeatureSource:
    """A table with its ids, label and typed feature columns.

    ``label`` is a column name, a position, or a separate frame keyed by the ids. Subclass and
    override ``load`` for data that needs its own preparation.
    """

    df: DataFrame | None
    id_cols: list[str]
    label: str | int | DataFrame | None = None
    continuous: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    onehot_prefixes: list[str] = field(default_factory=list)
    split_col: str | None = None
    subgroup: dict[str, object] | None = None

    def load(self) -> DataFrame:
        return self.df

    @property
    def label_name(self) -> str | None:
        if isinstance(self.label, int):
            return self.load().columns[self.label]
        if isinstance(self.label, DataFrame):
            return next(c for c in self.label.columns if c not in self.id_cols)
        return self.label

    def table(self) -> DataFrame:
        """Ids, features, label and split: numeric markers unified, subgroup filtered."""
        df = bools_to_int(nan_to_null(self.load()))
        if isinstance(self.label, DataFrame):
            df = df.join(self.label, self.id_cols, "left")  # rows without a label stay
        return filter_subgroup(df, self.subgroup)

    def features(self) -> DataFrame:
        return self.table().drop(*[c for c in (self.label_name, self.split_col) if c])

    def labels(self) -> DataFrame:
        return self.table().select(*self.id_cols, self.label_name)

    def schema(self) -> FeatureSchema:
        columns = [c for c in self.table().columns]
        return FeatureSchema.infer(
            columns,
            self.id_cols,
            [c for c in self.continuous if c in columns],
            self.onehot_prefixes,
            self.label_name,
            self.split_col,
        )
