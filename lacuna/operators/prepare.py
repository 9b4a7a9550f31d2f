"""From a raw table to data and ground truth, ready for an imputer.

Rows without gaps (if asked) are amputed, one-hot groups that lost a member go whole, rows are split,
and steps are fitted on the training rows only. Truth stays in the same row as the data, so neither
needs a join. A step is any function from training rows to something with ``transform``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.ampute import ampute
from lacuna.operators.clean import fully_observed, semi_observed
from lacuna.operators.encode import explode_nulls
from lacuna.schema import FeatureSchema


class Fitted(Protocol):
    def transform(self, df: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Step:
    """``fit`` sees training rows as the steps before leave them. ``maps``: features become others."""

    fit: Callable[[DataFrame], Fitted]
    maps: bool = False


@dataclass
class Prepared:
    """``rows`` holds the keys and the structs ``data`` and ``ground_truth``."""

    rows: DataFrame
    schema: FeatureSchema
    fitted: dict[str, list[tuple[Step, Fitted]]]

    def raw(self, role: str) -> DataFrame:
        return self.rows.select(*self.schema.keys, f"{role}.*")

    def view(self, space: str, role: str) -> DataFrame:
        """``mapped`` takes all steps, ``original`` those that keep the features."""
        if space not in ("original", "mapped"):
            raise ValueError(f"unknown feature space {space!r}")
        df = self.raw(role)
        for step, model in self.fitted[role]:
            if space == "mapped" or not step.maps:
                df = model.transform(df)
        return df


def prepare(
    df: DataFrame, schema: FeatureSchema, id_col: str, split: Callable[[DataFrame], DataFrame], steps: list[Step] = (),
    patterns: list[dict] | None = None, prop: float = 0.33, only_observed: bool = False, rest_as_test: bool = False,
    separate_truth: bool = False, seed: int = 0,
) -> Prepared:
    """Filter, ampute, empty broken groups, split, fit.

    ``only_observed`` keeps rows without gaps; with ``rest_as_test`` the others come back, as they
    are, as the test split. ``split`` adds the split column to the amputed rows. With
    ``separate_truth`` the truth has steps of its own, fitted on the truth of the training rows;
    else it takes those of the data.
    """
    feats, groups = schema.features, {k: list(v) for k, v in schema.onehot.items()}
    truth = F.struct(*[F.col(f"`{c}`") for c in feats]).alias("ground_truth")
    work = fully_observed(df, feats) if only_observed else df
    work = split(work.select("*", truth))
    if patterns:
        work = ampute(work, prop, patterns, id_col, feats, seed, groups)
    if only_observed and rest_as_test:
        rest = semi_observed(df, feats).select("*", truth).withColumn(schema.split, F.lit("test"))
        work = work.unionByName(rest.select(*work.columns))
    work = explode_nulls(work, groups)
    rows = work.select(*schema.keys, F.struct(*[F.col(f"`{c}`") for c in feats]).alias("data"), "ground_truth")
    out = Prepared(rows, schema, {"data": [], "ground_truth": []})
    for role in ("data", "ground_truth") if separate_truth else ("data",):
        seen = out.raw(role).filter(F.col(schema.split) == "train")
        for step in steps:
            model = step.fit(seen)
            out.fitted[role].append((step, model))
            seen = model.transform(seen)
    if not separate_truth:
        out.fitted["ground_truth"] = out.fitted["data"]
    return out
