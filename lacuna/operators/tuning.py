"""Tuning of imputers on held-out rows with hidden cells, and the grids of the baseline methods."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.encode import argmax, combine_onehots
from lacuna.operators.joins import self_joined
from lacuna.operators.metrics import tune_metric
from lacuna.schema import FeatureSchema

#: Values the baseline methods are tuned over: fixed by the method names.
GRIDS = {
    "none": {},
    "simple": {},
    "knn": {"k": [3, 5, 10], "weights": ["uniform", "distance"]},
    "mice": {"max_iter": [10, 50], "n_nearest_features": [5, 10, None]},
}


def candidates(grid: dict[str, list]) -> list[dict]:
    """All combinations of a grid; one empty candidate of an empty grid."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


@dataclass
class Tuned:
    """``scores`` holds a candidate and its score (greater is better) a row; ``model`` is refitted on train and val."""

    best: dict
    scores: list[tuple[dict, float | None]]
    model: Model


def masked_score(filled: DataFrame, data: DataFrame, truth: DataFrame, schema: FeatureSchema) -> float | None:
    """Score of the cells that were missing: minus the column-wise MAAPE and categorical error."""
    side = lambda df, name: df.select(*schema.ids, F.struct(*schema.features).alias(name))
    gone = data.select(*schema.ids, F.struct(*[F.col(f"`{c}`").isNull().alias(c) for c in schema.features]).alias("missing"))
    frame = side(truth, "truth").join(side(filled, "pred"), list(schema.ids)).join(gone, list(schema.ids))
    return tune_metric(frame, schema).first()["score"]


def masked_scores(models: list[Model], data: DataFrame, truth: DataFrame | str, schema: FeatureSchema) -> list[float | None]:
    """``masked_score`` of models that are applied together, from one frame.

    One-hot groups are compared by their codes: the arg-max over their members is taken once a row, not once a
    candidate and term, which made methods too long to be compiled. A truth that is a column of ``data`` is
    joined where an id repeats only.
    """
    ids, coded = list(schema.ids), schema.after_combine()
    missing = {c: F.col(f"`{c}`").isNull() for c in schema.features}
    missing |= {g: reduce(Column.__and__, [missing[c] for c in cols]) for g, cols in schema.onehot.items()}
    gone = F.struct(*[missing[c].alias(c) for c in coded.features]).alias("__missing")
    if isinstance(truth, str):
        member = {c: F.col(f"`{truth}`.`{c}`") for c in schema.features}
        member |= {g: argmax([member[c] for c in cols]) for g, cols in schema.onehot.items()}
        side = F.struct(*[member[c].alias(c) for c in coded.features]).alias("__truth")
        rest = [c for c in data.columns if c not in (truth, *ids)]
        both = self_joined(data.select(*ids, *rest, side, gone), ids, [rest, ["__truth"], ["__missing"]])
    else:
        side = combine_onehots(truth.select(*ids, *schema.features), schema.onehot).select(*ids, F.struct(*coded.features).alias("__truth"))
        both = data.join(side, ids).join(data.select(*ids, gone), ids)
    frame = models[0].codes_all(models, both, "__candidate")
    frame = frame.select("__candidate", F.col("__truth").alias("truth"), F.struct(*coded.features).alias("pred"), F.col("__missing").alias("missing"))
    found = {r["__candidate"]: r["score"] for r in tune_metric(frame, coded, ["__candidate"]).collect()}
    return [found.get(i) for i in range(len(models))]


def tune_imputer(
    make: Callable[[dict], Estimator],
    grid: list[dict],
    data: DataFrame,
    truth: DataFrame | str | None,
    schema: FeatureSchema,
    score: Callable[..., float | None] = masked_score,
    parallelism: int = 4,
) -> Tuned:
    """Fit every candidate on the train rows, score it on the hidden cells of the val rows, and refit the
    best on both.

    Candidates that can be applied together are fitted in one pass and scored from one frame; others run as
    parallel jobs of one session. The truth is a table, or the column of ``data`` that holds the true features
    as a struct. Without a truth nothing can be scored and the first
    candidate is taken, as on ties; a candidate without a score counts as the worst.
    """
    if not grid:
        raise ValueError("tuning needs a candidate")
    features = data.drop(truth) if isinstance(truth, str) else data
    train, val = (features.filter(F.col(schema.split) == s) for s in ("train", "val"))

    values: list[float | None] = [None] * len(grid)
    if truth is not None:
        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            made = [make(params) for params in grid]
            alike = hasattr(made[0], "fits_with") and made[0].fits_with(made)
            models = made[0].fit_all(made, train) if alike else list(pool.map(lambda m: m.fit(train), made))
            together = score is masked_score and hasattr(models[0], "shares_with") and models[0].shares_with(models)
            if together and isinstance(truth, str):
                values = masked_scores(models, data.filter(F.col(schema.split) == "val"), truth, schema)
            elif together:
                values = masked_scores(models, val, truth, schema)
            else:
                table = data.select(*schema.ids, f"{truth}.*") if isinstance(truth, str) else truth
                values = list(pool.map(lambda model: score(model.transform(val), val, table, schema), models))
    best = max(range(len(grid)), key=lambda i: (values[i] is not None, values[i] or 0.0, -i))
    both = features.filter(F.col(schema.split).isin("train", "val"))
    return Tuned(grid[best], list(zip(grid, values)), make(grid[best]).fit(both))
