"""Downstream classification: balanced classifiers, hold-out tuning, panel features."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.quantiles import exact_percentiles
from lacuna.operators.stats import average_precision
from lacuna.session import broadcast_if_small


#: Training rows of a task at most. Files of few distinct values hold many more rows than their size tells.
TRAIN_ROWS = 250_000


def _spread(train: DataFrame) -> DataFrame:
    """Training rows over as many partitions as ``TRAIN_ROWS`` asks for; a table below that stays as it is."""
    parts = -(-train.count() // TRAIN_ROWS)
    return train.repartition(parts) if parts > 1 else train


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weight n / (classes * n_class), so that all classes weigh the same, however many there are."""
    counts = df.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"), F.count("*").alias("__classes"))
    shares = counts.crossJoin(total).select("__label", (F.col("__total") / (F.col("__classes") * F.col("__n"))).alias(name))
    # one row a class: a shuffle by label would put a class into one task
    return df.join(broadcast_if_small(shares), F.col(label).eqNullSafe(F.col("__label"))).drop("__label")


def make_classifier(kind: str, label: str = "label", seed: int = 0, n_features: int = 0, **params):
    common = {"featuresCol": "features", "labelCol": label}
    if kind == "lr":
        return LogisticRegression(weightCol="weight", maxIter=50, **common, **params)
    if kind == "rf":
        return RandomForestClassifier(weightCol="weight", seed=seed, **{"numTrees": 20, "maxDepth": 5, **params}, **common)
    if kind == "gbt":
        return GBTClassifier(weightCol="weight", seed=seed, **{"maxIter": 10, "maxDepth": 3, **params}, **common)
    if kind == "mlp":  # sigmoid hidden layers and no dropout
        layers = [n_features, 64, 64, 32, 16, 2]
        return MultilayerPerceptronClassifier(layers=layers, seed=seed, **{"maxIter": 20, **params}, **common)
    raise ValueError(kind)


def fit_predict(
    df: DataFrame, features: list[str], kind: str, label: str = "label", split: str = "split",
    train_on: list[str] = ("train", "val"), seed: int = 0, **params
) -> DataFrame:
    """Fit on the given splits, score all rows: adds ``pred`` and ``prob``."""
    train = balanced_weights(df.filter(F.col(split).isin(*train_on)), label).select(*features, label, "weight")
    train = _spread(train)
    clf = make_classifier(kind, label, seed, len(features), **params)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), clf]).fit(train)
    scored = model.transform(df)
    return scored.select(
        *df.columns,
        F.col("prediction").cast("int").alias("pred"),
        vector_to_array("probability")[1].alias("prob"),
    )


def tune(df: DataFrame, features: list[str], kind: str, grid: list[dict], label="label", split="split", seed=0):
    """Fit each candidate on train, keep the best average precision on val, refit on both.

    Without positives in val no candidate has a score, and the first one is kept, as on ties.
    """
    if not grid:
        raise ValueError("tuning needs a candidate")
    best, best_score = grid[0], None
    for params in grid:
        scored = fit_predict(df, features, kind, label, split, ("train",), seed, **params)
        val = scored.filter(F.col(split) == "val")
        score = average_precision(val, label).first()[0]
        if score is not None and (best_score is None or score > best_score):
            best, best_score = params, score
    return best, fit_predict(df, features, kind, label, split, ("train", "val"), seed, **best)


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def panel_features(df: DataFrame, entity: str, time: str, columns: list[str]) -> DataFrame:
    """One row of statistics per entity and column; missing values are skipped.

    All but the quartiles come from one grouping whose sums merge before the shuffle; the quartiles
    are taken by rank (see ``quantiles``), so no buffer holds an entity. Skew and kurtosis (excess)
    are those of the population, NULL for an entity whose values are all equal.
    """
    aggs = []
    for c in columns:
        x, t = F.col(c).cast("double"), F.col(time).cast("double")
        seen = F.when(x.isNotNull(), F.struct(F.col(time), x.alias("v")))
        varies = F.min(x) < F.max(x)
        aggs += [
            F.count(x).alias(f"{c}_count"),
            F.avg(x).alias(f"{c}_mean"),
            F.stddev_pop(x).alias(f"{c}_std"),
            F.var_pop(x).alias(f"{c}_var"),
            F.min(x).alias(f"{c}_min"),
            F.max(x).alias(f"{c}_max"),
            F.sum(x).alias(f"{c}_sum"),
            F.sum(x * x).alias(f"{c}_abs_energy"),
            F.min(seen)["v"].alias(f"{c}_first"),
            F.max(seen)["v"].alias(f"{c}_last"),
            F.regr_slope(x, F.when(x.isNotNull(), t)).alias(f"{c}_slope"),
            F.when(varies, F.skewness(x)).alias(f"{c}_skew"),
            F.when(varies, F.kurtosis(x)).alias(f"{c}_kurtosis"),
        ]
    ranks = exact_percentiles(df, [entity], columns, list(QUARTILES.values()))
    wide = [
        F.max(F.when(F.col("feature") == c, F.col("p")[i])).alias(f"{c}_{name}") for c in columns for i, name in enumerate(QUARTILES)
    ]
    wide = ranks.groupBy(F.col(entity).alias("__entity")).agg(*wide)
    return df.groupBy(entity).agg(*aggs).join(wide, F.col(entity).eqNullSafe(F.col("__entity"))).drop("__entity")


def change_features(df: DataFrame, entity: str, time: str, columns: list[str]) -> DataFrame:
    """Mean absolute change, lag-1 autocovariance and autocorrelation, and mean crossings between
    successive rows.

    The previous row comes from the carried observation, which is computed per range of time. The
    autocorrelation divides by the variance of all rows; it is NULL for an entity whose values are
    all equal.
    """
    from lacuna.operators.impute_simple import previous_observation

    moments = []
    for c in columns:
        spread = F.when(F.min(c) < F.max(c), F.var_pop(c))
        moments += [F.avg(c).alias(f"__m_{c}"), spread.alias(f"__v_{c}")]
    means = df.groupBy(F.col(entity).alias("__entity")).agg(*moments)
    with_prev = previous_observation(df, entity, time, columns).join(means, F.col(entity).eqNullSafe(F.col("__entity")))
    aggs = []
    for c in columns:
        x, p, m = F.col(c), F.col(f"prev_{c}"), F.col(f"__m_{c}")
        together = F.avg((x - m) * (p - m))
        aggs += [
            F.avg(F.abs(x - p)).alias(f"{c}_mean_abs_change"),
            together.alias(f"{c}_autocov"),
            (together / F.max(f"__v_{c}")).alias(f"{c}_autocorr"),
            F.sum(F.when((x > m) != (p > m), 1).otherwise(0)).alias(f"{c}_crossings"),
        ]
    return with_prev.groupBy(entity).agg(*aggs)
