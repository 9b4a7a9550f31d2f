"""Chained imputation: every column with gaps is regressed on the others, in rounds.

Numeric columns use Bayesian ridge regression, which needs nothing but sums of products: one pass
per column and round, a small solve on the driver, and a linear expression as the model.
Categorical columns use decision trees on their codes. ``learner`` puts random forests or boosted
trees in the place of both; their numeric predictions are matched to observed values (predictive mean
matching), so a missing cell takes the value of a drawn donor with a similar prediction. The table is
written once per round; with trees a step shuffles and writes only the rows that lack its column, and the
table is put together from the last such rows of each column.

With ``copies`` the table is completed several times. The copies are rows of one frame, told apart by
a column: a model is fitted on all of them, and every copy draws its own donors, by row, column, round
and copy, so that the copies differ by what is uncertain. ``pool_copies`` puts them together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.hashing import mix32, salt, with_uniform53
from lacuna.session import materialize


def gram_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of (1, columns): one matrix product per batch, summed by Spark per cell."""
    p = len(columns) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[b.column(i).to_numpy(zero_copy_only=False) for i in range(p - 1)]])
            total += x.T @ x
        i, j = np.indices((p, p))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())],
            names=["i", "j", "v"],
        )

    cells = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(partial, "i int, j int, v double")
    out = np.zeros((p, p))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


def bayesian_ridge(g: np.ndarray, max_iter: int = 300, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of the last column on the others, from the sums of products.

    Noise and weight precision are re-estimated until the coefficients settle (MacKay, 1992).
    """
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    centred = g[1:, 1:] - n * np.outer(mean, mean)
    s, c, yy = centred[:-1, :-1], centred[:-1, -1], max(centred[-1, -1], 0.0)
    values, vectors = np.linalg.eigh(s)
    values = np.clip(values, 0, None)
    projected = vectors.T @ c
    alpha, lam = 1.0 / (yy / n + 1e-12), 1.0
    coef = np.zeros(len(c))
    for _ in range(max_iter):
        new = vectors @ (projected / (values + lam / alpha))
        gamma = np.sum(alpha * values / (lam + alpha * values))
        rss = max(yy - 2 * new @ c + new @ s @ new, 0.0)
        lam = (gamma + 2e-6) / (new @ new + 2e-6)
        alpha = (n - gamma + 2e-6) / (rss + 2e-6)
        settled = np.sum(np.abs(new - coef)) < tol
        coef = new
        if settled:
            break
    return coef, float(mean[-1] - coef @ mean[:-1])


def nearest_features(g: np.ndarray, target: int, n_nearest: int | None) -> list[int]:
    """Positions of the other columns, the ``n_nearest`` most correlated ones if given."""
    others = [i for i in range(len(g) - 1) if i != target]
    if not n_nearest or n_nearest >= len(others):
        return others
    mean = g[0, 1:] / g[0, 0]
    cov = g[1:, 1:] / g[0, 0] - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    strength = np.abs(cov[target] / sd / sd[target])
    return sorted(sorted(others, key=lambda i: (-strength[i], i))[:n_nearest])


COPY = "__copy"
TREES = {"forest", "boosted"}


@dataclass
class Step:
    """One column of one round: a linear rule, or a fitted model and its predictors."""

    column: str
    predictors: list[str]
    coef: list[float] | None = None
    intercept: float = 0.0
    model: object = None
    matching: tuple | None = None
    stream: int = 0

    def predict(self, df: DataFrame, id_col: str, name: str) -> DataFrame:
        if self.coef is not None:
            terms = [F.col(f"v_{c}") * float(w) for c, w in zip(self.predictors, self.coef)]
            return df.withColumn(name, reduce(lambda a, b: a + b, terms, F.lit(self.intercept)))
        out = self.model.transform(df).withColumn(name, F.col("prediction"))
        out = out.drop("features", "prediction", "rawPrediction", "probability")
        return out if self.matching is None else match_means(out, self.matching, id_col, name, stream=self.stream)


#: Ranges of predictions: at least, at most, and rows of one in between; parts of a range that are numbered apart.
MATCH_RANGES = 256
MAX_RANGES = 4096
RANGE_ROWS = 100_000
RANGE_PARTS = 16


def fit_matching(observed: DataFrame, target: str, pred: str, id_col: str) -> tuple:
    """Predictive-mean matching: all observed values, numbered within each range of predictions.

    (bounds of the ranges, written table of range, rows up to the end of each part of it, key of range, part
    and number with the value). Equal predictions share a range, so a range may hold any share
    of the rows; it is numbered in parts by a hash of the id.
    """
    n = observed.count()
    ranges = min(MAX_RANGES, max(MATCH_RANGES, n // RANGE_ROWS))
    cuts = sorted(set(observed.approxQuantile(pred, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    splits = [float("-inf"), *cuts, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=pred, outputCol="__range").transform(observed)
    bucketed = bucketed.withColumn("__part", (F.pmod(F.xxhash64(id_col), F.lit(RANGE_PARTS))).cast("int"))
    number = F.row_number().over(Window.partitionBy("__range", "__part").orderBy(id_col, target)).cast("long")
    donors = materialize(bucketed.select("__range", "__part", number.alias("__j"), F.col(target).cast("double").alias("__donor")), "mice-donors")
    parts = [F.count(F.when(F.col("__part") <= i, 1)).alias(str(i)) for i in range(RANGE_PARTS)]
    sizes = donors.groupBy("__range").agg(F.array(*parts).alias("__upto"))  # one row a range
    return splits, materialize(sizes, "mice-ranges"), donors.select(_donor_key(F.col("__j")).alias("__key"), "__donor")


def _donor_key(number):
    """Range (at most 12 bits), part (4 bits) and number of a donor in one integer, to shuffle; files hold them apart."""
    place = F.col("__range").cast("long") * RANGE_PARTS + F.col("__part")
    return F.shiftleft(place, 40) + number


def match_means(df: DataFrame, matching: tuple, id_col: str, name: str, wanted=None, stream: int = 0) -> DataFrame:
    """Replace predictions (where ``wanted``) by an observed value of their range.

    The donor is drawn by 53 bits of a hash of the id, the stream (one for each column, round and seed)
    and the copy, so every donor of a range is as likely as any other, however many there are.
    """
    splits, sizes, donors = matching
    wanted = F.lit(True) if wanted is None else wanted
    bucketed = Bucketizer(splits=splits, inputCol=name, outputCol="__range").transform(df)
    bucketed = bucketed.join(F.broadcast(sizes), "__range", "left")  # at most MAX_RANGES rows
    copy = F.col(COPY).cast("bigint") if COPY in df.columns else F.lit(0).cast("bigint")
    lane = mix32(copy.bitwiseXOR(F.lit(salt(stream)).cast("bigint")))
    drawn = with_uniform53(bucketed.withColumn("__id", F.col(id_col).cast("bigint")), "__id", lane, "__u")
    n = F.element_at("__upto", -1)
    k = F.least(F.floor(F.col("__u") * n), n - 1)
    drawn = drawn.withColumn("__k", F.when(wanted & (n > 0), k))
    drawn = drawn.withColumn("__part", F.expr("size(filter(__upto, c -> c <= __k))"))
    before = F.when(F.col("__part") > 0, F.element_at("__upto", F.greatest("__part", F.lit(1)))).otherwise(0)
    # rows without a draw take a key that no donor has and stay spread
    nowhere = -1 - F.pmod(F.coalesce("__id", F.lit(0)), F.lit(1 << 30))
    drawn = drawn.withColumn("__key", F.when(F.col("__k").isNotNull(), _donor_key(F.col("__k") - before + 1)).otherwise(nowhere))
    found = drawn.select(*df.columns, "__key").join(donors, "__key", "left")
    return found.withColumn(name, F.coalesce("__donor", name)).select(*df.columns)


@dataclass
class ChainedImputer:
    """Fitted chain: initial fills, then the steps of all rounds in order."""

    id_col: str
    numeric: list[str]
    categorical: list[str]
    initial: dict[str, float]
    rounds: list[list[Step]]
    copies: int = 1

    @staticmethod
    def fit(
        df: DataFrame,
        id_col: str,
        numeric: list[str],
        categorical: list[str] = (),
        max_iter: int | None = None,
        n_nearest_features: int | None = None,
        learner: str = "linear",
        tol: float = 1e-3,
        seed: int = 0,
        copies: int = 1,
    ) -> "ChainedImputer":
        """``learner``: linear (ridge and decision trees), forest or boosted (with matching).

        Numeric and categorical columns are chained separately, fewest gaps first. Rounds stop when
        no ridge model changes by more than ``tol`` of its column's spread and no more than a share of
        ``tol`` of the cells filled by decision trees change. Matched fills are drawn anew in each round,
        so forest and boosted chains of numeric columns run all ``max_iter`` rounds. The default is 5
        rounds for those, else 10.
        """
        max_iter = max_iter or (5 if learner in TREES else 10)
        if learner not in {"linear", *TREES}:
            raise ValueError(learner)
        if copies < 1:
            raise ValueError("copies must be 1 or more")
        numeric, categorical = list(numeric), list(categorical)
        cols = numeric + categorical
        row = df.agg(
            *[F.avg(c).alias(c) for c in numeric],
            *[F.mode(c, True).alias(c) for c in categorical],
            *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"gaps_{c}") for c in cols],
            *[F.stddev_pop(c).alias(f"sd_{c}") for c in numeric],
        ).first()
        imputer = ChainedImputer(id_col, numeric, categorical, {c: float(row[c] or 0) for c in cols}, [], copies)
        needed = [id_col, *[c for c in cols if c != id_col]]
        state = before_round = imputer._start(materialize(df.select(*needed), "mice-start"))
        filled: dict[str, DataFrame] | None = {"": state}
        todo = [c for c in sorted(numeric, key=lambda c: row[f"gaps_{c}"]) if row[f"gaps_{c}"]]
        todo += [c for c in sorted(categorical, key=lambda c: row[f"gaps_{c}"]) if row[f"gaps_{c}"]]
        last: dict[str, np.ndarray] = {}
        for number in range(max_iter):
            steps, moved, trees = [], 0.0, []
            for c in todo:
                block = numeric if c in numeric else categorical
                if len(block) < 2:
                    continue
                if c in numeric and learner == "linear":
                    others = [x for x in numeric if x != c]
                    names = [f"v_{x}" for x in others]
                    g = gram_matrix(state.filter(F.col(c).isNotNull()), [*names, f"v_{c}"])
                    keep = nearest_features(g, len(others), n_nearest_features)
                    idx = [0, *[i + 1 for i in keep], len(others) + 1]
                    coef, intercept = bayesian_ridge(g[np.ix_(idx, idx)])
                    step = Step(c, [others[i] for i in keep], list(coef), intercept)
                    rule = np.array([intercept, *coef])
                    before = last.get(c)
                    same = before is not None and len(before) == len(rule)
                    change = np.abs(rule - before).sum() if same else np.inf
                    moved, last[c] = max(moved, change / (row[f"sd_{c}"] or 1.0)), rule
                else:
                    step = imputer._fit_model(state, c, [x for x in block if x != c], learner, seed)
                    step.stream = salt(salt(salt(seed) ^ number) ^ cols.index(c)) ^ 9100
                    if step.matching is not None:
                        moved = np.inf
                    trees.append(c)
                steps.append(step)
                state, filled = imputer._advance(state, filled, step)
            imputer.rounds.append(steps)
            if not steps:
                break
            if trees:
                if moved < tol:  # else nothing settles, whatever else changed
                    moved = max(moved, imputer._changed(before_round, state, trees))
            elif moved >= tol:
                state = materialize(state, "mice-round")
                filled = {"": state}
            before_round = state
            if moved < tol:
                break
        return imputer

    def _changed(self, before: DataFrame, after: DataFrame, columns: list[str]) -> float:
        """The greatest share of missing cells of a column whose fill is another one now."""
        keys = [self.id_col, *([COPY] if self.copies > 1 else [])]
        old = before.select(*keys, *[F.col(f"v_{c}").alias(f"__{c}") for c in columns])
        share = [F.avg(F.when(F.col(c).isNull(), (F.col(f"v_{c}") != F.col(f"__{c}")).cast("double"))) for c in columns]
        return max((x for x in after.join(old, keys).agg(*share).first() if x is not None), default=0.0)

    def _start(self, df: DataFrame) -> DataFrame:
        if self.copies > 1:
            df = df.withColumn(COPY, F.explode(F.sequence(F.lit(0), F.lit(self.copies - 1))))
        return df.withColumns(
            {f"v_{c}": F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in self.initial.items()}
        )

    def _advance(self, state: DataFrame, filled: dict[str, DataFrame] | None, step: Step) -> tuple[DataFrame, dict[str, DataFrame] | None]:
        """The table after a step, and its pieces: the other rows ("") and those a column's last step has filled.

        A step of trees writes the rows that lack its column; they replace older ones of theirs. Pieces are None
        where the table is not made of written rows.
        """
        c = step.column
        if step.model is None:
            return self._apply(state, step), None
        if filled is None:
            filled = {"": materialize(state, "mice-step")}
        state = reduce(DataFrame.unionByName, filled.values())
        rows = state.filter(F.col(c).isNull()).drop(c, f"v_{c}")
        done = step.predict(rows, self.id_col, f"v_{c}").withColumn(c, F.lit(None).cast(state.schema[c].dataType))
        done = materialize(done.select(*state.columns), "mice-step")
        # rows that lack the column leave the other pieces, the first one once
        left = {k: p if k == "" and c in filled else p.filter(F.col(c).isNotNull()) for k, p in filled.items() if k != c}
        filled = {**left, c: done}
        return reduce(DataFrame.unionByName, filled.values()), filled

    def _apply(self, df: DataFrame, step: Step) -> DataFrame:
        out = step.predict(df, self.id_col, "__pred")
        value = F.when(F.col(step.column).isNull(), F.col("__pred")).otherwise(F.col(f"v_{step.column}"))
        return out.withColumn(f"v_{step.column}", value).drop("__pred")

    def _fit_model(self, state: DataFrame, c: str, others: list[str], learner: str, seed: int) -> Step:
        rows = state.filter(F.col(c).isNotNull()).withColumn("__y", F.col(c).cast("double"))
        common = {"featuresCol": "features", "labelCol": "__y"}
        if c in self.numeric:
            est = GBTRegressor(maxIter=10, maxDepth=3, seed=seed, **common) if learner == "boosted" else RandomForestRegressor(numTrees=10, maxDepth=5, seed=seed, **common)
        elif learner == "forest":
            est = RandomForestClassifier(numTrees=10, maxDepth=5, seed=seed, **common)
        elif learner == "boosted":
            est = GBTClassifier(maxIter=10, maxDepth=3, seed=seed, **common)
            if rows.agg(F.max("__y")).first()[0] > 1:  # boosting tells two classes apart
                est = OneVsRest(classifier=est, **common)
        else:
            est = DecisionTreeClassifier(maxDepth=5, seed=seed, **common)
        stages = [VectorAssembler(inputCols=[f"v_{x}" for x in others], outputCol="features"), est]
        step = Step(c, others, model=Pipeline(stages=stages).fit(rows))
        if c in self.numeric:
            step.matching = fit_matching(step.predict(rows, self.id_col, "__pred"), "__y", "__pred", self.id_col)
        return step

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply the chain; observed values stay as they are. Several copies add the column ``copy``."""
        state, filled = self._start(df), None
        if any(step.model is not None for steps in self.rounds for step in steps):
            state = self._start(materialize(df, "mice-input"))
            filled = {"": state}
        for steps in self.rounds:
            for step in steps:
                state, filled = self._advance(state, filled, step)
            if all(step.model is None for step in steps):
                state = materialize(state, "mice-transform")
                filled = {"": state}
        out = {c: F.col(f"v_{c}").cast(df.schema[c].dataType) for c in self.initial}
        extra = [F.col(COPY).alias("copy")] if self.copies > 1 else []
        return state.withColumns(out).select(*df.columns, *extra)


def pool_copies(completed: DataFrame, columns: list[str], copy: str = "copy") -> DataFrame:
    """feature, copies, mean, within, between, total, share: the mean of each column over the copies of
    a completed table and its variance.

    ``within`` is the mean over copies of the variance of a copy's mean, ``between`` the variance of
    the copies' means, ``total`` their sum with ``between`` weighed by 1 + 1 / copies, and ``share`` the
    part of it that is due to the missing values (Rubin, 1987). One copy has no variance between.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    each = completed.select(copy, F.inline(cells)).groupBy("feature", copy).agg(F.avg("v").alias("m"), (F.var_samp("v") / F.count("v")).alias("w"))
    out = each.groupBy("feature").agg(F.count("*").alias("copies"), F.avg("m").alias("mean"), F.avg("w").alias("within"), F.var_samp("m").alias("between"))
    extra = (1 + 1 / F.col("copies")) * F.col("between")
    out = out.withColumn("total", F.col("within") + F.coalesce(extra, F.lit(0.0)))
    return out.withColumn("share", F.try_divide(F.coalesce(extra, F.lit(0.0)), F.col("total")))
