"""Masked imputation errors as sums that merge over batches, partitions and replicates.

Per row and feature there are error terms and a flag telling whether the cell was missing; the
states are their sums per feature. One aggregate yields them for all cells and for the originally
missing ones; a second one over that small table turns them into metrics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.encode import argmax
from lacuna.schema import FeatureSchema

EPSILON = 1e-10
METRICS = ["RMSE", "MAAPE"]
REDUCTIONS = ["CW", "EW"]
SUBGROUPS = ["all", "missingonly"]


def _get(side: str, c: str) -> Column:
    return F.col(f"`{side}`.`{c}`")


def squared_error(t: Column, p: Column) -> Column:
    return F.pow(t - p, F.lit(2.0))


def aape(t: Column, p: Column) -> Column:
    """arctan(abs(relative error)); the offset is added with its sign."""
    return F.atan(F.abs((t - p) / (t + F.lit(EPSILON))))


def unit_terms(schema: FeatureSchema) -> dict[str, tuple[bool, Column, Column, Column]]:
    """Per feature: is it continuous, its two error terms and its missing flag (all double).

    Continuous: squared error and absolute arctangent error. Categorical: 1 where wrong, twice. A
    term is missing exactly where the truth or the prediction is. A one-hot group counts as missing
    when all of its members are.
    """
    out = {}
    for c in schema.continuous:
        t, p = _get("truth", c).cast("double"), _get("pred", c).cast("double")
        out[c] = (True, squared_error(t, p), aape(t, p), _get("missing", c).cast("double"))
    for c in (*schema.binary, *schema.categorical):
        wrong = (_get("truth", c) != _get("pred", c)).cast("double")
        out[c] = (False, wrong, wrong, _get("missing", c).cast("double"))
    for g, cols in schema.onehot.items():
        wrong = argmax([_get("truth", c) for c in cols]) != argmax([_get("pred", c) for c in cols])
        gone = reduce(lambda a, b: a & b, [_get("missing", c) for c in cols])
        out[g] = (False, wrong.cast("double"), wrong.cast("double"), gone.cast("double"))
    return out


def row_cells(schema: FeatureSchema) -> Column:
    """The terms of a row as an array, one element per feature."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.lit(ctn).alias("ctn"),
                e1.alias("e1"),
                e2.alias("e2"),
                m.alias("m"),
            )
            for name, (ctn, e1, e2, m) in unit_terms(schema).items()
        ]
    )


def _sums(weight: str | None = None) -> list[Column]:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e1, e2, m = F.col("e1") * w, F.col("e2") * w, F.col("m")
    return [
        F.sum(w).alias("n"),
        F.sum(m * w).alias("n_missing"),
        F.count(F.when(F.col("e1").isNull(), 1)).alias("gaps"),
        F.sum(e1).alias("e1_all"),
        F.sum(e1 * m).alias("e1_missing"),
        F.sum(e2).alias("e2_all"),
        F.sum(e2 * m).alias("e2_missing"),
    ]


STATES = ["n", "n_missing", "gaps", "e1_all", "e1_missing", "e2_all", "e2_missing"]


def cell_states(cells: DataFrame, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """States of frames that hold the array ``cells``.

    Cells are unfolded and summed within the task that reads the row. The aggregate stays a handful
    of sums for any number of features: one sum per feature and metric would make a generated
    method too long for the JIT.
    """
    extra = [weight] if weight else []
    long = cells.select(*by, *extra, F.inline("cells"))
    return long.groupBy(*by, "feature", "ctn").agg(*_sums(weight))


def metric_states(
    frame: DataFrame, schema: FeatureSchema, by: list[str] = (), weight: str | None = None
) -> DataFrame:
    """Mergeable states of a scoring frame: one row per group and feature, from one pass.

    The array is unfolded where it is built: as a named column its expression would be copied into
    inferred filters.
    """
    extra = [weight] if weight else []
    long = frame.select(*by, *extra, F.inline(row_cells(schema)))
    return long.groupBy(*by, "feature", "ctn").agg(*_sums(weight))


def merge_states(states: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sum the states of batches."""
    return states.groupBy(*by, "feature", "ctn").agg(*[F.sum(c).alias(c) for c in STATES])


def wide_terms(schema: FeatureSchema) -> dict[str, Column]:
    """The summands of the states as one column each, for sums by matrix product."""
    out = {}
    for i, (_, e1, e2, m) in enumerate(unit_terms(schema).values()):
        out |= {f"m{i}": m, f"a{i}": e1, f"b{i}": e1 * m, f"c{i}": e2, f"d{i}": e2 * m}
    return out


def states_from_wide(sums: DataFrame, schema: FeatureSchema, by: list[str]) -> DataFrame:
    """Sums of ``wide_terms`` and ``n`` per group as states."""
    cells = [
        F.struct(
            F.lit(name).alias("feature"),
            F.lit(unit[0]).alias("ctn"),
            F.col("n"),
            F.col(f"m{i}").alias("n_missing"),
            F.lit(0).cast("bigint").alias("gaps"),
            F.col(f"a{i}").alias("e1_all"),
            F.col(f"b{i}").alias("e1_missing"),
            F.col(f"c{i}").alias("e2_all"),
            F.col(f"d{i}").alias("e2_missing"),
        )
        for i, (name, unit) in enumerate(unit_terms(schema).items())
    ]
    return sums.select(*by, F.inline(F.array(*cells)))


def _reduce(ctn: bool, err: str, cnt: str, root: bool, scale: float) -> dict[str, Column]:
    """Column-wise: mean over features that have counted cells. Element-wise: ratio of the sums.
    Nothing counted: 0."""
    mine = F.col("ctn") == ctn
    some = mine & (F.col(cnt) > 0)
    cell = F.col(err) / F.col(cnt)
    cw = F.avg(F.when(some, F.sqrt(cell) if root else cell))
    ew = F.sum(F.when(some, F.col(err))) / F.sum(F.when(some, F.col(cnt)))
    ew = F.sqrt(ew) if root else ew
    return {r: F.coalesce(v, F.lit(0.0)) * scale for r, v in (("CW", cw), ("EW", ew))}


def metrics_long(states: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per metric: filter_subgroup, reduction, feature_type, metric_name, val.

    With nothing missing in the whole group, the missing-only metric is the one over all cells.
    """
    aggs = [F.sum("n_missing").alias("any_missing"), F.sum("gaps").alias("gaps")]
    for sub, cnt in (("all", "n"), ("missing", "n_missing")):
        parts = {
            "RMSE": _reduce(True, f"e1_{sub}", cnt, True, 1.0),
            "MAAPE": _reduce(True, f"e2_{sub}", cnt, False, 2 / math.pi),
            "wrong": _reduce(False, f"e1_{sub}", cnt, False, 1.0),
        }
        aggs += [c.alias(f"{sub}_{name}_{r}") for name, p in parts.items() for r, c in p.items()]
    wide = states.groupBy(*by).agg(*aggs)

    def value(subgroup: str, name: str, reduction: str) -> Column:
        over_all = F.col(f"all_{name}_{reduction}")
        if subgroup == "all":
            return over_all
        return F.when(F.col("any_missing") > 0, F.col(f"missing_{name}_{reduction}")).otherwise(over_all)

    cells = []
    for s in SUBGROUPS:
        for r in REDUCTIONS:
            for m in METRICS:
                num, cat = value(s, m, r), value(s, "wrong", r)
                for t, v in (("continuous", num), ("categorical", cat), ("mixed", num + cat)):
                    names = {"filter_subgroup": s, "reduction": r, "feature_type": t, "metric_name": m}
                    cells.append(F.struct(*[F.lit(x).alias(k) for k, x in names.items()], v.alias("val")))
    return wide.select(*by, F.inline(F.array(*cells)))


def check_complete(states: DataFrame, action: str = "raise") -> DataFrame:
    """Scores need complete predictions and truth: fail at run time, or ``skip`` to no rows."""
    if action == "skip":
        return states.filter(F.lit(states.agg(F.sum("gaps")).first()[0] in (0, None)))
    guard = F.assert_true(F.col("gaps") == 0, F.lit("prediction or truth has missing values"))
    return states.filter(guard.isNull())


def pick_metric(
    long: DataFrame, subgroup: str, reduction: str, feature_type: str, metric: str, name: str, by: list[str] = ()
) -> DataFrame:
    """One metric of the long table as a column."""
    where = {"filter_subgroup": subgroup, "reduction": reduction, "feature_type": feature_type, "metric_name": metric}
    for c, v in where.items():
        long = long.filter(F.col(c) == v)
    return long.select(*by, F.col("val").alias(name))


def score_imputation(
    frame: DataFrame,
    schema: FeatureSchema,
    by: list[str] = (),
    weight: str | None = None,
    check: str | None = "raise",
) -> DataFrame:
    """Long metric rows of a scoring frame (structs truth, pred, missing) per group."""
    states = metric_states(frame, schema, by, weight)
    if check:
        states = check_complete(states, check)
    return metrics_long(states, by)


def tune_metric(frame: DataFrame, schema: FeatureSchema, by: list[str] = ()) -> DataFrame:
    """Score to maximise: minus the missing-only column-wise MAAPE plus categorical error."""
    long = metrics_long(metric_states(frame, schema, by), by)
    picked = pick_metric(long, "missingonly", "CW", "mixed", "MAAPE", "err", by)
    return picked.select(*by, (-F.col("err")).alias("score"))


def normalised_rmse(frame: DataFrame, schema: FeatureSchema, by: str = "range") -> DataFrame:
    """Column-wise RMSE over missing cells, each divided by mean, population std or range of the truth."""
    aggs = []
    for i, c in enumerate(schema.continuous):
        t = F.when(_get("missing", c), _get("truth", c))
        err = F.sqrt(F.avg(F.when(_get("missing", c), squared_error(_get("truth", c), _get("pred", c)))))
        denom = {"mean": F.avg(t), "std": F.stddev_pop(t), "range": F.max(t) - F.min(t)}[by]
        aggs.append((err / denom).alias(c))
    return frame.agg(*aggs)


def mixed_loss(frame: DataFrame, schema: FeatureSchema, continuous: str = "MSE") -> DataFrame:
    """Sum over groups of cross-entropy, plus mean binary cross-entropy, plus MSE (or MAAPE).

    ``pred`` holds logits for binary and one-hot columns. Parts without columns are 0.
    """
    parts = {"onehot": F.lit(0.0), "binary": F.lit(0.0), "continuous": F.lit(0.0)}
    for cols in schema.onehot.values():
        logits = [_get("pred", c).cast("double") for c in cols]
        top = F.greatest(*logits) if len(logits) > 1 else logits[0]
        norm = top + F.log(reduce(lambda a, b: a + b, [F.exp(x - top) for x in logits]))
        chosen = F.get(F.array(*logits), argmax([_get("truth", c) for c in cols]))
        parts["onehot"] = parts["onehot"] + F.avg(norm - chosen)
    for c in schema.binary:
        x, y = _get("pred", c).cast("double"), _get("truth", c).cast("double")
        bce = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
        parts["binary"] = parts["binary"] + F.avg(bce) / len(schema.binary)
    for c in schema.continuous:
        t, p = _get("truth", c).cast("double"), _get("pred", c).cast("double")
        term = squared_error(t, p) if continuous == "MSE" else aape(t, p) * F.lit(2 / math.pi)
        parts["continuous"] = parts["continuous"] + F.avg(term) / len(schema.continuous)
    out = frame.agg(*[e.alias(k) for k, e in parts.items()])
    return out.withColumn("loss", F.col("onehot") + F.col("binary") + F.col("continuous"))


def row_error(schema: FeatureSchema) -> Column:
    """Error of one row over its continuous features: the root of the mean squared error."""
    terms = [
        squared_error(_get("truth", c).cast("double"), _get("pred", c).cast("double"))
        for c in schema.continuous
    ]
    return F.sqrt(reduce(lambda a, b: a + b, terms) / len(terms))


def best_worst_rows(frame: DataFrame, schema: FeatureSchema, id_col: str, n: int = 10) -> DataFrame:
    """The n rows with the smallest and the n with the largest error, ties by id.

    Sorting with a limit keeps n rows per partition before the exchange.
    """
    scored = frame.select(id_col, row_error(schema).alias("err"))
    best = scored.orderBy("err", id_col).limit(n).withColumn("kind", F.lit("best"))
    worst = scored.orderBy(F.desc("err"), id_col).limit(n).withColumn("kind", F.lit("worst"))
    return best.unionByName(worst)


def row_errors(schema: FeatureSchema, subgroup: str = "all") -> dict[str, Column]:
    """Per metric the error of one row: RMSE and MAAPE over its continuous features, the share of wrong
    ones over its categorical features. ``missingonly`` counts cells that were missing; a row without
    such cells, or with a gap left, has no error of that metric."""
    units = list(unit_terms(schema).values())
    out = {}
    for name, ctn, at, root in (("RMSE", True, 1, True), ("MAAPE", True, 2, False), ("wrong", False, 1, False)):
        mine = [u for u in units if u[0] == ctn]
        if not mine:
            continue
        weights = [u[3] if subgroup == "missingonly" else F.lit(1.0) for u in mine]
        terms = [F.when(w > 0, u[at] * w).otherwise(0.0) for u, w in zip(mine, weights)]
        mean = F.try_divide(reduce(lambda a, b: a + b, terms), reduce(lambda a, b: a + b, weights))
        out[name] = F.sqrt(mean) if root else mean * (2 / math.pi if name == "MAAPE" else 1.0)
    return out


def extreme_rows(errors: DataFrame, by: list[str], id_col: str, n: int, groups: int = 64) -> DataFrame:
    """by, kind, rank, id, err: the n rows of each group of ``errors`` with the least and the greatest err.

    Ties go to the smaller id. Every task keeps n rows a group and kind in heaps, whatever it reads; the
    heaps of the tasks are merged in ``groups`` parts a group first, so nothing is sorted as a whole.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    table = errors.select(*by, F.col(id_col).alias("id"), F.col("err").cast("double").alias("err")).filter("err IS NOT NULL")
    kinds = dict(table.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + f", kind string, id {kinds['id']}, err double"

    def kept(rows: pa.Table) -> pa.Table:
        """The n first of each group and kind, worst errors being negative inside."""
        signed = pc.if_else(pc.equal(rows["kind"], "best"), rows["err"], pc.negate(rows["err"]))
        rows = rows.append_column("__key", signed)
        order = pc.sort_indices(rows, [*((c, "ascending") for c in by), ("kind", "ascending"), ("__key", "ascending"), ("id", "ascending")])
        rows = rows.take(order).drop_columns("__key")
        group = [rows[c].combine_chunks() for c in [*by, "kind"]]
        starts = np.zeros(len(rows), bool)
        starts[:1] = True
        for g in group:
            code = g.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts[1:] |= code[1:] != code[:-1]
        first = np.maximum.accumulate(np.where(starts, np.arange(len(rows)), 0))
        return rows.filter(pa.array(np.arange(len(rows)) - first < n))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            both = [part.add_column(len(by), "kind", pa.array([k] * len(part), pa.string())) for k in ("best", "worst")]
            held = kept(pa.concat_tables([*([held] if held is not None else []), *both]))
        if held is not None:
            yield from held.to_batches()

    heaps = table.mapInArrow(per_task, schema).withColumn("__part", F.spark_partition_id() % groups)
    merged = heaps.groupBy(*by, "kind", "__part").applyInArrow(lambda t: kept(t.drop_columns("__part")), schema)
    merged = merged.groupBy(*by, "kind").applyInArrow(kept, schema)
    place = F.when(F.col("kind") == "best", F.col("err")).otherwise(-F.col("err"))
    rank = F.row_number().over(Window.partitionBy(*by, "kind").orderBy(place, "id"))  # n rows a group and kind
    return merged.select(*by, "kind", rank.alias("rank"), F.col("id").alias(id_col), "err")


def best_worst_by_metric(frame: DataFrame, schema: FeatureSchema, id_col: str, n: int = 10) -> DataFrame:
    """filter_subgroup, metric_name, kind, rank, id, err: the best and worst rows of every metric."""
    cells = [
        F.struct(F.lit(s).alias("filter_subgroup"), F.lit(m).alias("metric_name"), e.alias("err"))
        for s in SUBGROUPS for m, e in row_errors(schema, s).items()
    ]
    return extreme_rows(frame.select(id_col, F.inline(F.array(*cells))), ["filter_subgroup", "metric_name"], id_col, n)
