"""Metrics that a user writes as mergeable states.

A metric is four functions: ``init()`` gives an empty state, ``update(state, truth, pred, weight)``
takes arrays of cells into it, ``merge(a, b)`` puts two states together and ``finish(state)`` gives
the value, or None. States may be anything that can be pickled. Every task updates one state per
group, feature and subgroup from the rows it reads; the states of tasks are merged in parts first,
then per group; so a hot group or one long stream ends as a few states. The same states merge over
the batches of a stream.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.session import new_table_path

HELD_STATES = 10_000
SUBGROUPS = ("all", "missingonly")


@dataclass(frozen=True)
class UserMetric:
    name: str
    init: Callable[[], Any]
    update: Callable[[Any, np.ndarray, np.ndarray, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]


_SLOT = "feature string, filter_subgroup string, metric_name string"


def user_states(frame: DataFrame, features: list[str], metrics: list[UserMetric], by: list[str] = (), weight: str | None = None) -> DataFrame:
    """by, feature, filter_subgroup, metric_name, state: several rows a slot, one or more from each task.

    ``frame`` holds the structs ``truth``, ``pred`` and ``missing``. Cells whose truth or prediction is
    missing are left out. ``weight`` counts rows, as for a bootstrap replicate.
    """
    by = list(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f"truth.`{f}`").cast("double").alias("t"), F.col(f"pred.`{f}`").cast("double").alias("p"), F.col(f"missing.`{f}`").alias("m")) for f in features]
    long = frame.select(*by, w.alias("__w"), F.inline(F.array(*cells))).filter("t IS NOT NULL AND p IS NOT NULL AND __w IS NOT NULL")
    kinds = dict(long.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + f"{_SLOT}, state binary"

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}

        def out() -> pa.RecordBatch:
            rows = [(*key[0], *key[1:], pickle.dumps(state)) for key, state in held.items()]
            held.clear()
            types = [*(batch.schema.field(c).type for c in by), pa.string(), pa.string(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[*by, "feature", "filter_subgroup", "metric_name", "state"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*[batch.column(c).to_pylist() for c in [*by, "feature"]]))
            code = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            group = np.fromiter((code[k] for k in keys), np.int64, len(keys))
            t, p, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("t", "p", "__w"))
            gone = batch.column("m").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            order = np.argsort(group, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(group[order])) + 1, len(order))
            for key, lo, hi in zip(code, np.append(0, ends[:-1]), ends):
                rows = order[lo:hi]
                for sub in SUBGROUPS:
                    some = rows if sub == "all" else rows[gone[rows]]
                    for metric in metrics:
                        slot = (key[:-1], key[-1], sub, metric.name)
                        state = held[slot] if slot in held else metric.init()
                        held[slot] = metric.update(state, t[some], p[some], w[some]) if len(some) else state
            if len(held) > HELD_STATES:
                yield out()
        if held:
            yield out()

    return long.mapInArrow(update, schema)


def merge_user_states(states: DataFrame, metrics: list[UserMetric], by: list[str] = (), parts: int = 64) -> DataFrame:
    """One state per slot."""
    slot = [*by, "feature", "filter_subgroup", "metric_name"]
    merges = {m.name: m.merge for m in metrics}
    kinds = dict(states.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in slot) + ", state binary"

    def merge(group: pa.Table) -> pa.Table:
        name = group.column("metric_name")[0].as_py()
        first, *rest = (pickle.loads(s) for s in group.column("state").to_pylist())
        for state in rest:
            first = merges[name](first, state)
        return group.select(slot).slice(0, 1).append_column("state", pa.array([pickle.dumps(first)], pa.binary()))

    spread = states.select(*slot, "state", (F.spark_partition_id() % parts).alias("__part"))
    return spread.groupBy(*slot, "__part").applyInArrow(merge, schema).groupBy(*slot).applyInArrow(merge, schema)


def finish_user_states(states: DataFrame, metrics: list[UserMetric], by: list[str] = ()) -> DataFrame:
    """by, feature, filter_subgroup, metric_name, val."""
    finishes = {m.name: m.finish for m in metrics}
    kept = [c for c in states.columns if c != "state"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [finishes[n](pickle.loads(s)) for n, s in zip(batch.column("metric_name").to_pylist(), batch.column("state").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(values, pa.float64())], names=[*kept, "val"])

    kinds = dict(states.dtypes)
    return states.mapInArrow(finish, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", val double")


def score_user_metrics(frame: DataFrame, features: list[str], metrics: list[UserMetric], by: list[str] = (), weight: str | None = None) -> DataFrame:
    """by, feature, filter_subgroup, metric_name, val of every group, from one pass over the rows."""
    states = user_states(frame, features, metrics, by, weight)
    return finish_user_states(merge_user_states(states, metrics, by), metrics, by)


def score_user_stream(stream: DataFrame, features: list[str], metrics: list[UserMetric], by: list[str] = (), path: str | None = None) -> DataFrame:
    """The same over what a stream has; each batch leaves its merged states once, in a folder of its number."""
    path = path or new_table_path(stream.sparkSession, "user-states")

    def add(batch: DataFrame, number: int) -> None:
        merged = merge_user_states(user_states(batch, features, metrics, by), metrics, by)
        merged.write.mode("overwrite").parquet(f"{path}/states/batch={number}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    states = stream.sparkSession.read.parquet(f"{path}/states").drop("batch")
    return finish_user_states(merge_user_states(states, metrics, by), metrics, by)
