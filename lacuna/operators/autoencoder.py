"""Autoencoder imputation, trained data-parallel.

Every task takes small gradient steps over its own rows from the current weights; Spark averages the
resulting weights by row count (local SGD). One job per epoch also measures the validation loss of
the weights it started from. Only weights pass through the driver. The rows are packed into blocks of
columns once, so that an epoch does not turn every cell from Parquet into Arrow and into a matrix.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.hashing import salt, stream_key, uniform, with_uniform53
from lacuna.operators.encode import binary_threshold, onehot_threshold
from lacuna.operators.impute_simple import warm_start
from lacuna.operators.ranking import grouped_rank
from lacuna.schema import FeatureSchema
from lacuna.session import materialize

# Named variants and what each changes.
PRESETS: dict[str, dict] = {
    "vanilla": {},
    "dae": {"dropout_corruption": 0.3},
    "batchswap": {"batchswap_corruption": 0.3},
    "vae": {"variational": True},
    "dvae": {"dropout_corruption": 0.3, "variational": True},
    "ap_new": {"activation": "relu", "optimizer": "adam", "loss": "BCE"},
    "mida": {"loss": "MSE", "optimizer": "sgd", "activation": "tanh", "dropout_corruption": 0.5, "replace_nan_with": "simple"},
    "dae_mvec": {"dropout_corruption": 0.2, "replace_nan_with": 0, "loss": "BCE", "optimizer": "sgd", "activation": "sigmoid"},
    "vae_ifac": {"variational": True, "loss": "CEMSE", "activation": "relu", "replace_nan_with": 0},
}
SWAP_STREAM = 4_000
KL_WEIGHT = 0.1
BLOCK_BYTES = 1 << 20  # of a block's cells as doubles
GROUP_BYTES = 16 << 20  # of a row group of blocks
EPSILON = 1e-10


def _act(name: str, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Activation and its derivative."""
    if name == "relu":
        return np.maximum(z, 0), (z > 0).astype(z.dtype)
    if name == "tanh":
        a = np.tanh(z)
        return a, 1 - a * a
    a = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    return a, a * (1 - a)


def layer_sizes(n: int, hidden: list[float]) -> list[int]:
    """Symmetric sizes; a fraction is taken of the number of features, rounded up."""
    sizes = [math.ceil(h * n) if isinstance(h, float) else h for h in hidden]
    return [n, *sizes, *sizes[-2::-1], n]


@dataclass
class Layout:
    """Positions of the column types and the loss to use on them."""

    continuous: list[int]
    binary: list[int]
    groups: list[list[int]]
    loss: str


def loss_and_gradient(out: np.ndarray, truth: np.ndarray, seen: np.ndarray, lay: Layout) -> tuple[float, np.ndarray]:
    """Mean loss per row and its gradient in the output; unobserved truth does not count."""
    n, grad, loss = max(1, len(out)), np.zeros_like(out), 0.0
    binary, groups = list(lay.binary), lay.groups
    if lay.loss == "BCE":
        binary, groups = binary + [i for g in groups for i in g], []
    if lay.loss == "MSE":
        ctn, binary, groups = list(range(out.shape[1])), [], []
    else:
        ctn = list(lay.continuous)
    if binary:
        x, y, m = out[:, binary], truth[:, binary], seen[:, binary]
        loss += np.sum(m * (np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x))))) / (n * len(binary))
        grad[:, binary] = m * (1 / (1 + np.exp(-np.clip(x, -60, 60))) - y) / (n * len(binary))
    for g in groups:
        x, m = out[:, g], seen[:, g].all(axis=1, keepdims=True)
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        y = np.eye(len(g))[truth[:, g].argmax(axis=1)]
        loss += -np.sum(m * y * np.log(p + 1e-30)) / n
        grad[:, g] = m * (p - y) / n
    if ctn:
        d, m = out[:, ctn] - truth[:, ctn], seen[:, ctn]
        if lay.loss == "CEMAAPE":
            scale = truth[:, ctn] + EPSILON
            r = d / scale
            loss += np.sum(m * np.arctan(np.abs(r))) * 2 / math.pi / (n * len(ctn))
            grad[:, ctn] = m * np.sign(r) / scale / (1 + r * r) * 2 / math.pi / (n * len(ctn))
        else:
            loss += np.sum(m * d * d) / (n * len(ctn))
            grad[:, ctn] = m * 2 * d / (n * len(ctn))
    return loss, grad


@dataclass
class Network:
    """Shapes and options of the network; weights are one flat vector."""

    sizes: list[int]
    activation: str = "relu"
    variational: bool = False
    dropout: float = 0.0

    def shapes(self) -> list[tuple[int, int]]:
        pairs = list(zip(self.sizes[:-1], self.sizes[1:]))
        if self.variational:  # the code layer gives mean and log variance
            k = len(pairs) // 2 - 1
            pairs[k] = (pairs[k][0], 2 * pairs[k][1])
        return pairs

    def initial(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        parts = []
        for i, o in self.shapes():
            bound = 1 / math.sqrt(i)
            parts += [rng.uniform(-bound, bound, i * o), rng.uniform(-bound, bound, o)]
        return np.concatenate(parts)

    def unpack(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for i, o in self.shapes():
            out.append((flat[at : at + i * o].reshape(i, o), flat[at + i * o : at + i * o + o]))
            at += i * o + o
        return out

    def run(self, flat: np.ndarray, x: np.ndarray, rng=None):
        """Output and a function from its gradient to (flat gradient, KL term). ``rng`` means training."""
        layers, code = self.unpack(flat), len(self.sizes) // 2 - 1
        inputs, slopes, kl, noise = [], [], 0.0, None
        h = x
        for k, (w, b) in enumerate(layers):
            inputs.append(h)
            z = h @ w + b
            if k == len(layers) - 1:
                h, slope = z, np.ones_like(z)
            elif self.variational and k == code:
                half = z.shape[1] // 2
                mu, logvar = z[:, :half], np.clip(z[:, half:], -20, 20)
                noise = rng.standard_normal(mu.shape) if rng is not None else np.zeros_like(mu)
                h, slope = mu + noise * np.exp(logvar / 2), None
                kl = float(np.mean(logvar / 2 + (1 + mu**2) / (2 * np.exp(logvar)) - 0.5))
            else:
                h, slope = _act(self.activation, z)
                if rng is not None and self.dropout:
                    keep = (rng.random(h.shape) >= self.dropout) / (1 - self.dropout)
                    h, slope = h * keep, slope * keep
            slopes.append(slope)

        def backward(grad: np.ndarray) -> np.ndarray:
            parts = []
            for k in reversed(range(len(layers))):
                if slopes[k] is None:
                    var = np.exp(logvar)
                    d_mu = grad + KL_WEIGHT * mu / var / mu.size
                    d_lv = grad * noise * np.exp(logvar / 2) / 2
                    d_lv += KL_WEIGHT * (0.5 - (1 + mu**2) / (2 * var)) / mu.size
                    dz = np.hstack([d_mu, d_lv])
                else:
                    dz = grad * slopes[k]
                parts += [dz.sum(axis=0), (inputs[k].T @ dz).ravel()]
                grad = dz @ layers[k][0].T
            return np.concatenate(parts[::-1])

        return h, backward, kl


def swap_rows(x: np.ndarray, p: float, rng) -> np.ndarray:
    """Each cell is replaced with probability p by the same column of another row of the batch."""
    other = rng.integers(0, len(x), x.shape)
    return np.where(rng.random(x.shape) < p, np.take_along_axis(x, other, axis=0), x)


def _matrix(columns: list[pa.Array]) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])


def _pack(m: np.ndarray) -> bytes:
    """Column by column: up to 256 distinct values, counted, and a byte a row; else a count of 0 and the values."""
    parts = [len(m).to_bytes(4, "little")]
    for c in m.T:
        values, codes = np.unique(c, return_inverse=True)
        if len(values) <= 256:
            parts += [len(values).to_bytes(2, "little"), values.astype("<f8").tobytes(), codes.astype(np.uint8).tobytes()]
        else:
            parts += [bytes(2), c.astype("<f8").tobytes()]
    return b"".join(parts)


def _unpack(data: bytes, matrices: int) -> np.ndarray:
    """The columns of a block, dealt in order to matrices of equal width."""
    rows, at, columns = int.from_bytes(data[:4], "little"), 4, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 2], "little")
        values = np.frombuffer(data, "<f8", n or rows, at + 2)
        at += 2 + values.nbytes
        if n:
            values = values[np.frombuffer(data, np.uint8, rows, at)]
            at += rows
        columns.append(values)
    width = len(columns) // matrices
    out = np.empty((matrices, rows, width))
    for j, c in enumerate(columns):
        out[j // width, :, j % width] = c
    return out


def _blocks(table: DataFrame, n: int, split: str) -> DataFrame:
    """The train and validation rows, packed: task and batch they come from, kind, cells.

    A batch keeps its rows in order; one of many bytes is several blocks.
    """
    most = max(1, BLOCK_BYTES // (8 * 3 * n))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            part = np.asarray(batch.column(split).to_pylist())
            inputs, targets = ([batch.column(f"{k}{i}") for i in range(n)] for k in "xt")
            seen = [pc.cast(c.is_valid(), pa.float64()) for c in targets]
            cells = None
            for kind in ("val", "train"):
                of_kind = np.flatnonzero(part == kind)
                for at in range(0, len(of_kind), most):
                    cells = _matrix([*inputs, *[c.fill_null(0.0) for c in targets], *seen]) if cells is None else cells
                    row = [task, number, kind == "val", _pack(cells[of_kind[at : at + most]])]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=columns)
            number += cells is not None

    columns, types = ["task", "batch", "val", "cells"], [pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    packed = table.mapInArrow(pack, "task int, batch int, val boolean, cells binary")
    return materialize(packed, "autoencoder-blocks", row_group_bytes=GROUP_BYTES)


@dataclass
class AutoencoderImputer:
    """Configuration, and after ``fit`` the weights."""

    schema: FeatureSchema
    hidden_layers: list[float] = field(default_factory=lambda: [0.5])
    learning_rate: float = 1e-2
    l2_penalty: float = 0.0
    loss: str = "CEMSE"
    optimizer: str = "adam"
    activation: str = "relu"
    dropout: float = 0.0
    dropout_corruption: float = 0.0
    batchswap_corruption: float = 0.0
    variational: bool = False
    replace_nan_with: float | str = 0
    batch_size: int = 128
    max_epochs: int = 100
    patience: int = 3
    seed: int = 0
    weights: list[float] | None = None
    history: list[float] = field(default_factory=list)

    @staticmethod
    def preset(name: str, schema: FeatureSchema, **changes) -> "AutoencoderImputer":
        return AutoencoderImputer(schema, **{**PRESETS[name], **changes})

    def __post_init__(self) -> None:
        features = self.schema.features
        if self.variational and self.schema.bins:
            raise ValueError("a variational autoencoder does not take discretised columns")
        at = {c: i for i, c in enumerate(features)}
        groups = [*self.schema.onehot.values(), *self.schema.bins.values()]
        self._layout = Layout(
            [at[c] for c in self.schema.continuous],
            [at[c] for c in self.schema.binary],
            [[at[c] for c in g] for g in groups],
            self.loss,
        )
        self._net = Network(layer_sizes(len(features), self.hidden_layers), self.activation, self.variational, self.dropout)

    def _inputs(self, df: DataFrame) -> DataFrame:
        doubles = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in self.schema.features})
        return warm_start(doubles, self.schema, self.replace_nan_with)

    def _training_table(self, data: DataFrame, truth: DataFrame | None) -> DataFrame:
        """Input, target and observed flag per feature, in blocks; without truth, observed data is the target."""
        ids, split = list(self.schema.ids), self.schema.split
        feats = self.schema.features
        filled = self._inputs(data)
        target = truth if truth is not None else data
        goal = target.select(
            *ids,
            *[F.col(f"`{c}`").cast("double").alias(f"t{i}") for i, c in enumerate(feats)],
        )
        cells = filled.filter(F.col(split).isin("train", "val")).select(
            *ids, split, *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(feats)]
        )
        return _blocks(materialize(cells.join(goal, ids).drop(*ids), "autoencoder-train"), len(feats), split)

    def fit(self, data: DataFrame, truth: DataFrame | None = None) -> "AutoencoderImputer":
        table = self._training_table(data, truth)
        flat, best, best_loss, waited = self._net.initial(self.seed), None, math.inf, 0
        for epoch in range(self.max_epochs + 1):
            updated, val = self._epoch(table, flat, epoch)
            self.history.append(val)
            if val < best_loss:
                best, best_loss, waited = flat, val, 0
            else:
                waited += 1
            if waited >= self.patience or updated is None:
                break
            flat = updated
        self.weights = [float(v) for v in (best if best is not None else flat)]
        return self

    def _epoch(self, table: DataFrame, flat: np.ndarray, epoch: int) -> tuple[np.ndarray | None, float]:
        """Averaged weights after one pass over the train rows; validation loss of the given weights."""
        net, lay, cfg = self._net, self._layout, self
        lr, l2, size, adam = cfg.learning_rate, cfg.l2_penalty, cfg.batch_size, cfg.optimizer == "adam"
        drop, swap, seed = cfg.dropout_corruption, cfg.batchswap_corruption, cfg.seed
        shared = table.sparkSession.sparkContext.broadcast(flat)

        def replica(batches) -> np.ndarray:
            """Weights times rows, rows, validation loss and its rows, from one task's batches."""
            start, rng = shared.value, None
            w, rows, val_sum, val_rows = start.copy(), 0, 0.0, 0
            m1, m2, step = np.zeros_like(w), np.zeros_like(w), 0
            for (task, number), blocks in batches:
                kinds = {True: [], False: []}
                for _, _, v, cells in blocks:
                    kinds[v].append(_unpack(cells, 3))
                # where a file is read by several tasks, each has draws of its own
                rng = rng or np.random.default_rng([seed, epoch, task, number][: 4 if number else 3])
                if kinds[True]:
                    x, t, s = np.concatenate(kinds[True], axis=1)
                    out, _, kl = net.run(start, x)
                    loss, _ = loss_and_gradient(out, t, s, lay)
                    val_sum += (loss + KL_WEIGHT * kl) * len(x)
                    val_rows += len(x)
                if not kinds[False]:
                    continue
                x, t, s = np.concatenate(kinds[False], axis=1)
                order = rng.permutation(np.arange(len(x)))
                for at in range(0, len(order), size):
                    idx = order[at : at + size]
                    h = swap_rows(x[idx], swap, rng) if swap else x[idx]
                    h = h * (rng.random(h.shape) >= drop) if drop else h
                    out, backward, _ = net.run(w, h, rng)
                    _, grad = loss_and_gradient(out, t[idx], s[idx], lay)
                    g = backward(grad) + l2 * w
                    step += 1
                    if adam:
                        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
                        w -= lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
                    else:
                        w -= lr * g
                    rows += len(idx)
            return np.concatenate([w * rows, [rows, val_sum, val_rows]])

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = (
                tuple(v.as_py() for v in row) for batch in batches for row in zip(*(batch.column(c) for c in ("task", "batch", "val", "cells")))
            )
            for _, mine in groupby(blocks, itemgetter(0)):
                values = replica(groupby(mine, itemgetter(0, 1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["pos", "v"]
                )

        sums = table.mapInArrow(train, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v"))
        total = np.zeros(len(flat) + 3)
        for r in sums.collect():
            total[r.pos] = r.v
        shared.destroy()
        rows, val_sum, val_rows = total[-3:]
        val = val_sum / val_rows if val_rows else math.inf
        return (total[:-3] / rows if rows and epoch < self.max_epochs else None), val

    def predict(self, df: DataFrame) -> DataFrame:
        """Raw outputs: values for continuous columns, logits for the others."""
        feats, net = self.schema.features, self._net
        shared = df.sparkSession.sparkContext.broadcast(np.array(self.weights))
        passed = [c for c in df.columns if c not in set(feats)]
        # Bin columns have dots in their names, which the Arrow functions do not take.
        plain = [f"x{i}" for i in range(len(feats))]
        inputs = [F.col(f"`{c}`").alias(x) for c, x in zip(feats, plain)]
        filled = self._inputs(df).select(*passed, *inputs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out, _, _ = net.run(shared.value, _matrix([b.column(c) for c in plain]))
                arrays = [b.column(c) for c in passed] + [pa.array(out[:, i]) for i in range(len(feats))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*passed, *plain])

        return filled.mapInArrow(run, filled.schema).toDF(*passed, *feats)

    def transform(self, df: DataFrame) -> DataFrame:
        """Fill missing cells; observed ones never change.

        Observed values travel along with the row, so nothing has to be joined back.
        """
        kept = df.withColumn("__kept", F.struct(*[F.col(f"`{c}`") for c in self.schema.features]))
        out = self.predict(kept)
        out = binary_threshold(out, list(self.schema.binary))
        groups = {**self.schema.onehot, **self.schema.bins}
        out = onehot_threshold(out, {k: list(v) for k, v in groups.items()})
        cells = {
            c: F.coalesce(F.col(f"__kept.`{c}`"), F.col(f"`{c}`").cast(df.schema[c].dataType))
            for c in self.schema.features
        }
        return out.withColumns(cells).select(*[F.col(f"`{c}`") for c in df.columns])

    def save(self, spark, path: str) -> None:
        config = {k: v for k, v in asdict(self).items() if k not in ("schema", "weights")}
        row = [(self.schema.to_json(), json.dumps(config), self.weights)]
        spark.createDataFrame(row, "schema string, config string, weights array<double>").write.parquet(path)

    @staticmethod
    def load(spark, path: str) -> "AutoencoderImputer":
        r = spark.read.parquet(path).first()
        return AutoencoderImputer(FeatureSchema.from_json(r["schema"]), weights=r["weights"], **json.loads(r["config"]))


def swap_noise(df: DataFrame, columns: list[str], p: float, id_col: str = "id", seed: int = 0) -> DataFrame:
    """Table form of the swap: a cell takes, with probability p, its column's value in another row.

    Whether and with which row number is drawn from a hash of the id, so any engine, partitioning
    and retry gives the same table. Only swapped cells are shuffled. Ids have to be distinct; rows
    without an id stay as they are.
    """
    rows = materialize(df, "swap-input")
    n = rows.count()
    numbered = grouped_rank(rows.withColumn("__all", F.lit(0)), ["__all"], id_col, "__rn")
    cells, swapped = [], []
    for j in range(len(columns)):
        numbered = with_uniform53(numbered, id_col, F.lit(salt(seed + SWAP_STREAM + 2 * j + 1)), f"__u{j}")
        swapped.append(uniform(stream_key(F.col(id_col), seed + SWAP_STREAM + 2 * j)) < p)
        partner = F.least(F.floor(F.col(f"__u{j}") * float(n)), F.lit(n - 1)).cast("bigint") + 1
        cells.append(F.struct(F.lit(j).alias("pos"), F.when(swapped[j], partner).alias("partner")))
    wanted = numbered.select("__rn", F.inline(F.array(*cells))).filter("partner IS NOT NULL")
    values = numbered.select(F.col("__rn").alias("partner"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("v"))
    taken = wanted.join(values, "partner").groupBy("__rn").agg(
        *[F.max(F.when(F.col("pos") == j, F.col("v")[c])).alias(f"__s{j}") for j, c in enumerate(columns)]
    )
    out = {c: F.when(swapped[j], F.col(f"__s{j}")).otherwise(F.col(f"`{c}`")) for j, c in enumerate(columns)}
    return numbered.join(taken, "__rn", "left").withColumns(out).select(*[f"`{c}`" for c in df.columns])
