"""The softmax student: loss and gradient, scoring. Fitting is in ``jointfit``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pupilage.config import ModelError, TaskSpec, TrainingError
from pupilage.functions.probability import argmax, served_label
from pupilage.operators.metrics import class_weights

# Fixed values of the Adam update and of the loss.
BETA1 = 0.9
BETA2 = 0.999
EPSILON = 1e-8
PROBABILITY_FLOOR = 1e-12
# Stored values that are worked on at once.
SLICE_CELLS = 1 << 19


@dataclass(frozen=True)
class LinearModel:
    """``weights`` is classes x dimensions; bounded by 32 x 262,144 plus dense."""

    weights: np.ndarray
    bias: np.ndarray

    @property
    def classes(self) -> int:
        return self.weights.shape[0]

    @property
    def dimensions(self) -> int:
        return self.weights.shape[1]

    def check(self) -> None:
        """One finite bias and one row of finite weights for each of two or more classes."""
        table = self.weights if self.weights.ndim == 2 else np.zeros((0, 0))
        if min(table.shape[0] - 1, table.shape[1]) < 1 or self.bias.shape != table.shape[:1]:
            raise ModelError(f"weights {self.weights.shape} and bias {self.bias.shape} are no linear model")
        if not np.isfinite(np.column_stack([table, self.bias])).all():
            raise ModelError("a weight or bias is NaN or infinite")


@dataclass(frozen=True)
class Fit:
    model: LinearModel
    final_loss: float
    train_accuracy: float
    #: False if the passes ended before the optimiser did.
    converged: bool = True


# ---- Arrow batches of vectors -------------------------------------------------


def _cells(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of a batch of sparse or dense vectors."""
    values = vectors.field("values")
    sizes = values.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(vectors)), sizes)
    value = values.flatten().to_numpy(zero_copy_only=False)
    dense = vectors.field("type").to_numpy(zero_copy_only=False)[row] == 1
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    index = np.arange(len(row)) - starts[row]
    index[~dense] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
    return row, index, value


def _probabilities(cells, rows: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    row, index, value = cells
    logits = np.stack([np.bincount(row, w[index] * value, rows) for w in weights], axis=1) + bias
    exps = np.exp(logits - logits.max(axis=1, keepdims=True))
    return exps / exps.sum(axis=1, keepdims=True)


def _slices(vectors: pa.StructArray, cells: int = SLICE_CELLS) -> Iterator[slice]:
    """Places of rows that hold about so many values together, at least one row each."""
    ends = np.cumsum(vectors.field("values").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(vectors):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + cells, side="right")))
        yield slice(at, stop)
        at = stop


def _batch_struct(batch: pa.RecordBatch, name: str) -> pa.StructArray:
    return batch.column(batch.schema.get_field_index(name))


# ---- One full-batch pass --------------------------------------------------------


def weighted_rows(train: DataFrame, labels: int, mode: str) -> DataFrame:
    """Adds ``weight``, the class weight of the row's label; the joined table
    has one row per label, at most 32."""
    return train.join(F.broadcast(class_weights(train, labels, mode)), "label_index")


def gradient_sums(rows: DataFrame, model: LinearModel, shared: Broadcast | None = None) -> DataFrame:
    """(class, index, gradient, loss, weight) sums over the data, unscaled.

    Each task adds up its own rows; the shuffle carries at most one cell per
    class and dimension and task. ``index`` -1 is the bias, and class -1 holds
    the loss and the total weight. ``shared`` is the model already broadcast,
    for callers that release it after use.
    """
    if shared is None:
        shared = rows.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        grad, grad_bias, loss, total = np.zeros_like(weights), np.zeros_like(bias), 0.0, 0.0
        for batch in batches:
            cells = _cells(_batch_struct(batch, "features"))
            label = batch.column("label_index").to_numpy(zero_copy_only=False).astype(np.int64)
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            n = len(label)
            p = _probabilities(cells, n, weights, bias)
            loss -= float(weight @ np.log(np.maximum(p[np.arange(n), label], PROBABILITY_FLOOR)))
            total += float(weight.sum())
            p[np.arange(n), label] -= 1.0
            g = p * weight[:, None]
            grad_bias += g.sum(axis=0)
            row, index, value = cells
            for c in range(len(bias)):
                grad[c] += np.bincount(index, g[row, c] * value, weights.shape[1])
        klass, index = np.nonzero(grad)
        k = len(bias)
        yield pa.RecordBatch.from_pydict(
            {
                "class": pa.array(np.concatenate([klass, np.arange(k), [-1]]).astype(np.int32)),
                "index": pa.array(np.concatenate([index, np.full(k, -1), [-1]]).astype(np.int32)),
                "gradient": pa.array(np.concatenate([grad[klass, index], grad_bias, [0.0]])),
                "loss": pa.array(np.concatenate([np.zeros(len(klass) + k), [loss]])),
                "weight": pa.array(np.concatenate([np.zeros(len(klass) + k), [total]])),
            }
        )

    partial = rows.select("features", "label_index", "weight").mapInArrow(
        sums, "class int, index int, gradient double, loss double, weight double"
    )
    return partial.groupBy("class", "index").agg(
        F.sum("gradient").alias("gradient"), F.sum("loss").alias("loss"), F.sum("weight").alias("weight")
    )


def loss_and_gradient(rows: DataFrame, model: LinearModel, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Class-weighted mean cross-entropy plus l2/2 |W|^2 (bias free), and its
    gradient. Only the classes x dimensions sums come to the driver."""
    shared = rows.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    table = gradient_sums(rows, model, shared).toArrow()
    shared.unpersist()
    klass, index = (table.column(c).to_numpy() for c in ("class", "index"))
    gradient = table.column("gradient").to_numpy()
    loss, total = (float(table.column(c).to_numpy().sum()) for c in ("loss", "weight"))
    if total == 0:
        raise TrainingError("no training rows")
    grad, grad_bias = np.zeros_like(model.weights), np.zeros_like(model.bias)
    cell = (klass >= 0) & (index >= 0)
    grad[klass[cell], index[cell]] = gradient[cell]
    on_bias = (klass >= 0) & (index < 0)
    grad_bias[klass[on_bias]] = gradient[on_bias]
    penalty = 0.5 * l2 * float((model.weights**2).sum())
    return loss / total + penalty, grad / total + l2 * model.weights, grad_bias / total


# ---- Scoring ------------------------------------------------------------------------


def probabilities(model: LinearModel, spark: SparkSession, features: Column | str = "features") -> Column:
    """Softmax of ``W x + b`` per row; the weights are broadcast (bounded by
    the task's own limits, about 67 MB at most)."""
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    def score(vectors: pa.Array) -> pa.Array:
        weights, bias = shared.value
        parts = [vectors[own] for own in _slices(vectors)]
        p = np.concatenate([np.zeros((0, len(bias))), *(_probabilities(_cells(part), len(part), weights, bias) for part in parts)])
        offsets = np.arange(len(vectors) + 1, dtype=np.int32) * len(bias)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.ravel()))

    return F.arrow_udf(score, "array<double>")(F.col(features) if isinstance(features, str) else features)


def many_probabilities(models: list[LinearModel], spark: SparkSession) -> Column:
    """Probabilities of every model for one ``features`` column, in one go."""
    shared = spark.sparkContext.broadcast([(m.weights, m.bias) for m in models])

    def score(vectors: pa.Array) -> pa.Array:
        cells, n = _cells(vectors), len(vectors)
        parts = [_probabilities(cells, n, weights, bias) for weights, bias in shared.value]
        inner = np.cumsum(np.tile([p.shape[1] for p in parts], n))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], inner]).astype(np.int32)), pa.array(np.concatenate(parts, axis=1).ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(parts)), lists)

    return F.arrow_udf(score, "array<array<double>>")("features")


def chosen_probabilities(models: list[LinearModel], spark: SparkSession) -> Column:
    """Probabilities of the model each row picks by its position ``which``."""
    shared = spark.sparkContext.broadcast([(m.weights, m.bias) for m in models])

    def score(vectors: pa.Array, which: pa.Array) -> pa.Array:
        row, index, value = _cells(vectors)
        picked = which.to_numpy(zero_copy_only=False)
        found: list = [None] * len(picked)
        for position in np.unique(picked):
            rows = np.flatnonzero(picked == position)
            place = np.full(len(picked), -1)
            place[rows] = np.arange(len(rows))
            mine = place[row] >= 0
            p = _probabilities((place[row[mine]], index[mine], value[mine]), len(rows), *shared.value[position])
            for at, values in zip(rows, p):
                found[at] = values
        return pa.array(found, pa.list_(pa.float64()))

    return F.arrow_udf(score, "array<double>")("features", "which")


def with_probabilities(df: DataFrame, model: LinearModel, alias: str = "p") -> DataFrame:
    return df.withColumn(alias, probabilities(model, df.sparkSession))


def prediction_rows(scored: DataFrame, spec: TaskSpec, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Served predictions of rows with probabilities ``p``."""
    return scored.select(
        *keep,
        F.lit(spec.name).alias("classifier"),
        F.lit(spec.version).alias("version"),
        served_label(F.col("p"), spec).alias("_served"),
    ).select(*keep, "classifier", "version", "_served.*")
