"""Fit one or many students over the same rows at once.

Cross-validation needs one fit per candidate and fold. Fitting them one by one
reads (or caches) the features once per fit; here all fits share the rows, and
each row is skipped by the fits whose fold it belongs to. The final fit is the
same with one job that skips no fold, so selection and fit share the objective,
the steps and the stopping rule. Rows that the tasks of one stage can hold are
fitted inside that stage (``stagefit``); else every pass over the rows is a Spark
job that serves all fits still running.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pupilage.config import TaskSpec, TrainingError
from pupilage.operators import stagefit
from pupilage.operators.blocks import Block, Sums, batch_blocks, packed, unpacked
from pupilage.operators.student import BETA1, BETA2, EPSILON, Fit, LinearModel, _cells, _probabilities, _slices
from pupilage.sources.storage import materialize

MEMORY = 10
TOLERANCE = 1e-6
# Parameters broadcast per pass: 64 MB of doubles.
MAX_PARAMETERS = 8_000_000
# Summed numbers in one row that a task of a pass sends: 128 KB.
PART = 1 << 14
# No row has this fold.
NO_FOLD = -1
ABSENT_BIAS = -1e3


@dataclass(frozen=True)
class Job:
    """One fit: its regulariser, the fold it must not see, its class weights."""

    l2: float
    left_out: int
    weights: tuple[float, ...]
    total: float
    #: Classes without a row have no minimum, as their bias would fall for ever; these end at ``ABSENT_BIAS``.
    absent: tuple[int, ...] = ()


@dataclass
class Descent:
    """L-BFGS for one job, fed one function value and gradient per pass."""

    x: np.ndarray
    f: float = np.inf
    g: np.ndarray | None = None
    pairs: deque = field(default_factory=lambda: deque(maxlen=MEMORY))
    direction: np.ndarray | None = None
    step: float = 0.0
    done: bool = False

    @property
    def converged(self) -> bool:
        return self.done

    def trial(self) -> np.ndarray:
        return self.x if self.direction is None else self.x + self.step * self.direction

    def observe(self, f: float, g: np.ndarray) -> None:
        if self.direction is not None:
            if not f <= self.f + 1e-4 * self.step * float(self.g @ self.direction):
                self.step /= 2
                self.done = self.step < 1e-12
                return
            moved, turned = self.step * self.direction, g - self.g
            if float(moved @ turned) > 1e-12:
                self.pairs.append((moved, turned))
            self.done = self.f - f <= TOLERANCE * max(1.0, abs(f))
            self.x = self.x + moved
        self.f, self.g = f, g
        self.direction = self._descend()
        self.step = 1.0 if self.pairs else 1.0 / max(1.0, float(np.linalg.norm(g)))
        self.done = self.done or float(np.linalg.norm(g)) < 1e-9

    def _descend(self) -> np.ndarray:
        q, scales = self.g.copy(), []
        for s, y in reversed(self.pairs):
            a = float(s @ q) / float(s @ y)
            q -= a * y
            scales.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(self.pairs, reversed(scales)):
            q += (a - float(y @ q) / float(s @ y)) * s
        return -q


@dataclass
class AdamSteps:
    """Full-batch Adam from zero for one job; it ends with the passes, not before."""

    x: np.ndarray
    rate: float
    f: float = np.inf
    count: int = 0
    done: bool = False
    converged: bool = True

    def __post_init__(self) -> None:
        self.mean, self.square = np.zeros_like(self.x), np.zeros_like(self.x)

    def trial(self) -> np.ndarray:
        return self.x

    def observe(self, f: float, g: np.ndarray) -> None:
        self.f, self.count = f, self.count + 1
        self.mean = BETA1 * self.mean + (1 - BETA1) * g
        self.square = BETA2 * self.square + (1 - BETA2) * g**2
        scale = np.sqrt(self.square / (1 - BETA2**self.count)) + EPSILON
        self.x = self.x - self.rate * self.mean / (1 - BETA1**self.count) / scale


def _unpack(x: np.ndarray, classes: int, dimensions: int) -> LinearModel:
    return LinearModel(x[: classes * dimensions].reshape(classes, dimensions), x[classes * dimensions :])


def joint_sums(rows: DataFrame, points: list[np.ndarray], jobs: list[Job], classes: int, dimensions: int) -> list[tuple[float, np.ndarray]]:
    """Loss and gradient sums of all jobs in one pass over (features, label_index, fold)."""
    return _summed(rows.select("features", "label_index", "fold"), batch_blocks, points, jobs, classes, dimensions)


def _summed(table: DataFrame, blocks: Callable[[pa.RecordBatch], Iterator[Block]], points: list[np.ndarray], jobs: list[Job], classes: int, dimensions: int) -> list[tuple[float, np.ndarray]]:
    """The sums over the blocks that ``blocks`` finds in the batches of a table.

    Each task sends its sums in parts of at most ``PART`` numbers, without those
    that are all zero. The parts are added up behind a shuffle, so the driver
    receives the summed parameters only.
    """
    length = len(jobs) * (classes * (dimensions + 1) + 1)
    shared = table.sparkSession.sparkContext.broadcast((np.stack(points), [(j.left_out, np.array(j.weights)) for j in jobs]))

    def rows_of(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], ["part", "sums"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, plans = shared.value
        found = Sums(at, plans, dimensions)
        for batch in batches:
            for block in blocks(batch):
                found.add(block)
        flat = found.found.ravel()
        yield rows_of({k // PART: flat[k : k + PART] for k in range(0, length, PART) if flat[k : k + PART].any()})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, some in zip(batch.column("part").to_pylist(), batch.column("sums")):
                own = np.frombuffer(some.as_buffer())
                parts[part] = parts[part] + own if part in parts else own.copy()
        yield rows_of(parts)

    partial = table.mapInArrow(sums, "part int, sums binary")
    width = min(-(-length // PART), slots_of(table)[0])
    found = partial.repartition(width, "part").mapInArrow(added, "part int, sums binary").toArrow()
    shared.unpersist()
    flat = np.zeros(length)
    for part, some in zip(found.column("part").to_pylist(), found.column("sums")):
        flat[part * PART : (part + 1) * PART] = np.frombuffer(some.as_buffer())
    return [(float(part[-1]), part[:-1]) for part in flat.reshape(len(jobs), -1)]


@dataclass(frozen=True)
class Fitted:
    """``loss`` is the penalised objective at the model (before its last step for Adam).

    ``hits`` of ``tested`` rows were right: those of the fold left out, or all
    rows where none was.
    """

    model: LinearModel
    loss: float
    converged: bool
    hits: int
    tested: int


def _starts(count: int, size: int, method: str, rate: float) -> list:
    return [AdamSteps(np.zeros(size), rate) if method == "adam" else Descent(np.zeros(size)) for _ in range(count)]


def _finished(job: Job, steps, classes: int, dimensions: int) -> tuple[LinearModel, float, bool, int | None]:
    model = _unpack(steps.x.copy(), classes, dimensions)
    for k in job.absent:
        model.weights[k], model.bias[k] = 0.0, ABSENT_BIAS
    return model, steps.f, steps.converged, None if job.left_out == NO_FOLD else job.left_out


def _by_passes(rows: DataFrame, jobs: list[Job], classes: int, dimensions: int, passes: int, method: str, rate: float) -> list[Fitted]:
    """A Spark job a pass, over a table of blocks written once."""
    table = materialize(packed(rows), "blocks")
    penalty = np.concatenate([np.ones(classes * dimensions), np.zeros(classes)])
    steps = _starts(len(jobs), classes * (dimensions + 1), method, rate)
    for _ in range(passes):
        active = [i for i, d in enumerate(steps) if not d.done]
        if not active:
            break
        points = [steps[i].trial() for i in active]
        sums = _summed(table, unpacked, points, [jobs[i] for i in active], classes, dimensions)
        for i, point, (loss, gradient) in zip(active, points, sums):
            penalized = point * penalty
            f = loss / jobs[i].total + 0.5 * jobs[i].l2 * float(penalized @ penalized)
            steps[i].observe(f, gradient / jobs[i].total + jobs[i].l2 * penalized)
    ends = [_finished(job, d, classes, dimensions) for job, d in zip(jobs, steps)]
    tested = left_out_hits(rows, [e[0] for e in ends], jobs)
    return [Fitted(model, loss, converged, *pair) for (model, loss, converged, _), pair in zip(ends, tested)]


def _in_stage(rows: DataFrame, jobs: list[Job], classes: int, dimensions: int, passes: int, method: str, rate: float, grid: stagefit.Grid, started=None) -> list[Fitted]:
    size = classes * (dimensions + 1)
    found = stagefit.run_jobs(
        rows, jobs, lambda: _starts(len(jobs), size, method, rate), lambda job, steps: _finished(job, steps, classes, dimensions),
        classes, dimensions, passes, grid, started,
    )
    return [Fitted(_unpack(point, classes, dimensions), *rest) for point, *rest in found]


def cell_count(features: str = "features"):
    """Stored values of a vector column, per row."""

    def count(vectors: pa.Array) -> pa.Array:
        return vectors.field("values").value_lengths().cast(pa.int64())

    return F.arrow_udf(count, "bigint")(features)


def slots_of(rows: DataFrame) -> tuple[int, bool]:
    """Tasks that run at once, and whether a stage may need all of them at once."""
    context = rows.sparkSession.sparkContext
    return context.defaultParallelism, context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() != "true"


def fit_many(rows: DataFrame, jobs: list[Job], classes: int, dimensions: int, passes: int, method: str = "lbfgs", rate: float = 0.05,
             cells: int | None = None, started=None) -> list[Fitted]:
    """Minimise every job's class-weighted objective (see ``loss_and_gradient``).

    ``rows`` (features, label_index, fold) should be written or kept: without a
    grid that holds them they are read once per pass. ``passes`` bounds the passes
    of a job; whether a job ended before is part of the result. ``cells`` is the
    number of stored values in ``features``, counted here if it is not given.
    """
    if not jobs:
        return []
    size = classes * (dimensions + 1)
    if cells is None:
        cells = rows.agg(F.coalesce(F.sum(cell_count()), F.lit(0)).alias("n")).first()["n"]
    at_once = max(1, MAX_PARAMETERS // size)
    slots, barrier = slots_of(rows)
    found: list[Fitted] = []
    for start in range(0, len(jobs), at_once):
        chunk = jobs[start : start + at_once]
        grid = stagefit.layout(cells, len(chunk), size, classes, slots, barrier)
        if grid is None:
            found += _by_passes(rows, chunk, classes, dimensions, passes, method, rate)
        else:
            found += _in_stage(rows, chunk, classes, dimensions, passes, method, rate, grid, started)
    return found


def job_for(l2: float, counts: np.ndarray, mode: str, left_out: int = NO_FOLD) -> Job:
    """Class weights from the label counts of the rows the job sees."""
    present = counts > 0
    weights = np.ones_like(counts)
    if mode == "balanced":
        weights = np.divide(counts.sum(), present.sum() * counts, out=np.zeros_like(counts), where=present)
    return Job(float(l2), left_out, tuple(weights.tolist()), float((weights * counts).sum()))


@dataclass(frozen=True)
class Extent:
    """Rows per fold and label, and stored values: all that a fit must know before it starts."""

    counts: np.ndarray
    cells: int


def extent(rows: DataFrame, folds: int, classes: int) -> Extent:
    counts, cells = np.zeros((folds, classes)), 0
    for r in rows.groupBy("fold", "label_index").agg(F.count(F.lit(1)).alias("n"), F.sum(cell_count()).alias("c")).collect():
        counts[r["fold"], r["label_index"]] = r["n"]
        cells += r["c"]
    return Extent(counts, cells)


def fit_student(train: DataFrame, spec: TaskSpec, dimensions: int, l2: float, method: str = "lbfgs", known: Extent | None = None) -> Fit:
    """Fit (``features``, ``label_index``) rows; ``known`` is their extent, in any folds."""
    settings, classes = spec.student, len(spec.labels)
    rows = train.select("features", "label_index", F.lit(0).alias("fold"))
    known = known or extent(rows, 1, classes)
    counts = known.counts.sum(axis=0)
    if not counts.sum():
        raise TrainingError("no training rows")
    absent = tuple(np.flatnonzero(counts == 0).tolist()) if method != "adam" else ()
    job = replace(job_for(l2, counts, settings.class_weighting), absent=absent)
    fitted = fit_many(rows, [job], classes, dimensions, settings.epochs, method, settings.learning_rate, known.cells)[0]
    if not np.isfinite(fitted.loss):
        raise TrainingError("the loss is no longer finite; try a smaller learning rate")
    fitted.model.check()
    return Fit(fitted.model, fitted.loss, fitted.hits / fitted.tested, fitted.converged)


def left_out_hits(rows: DataFrame, models: list[LinearModel], jobs: list[Job]) -> list[tuple[int, int]]:
    """(hits, rows) of every model on the fold it has not seen, or on all rows; a pass for each lot of models that may be broadcast."""
    at_once = max(1, MAX_PARAMETERS // (models[0].classes * (models[0].dimensions + 1))) if models else 1
    return [pair for k in range(0, len(jobs), at_once) for pair in _hits(rows, models[k : k + at_once], jobs[k : k + at_once])]


def _hits(rows: DataFrame, models: list[LinearModel], jobs: list[Job]) -> list[tuple[int, int]]:
    shared = rows.sparkSession.sparkContext.broadcast([(m.weights, m.bias, j.left_out) for m, j in zip(models, jobs)])

    def judge(features: pa.Array, label: pa.Array, fold: pa.Array) -> pa.Array:
        n = len(features)
        truth, place = label.to_numpy(zero_copy_only=False), fold.to_numpy(zero_copy_only=False)
        hits = np.zeros((n, len(shared.value)), np.int32)
        for own in _slices(features):
            cells, size = _cells(features[own]), own.stop - own.start
            for m, (weights, bias, left_out) in enumerate(shared.value):
                tested = (place[own] == left_out) | (left_out == NO_FOLD)
                if tested.any():
                    hits[own, m] = (_probabilities(cells, size, weights, bias).argmax(axis=1) == truth[own]) & tested
        offsets = np.arange(n + 1, dtype=np.int32) * hits.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(hits.ravel()))

    judged = rows.select("fold", F.arrow_udf(judge, "array<int>")("features", "label_index", "fold").alias("hits"))
    summed = judged.agg(
        *[F.sum(F.col("hits")[m]).alias(f"h{m}") for m in range(len(jobs))],
        *[F.count_if((F.col("fold") == j.left_out) | F.lit(j.left_out == NO_FOLD)).alias(f"n{m}") for m, j in enumerate(jobs)],
    ).first()
    shared.unpersist()
    return [(summed[f"h{m}"] or 0, summed[f"n{m}"]) for m in range(len(jobs))]
