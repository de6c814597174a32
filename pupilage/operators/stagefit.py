"""Fits inside one stage: tasks keep their rows and exchange gradient sums.

A fit by passes is one Spark job a pass, so a small training set waits for the
scheduler most of the time. Here the rows are dealt once to ``shards`` x ``groups``
tasks: a group of tasks fits its share of the jobs, and each of its shards holds
a part of the rows. Every pass, each shard adds up its rows and the shards of a
group exchange the sums (a barrier stage; one all-gather), so all of them take the
same next step and nothing returns to the driver before the end. With one shard a
group needs no exchange, and the stage no barrier.

``layout`` finds the cheapest such grid, or none when the rows, the optimiser's
state or the exchange (which passes through the driver's coordinator) would be too
large for it; then the same fits run by passes, with the same results up to the
order of additions. A task that dies takes a barrier stage with it, which the
scheduler starts again from the dealt rows.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pupilage.operators.blocks import Sums, batch_blocks
from pupilage.operators.student import LinearModel, _probabilities

# Cells (feature, value) that one task may hold: about 100 MB.
RESIDENT_CELLS = 8_000_000
# Bytes of optimiser state in one task; L-BFGS keeps about this many vectors a job.
STATE_BYTES = 256 << 20
STATE_VECTORS = 26
# Bytes that one exchange may pass through the coordinator, in and out.
EXCHANGE_BYTES = 32 << 20
# What a second is good for, to choose between grids: cells times classes, and exchanged bytes.
CELLS_A_SECOND = 5e7
BYTES_A_SECOND = 1e8
ROUND_SECONDS = 0.01


@dataclass(frozen=True)
class Grid:
    shards: int
    groups: int

    @property
    def tasks(self) -> int:
        return self.shards * self.groups


def layout(cells: int, jobs: int, size: int, classes: int, slots: int, barrier: bool = True) -> Grid | None:
    """The grid with the shortest pass, of those whose tasks all run at once and stay within the bounds."""
    best: tuple[float, int, Grid] | None = None
    for groups in range(1, min(jobs, slots) + 1):
        own = -(-jobs // groups)
        if own * size * 8 * STATE_VECTORS > STATE_BYTES:
            continue
        for shards in range(1, slots // groups + 1):
            grid = Grid(shards, groups)
            message = 4 * (own * (size + 1) * 8 // 3)
            moved = grid.tasks * message * (1 + grid.tasks) if shards > 1 else 0
            if cells > shards * RESIDENT_CELLS or moved > EXCHANGE_BYTES or (shards > 1 and not barrier):
                continue
            seconds = cells / shards * own * classes / CELLS_A_SECOND
            seconds += moved / BYTES_A_SECOND + ROUND_SECONDS if shards > 1 else 0
            if best is None or (seconds, grid.tasks) < best[:2]:
                best = seconds, grid.tasks, grid
    return best[2] if best else None


class Held:
    """The rows of one shard, as blocks: 12 bytes a cell."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.blocks = [block for batch in batches for block in batch_blocks(batch)]

    def sums(self, points: list[np.ndarray], plans: list[tuple[int, np.ndarray]], dimensions: int) -> np.ndarray:
        """For each point, the gradient sums and the loss sum over the rows outside the left-out fold of its plan."""
        found = Sums(np.stack(points), plans, dimensions)
        for block in self.blocks:
            found.add(block)
        return found.found

    def hits(self, model: LinearModel, tested: int | None) -> tuple[int, int]:
        """Right answers and rows, of one fold or of all."""
        hits = rows = 0
        for block in self.blocks:
            seen = np.ones(block.rows, bool) if tested is None else block.fold == tested
            right = _probabilities(block.cells(), block.rows, model.weights, model.bias).argmax(axis=1) == block.label
            hits, rows = hits + int((right & seen).sum()), rows + int(seen.sum())
        return hits, rows


def dealt(rows: DataFrame, grid: Grid) -> DataFrame:
    """Rows at the tasks that need them: every group gets all rows, each shard of it a part."""
    shard = F.pmod(F.monotonically_increasing_id(), F.lit(grid.shards)).cast("int")
    group = F.explode(F.sequence(F.lit(0), F.lit(grid.groups - 1)))
    placed = rows.select("features", "label_index", "fold", shard.alias("_shard")).withColumn("_group", group)
    return placed.repartitionById(grid.tasks, F.col("_group") * grid.shards + F.col("_shard"))


def run_jobs(rows: DataFrame, jobs: list, starts: Callable[[], list], finish: Callable[[Any, Any], tuple[LinearModel, float, bool, int | None]],
             classes: int, dimensions: int, passes: int, grid: Grid, started: Callable[[int], None] | None = None) -> list[tuple]:
    """(point, loss, converged, hits, rows tested) of every job, fitted in one stage.

    ``starts`` makes the optimisers of all jobs, ``finish`` turns one into a model
    and says which fold it is tested on. ``started`` is called in every task with
    its number, before its first pass.
    """
    plans = [(j.left_out, np.array(j.weights), j.total, j.l2) for j in jobs]
    size = classes * (dimensions + 1)
    penalty = np.concatenate([np.ones(classes * dimensions), np.zeros(classes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(batches)
        task = TaskContext.get().partitionId()
        group, shard = divmod(task, grid.shards)
        exchange = BarrierTaskContext.get().allGather if grid.shards > 1 else None
        if started is not None:
            started(task)
        own = list(range(group, len(plans), grid.groups))
        steps = dict(zip(own, [s for k, s in enumerate(starts()) if k % grid.groups == group]))
        for _ in range(passes):
            active = [k for k in own if not steps[k].done]
            if exchange is None and not active:
                break
            points = [steps[k].trial() for k in active]
            flat = held.sums(points, [plans[k][:2] for k in active], dimensions).ravel() if active else np.zeros(0)
            if exchange is not None:
                said = exchange(base64.b64encode(flat.tobytes()).decode())
                if not any(said):
                    break
                # Every shard adds in the same order, so all go on from the same numbers.
                mine = said[group * grid.shards : (group + 1) * grid.shards]
                flat = sum(np.frombuffer(base64.b64decode(m)) for m in mine)
            for k, x, part in zip(active, points, flat.reshape(len(active), size + 1)):
                _, _, total, l2 = plans[k]
                f = part[-1] / total + 0.5 * l2 * float((x * penalty) @ (x * penalty))
                steps[k].observe(float(f), part[:-1] / total + l2 * x * penalty)
        ends = {k: finish(jobs[k], steps[k]) for k in own}
        counts = [held.hits(model, tested) for model, _, _, tested in ends.values()]
        if exchange is not None:
            said = [json.loads(m) for m in exchange(json.dumps(counts))][group * grid.shards : (group + 1) * grid.shards]
            counts = [[sum(c) for c in zip(*part)] for part in zip(*said)]
        found = [(k, np.concatenate([m.weights.ravel(), m.bias]).tobytes(), float(f), bool(c), *n) for (k, (m, f, c, _)), n in zip(ends.items(), counts)]
        if shard == 0 and found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names)

    names = ["job", "point", "loss", "converged", "hits", "tested"]
    kinds = [pa.int32(), pa.binary(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
    fitted = dealt(rows, grid).select("features", "label_index", "fold").mapInArrow(
        run, "job int, point binary, loss double, converged boolean, hits long, tested long", barrier=grid.shards > 1
    )
    # The scheduler starts a barrier stage again only if it writes a shuffle, not if it returns results.
    answers = {r.job: r for r in (fitted.repartition(grid.groups, "job") if grid.shards > 1 else fitted).collect()}
    return [(np.frombuffer(answers[k].point), answers[k].loss, answers[k].converged, answers[k].hits, answers[k].tested) for k in range(len(jobs))]
