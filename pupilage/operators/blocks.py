"""Rows of a fit as blocks, and the gradient sums of many fits over a block.

A block is a few rows with their stored values (cells), kept as flat arrays. Where
a good part of a block's matrix is filled, it is written out and the sums of all
fits are two matrix products; else every fit adds up its cells. Both take as much
working memory as one block, whatever the number of rows. ``packed`` is a table of
blocks, for rows that are read many times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pupilage.operators.student import PROBABILITY_FLOOR, _batch_struct, _cells, _probabilities

# Numbers in the matrix of a block that is written out (2 MB), and cells of one that is not.
MATRIX_CELLS = 1 << 18
SPARSE_CELLS = 1 << 19
MATRIX_ROWS = 512
MATRIX_LEAST = 16
# A matrix is written out if at least one number in so many is stored.
FILLED = 32
# Cells in one row of a table of blocks, except those of a longer single row of the fit.
PACKED_CELLS = 1 << 17
PACKED = "label binary, fold binary, sizes binary, index binary, value binary"


@dataclass(frozen=True)
class Block:
    label: np.ndarray
    fold: np.ndarray
    sizes: np.ndarray
    index: np.ndarray
    value: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.label)

    def parts(self, cells: int, rows: int) -> Iterator[Block]:
        """The block in parts of at most so many rows and cells, a longer row by itself."""
        ends, at = np.cumsum(self.sizes, dtype=np.int64), 0
        while at < self.rows:
            start = int(ends[at] - self.sizes[at])
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, start + cells, side="right"))))
            within = slice(start, int(ends[stop - 1]))
            yield Block(self.label[at:stop], self.fold[at:stop], self.sizes[at:stop], self.index[within], self.value[within])
            at = stop

    def filled(self, dimensions: int) -> bool:
        """Whether to write its matrix out; wide rows, of which only few fit in one, go by their cells."""
        return len(self.index) * FILLED >= self.rows * dimensions and dimensions * MATRIX_LEAST <= MATRIX_CELLS

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(np.arange(self.rows), self.sizes), self.index, self.value

    def places(self, dimensions: int) -> np.ndarray:
        """Of the cells in the matrix, row after row."""
        return np.repeat(np.arange(self.rows) * dimensions, self.sizes) + self.index


def block_of(batch: pa.RecordBatch) -> Block:
    """All rows of a batch (features, label_index, fold)."""
    row, index, value = _cells(_batch_struct(batch, "features"))
    label, fold = (batch.column(name).to_numpy(zero_copy_only=False).astype(np.int32) for name in ("label_index", "fold"))
    # A copy, so that a kept block does not keep its whole batch.
    return Block(label, fold, np.bincount(row, minlength=batch.num_rows).astype(np.int32), index.astype(np.int32), value.copy())


def batch_blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """A batch in blocks of bounded size."""
    sizes = _batch_struct(batch, "features").field("values").value_lengths().to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + PACKED_CELLS, side="right")))
        yield block_of(batch.slice(at, stop - at))
        at = stop


def packed(rows: DataFrame) -> DataFrame:
    """A table of blocks of ``rows`` (features, label_index, fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch_blocks(batch):
                parts = [block.label, block.fold, block.sizes, block.index, block.value]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], ["label", "fold", "sizes", "index", "value"])

    return rows.select("features", "label_index", "fold").mapInArrow(run, PACKED)


def unpacked(batch: pa.RecordBatch) -> Iterator[Block]:
    kinds = [np.int32, np.int32, np.int32, np.int32, np.float64]
    for row in range(batch.num_rows):
        yield Block(*(np.frombuffer(column[row].as_buffer(), kind) for column, kind in zip(batch.columns, kinds)))


class Sums:
    """Gradient sums and loss sums of several fits at their points, over blocks.

    ``points`` has a row of weights, then biases, for each fit; ``plans`` the fold it
    leaves out and its class weights.
    """

    def __init__(self, points: np.ndarray, plans: list[tuple[int, np.ndarray]], dimensions: int):
        self.fits, self.classes, self.dimensions = len(plans), len(plans[0][1]) if plans else 0, dimensions
        self.left_out = [left_out for left_out, _ in plans]
        self.class_weight = [weight for _, weight in plans]
        inner = self.classes * dimensions
        self.weights = points[:, :inner].reshape(self.fits * self.classes, dimensions)
        self.bias = points[:, inner:].reshape(self.fits * self.classes)
        self.found = np.zeros((self.fits, inner + self.classes + 1))
        # The matrix of one block after the other; only its cells are set and cleared.
        self.space = np.zeros(0)

    def add(self, block: Block) -> None:
        if not self.fits:
            return
        if block.filled(self.dimensions):
            for part in block.parts(MATRIX_CELLS, max(1, min(MATRIX_ROWS, MATRIX_CELLS // self.dimensions))):
                self._add_matrix(part)
        else:
            for part in block.parts(SPARSE_CELLS, SPARSE_CELLS):
                self._add_cells(part)

    def _row_weights(self, block: Block) -> np.ndarray:
        return np.stack([np.where(block.fold == left_out, 0.0, weight[block.label]) for left_out, weight in zip(self.left_out, self.class_weight)])

    def _add_matrix(self, block: Block) -> None:
        n, inner = block.rows, self.classes * self.dimensions
        if len(self.space) < n * self.dimensions:
            self.space = np.zeros(max(n * self.dimensions, min(MATRIX_CELLS, MATRIX_ROWS * self.dimensions)))
        places = block.places(self.dimensions)
        self.space[places] = block.value
        x, w, at = self.space[: n * self.dimensions].reshape(n, self.dimensions), self._row_weights(block), np.arange(n)
        p = (x @ self.weights.T + self.bias).reshape(n, self.fits, self.classes)
        p = np.exp(p - p.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        self.found[:, -1] -= (w.T * np.log(np.maximum(p[at, :, block.label], PROBABILITY_FLOOR))).sum(axis=0)
        p[at, :, block.label] -= 1.0
        p *= w.T[:, :, None]
        self.found[:, inner:-1] += p.sum(axis=0)
        self.found[:, :inner] += (p.reshape(n, -1).T @ x).reshape(self.fits, inner)
        self.space[places] = 0.0

    def _add_cells(self, block: Block) -> None:
        n, inner, d = block.rows, self.classes * self.dimensions, self.dimensions
        cells = row, index, value = block.cells()
        at = np.arange(n)
        for k, w in enumerate(self._row_weights(block)):
            own = slice(k * self.classes, (k + 1) * self.classes)
            p = _probabilities(cells, n, self.weights[own], self.bias[own])
            self.found[k, -1] -= float(w @ np.log(np.maximum(p[at, block.label], PROBABILITY_FLOOR)))
            p[at, block.label] -= 1.0
            p *= w[:, None]
            for c in range(self.classes):
                self.found[k, c * d : (c + 1) * d] += np.bincount(index, p[row, c] * value, d)
            self.found[k, inner:-1] += p.sum(axis=0)
