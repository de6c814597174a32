"""Hashed word n-grams as one vector per row, computed where the row is.

Words are cut out in the JVM; an Arrow function hashes whole batches with
numpy. Nothing is shuffled, so streams and batch tables share this form.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F

from pupilage.config import InputField
from pupilage.functions.text import field_text, words

# Fixed values of 64-bit FNV-1a.
FNV_BASIS = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
# Words that are hashed at once; each takes some hundred bytes meanwhile.
SLICE_WORDS = 1 << 18


def _absorb(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """FNV-1a states after reading one byte run each, longest runs first."""
    order = np.argsort(-sizes, kind="stable")
    running, begin, size = state[order], starts[order], sizes[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), side="left")
    for position in range(longest):
        n = live[position]
        running[:n] = (running[:n] ^ data[begin[:n] + position]) * np.uint64(FNV_PRIME)
    result = np.empty_like(running)
    result[order] = running
    return result


def _absorb_text(state: np.ndarray, text: str) -> np.ndarray:
    for byte in text.encode("utf-8"):
        state = (state ^ np.uint64(byte)) * np.uint64(FNV_PRIME)
    return state


def _byte_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, with each text's start and size."""
    _, offsets, raw = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8).astype(np.uint64) if raw else np.zeros(0, np.uint64)
    return data, edges[:-1], np.diff(edges)


def _field_buckets(column: pa.Array, name: str, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every token of one field in a batch."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    coded = column.flatten().cast(pa.string()).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    vocabulary = coded.dictionary
    if not len(vocabulary):
        return row, row
    data, starts, lengths = _byte_runs(vocabulary)
    fresh = np.full(len(vocabulary), FNV_BASIS, np.uint64)
    word = _absorb(fresh, data, starts, lengths)
    named = _absorb(_absorb_text(fresh, f"{name}="), data, starts, lengths)
    # A bigram continues the first word's state over a space and the second.
    adjacent = row[1:] == row[:-1]
    pairs, which = np.unique(code[:-1][adjacent].astype(np.int64) * len(vocabulary) + code[1:][adjacent], return_inverse=True)
    left, right = pairs // len(vocabulary), pairs % len(vocabulary)
    bigram = _absorb(_absorb_text(word[left], " "), data, starts[right], lengths[right])
    hashes = np.concatenate([word[code], named[code], bigram[which]])
    return np.concatenate([row, row, row[1:][adjacent]]), (hashes % np.uint64(dimensions)).astype(np.int64)


def _term_counts(columns: list[pa.Array], names: list[str], dimensions: int):
    """Sorted (row, bucket, count) of a batch."""
    parts = [_field_buckets(c, n, dimensions) for c, n in zip(columns, names)]
    keys = np.concatenate([r * dimensions + b for r, b in parts])
    cells, counts = np.unique(keys, return_counts=True)
    return cells // dimensions, cells % dimensions, counts


def _in_slices(build: Callable[..., pa.Array], columns: tuple[pa.Array, ...], words: int) -> pa.Array:
    """``build`` over slices of a batch that hold about ``SLICE_WORDS`` words, at least one row each; lists of words are the last ``words`` columns."""
    ends = np.cumsum(sum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[len(columns) - words :]))
    found, at = [], 0
    while at < len(ends) or not found:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_WORDS, side="right")))
        found.append(build(*(c.slice(at, stop - at) for c in columns)))
        at = stop
    return pa.concat_arrays(found)


def _normalized(row: np.ndarray, counts: np.ndarray, rows: int) -> np.ndarray:
    """log1p counts scaled to unit length per row."""
    raw = np.log1p(counts)
    norm = np.sqrt(np.bincount(row, raw * raw, rows))
    return raw / np.maximum(norm, 1e-12)[row]


def _lists(row: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _vector_array(row: np.ndarray, index: np.ndarray, value: np.ndarray, rows: int, size: int) -> pa.Array:
    return pa.StructArray.from_arrays(
        [
            pa.array(np.zeros(rows, np.int8)),
            pa.array(np.full(rows, size, np.int32)),
            _lists(row, index.astype(np.int32), rows, pa.int32()),
            _lists(row, value, rows, pa.float64()),
        ],
        names=["type", "size", "indices", "values"],
    )


def token_bucket(token: Column, dimensions: int) -> Column:
    """FNV-1a bucket of a non-null token, hashed a batch at a time."""

    def build(tokens: pa.Array) -> pa.Array:
        coded = tokens.cast(pa.string()).dictionary_encode()
        data, starts, lengths = _byte_runs(coded.dictionary)
        hashes = _absorb(np.full(len(starts), FNV_BASIS, np.uint64), data, starts, lengths)
        buckets = (hashes % np.uint64(dimensions)).astype(np.int64)
        return pa.array(buckets[coded.indices.to_numpy(zero_copy_only=False)])

    return F.arrow_udf(build, "bigint")(token)


def word_columns(fields: tuple[InputField, ...], source: str = "input") -> list[Column]:
    return [words(field_text(f, F.col(f"{source}.{f.name}"))) for f in fields]


def hashed_vector(fields: tuple[InputField, ...], dimensions: int, source: str = "input") -> Column:
    """Sparse vector of a row's hashed unigrams, field unigrams and bigrams."""
    names = [f.name for f in fields]

    def build(*columns: pa.Array) -> pa.Array:
        rows = len(columns[0])
        row, bucket, count = _term_counts(list(columns), names, dimensions)
        return _vector_array(row, bucket, _normalized(row, count, rows), rows, dimensions)

    return F.arrow_udf(_fixed_arity(lambda *columns: _in_slices(build, columns, len(fields)), len(fields)), VectorUDT())(*word_columns(fields, source))


def hybrid_vector(dense: Column, size: int, fields: tuple[InputField, ...], dimensions: int, source: str = "input") -> Column:
    """Dense values first, hashed n-grams shifted behind them."""
    names = [f.name for f in fields]

    def build(*columns: pa.Array) -> pa.Array:
        values, texts = columns[0], list(columns[1:])
        rows = len(values)
        row, bucket, count = _term_counts(texts, names, dimensions)
        front = np.repeat(np.arange(rows), size)
        all_rows = np.concatenate([front, row])
        all_index = np.concatenate([np.tile(np.arange(size), rows), bucket + size])
        all_values = np.concatenate([values.flatten().to_numpy(zero_copy_only=False), _normalized(row, count, rows)])
        order = np.argsort(all_rows, kind="stable")
        return _vector_array(all_rows[order], all_index[order], all_values[order], rows, size + dimensions)

    return F.arrow_udf(_fixed_arity(lambda *columns: _in_slices(build, columns, len(fields)), len(fields) + 1), VectorUDT())(dense, *word_columns(fields, source))


def _fixed_arity(build: Callable[..., pa.Array], count: int) -> Callable[..., pa.Array]:
    # Arrow functions are inspected for their parameters; give them real ones.
    if count == 1:
        return lambda a: build(a)
    if count == 2:
        return lambda a, b: build(a, b)
    return lambda *columns: build(*columns)
