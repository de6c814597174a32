"""Whole texts as byte blocks, and hashes of every word or n-gram in a block.

A block holds many texts, or one piece of a very long text, so memory is
bounded by the block and not by the longest text. Hashes of substrings come
from one prefix sum: with odd ``BASE``, the sum of ``byte[i] * BASE**i`` modulo
2^64 over a range, times ``BASE**-start``, depends on the range's bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn labels from; a null id counts as held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that no other column of the input can clash with one made here."""
    return docs.select(*columns)


def sample_of(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key``; all of them if there are fewer."""
    count = rows.count()
    if count <= bound:
        return rows
    steps = 1 << 30
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(steps)) < int(steps * bound / count))


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def blocks(column: pa.Array, limit: int = BLOCK, ends: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, bytes, offsets) of blocks of about ``limit`` bytes.

    A longer text comes in several pieces, cut before white space where there
    is some (the white space begins the later piece), else at the limit; where
    ``ends`` names bytes that end a sentence, after the last of those first of all.
    """
    data, offsets = byte_column(column)
    rows, row = len(column), 0
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        if last > row:
            yield np.arange(row, last), data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
            row = last
            continue
        at, end = int(offsets[row]), int(offsets[row + 1])
        while at < end:
            stop = min(end, at + limit)
            if stop < end:
                last = np.flatnonzero(ends[data[at:stop]]) if ends is not None else np.zeros(0, np.int64)
                gaps = last if len(last) else np.flatnonzero(SPACE[data[at + 1 : stop]])
                stop = at + 1 + int(gaps[-1]) if len(gaps) else stop
            yield np.array([row]), data[at:stop], np.array([0, stop - at])
            at = stop
        row += 1


def powers(n: int, base: int = BASE) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out[:n]


class Hashes:
    """Hashes of ranges of one block."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=self.sums[1:])
        self.back = powers(len(data) + 1, INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def windows(self, length: int) -> np.ndarray:
        """Of all ranges of ``length`` bytes, in order of their start."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true flags, none of which crosses one of ``offsets``."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], flags[:-1]]) if len(flags) else flags
    after = np.concatenate([flags[1:], [False]]) if len(flags) else flags
    return np.flatnonzero(flags & (~before | edge[:-1])), np.flatnonzero(flags & (~after | edge[1:])) + 1
