"""Benchmark decontamination: edit matches found through exact pieces.

An item of m bytes (lower case, runs of white space as one space) may differ
from a passage by at most ``budget * m`` edits. Cut into one piece more than
that, at least one piece occurs in the passage unchanged. The pieces' first
eight bytes are looked up at every position of every text by a table over all
items; a hit must match its whole piece, then the item's piece joined with its
neighbours must fit within their share of the errors (each half of a pattern
with k errors has one half with k/2 at most), doubling up to the whole item,
which Myers' bit-parallel distance decides. All hits of a batch advance
together, one text byte at a time, in words of 64 pattern bits.

Defined cases: null and empty texts have no match; null, empty and blank items,
and items of fewer than ``LEAST`` bytes, match nothing; equal items each report
their matches; repeated rows are searched each; items and texts meet by
``doc_id`` and ``text``, ``item_id`` and ``text`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pupilage.llm.texts import BLOCK, byte_column, only

BUDGET = 0.1
LEAST = 24
KEY = 8
TABLE_BITS = 20
#: Bytes of items that one broadcast part of the benchmark holds.
PART_BYTES = 4 << 20
HITS = 20_000
PAD = np.uint8(0)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[[9, 10, 11, 12, 13]] = 32


def normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ASCII lower case with runs of white space as one space, and the place of each kept byte."""
    low = LOWER[data]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    at = np.flatnonzero(keep)
    return low[at], at


@dataclass
class Items:
    """Items of one part of the benchmark, and every piece of each."""

    ids: list
    data: np.ndarray
    start: np.ndarray
    errors: np.ndarray
    #: Per piece: its item, first byte in the item, length, number in the item.
    item: np.ndarray
    at: np.ndarray
    size: np.ndarray
    number: np.ndarray
    #: Pieces in order of their first eight bytes.
    keys: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], budget: float) -> Items:
        ids, texts = [], []
        for item_id, text in rows:
            clean = normal(np.frombuffer((text or "").encode(), np.uint8))[0].tobytes().strip()
            if len(clean) >= LEAST:
                ids.append(item_id)
                texts.append(clean)
        item, at, size, number, keys, errors = [], [], [], [], [], []
        for k, text in enumerate(texts):
            # Pieces are at least a key long, so very tight items allow fewer errors.
            pieces = min(int(budget * len(text)) + 1, len(text) // KEY)
            errors.append(pieces - 1)
            cuts = np.linspace(0, len(text), pieces + 1).astype(int)
            for n in range(pieces):
                item.append(k)
                at.append(cuts[n])
                size.append(cuts[n + 1] - cuts[n])
                number.append(n)
                keys.append(int.from_bytes(text[cuts[n] : cuts[n] + KEY], "little"))
        key = np.array(keys, np.uint64)
        order = np.argsort(key, kind="stable")
        table = np.zeros(1 << TABLE_BITS, bool)
        table[_slot(key)] = True
        ordered = (np.array(x, np.int64)[order] for x in (item, at, size, number))
        return cls(ids, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), np.array(errors, np.int64), *ordered, key[order], table)


def _slot(key: np.ndarray) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one word."""
    if len(data) < KEY:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros((-len(data)) % KEY, np.uint8)])
    out = np.empty(len(padded) - KEY + 1, np.uint64)
    for shift in range(KEY):
        words = padded[shift : shift + (len(padded) - shift) // KEY * KEY].view("<u8")
        out[shift::KEY] = words[: len(out[shift::KEY])]
    return out[: len(data) - KEY + 1]


def distances(patterns: np.ndarray, size: np.ndarray, texts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each pattern to any part of its text, and where that part ends.

    Myers' recurrences for all rows at once: ``patterns`` and ``texts`` are byte
    rows padded on the right, ``size`` and ``length`` the true lengths. Bits of a
    pattern fill words of 64; carries of the addition and the shifts go on to the
    next word. The least end wins ties.
    """
    rows, words = len(patterns), -(-int(size.max()) // 64)
    one = np.uint64(1)
    # Match masks by the distinct bytes of each row's pattern.
    alphabet, code = np.unique(patterns, return_inverse=True)
    code = code.reshape(patterns.shape)
    column = np.zeros(256, np.int64)
    column[:] = len(alphabet)
    column[alphabet] = np.arange(len(alphabet))
    masks = np.zeros((len(alphabet) + 1, words, rows), np.uint64)
    for j in range(int(size.max())):
        live = np.flatnonzero(size > j)
        masks[code[live, j], j // 64, live] |= one << np.uint64(j % 64)
    plus = np.full((words, rows), ~np.uint64(0))
    minus = np.zeros((words, rows), np.uint64)
    top_word, top_bit = (size - 1) // 64, ((size - 1) % 64).astype(np.uint64)
    score = size.astype(np.int64).copy()
    best, where = score.copy(), np.zeros(rows, np.int64)
    each = np.arange(rows)
    for step in range(int(length.max())):
        symbol = column[texts[:, step]]
        carry = np.zeros(rows, np.uint64)
        in_plus = np.zeros(rows, np.uint64)
        in_minus = np.zeros(rows, np.uint64)
        up = np.zeros(rows, np.int64)
        for w in range(words):
            match = masks[symbol, w, each]
            vertical = match | minus[w]
            both = match & plus[w]
            total = both + plus[w]
            over = total < both
            total = total + carry
            carry = (over | (total < carry)).astype(np.uint64)
            horizontal = (total ^ plus[w]) | match
            rise = minus[w] | ~(horizontal | plus[w])
            fall = plus[w] & horizontal
            here = top_word == w
            up += np.where(here, ((rise >> top_bit) & one).astype(np.int64) - ((fall >> top_bit) & one).astype(np.int64), 0)
            out_plus, out_minus = rise >> np.uint64(63), fall >> np.uint64(63)
            rise, fall = (rise << one) | in_plus, (fall << one) | in_minus
            in_plus, in_minus = out_plus, out_minus
            plus[w] = fall | ~(vertical | rise)
            minus[w] = rise & vertical
        live = step < length
        score = np.where(live, score + up, score)
        better = live & (score < best)
        best = np.where(better, score, best)
        where = np.where(better, step + 1, where)
    return best, where


def _rows_of(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Byte rows ``data[start:start + length]``, padded."""
    width = int(length.max()) if len(length) else 0
    place = start[:, None] + np.arange(width)
    return np.where(np.arange(width) < length[:, None], data[np.minimum(place, len(data) - 1)], PAD)


def matches(data: np.ndarray, offsets: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """(text, item, distance, end) of items within their budget in the normal texts of a block, one for each passage found."""
    none = np.zeros(0, np.int64)
    if not len(items.keys) or len(data) < KEY:
        return none, none, none, none
    words = eights(data)
    place = np.flatnonzero(items.filter[_slot(words)])
    first, last = (np.searchsorted(items.keys, words[place], side=side) for side in ("left", "right"))
    count = last - first
    place, first, count = place[count > 0], first[count > 0], count[count > 0]
    piece = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    place = np.repeat(place, count)
    text = np.searchsorted(offsets, place, side="right") - 1
    out: list[tuple] = []
    for lot in range(0, len(place), HITS):
        some = slice(lot, lot + HITS)
        out.append(_verified(data, offsets, items, place[some], piece[some], text[some]))
    if not out:
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _verified(data: np.ndarray, offsets: np.ndarray, items: Items, place: np.ndarray, piece: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    item, number, size = items.item[piece], items.number[piece], items.size[piece]
    # The whole piece, not just its key.
    inside = place + size <= offsets[text + 1]
    item, number, size, place, text, piece = (x[inside] for x in (item, number, size, place, text, piece))
    width = int(size.max()) if len(size) else 0
    pattern = items.start[item] + items.at[piece]
    ok = np.ones(len(place), bool)
    for j in range(KEY, width):
        live = size > j
        ok &= ~live | (data[np.minimum(place + j, len(data) - 1)] == items.data[np.minimum(pattern + j, len(items.data) - 1)])
    item, number, place, text, piece = (x[ok] for x in (item, number, place, text, piece))
    origin = place - items.at[piece]  # where the item would begin without insertions or deletions
    pieces = items.errors[item] + 1
    span = 2
    while len(item):
        # The piece's aligned group of ``span`` pieces; a passage leaves some such group with fewer errors than pieces.
        head = number // span * span
        tail = np.minimum(head + span, pieces)
        length = items.start[item + 1] - items.start[item]
        begin, end = _edge(head, length, pieces), _edge(tail, length, pieces)
        errors = tail - head - 1
        # The unchanged piece holds the passage in place, so the group's ends shift by its own errors at most.
        low = np.maximum(origin + begin - errors, offsets[text])
        high = np.minimum(origin + end + errors, offsets[text + 1])
        whole = (head == 0) & (tail == pieces)
        best, where = distances(_rows_of(items.data, items.start[item] + begin, end - begin), end - begin, _rows_of(data, low, high - low), high - low)
        keep = best <= errors
        if whole.all():
            found = np.unique(np.stack([text, item, best, low + where], 1)[keep], axis=0)
            return tuple(found.T) if len(found) else (np.zeros(0, np.int64),) * 4
        item, number, place, text, origin, pieces = (x[keep] for x in (item, number, place, text, origin, pieces))
        span *= 2
        # Hits of one passage ask the same question from here on.
        head = number // span * span
        _, one = np.unique(np.stack([text, item, head, origin], 1), axis=0, return_index=True)
        item, number, place, text, origin, pieces = (x[one] for x in (item, number, place, text, origin, pieces))
    return (np.zeros(0, np.int64),) * 4


def _edge(number: np.ndarray, length: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Where piece ``number`` of an item begins, as linspace cuts it."""
    return np.where(number >= pieces, length, (number * (length / pieces)).astype(np.int64))


def lots(column: pa.Array, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, normal bytes, offsets, original byte of each) of blocks; parts of a long text overlap by ``overlap`` normal bytes."""
    data, offsets = byte_column(column)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1
        if last > row:
            start = int(offsets[row])
            low, at = normal(data[start : offsets[last]])
            yield np.arange(row, last), low, np.searchsorted(at, offsets[row : last + 1] - start), at
            row = last
            continue
        held, places = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        begin, end, fresh = int(offsets[row]), int(offsets[row + 1]), 0
        for start in range(begin, end, BLOCK):
            low, at = normal(data[start : min(end, start + BLOCK)])
            # A run of white space across the cut is one space.
            again = int(len(held) > 0 and held[-1] == 32 and low[0] == 32)
            held, places = np.concatenate([held, low[again:]]), np.concatenate([places, at[again:] + (start - begin)])
            fresh += len(low) - again
            if fresh >= BLOCK // 2 or start + BLOCK >= end:
                yield np.array([row]), held, np.array([0, len(held)]), places
                held, places, fresh = held[max(0, len(held) - overlap) :], places[max(0, len(held) - overlap) :], 0
        row += 1


def parts(benchmark: DataFrame, budget: float) -> Iterator[Items]:
    """The items in parts of bounded size, streamed to the driver one partition at a time."""
    rows, size = [], 0
    for row in only(benchmark, "item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        rows.append((row.item_id, row.text))
        size += len(row.text)
        if size >= PART_BYTES:
            yield Items.of(rows, budget)
            rows, size = [], 0
    if rows:
        yield Items.of(rows, budget)


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``doc_id``, ``row`` (a hash of the text), ``item_id`` and ``distance``: each item found in a text, at its least distance."""
    source = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("row"), "text")
    schema = T.StructType([source.schema["doc_id"], T.StructField("row", T.LongType()), only(benchmark, "item_id").schema["item_id"], T.StructField("distance", T.LongType())])
    found = None
    for items in parts(benchmark, budget):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            overlap = int(np.diff(items.start).max() * (1 + 2 * budget)) + 64 if len(items.ids) else 0
            ids = pa.array(items.ids, pa.from_numpy_dtype(np.int64) if all(isinstance(x, int) for x in items.ids) else None)
            for batch in batches:
                for rows, data, offsets, _ in lots(batch.column("text"), overlap):
                    text, item, distance, _ = matches(data, offsets, items)
                    if len(text):
                        row = pa.array(rows[text])
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("row").take(row), ids.take(pa.array(item)), pa.array(distance)], ["doc_id", "row", "item_id", "distance"])

        part = source.mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.groupBy("doc_id", "row", "item_id").agg(F.min("distance").alias("distance"))


def report(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Per row: ``doc_id``, number of items found, the least item and distance, whether any was found."""
    per = contaminated(docs, benchmark, budget).groupBy("doc_id", "row").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.min("distance").alias("least_distance"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"))
    joined = rows.join(per, (rows["row"] == per["row"]) & rows["doc_id"].eqNullSafe(per["doc_id"]), "left")
    return joined.select(rows["doc_id"], F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "first_item", "least_distance", F.col("n_items").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item was found."""
    per = contaminated(docs, benchmark, budget).select(F.col("doc_id").alias("_leak_id"), F.col("row").alias("_leak_row")).distinct()
    return docs.join(per, (F.xxhash64(docs["text"]) == F.col("_leak_row")) & docs["doc_id"].eqNullSafe(F.col("_leak_id")), "left_anti")
