"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of words with smallest period q, at least ``EXPONENT`` * q and
at least ``LEAST`` words long, that no neighbouring word extends keeping period q.

Periods up to 3 are found by comparing words directly. Longer ones come from
dyadic scales t = 4, 8, 16, ...: every window of t words has a 64-bit name, made
from the names of its halves, and a position is in the set if the least name
among the positions from it to t further is its own or that of the position t
further. Equal contexts of 2 t words decide alike, so the set repeats with the
text. Two neighbours in the set with the same context, p words apart with t <= p
<= 2 t, propose period p; as the context covers the period, the next position
with it in a run is exactly one period on. Windows with a period of at most t / 4
would make the set dense: they are left out of it, and the runs that hold them
were found at the scales before, which is how small periods are supplied. A run of
4 p words and more always holds such a pair at the scale with t <= p <= 2 t.

Proposals of one period whose contexts touch are one stretch; it is extended word
by word, and the words of a stretch long enough are compared once more, so equal
names alone decide nothing. Texts of a lot (about ``LOT`` bytes) are worked on
together, with marks of their own between them; texts too short for a scale are
left out of it. A longer text is a lot by itself, with memory in proportion to
its words.

Defined cases: a null or blank text has no words and no runs; equal rows count
each; a null ``doc_id`` is kept; an empty table gives no rows; only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pupilage.llm.texts import SPACE, byte_column, mixed, only

EXPONENT = 4
LEAST = 6
DIRECT = 3
LOT = 4 << 20
NEVER = np.uint64(2**64 - 1)
#: Words of the contract: all but white space of ASCII.
WORD_GAPS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAPS), lambda word: word != "")


def worded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, each with one space after it; the n + 1 ends of words; the first word of each row, and the end."""
    data, offsets = byte_column(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    # A space after every row, so that its last word has one too.
    apart = np.full(len(data) + len(offsets) - 1, 32, np.uint8)
    inside = np.ones(len(apart), bool)
    inside[offsets[1:] + np.arange(len(offsets) - 1)] = False
    apart[inside] = data
    gap = SPACE[apart]
    after = np.zeros(len(apart), bool)
    after[1:] = gap[1:] & ~gap[:-1]
    kept = ~gap | after
    out = np.where(after, 32, apart)[kept].astype(np.uint8)
    ends = np.concatenate([[0], np.flatnonzero(after[kept]) + 1])
    rows = np.cumsum(after)[offsets[1:] + np.arange(len(offsets) - 1)] if len(offsets) > 1 else np.zeros(0, np.int64)
    return out, ends, np.concatenate([[0], rows]).astype(np.int64)


def numbered(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words get equal numbers."""
    if len(ends) == 1:
        return np.zeros(0, np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def stretched(x: np.ndarray, at: np.ndarray, period: np.ndarray, way: int) -> np.ndarray:
    """How many words from ``at`` on, in direction ``way``, equal the word one period later."""
    count, open_, size = np.zeros(len(at), np.int64), np.arange(len(at)), 8
    while len(open_):
        place = (at + way * count)[open_, None] + way * np.arange(size)
        later = place + period[open_, None]
        same = (place >= 0) & (later < len(x))
        same &= x[np.clip(place, 0, len(x) - 1)] == x[np.clip(later, 0, len(x) - 1)]
        ahead = np.where(same.all(1), size, np.argmin(same, 1))
        count[open_] += ahead
        open_ = open_[ahead == size]
        size = min(4 * size, max(8, (1 << 20) // max(1, len(open_))))
    return count


def equal_stretches(x: np.ndarray, period: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all stretches in which each word equals the one ``period`` later."""
    part = x[first:last]
    same = np.zeros(max(0, len(part) - period) + 2, bool)
    same[1:-1] = part[:-period] == part[period:] if len(part) > period else same[1:-1]
    turn = np.flatnonzero(same[1:] != same[:-1])
    return first + turn[::2], turn[1::2] - turn[::2]


def least_ahead(x: np.ndarray, size: int) -> np.ndarray:
    """The least of ``x[i] .. x[i + size]`` (``size`` a power of two), as far as there are any."""
    out, step = x.copy(), 1
    while step < size:
        np.minimum(out[:-step], out[step:], out=out[:-step])
        step *= 2
    np.minimum(out[:-size], x[size:], out=out[:-size])
    return out


def named_pairs(names: np.ndarray, size: int) -> np.ndarray:
    """Names of windows of ``2 * size`` words from those of their halves."""
    second = np.zeros(len(names), np.uint64)
    second[:-size] = names[size:]
    return mixed(mixed(names * np.uint64(0x9E3779B97F4A7C15)) + second)


def proposals(names: np.ndarray, contexts: np.ndarray, periodic: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the synchronising set with an equal context ``size`` to ``2 * size`` further, and that distance."""
    own = np.where(periodic, NEVER, names)
    least = least_ahead(own, size)
    chosen = own == least
    chosen[:-size] |= own[size:] == least[:-size]
    at = np.flatnonzero(chosen & (least != NEVER))
    order = np.argsort(contexts[at], kind="stable")
    at, context = at[order], contexts[at[order]]
    apart = np.diff(at)
    near = (context[1:] == context[:-1]) & (apart >= size) & (apart <= 2 * size)
    return at[:-1][near], apart[near]


def touching(at: np.ndarray, period: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proposals of one period that are at most ``reach`` apart as one stretch: first position, end, period."""
    order = np.lexsort([at, period])
    at, period = at[order], period[order]
    begins = np.concatenate([[True], (period[1:] != period[:-1]) | (np.diff(at) > reach)]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    return at[first], at[last] + reach, period[first]


def verified(x: np.ndarray, start: np.ndarray, matched: np.ndarray, period: np.ndarray) -> list[np.ndarray]:
    """The stretches whose words all match; of any other, the parts that do."""
    whole = np.ones(len(start), bool)
    extra: list[tuple[int, int, int]] = []
    for k, (s, m, p) in enumerate(zip(start.tolist(), matched.tolist(), period.tolist())):
        if not np.array_equal(x[s : s + m], x[s + p : s + p + m]):
            whole[k] = False
            extra += [(a, b, p) for a, b in zip(*(v.tolist() for v in equal_stretches(x, p, s, s + m + p)))]
    more = np.array(extra, np.int64).reshape(-1, 3).T
    return [np.concatenate([own[whole], other]) for own, other in zip((start, matched, period), more)]


def periodic_runs(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of all runs of the texts whose words begin at ``rows``, by start and period.

    Starts are places in ``words``.
    """
    sizes = np.diff(rows)
    row = np.arange(len(sizes))
    # Every text is followed by a mark that occurs once.
    x = np.zeros(len(words) + len(sizes), np.int64)
    marks = rows[1:] + row
    inside = np.ones(len(x), bool)
    inside[marks] = False
    x[inside] = words
    x[marks] = -1 - row
    places = rows[:-1] + row
    found = np.zeros((3, 0), np.int64)  # row, start in the row, length
    periods = np.zeros(0, np.int64)

    def keep(start: np.ndarray, matched: np.ndarray, period: np.ndarray) -> None:
        nonlocal found, periods
        long = matched >= (EXPONENT - 1) * period
        start, length, period = start[long], (matched + period)[long], period[long]
        which = np.searchsorted(places, start, side="right") - 1
        fresh = np.stack([row[which], start - places[which], length]) if len(start) else np.zeros((3, 0), np.int64)
        found, periods = np.concatenate([found, fresh], 1), np.concatenate([periods, period])

    for p in range(1, DIRECT + 1):
        start, matched = equal_stretches(x, p)
        keep(start, matched, np.full(len(start), p))
    names = mixed(x.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    size = 1
    while True:
        # A period of ``size`` or more needs so many words.
        fits = sizes[row] >= EXPONENT * size
        if size > DIRECT and not fits.any():
            break
        if size > DIRECT and not fits.all():
            own = np.repeat(fits, sizes[row] + 1)
            x, names, row = x[own], names[own], row[fits]
            places = np.concatenate([[0], np.cumsum(sizes[row] + 1)])[:-1]
        if len(x) <= 2 * size:
            break
        contexts = named_pairs(names, size)
        if size > DIRECT:
            change = np.zeros(len(x) + 1, np.int64)
            where = np.full(len(sizes), -1, np.int64)
            where[row] = places
            small = (periods <= size // 4) & (found[2] >= size) & (where[found[0]] >= 0)
            first = where[found[0][small]] + found[1][small]
            np.add.at(change, first, 1)
            np.add.at(change, first + found[2][small] - size + 1, -1)
            at, period = proposals(names, contexts, np.cumsum(change)[:-1] > 0, size)
            start, end, period = touching(at, period, 2 * size)
            before = stretched(x, start - 1, period, -1)
            after = stretched(x, end, period, 1)
            matched = end - start + before + after
            long = matched >= (EXPONENT - 1) * period
            keep(*verified(x, (start - before)[long], matched[long], period[long]))
        names, size = contexts, 2 * size
    # Of one stretch found with several periods, the smallest counts.
    order = np.lexsort([periods, found[2], found[1], found[0]])
    found, periods = found[:, order], periods[order]
    once = np.concatenate([[True], (found[:, 1:] != found[:, :-1]).any(0)]) if len(order) else np.zeros(0, bool)
    once &= found[2] >= LEAST
    start, length, period = rows[found[0][once]] + found[1][once], found[2][once], periods[once]
    order = np.lexsort([period, start])
    return start[order], length[order], period[order]


def lots(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes at most; a longer row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last
        first = last


def scan(docs: DataFrame, limit: int = LOT) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and the ``collapsed`` text.

    The collapsed text joins by one space the words that no run holds after its first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            _, offsets = byte_column(column)
            for first, last in lots(offsets, limit):
                data, ends, rows = worded(column.slice(first, last - first))
                start, length, period = periodic_runs(numbered(data, ends), rows)
                n = len(ends) - 1
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                gone = np.cumsum(change)[:-1] > 0
                kept = data[np.repeat(~gone, np.diff(ends))] if gone.any() else data
                bytes_kept = np.concatenate([[0], np.cumsum(np.where(gone, 0, np.diff(ends)))])[rows]
                texts = [kept[a : max(a, b - 1)].tobytes() for a, b in zip(bytes_kept[:-1], bytes_kept[1:])]
                own = np.searchsorted(start, rows)
                at = start - rows[np.searchsorted(rows, start, side="right") - 1]
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (at, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(np.diff(rows), pa.int64()), pa.ListArray.from_arrays(pa.array(own, pa.int32()), runs), pa.array(texts, pa.binary()).cast(pa.string(), safe=False)],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    source = only(docs, "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(scanned: DataFrame) -> DataFrame:
    """Per row the number of runs, its longest run (ties: the first, then the shortest period) and digests."""
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    longest = F.array_min(ranked)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    ended = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    length = -longest["less"]
    return scanned.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest["start"].alias("start"),
        length.alias("length"),
        longest["period"].alias("period"),
        F.expr("1000L").alias("_k"),
        F.sha2(ended, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    ).withColumn("exponent_milli", F.expr("_k * length div period")).drop("_k")


def planted(docs: DataFrame) -> DataFrame:
    """Every tenth text, by CRC-32 of its id, repeated with a period from a word on; the others as they are."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.when(crc % 10 == 0, words_of(F.col("text"))).alias("w"), F.floor(crc / 10).alias("g")).withColumn("n", F.size("w"))
    first = F.col("g") % F.col("n")
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, first)).withColumn("p", F.when(F.col("n") > 0, period))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    again = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", place(i))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))
