"""Exact substring dedup: bytes under a repeated window of 200 bytes go.

Equal windows hold equal anchors: the least of the hashes of the window's
``GRAM``-byte pieces, the leftmost of equals. Neighbouring windows share their
anchor, so a text is cut into segments of windows with one anchor each, and
segments meet by the anchor's hash. Segments whose anchor occurs once hold no
repeated window. Equal segments are counted and collapse to one string, all of
whose windows are repeated. What is left is decided by the Burrows-Wheeler
transform of each lot of segments, built column by column: in every round each
segment inserts one symbol, from its last to its first, and the transform and
the array of common prefixes grow in place, read from and written to sequential
files. A window is repeated if its suffix shares 200 bytes with a neighbour in
the finished order. A segment is at most ``2 * 200`` bytes, so there are at most
400 rounds however long the texts are.

Very common anchors: where more than ``LIMIT`` different segments share one,
they are cut into runs of 16 windows, and then of one window, that meet by the
bytes common to the run's windows; equal pieces collapse again.

Defined cases: null text is empty; texts below 200 bytes lose nothing; equal
rows are elsewhere for each other; a null doc_id is kept as it is; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pupilage.llm.texts import BLOCK, Hashes, byte_column, mixed, only
from pupilage.sources.storage import materialize

WINDOW = 200
GRAM = 48
LIMIT = 50_000
#: Windows of one run, from the whole segment down to a single window.
RUNS = (16, 1)
LOT_BYTES = 1 << 20
#: Bits of a number below the window's size.
STEP = 12


def segments(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a block: text number, first and last window start, anchor start, anchor hash and hash of all bytes of every segment."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    block = Hashes(data)
    hashes, wide = block.windows(gram), window - gram + 1
    place = np.arange(len(hashes), dtype=np.uint64)
    key = (hashes & ~np.uint64((1 << 24) - 1)) | place
    rows = -(-len(key) // wide)
    padded = np.full(rows * wide, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    padded = padded.reshape(rows, wide)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - window + 1
    least = np.minimum(after[:windows], before[wide - 1 : wide - 1 + windows])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(windows), side="right") - 1
    inside = np.arange(windows) + window <= offsets[text + 1]
    new = np.ones(windows, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(inside & (new | ~np.concatenate([[False], inside[:-1]])))
    stop = np.ones(windows, bool)
    stop[:-1] = new[1:] | ~inside[1:]
    last = np.flatnonzero(inside & stop)
    return text[first], first, last, anchor[first], hashes[anchor[first]], block.of(first, last + window)


def again(data: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, whole: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments that stand for themselves, and those that have an equal in the same text (the first of which does both)."""
    name = mixed(whole ^ mixed(anchor + text.astype(np.uint64)))
    order = np.argsort(name, kind="stable")
    head = np.concatenate([[True], name[order][1:] != name[order][:-1]]) if len(order) else np.zeros(0, bool)
    leader = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(order) else order
    alone, twice, view = np.ones(len(first), bool), np.zeros(len(first), bool), data.tobytes()
    for own, lead in zip(order[~head].tolist(), leader[~head].tolist()):
        if view[first[own] : last[own] + window] == view[first[lead] : last[lead] + window]:
            alone[own] = False
            twice[own] = twice[lead] = True
    return np.flatnonzero(alone), np.flatnonzero(twice)


def lots(column: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row numbers, bytes, offsets, bytes of the row before them) of blocks; pieces of a long text overlap by ``window - 1``."""
    data, offsets = byte_column(column)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1
        if last > row:
            yield np.arange(row, last), data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row], 0
            row = last
            continue
        for at in range(int(offsets[row]), int(offsets[row + 1]), BLOCK):
            part = data[at : min(int(offsets[row + 1]), at + BLOCK + window - 1)]
            yield np.array([row]), part, np.array([0, len(part)]), at - int(offsets[row])
        row += 1


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``hash`` (together the name of a text of the input) and ``text``, never null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return only(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text"))


def anchors(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``anchor``, ``doc_id``, ``hash`` and ``segment``: start of its first window, number of windows and bytes from there to the anchor, in one number.

    Segments that are equal in one text (as in a text of one word) come once.
    Their windows are repeated whatever other texts hold: rows without an anchor
    give their bytes, from ``segment`` to ``end``, neighbours merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets, before in lots(batch.column("text"), window):
                text, first, last, place, anchor, whole = segments(data, offsets, window, gram)
                alone, twice = again(data, text, first, last, anchor, whole, window)
                # Two bytes between texts, so that ranges of neighbours never touch.
                apart = 2 * text[twice]
                start, end = _merge(first[twice] + apart, last[twice] + window + apart) if len(twice) else (twice, twice)
                of = np.searchsorted(offsets + 2 * np.arange(len(offsets)), start, side="right") - 1
                start, end = start - 2 * of, end - 2 * of
                row = pa.array(np.concatenate([rows[text[alone]], rows[of]]))
                begin = first[alone] - offsets[text[alone]] + before
                packed = begin << 2 * STEP | (last[alone] - first[alone] + 1) << STEP | (place[alone] - first[alone])
                plain = np.arange(len(row)) < len(alone)
                named = pa.array(np.concatenate([anchor[alone].view(np.int64), np.zeros(len(start), np.int64)]), mask=~plain)
                segment = np.concatenate([packed, start - offsets[of] + before])
                stop = pa.array(np.concatenate([np.zeros(len(alone), np.int64), end - offsets[of] + before]), mask=plain)
                yield pa.RecordBatch.from_arrays([named, batch.column("doc_id").take(row), batch.column("hash").take(row), pa.array(segment), stop], ["anchor", "doc_id", "hash", "segment", "end"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"anchor long, doc_id {kind}, hash long, segment long, end long")


PIECE = "bucket long, piece binary, lead short, doc_id {}, hash long, first long"
NAMES = ["bucket", "piece", "lead", "doc_id", "hash", "first"]


def _cut(window: int):
    """The bytes of the listed segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            for row in range(batch.num_rows):
                at = int(offsets[row])
                listed = batch.column("listed").slice(row, 1).flatten()
                segment = listed.field("segment").to_numpy(zero_copy_only=False).astype(np.int64)
                first, windows, lead = segment >> 2 * STEP, segment >> STEP & (1 << STEP) - 1, segment & (1 << STEP) - 1
                pieces = [data[at + a : at + a + n + window - 1].tobytes() for a, n in zip(first, windows)]
                same = pa.array(np.full(len(first), row))
                yield pa.RecordBatch.from_arrays([listed.field("anchor"), pa.array(pieces, pa.binary()), pa.array(lead.astype(np.int16)), batch.column("doc_id").take(same), batch.column("hash").take(same), pa.array(first)], NAMES)

    return run


def grid(piece: bytes, lead: int, window: int, width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Runs of ``width`` windows counted from the anchor: number, first and last window, and the bytes that all windows of such a run hold."""
    last = len(piece) - window
    for run in range((lead - last) // width, lead // width + 1):
        end = lead - width * run
        yield run, max(0, end - width + 1), min(last, end), piece[end : end - width + 1 + window]


def _divide(window: int, width: int):
    """Runs of ``width`` windows of each piece, which meet by the bytes their windows have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pieces, starts, leads, bucket = [], [], [], [], []
            for row, (piece, lead, anchor) in enumerate(zip(*(batch.column(name).to_pylist() for name in ("piece", "lead", "bucket")))):
                for number, start, last, core in grid(piece, lead, window, width):
                    rows.append(row)
                    pieces.append(piece[start : last + window])
                    starts.append(start)
                    leads.append(lead - start)
                    name = anchor.to_bytes(8, "little", signed=True) + number.to_bytes(4, "little", signed=True)
                    bucket.append(int.from_bytes(hashlib.blake2b(core, digest_size=8, key=name).digest(), "little", signed=True))
            of = pa.array(rows, pa.int64())
            first = np.asarray(batch.column("first").take(of)) + np.array(starts, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(pieces, pa.binary()), pa.array(leads, pa.int16()), batch.column("doc_id").take(of), batch.column("hash").take(of), pa.array(first)], NAMES)

    return run


class Files:
    """Columns kept as sequential files between rounds."""

    def __init__(self, **kinds: type):
        self.kinds = kinds
        self.files = {name: tempfile.TemporaryFile() for name in kinds}

    def put(self, **columns: np.ndarray) -> None:
        for name, column in columns.items():
            self.files[name].seek(0)
            column.tofile(self.files[name])

    def get(self, *names: str) -> list[np.ndarray]:
        for name in names:
            self.files[name].flush()
            self.files[name].seek(0)
        return [np.fromfile(self.files[name], self.kinds[name], self.rows) for name in names]

    rows = 0

    def close(self) -> None:
        for file in self.files.values():
            file.close()


def least_between(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of ``values[start:end]`` for each pair; all ranges hold a value."""
    order = np.argsort(start, kind="stable")
    index = np.empty(2 * len(order), np.int64)
    index[::2], index[1::2] = start[order], np.minimum(end[order], len(values) - 1)
    found = np.minimum.reduceat(values, index)[::2]
    found = np.where(end[order] == len(values), np.minimum(found, values[-1]), found)
    out = np.empty(len(order), values.dtype)
    out[order] = found
    return out


def _groups(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct sorted keys, and the values of each."""
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head].astype(np.int64), np.split(values, head[1:])


def repeated(pieces: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of all windows that occur twice or more among the pieces.

    Symbols number the bytes that occur, from 1 on; 0 stands before a piece's first byte. Suffixes
    of length ``round - 1`` were inserted last; the symbol before each gives its
    longer suffix a place: all empty suffixes, all suffixes with smaller first
    symbols, and those with the same symbol that stand before it.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    end = np.cumsum(size)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    used = np.bincount(data, minlength=256) > 0
    kind = np.uint8 if used.sum() < 256 else np.uint16
    symbols = np.cumsum(used).astype(kind)[data]
    count = len(pieces)
    live = np.flatnonzero(size > 0)
    at = np.arange(count)
    first = np.zeros(count, kind)
    first[live] = symbols[end[live] - 1]
    files = Files(before=kind, common=np.int16, number=np.int32)
    files.rows = count
    files.put(before=first, common=np.zeros(count, np.int16), number=np.full(count, -1, np.int32))
    number, inserted, length = 0, [], 0
    begin = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=int(used.sum()) + 1))])
    while len(live):
        length += 1
        before, common, numbers = files.get("before", "common", "number")
        order = np.argsort(before, kind="stable")
        place = at[live]
        symbol = before[place]
        # Entries of one symbol stand in order of position, so a place is found among its symbol's by search.
        rank = np.empty(len(live), np.int64)
        turn = np.argsort(symbol, kind="stable")
        for c, group in zip(*_groups(symbol[turn], turn)):
            rank[group] = begin[c] + np.searchsorted(order[begin[c] : begin[c + 1]], place[group])
        new = count + rank - begin[1]
        # Common prefixes with the neighbours of the same first symbol: one more than between the shorter suffixes.
        up, down = np.zeros(len(live), np.int16), np.zeros(len(live), np.int16)
        earlier = order[rank - 1]
        has = rank > begin[symbol]
        if has.any():
            up[has] = least_between(common, earlier[has] + 1, place[has] + 1) + np.int16(1)
        has = rank + 1 < begin[symbol.astype(np.int64) + 1]
        later = order[np.minimum(rank + 1, len(order) - 1)]
        if has.any():
            down[has] = least_between(common, place[has] + 1, later[has] + 1) + np.int16(1)
        more = size[live] > length
        ahead = np.zeros(len(live), kind)
        ahead[more] = symbols[end[live[more]] - length - 1]
        turn = np.argsort(new, kind="stable")
        own = np.zeros(len(before) + len(live), bool)
        own[new] = True
        kept = np.flatnonzero(~own)
        merged = []
        for old, added in ((before, ahead), (common, up), (numbers, np.arange(number, number + len(live), dtype=np.int32))):
            column = np.empty(len(own), old.dtype)
            column[kept] = old
            column[new[turn]] = added[turn]
            merged.append(column)
        after = new[has] + 1
        old = ~own[after]
        merged[1][after[old]] = down[has][old]
        files.rows = len(own)
        files.put(before=merged[0], common=merged[1], number=merged[2])
        begin = begin + np.concatenate([[0], np.cumsum(np.bincount(ahead, minlength=len(begin) - 1))])
        inserted.append((number, length, live))
        number += len(live)
        at[live] = new
        live = live[more]
    common, numbers = files.get("common", "number")
    files.close()
    long = common >= window
    hit = np.sort(numbers[long | np.concatenate([long[1:], [False]])])
    out_piece, out_start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number, length, live in inserted[window - 1 :]:
        own = live[hit[np.searchsorted(hit, number) : np.searchsorted(hit, number + len(live))] - number]
        out_piece.append(own)
        out_start.append(size[own] - length)
    return np.concatenate(out_piece), np.concatenate(out_start)


def windows_repeated(bucket: np.ndarray, pieces: list[bytes], lead: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of the repeated windows of all pieces with ``n`` of 1.

    Only runs of windows whose common bytes occur in another piece too, and not
    all in equal pieces, go into the transform.
    """
    met: dict[tuple, list] = {}
    for k, piece in enumerate(pieces):
        for number, start, last, core in grid(piece, int(lead[k]), window, RUNS[0]):
            met.setdefault((int(bucket[k]), number, core), []).append((k, start, last))
    out_piece, out_start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def mark(k: int, start: int, last: int) -> None:
        if n[k] == 1:
            out_piece.append(np.full(last - start + 1, k))
            out_start.append(np.arange(start, last + 1))

    parts, owners = [], []
    for entries in met.values():
        if len(entries) == 1:
            continue
        equal: dict[tuple[int, bytes], list] = {}
        for k, start, last in entries:
            equal.setdefault((start - int(lead[k]), pieces[k][start : last + window]), []).append((k, start, last))
        single = [(part, own[0]) for (_, part), own in equal.items() if len(own) == 1 and n[own[0][0]] == 1]
        for own in equal.values():
            if len(own) > 1:
                for entry in own:
                    mark(*entry)
        if single and len(equal) > 1:
            parts += [part for _, part in equal]
            found = {part: entry for part, entry in single}
            owners += [found.get(part) for _, part in equal]
    if parts:
        part, offset = repeated(parts, window)
        wanted = np.array([owner is not None for owner in owners])[part]
        part, offset = part[wanted], offset[wanted]
        owner = np.array([own if own is not None else (0, 0, 0) for own in owners], np.int64)
        out_piece.append(owner[part, 0])
        out_start.append(owner[part, 1] + offset)
    return np.concatenate(out_piece).astype(np.int64), np.concatenate(out_start).astype(np.int64)


def _transform(window: int):
    """Ranges under repeated windows of pieces that came once each, in lots of whole buckets."""

    def lot(table: pa.Table) -> Iterator[pa.RecordBatch]:
        piece, offset = windows_repeated(table.column("bucket").to_numpy(), table.column("piece").to_pylist(), table.column("lead").to_numpy(), table.column("n").to_numpy(), window)
        if not len(piece):
            return
        both = np.unique(np.stack([piece, offset], 1), axis=0)
        piece, offset = both[:, 0], both[:, 1]
        head = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)]))
        tail = np.append(head[1:], len(piece)) - 1
        table = table.combine_chunks()
        of = pa.array(piece[head])
        first = np.asarray(table.column("first").take(of))
        columns = {"doc_id": table.column("doc_id").take(of), "hash": table.column("hash").take(of), "start": pa.array(first + offset[head]), "end": pa.array(first + offset[tail] + window)}
        yield from pa.table(columns).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held is not None and held.num_rows:
                bucket = held.column("bucket").to_numpy()
                size = np.cumsum(np.asarray(pa.compute.binary_length(held.column("piece"))))
                if size[-1] < LOT_BYTES:
                    break
                # A lot ends where a bucket ends, at or after the limit.
                cut = int(np.searchsorted(bucket, bucket[int(np.searchsorted(size, LOT_BYTES))]))
                cut = cut or int(np.searchsorted(bucket, bucket[0], side="right"))
                if cut == held.num_rows:
                    break
                yield from lot(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from lot(held)

    return run


def copies(texts: DataFrame) -> DataFrame:
    """Each text once: its hash, the least doc_id that has it, and the number of rows."""
    rows = texts.select("doc_id", "hash", F.md5(F.col("text").cast("binary")).alias("md5"))
    return rows.groupBy("hash", "md5").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Byte ranges under repeated windows, the texts that may have some, and the copies.

    Ranges (``doc_id``, ``hash``, ``start``, ``end``) may overlap, and are those
    of one row of each text; a text of two rows or more is repeated as a whole.
    """
    texts = keyed(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    once = materialize(copies(texts), "copies")
    found = materialize(anchors(texts.filter(F.octet_length("text") >= window), window, gram), "anchors")
    # Twice in one text, or in two texts; copies of a text alone do not count.
    sure, found = found.filter("anchor is null"), found.filter("anchor is not null")
    edges = found.select("anchor", F.xxhash64("hash", "segment").alias("place")).groupBy("anchor").agg(F.min("place").alias("least"), F.max("place").alias("most"))
    common = materialize(edges.filter("least < most").select("anchor"), "common-anchors")
    shared = found.join(common, "anchor").unionByName(sure)
    first = once.select(F.col("doc_id").alias("own"), F.col("hash").alias("text_hash"))
    listed = shared.groupBy("doc_id", "hash").agg(F.collect_set(F.when(F.col("anchor").isNotNull(), F.struct("anchor", "segment"))).alias("listed"))
    listed = listed.join(first, (F.col("hash") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("own")), "left_semi")
    chosen = materialize(texts.join(listed, (texts["hash"] == listed["hash"]) & texts["doc_id"].eqNullSafe(listed["doc_id"])).select(texts["doc_id"], texts["hash"], "text", "listed").dropDuplicates(["doc_id", "hash"]), "candidates")
    pieces = chosen.mapInArrow(_cut(window), PIECE.format(kind))
    ranges = _repeats(pieces, window, kind).unionAll(sure.select("doc_id", "hash", F.col("segment").alias("start"), "end"))
    return ranges, chosen.select("doc_id", "hash", "text"), once


def _repeats(pieces: DataFrame, window: int, kind: str) -> DataFrame:
    """Ranges under repeated windows, from pieces (``bucket``, ``piece``, ``lead``, ``doc_id``, ``hash``, ``first``)."""
    out = []
    for width in (*RUNS, None):
        mark = F.xxhash64("piece")
        strings = pieces.groupBy("bucket", "lead", mark.alias("mark"), "piece").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("hash").alias("hash"), F.min("first").alias("first"))
        strings = materialize(strings, "strings")
        buckets = strings.groupBy("bucket").agg(F.count("*").alias("strings"))
        several = buckets.filter("strings > 1")
        divided = False
        if width:
            hot = materialize(several.filter(F.col("strings") > LIMIT).select("bucket"), "hot-anchors")
            divided = hot.count() > 0
            several = several.filter(F.col("strings") <= LIMIT)
        twice = strings.filter("n > 1").select("bucket", "lead", "mark")
        whole = pieces.select("bucket", "lead", mark.alias("mark"), "doc_id", "hash", F.col("first").alias("start"), (F.col("first") + F.octet_length("piece")).alias("end"))
        out.append(whole.join(twice, ["bucket", "lead", "mark"]).select("doc_id", "hash", "start", "end"))
        # Dealt by bucket before the join, which then needs no dealing of its own;
        # the engine splits no partition that was asked for by name.
        mixed = strings.repartition("bucket").join(several.select("bucket"), "bucket").select("bucket", "piece", "lead", "n", "doc_id", "hash", "first")
        out.append(mixed.sortWithinPartitions("bucket").mapInArrow(_transform(window), f"doc_id {kind}, hash long, start long, end long"))
        if not divided:
            break
        pieces = pieces.join(hot, "bucket", "left_semi").mapInArrow(_divide(window, width), PIECE.format(kind))
    result = out[0]
    for more in out[1:]:
        result = result.unionAll(more)
    return result


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal runs."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1]


def _rest(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    keep = np.ones(len(data), bool)
    for a, b in zip(start, end):
        keep[a:b] = False
    return data[keep].tobytes()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = byte_column(batch.column("text"))
        removed, count, digest = [], [], []
        for row in range(batch.num_rows):
            ranges = batch.column("ranges").slice(row, 1).flatten()
            start, end = _merge(*(ranges.field(name).to_numpy(zero_copy_only=False) for name in ("start", "end")))
            removed.append(int((end - start).sum()))
            count.append(len(start))
            digest.append(hashlib.sha256(_rest(data[offsets[row] : offsets[row + 1]], start, end)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "hash", "removed", "count", "digest"])


def _with_ranges(ranges: DataFrame, texts: DataFrame) -> DataFrame:
    """Each text that loses bytes with its ranges."""
    per = ranges.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    return texts.join(per, (texts["hash"] == per["hash"]) & texts["doc_id"].eqNullSafe(per["doc_id"])).select(texts["doc_id"], texts["hash"], "text", "ranges")


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    ranges, texts, once = spans(docs, window)
    kind = texts.schema["doc_id"].dataType.simpleString()
    cut = _with_ranges(ranges, texts).mapInArrow(_digests, f"doc_id {kind}, hash long, removed long, count long, digest string")
    text = F.col("text").cast("binary")
    rows = keyed(docs).select("doc_id", "hash", F.md5(text).alias("md5"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    joined = rows.join(cut, (rows["hash"] == cut["hash"]) & rows["doc_id"].eqNullSafe(cut["doc_id"]), "left").select(rows["doc_id"], rows["hash"], "md5", "n_bytes", "sha", "removed", "count", "digest")
    joined = joined.join(once.filter("rows > 1").select("hash", "md5", "rows"), ["hash", "md5"], "left")
    gone = F.col("rows").isNotNull() & (F.col("n_bytes") >= window)
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("count", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, hashlib.sha256().hexdigest()).otherwise(F.coalesce("digest", "sha")).alias("kept_sha256"),
    )


def _cuts(column: int, listed: int, gone: int, window: int):
    """Texts without their ranges, or without anything if they are copies; bytes of characters cut in two go too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(column))
            texts = []
            for row in range(batch.num_rows):
                own = data[offsets[row] : offsets[row + 1]]
                ranges = batch.column(listed).slice(row, 1).flatten()
                if batch.column(gone)[row].is_valid and len(own) >= window:
                    texts.append("")
                elif len(ranges):
                    start, end = _merge(*(ranges.field(name).to_numpy(zero_copy_only=False) for name in ("start", "end")))
                    texts.append(_rest(own, start, end).decode("utf-8", "ignore"))
                else:
                    texts.append(batch.column(column)[row].as_py())
            columns = [*batch.columns[:column], pa.array(texts, pa.string()), *batch.columns[column + 1 :]]
            yield pa.RecordBatch.from_arrays(columns[:listed], batch.schema.names[:listed])

    return run


def cut(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every repeated window cut out of ``text``; all rows and columns stay."""
    ranges, _, once = spans(docs, window)
    per = ranges.groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_of")).agg(F.collect_set(F.struct("start", "end")).alias("_ranges"))
    copied = once.filter("rows > 1").select(F.col("hash").alias("_copy"), F.col("md5").alias("_md5"), F.col("rows").alias("_rows"))
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.withColumn("_hash", F.xxhash64(text)).withColumn("_digest", F.md5(text.cast("binary")))
    rows = rows.join(per, (F.col("_hash") == F.col("_of")) & docs["doc_id"].eqNullSafe(F.col("_id")), "left")
    rows = rows.join(copied, (F.col("_hash") == F.col("_copy")) & (F.col("_digest") == F.col("_md5")), "left").select(*docs.columns, "_ranges", "_rows")
    width = len(docs.columns)
    return rows.mapInArrow(_cuts(docs.columns.index("text"), width, width + 1, window), docs.schema)
