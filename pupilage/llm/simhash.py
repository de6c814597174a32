"""SimHash near-duplicates through a hierarchical index in Gray order.

A fingerprint bit is set if it is set in more than half of the text's shingle
hashes. Equal fingerprints are one class; classes that differ in few bits are
linked, and links make components.

Classes meet in buckets. For 64 bits and a small limit the buckets are the
``limit + 1`` blocks of the fingerprint, one of which two linked classes must
share: no link is lost. For wide fingerprints, where that gives no selection,
each of many tables takes bits of its own, as many tables as find a pair at the
limit with chance ``RECALL``. In a bucket the fingerprints are sorted by Gray
rank; runs of them become upper nodes that hold the bits their members agree
in. A search goes down pairs of nodes, adds up the differences in the bits both
nodes fix and leaves a pair of nodes, with all below, once they exceed the
limit. A task passes on a spanning forest of its links, not all of them.

Defined cases: null and empty texts and texts of white space have fingerprint
zero and are linked like any other; fewer words than a shingle give one shingle
of all words; repeated rows are rows of one class; a null doc_id never names a
component unless all its ids are null; only ``doc_id`` and ``text`` are read.

``survivors`` drops no row on fingerprints. Its classes are texts with equal sets
of shingles, its fingerprints are made of the distinct shingles, and a pair within
the limit is a candidate only: it links if the Jaccard similarity of the two sets,
made from the texts, is as asked. Texts without words are a class of their own.
Sketches of the sets, which differ in no more bits than the sets in shingles, show
of most candidates where they meet that they cannot be so similar; only the others
are written and read again.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pupilage.llm.buckets import by_bucket, spread, union
from pupilage.llm.components import components
from pupilage.llm.texts import byte_column, mixed, only
from pupilage.sources.storage import materialize

SEED = 42
PIECE = 4 << 20
RECALL = 0.98
FAN = 8
PAIRS = 1 << 17
#: Candidates that a class writes from one bucket; with more it writes one and waits for the next round.
DENSE = 16
ROUNDS = 4
#: Bytes of a set's sketch in the first round, for all classes, and in the later ones, for those with many candidates.
BRIEF = 32
SKETCH = 128


def pieces(text: bytes) -> Iterator[bytes]:
    """The text, or parts of a long one; parts end between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end]
        at = end


def shingles(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the text's shingles, piece by piece."""
    total, tail = 0, []
    for piece in pieces(text):
        words = tail + piece.lower().split()
        if len(words) < shingle:
            tail = words
            continue
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        first, last = (end - size).tolist(), end.tolist()
        yield np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last[shingle - 1 :])), np.uint64, len(words) - shingle + 1)
        total += len(words) - shingle + 1
        tail = words[len(words) - shingle + 1 :]
    if not total and tail:
        yield np.array([xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)


def distinct(text: bytes, shingle: int) -> np.ndarray:
    """The set of the text's shingle hashes, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(text, shingle)]))


def fingerprint(hashes: Iterable[np.ndarray], width: int) -> np.ndarray:
    """``width`` words of 64 bits; the second and later words mix the shingle hashes anew."""
    counts, total = np.zeros((width, 64), np.int64), 0
    for part in hashes:
        total += len(part)
        for k in range(width):
            own = part if k == 0 else mixed(part + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            for at in range(0, len(own), PIECE // 8):
                counts[k] += np.unpackbits(own[at : at + PIECE // 8].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > total).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(width)


def sketch(hashes: np.ndarray, size: int) -> bytes:
    """For each residue of the hashes, whether an odd number has it: sets differ in at least as many members as sketches in bits."""
    odd = np.bincount((hashes % np.uint64(8 * size)).astype(np.int64), minlength=8 * size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4, width: int = 1) -> DataFrame:
    """``doc_id``, ``hash`` of the text and the fingerprint words ``f0``, ``f1``, ... of every row."""
    names = [f"f{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            found = np.zeros((batch.num_rows, width), np.uint64)
            for row in range(batch.num_rows):
                found[row] = fingerprint(shingles(data[offsets[row] : offsets[row + 1]].tobytes(), shingle), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *(pa.array(found[:, k].view(np.int64)) for k in range(width))], ["doc_id", "hash", *names])

    source = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("hash"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, ", ".join([f"doc_id {kind}", "hash long", *(f"{name} long" for name in names)]))


def gray_rank(words: np.ndarray) -> list[np.ndarray]:
    """Place of each fingerprint in the reflected Gray sequence, as words from the highest on."""
    ranks, carry = [], np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        rank = words[:, k].copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(shift)
        rank ^= (np.uint64(0) - carry)
        carry = rank & np.uint64(1)
        ranks.append(rank)
    return ranks


class Index:
    """Gray-ordered hierarchy over the fingerprints of many buckets."""

    def __init__(self, bucket: np.ndarray, words: np.ndarray):
        self.order = np.lexsort((*gray_rank(words)[::-1], bucket))
        bucket, pattern = bucket[self.order], words[self.order]
        mask = np.full_like(pattern, ~np.uint64(0))
        self.levels = [(pattern, mask, None, None)]
        while True:
            first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            start = np.flatnonzero(first)
            if len(start) == len(bucket):
                return
            place = np.arange(len(bucket)) - start[np.cumsum(first) - 1]
            head = np.flatnonzero(place % FAN == 0)
            count = np.diff(np.append(head, len(bucket)))
            free = np.bitwise_or.reduceat((pattern ^ np.repeat(pattern[head], count, 0)) | ~mask, head, axis=0)
            pattern, mask, bucket = pattern[head], ~free, bucket[head]
            self.levels.append((pattern, mask, head, count))

    def pairs(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the given order that differ in at most ``limit`` bits, in bounded lots."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        zero = np.zeros((len(roots), self.levels[0][0].shape[1]), np.uint64)
        stack = [(top, roots, roots, np.zeros(len(roots), np.int64), zero)]
        while stack:
            level, a, b, sofar, fixed = stack.pop()
            if level == 0:
                apart = a != b
                if apart.any():
                    yield self.order[a[apart]], self.order[b[apart]]
                continue
            _, _, head, count = self.levels[level]
            width = count[a] * count[b]
            if width.sum() > PAIRS and len(a) > 1:
                half = len(a) // 2
                stack.append((level, a[half:], b[half:], sofar[half:], fixed[half:]))
                stack.append((level, a[:half], b[:half], sofar[:half], fixed[:half]))
                continue
            of = np.repeat(np.arange(len(a)), width)
            k = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
            i, j = head[a[of]] + k // count[b[of]], head[b[of]] + k % count[b[of]]
            keep = i <= j
            of, i, j = of[keep], i[keep], j[keep]
            pattern, mask, _, _ = self.levels[level - 1]
            both = mask[i] & mask[j]
            differ = sofar[of] + np.bitwise_count((pattern[i] ^ pattern[j]) & both & ~fixed[of]).sum(1, dtype=np.int64)
            keep = differ <= limit
            stack.append((level - 1, i[keep], j[keep], differ[keep], both[keep]))


def _links(limit: int, width: int):
    names = [f"f{k}" for k in range(width)]

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, side, node = (table.column(name).to_numpy() for name in ("bucket", "side", "node"))
        words = np.stack([table.column(name).to_numpy().view(np.uint64) for name in names], 1)
        label = np.arange(len(node))
        for i, j in Index(bucket, words).pairs(limit):
            meet = ((side[i] == 0) | (side[i] != side[j])) & (label[i] != label[j])
            union(label, i[meet], j[meet])
        other = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[label[other]])], ["a", "b"])

    return work


def tables(width: int, limit: int, classes: int) -> list[np.ndarray]:
    """The bits that make the key of each table of buckets."""
    if width == 1:
        return [np.asarray(x) for x in np.array_split(np.arange(64), limit + 1)]
    size = max(12, math.ceil(math.log2(max(2, classes) / 64)))
    once = (1 - limit / (64 * width)) ** size
    rng = np.random.default_rng(5)
    return [rng.choice(64 * width, size, replace=False) for _ in range(math.ceil(math.log(1 - RECALL) / math.log(1 - once)))]


def _met(rows: DataFrame, bits: list[np.ndarray], width: int) -> DataFrame:
    """Rows (``node``, ``f0``, ... and others) in each bucket of each table."""
    names = [f"f{k}" for k in range(width)]
    kinds = [f"{field.name} {field.dataType.simpleString()}" for field in rows.schema]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(name).to_numpy().view(np.uint64) for name in names], 1)
            for number, chosen in enumerate(bits):
                value = np.zeros(len(words), np.uint64)
                for bit in chosen:
                    value = (value << np.uint64(1)) | ((words[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1))
                key = mixed(value * np.uint64(len(bits)) + np.uint64(number))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], ["key", *batch.schema.names])

    keyed = rows.mapInArrow(keys, ", ".join(["key long", *kinds]))
    return spread(keyed, "key", "node")


def linked(classes: DataFrame, limit: int, width: int) -> DataFrame:
    """A spanning forest of the links between classes (``node``, ``f0``, ...), task by task."""
    rows = classes.select("node", *(f"f{k}" for k in range(width)))
    return by_bucket(_met(rows, tables(width, limit, classes.count()), width), _links(limit, width), "a long, b long").distinct()


def _rooted(prints: DataFrame, limit: int, width: int) -> DataFrame:
    """The classes with ``first`` (least doc_id) and ``root`` (their component)."""
    names = [f"f{k}" for k in range(width)]
    classes = materialize(prints.groupBy(*names).agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = components(linked(classes, limit, width))
    return materialize(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")


def grouped(docs: DataFrame, shingle: int = 4, limit: int = 4, width: int = 1) -> DataFrame:
    """``doc_id``, ``f0``, ... and ``component_id`` (least doc_id of the component) of every row."""
    names = [f"f{k}" for k in range(width)]
    prints = materialize(fingerprints(docs, shingle, width), "fingerprints")
    placed = _rooted(prints, limit, width)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(placed.join(least, "root").select(*names, "component_id"), names).select("doc_id", *names, "component_id")


def limit_for(similarity: float, width: int) -> int:
    """Differing bits of two texts whose shingle sets have this Jaccard similarity, as expected, and two standard deviations more."""
    bits = 64 * width
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + 2 * math.sqrt(bits * share * (1 - share)))


def _sets(docs: DataFrame, shingle: int, width: int) -> DataFrame:
    """``doc_id``, ``hash`` of the text, ``digest``, ``size``, ``brief`` and ``sketch`` of its set of shingles and the fingerprint of that set."""
    names = [f"f{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            found, briefs, sketches = np.zeros((batch.num_rows, width + 2), np.uint64), [], []
            for row in range(batch.num_rows):
                own = distinct(data[offsets[row] : offsets[row + 1]].tobytes(), shingle)
                found[row] = (xxh64_intdigest(own.tobytes(), SEED), len(own), *fingerprint([own], width))
                briefs.append(sketch(own, BRIEF))
                sketches.append(sketch(own, SKETCH))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hash"), *(pa.array(found[:, k].view(np.int64)) for k in range(width + 2)), pa.array(briefs, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "hash", "digest", "size", *names, "brief", "sketch"],
            )

    source = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("hash"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, ", ".join([f"doc_id {kind}", "hash long, digest long, size long", *(f"{name} long" for name in names), "brief binary, sketch binary"]))


def _candidates(limit: int, width: int, similarity: float, turn: int, dense: int | None):
    """Pairs of different roots within the limit whose sizes and sketches allow the similarity.

    A row with more than ``dense`` pairs in its bucket writes one, to the least
    neighbour in an order of this turn, and itself as a pair with itself. A pair
    is left out only if both its rows do so.
    """
    names = [f"f{k}" for k in range(width)]

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, root = table.column("bucket").to_numpy(), table.column("root").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        many = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
        rows = np.flatnonzero(np.repeat(many, np.diff(np.append(start, len(bucket)))))
        if not len(rows):
            return
        bucket, root = bucket[rows], root[rows]
        side, node, size = (table.column(name).to_numpy()[rows] for name in ("side", "node", "size"))
        words = np.stack([table.column(name).to_numpy()[rows].view(np.uint64) for name in names], 1)
        data, offsets = byte_column(table.column("sketch").combine_chunks())
        marks = data[offsets[0] : offsets[-1]].reshape(len(offsets) - 1, -1)[rows].view(np.uint64)
        order = mixed(node.view(np.uint64) + np.uint64(turn))
        degree = np.zeros(len(node), np.int64)
        least = np.full(len(node), ~np.uint64(0))
        held_i, held_j = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        back = np.argsort(order)
        for i, j in Index(bucket, words).pairs(limit):
            low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            meet = ((side[i] == 0) | (side[i] != side[j])) & (root[i] != root[j]) & (low >= similarity * high)
            i, j = i[meet], j[meet]
            # What both sets hold at most, if they differ no more than their sketches do.
            total = size[i] + size[j]
            both = (total - np.bitwise_count(marks[i] ^ marks[j]).sum(1, dtype=np.int64)) // 2
            able = both >= similarity * (total - both)
            i, j = i[able], j[able]
            if dense is None:
                yield batch(node[i], node[j])
                continue
            open_ = (degree[i] <= dense) | (degree[j] <= dense)
            degree += np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
            np.minimum.at(least, i, order[j])
            np.minimum.at(least, j, order[i])
            held_i, held_j = np.concatenate([held_i, i[open_]]), np.concatenate([held_j, j[open_]])
            few = (degree[held_i] <= dense) | (degree[held_j] <= dense)
            held_i, held_j = held_i[few], held_j[few]
        yield batch(node[held_i], node[held_j])
        full = np.flatnonzero(degree > (dense or 0)) if dense is not None else np.zeros(0, np.int64)
        # A node may have more rows in the table, one a bucket; they are all named by their node.
        yield batch(node[full], node[back[np.searchsorted(order, least[full], sorter=back)]])
        yield batch(node[full], node[full])

    return work


def _similar(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` of classes and whether their sets of shingles are similar (``linked``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [byte_column(batch.column(name)) for name in ("text_a", "text_b")]
            near = np.zeros(batch.num_rows, bool)
            for row in range(batch.num_rows):
                a, b = (distinct(data[offsets[row] : offsets[row + 1]].tobytes(), shingle) for data, offsets in sides)
                both = len(np.intersect1d(a, b, assume_unique=True))
                near[row] = both >= similarity * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near)], ["a", "b", "linked"])

    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "least"), "node")
    needed = needed.select("node", F.col("least.doc_id").alias("_id"), F.col("least.hash").alias("_hash"))
    rows = only(docs, "doc_id", "text").withColumn("_hash_of", F.xxhash64("text"))
    texts = rows.join(needed, (rows["_hash_of"] == needed["_hash"]) & rows["doc_id"].eqNullSafe(needed["_id"])).select("node", "text").dropDuplicates(["node"])
    texts = materialize(texts, "candidate-texts")
    a, b = (texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}")) for name in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


def _verified(docs: DataFrame, classes: DataFrame, shingle: int, similarity: float, width: int) -> DataFrame:
    """``node`` and ``root`` of the components that candidates with similar sets make.

    Each round checks candidates between different components. Groups with many
    candidates are joined by one for each class first, so that a group of near
    copies does not write all its pairs; what is then still apart writes them.
    """
    names = [f"f{k}" for k in range(width)]
    limit = limit_for(similarity, width)
    bits = tables(width, limit, classes.count())
    active, tested, roots = classes.select("node", "size", F.col("brief").alias("sketch"), *names).withColumn("root", F.col("node")), None, None
    for turn in range(ROUNDS):
        dense = DENSE if turn < ROUNDS - 1 else None
        found = materialize(by_bucket(_met(active, bits, width), _candidates(limit, width, similarity, turn, dense), "a long, b long").distinct(), "candidates")
        pairs = found.filter("a <> b")
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        now = materialize(_similar(materialize(pairs, "pairs"), docs, classes, shingle, similarity), "tested")
        tested = now if tested is None else tested.unionAll(now)
        roots = components(tested.filter("linked").select("a", "b"))
        full = found.filter("a = b").select(F.col("a").alias("node"))
        if dense is None or full.isEmpty():
            break
        active = materialize(classes.select("node", "size", "sketch", *names).join(full, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "active")
    return roots


def survivors(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, width: int = 4) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: the least doc_id, then the least text hash."""
    sets = materialize(_sets(docs, shingle, width), "sets")
    # Of equal sets one row can stay at most; so few rows are left for the component's choice.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("least")
    classes = materialize(sets.groupBy(*(f"f{k}" for k in range(width)), "digest", "size", "brief", "sketch").agg(least).withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = _verified(docs, classes, shingle, similarity, width)
    chosen = classes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    chosen = chosen.select(F.col("least.doc_id").alias("_kept_id"), F.col("least.hash").alias("_kept_hash"))
    rows = docs.withColumn("_hash", F.xxhash64(docs["text"]))
    kept = rows.join(chosen, (rows["_hash"] == chosen["_kept_hash"]) & rows["doc_id"].eqNullSafe(chosen["_kept_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_hash"]).select(*docs.columns)
