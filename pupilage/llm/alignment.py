"""Tokens of two tokenizers over the same bytes, aligned by merge-path partitioning.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (pieces,
which add a space of their own) the text, so the tokens of both cover the same
bytes. Their ends are two ascending lists. Merged, every distinct end closes one
overlap of one A and one B token, and an end that both lists hold closes a group.

The merging is cut into independent pieces of ``WORK`` steps: on the diagonal of
every ``WORK``-th step a binary search finds how many of the steps before it come
from A (an A end goes before an equal B end), all diagonals at once. Each piece
merges its own part of both lists and emits overlaps. Where equal ends fall on
both sides of a boundary, both pieces have emitted that overlap: the later one is
dropped and the earlier one closes the group.

Neither tokenizer joins bytes across a space that follows other than white space.
So texts are cut there into parts: equal parts are tokenized once, and a text
above ``LOT`` bytes goes through its tokenizers in blocks that end there.

Counting how many documents hold an id pair linked: a lot (about ``LOT`` bytes of
whole documents, or one longer document) lists its distinct pairs with their
number of documents, and each document the places of its pairs in that list. Only
the lists are summed over the corpus; a pair that occurs everywhere has one row a
lot. The counts go back to the lots, and a lot meets its documents again.

Defined cases: a text that is null, empty, or whose joined A or B bytes differ
from a space and the text (also: no valid UTF-8) has no tokens, only zeros and an
empty digest; equal rows count each; a null ``doc_id`` is kept; an empty table
gives no rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pupilage.llm.texts import byte_column, only
from pupilage.sources.storage import materialize

LOT = 4 << 20
WORK = 1 << 16
#: Parts, and bytes of parts, whose tokens a task remembers.
MEMORY = 300_000
MEMORY_BYTES = 16 << 20
SPACE = 32
#: Fixed value: the pattern by which byte-level BPE parts a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = np.zeros(256, bool)
WHITE[[*range(9, 14), *range(28, 33)]] = True


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level BPE writes bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places of spaces after other than white space (Unicode's included)."""
    at = np.flatnonzero((data[1:] == SPACE) & ~WHITE[data[:-1]]) + 1
    one = data[at - 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    white = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    white |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    white |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    white |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    white |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
    return at[~white]


def split_points(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """How many of the first ``steps`` elements of the merged lists come from ``a``, by binary search along each diagonal."""
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        ahead = np.zeros(len(steps), bool)
        ahead[open_] = a[middle[open_]] <= b[steps[open_] - middle[open_] - 1]
        low, high = np.where(open_ & ahead, middle + 1, low), np.where(open_ & ~ahead, middle, high)
    return low


def merged_piece(a: np.ndarray, b: np.ndarray, i: int, i2: int, j: int, j2: int) -> tuple[np.ndarray, ...]:
    """Overlaps of one piece: their end, A token, B token, and whether A and B end there."""
    own_a, own_b = a[i:i2], b[j:j2]
    ends = np.concatenate([own_a, own_b])
    ends.sort(kind="stable")  # two ascending runs: one linear merge
    if len(ends):
        ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]
    at_a, at_b = np.searchsorted(own_a, ends), np.searchsorted(own_b, ends)
    in_a, in_b = np.zeros(len(ends), bool), np.zeros(len(ends), bool)
    in_a[np.searchsorted(ends, own_a)] = True
    in_b[np.searchsorted(ends, own_b)] = True
    return ends, at_a + i, at_b + j, in_a, in_b


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, ...]:
    """All overlaps of the tokens with ascending ends ``a`` and ``b``: end, A token, B token, A ends there, B ends there."""
    steps = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    from_a = split_points(a, b, steps)
    from_b = steps - from_a
    pieces = []
    for k in range(len(steps) - 1):
        piece = merged_piece(a, b, from_a[k], from_a[k + 1], from_b[k], from_b[k + 1])
        if len(piece[0]) and from_a[k] and a[from_a[k] - 1] == piece[0][0]:
            # The piece before emitted this overlap when A ended; B's end, which is here, closes it.
            last = next(p for p in reversed(pieces) if len(p[0]))
            last[4][-1] = True
            piece = tuple(x[1:] for x in piece)
        pieces.append(piece)
    return tuple(np.concatenate([p[k] for p in pieces]) if pieces else np.zeros(0, np.int64 if k < 3 else bool) for k in range(5))


def gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of ``size`` elements from each ``start``, one range after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class Remembered:
    """Ragged rows of numbers, added to and gathered from."""

    def __init__(self, values: np.ndarray | None = None, sizes: np.ndarray | None = None):
        self.values, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        if values is not None:
            self.values, self.starts = values, np.concatenate([[0], np.cumsum(sizes)])

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values = np.concatenate([self.values, values])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def of(self, rows: np.ndarray) -> np.ndarray:
        starts = self.starts[rows]
        return self.values[gathered(starts, self.starts[rows + 1] - starts)]


class Tokens:
    """Both tokenizers, and the ids of the parts seen so far."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.n_a, self.n_b = max(self.a.get_vocab().values()) + 1, self.b.get_piece_size()
        self.bytes_a = [b""] * self.n_a
        for piece, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(map(self.b.id_to_piece, range(self.n_b)))]
        self.size_a, self.size_b = (np.array([len(x) for x in known], np.int64) for known in (self.bytes_a, self.bytes_b))
        self.spelt_a, self.spelt_b = (Remembered(np.frombuffer(b"".join(known), np.uint8), size) for known, size in ((self.bytes_a, self.size_a), (self.bytes_b, self.size_b)))
        #: Each id as it stands in a group: not its side's last there, or the last.
        self.names = [f"{k}{end}".encode() for k in range(self.n_a) for end in ",|"] + [f"{k}{end}".encode() for k in range(self.n_b) for end in ",;"]
        given = json.loads(Path(path_a).read_text())
        split = given.get("pre_tokenizer") or {}
        inner = any("▁" in self.b.id_to_piece(k).lstrip("▁") for k in range(self.n_b) if not self.b.is_control(k))
        #: Whether both tokenizers part at safe cuts; if not, a text is one part.
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and given.get("normalizer") is None and not inner
        self.ranked = self._by_rank(given) if self.cuts else None
        self.forget()

    def _by_rank(self, given: dict):
        """A's own vocabulary and merges as ranks, if merges come in the order of the ids they make: the same ids, much faster."""
        import tiktoken

        vocab, merges = given["model"]["vocab"], given["model"]["merges"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        special = {t["id"] for t in given["added_tokens"]}
        if made != sorted(set(made)) or len(made) + 256 != len(set(vocab.values()) - special) or given["model"].get("ignore_merges"):
            return None
        ranks = {self.bytes_a[k]: k for k in vocab.values() if k not in special}
        return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids_a, self.ids_b, self.fit, self.held = Remembered(), Remembered(), np.zeros(0, bool), 0

    def encode_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        if self.ranked is None:
            found = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
            return np.array([x for ids in found for x in ids], np.int32), np.array([len(ids) for ids in found], np.int64)
        # A part that ends in other than white space stands by itself before the next; the others close a run of parts.
        ids, stop = [], [k + 1 for k, t in enumerate(texts) if t[-1].isspace()]
        for first, last in itertools.pairwise([0, *stop, len(texts)]):
            ids.append(np.array(self.ranked.encode_ordinary("".join(texts[first:last])), np.int32))
        ids = np.concatenate(ids)
        ends = np.cumsum([len(t.encode()) for t in texts])
        return ids, np.diff(np.searchsorted(np.cumsum(self.size_a[ids]), ends, side="right"), prepend=0)

    def encode_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.b.encode([t[1:] for t in texts], num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def learn(self, parts: list[bytes]) -> np.ndarray:
        """The number of each part among those remembered."""
        if len(self.index) > MEMORY or self.held > MEMORY_BYTES:
            self.forget()
        new = [p for p in parts if p not in self.index]
        if new:
            self._add(new)
        return np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))

    def _add(self, parts: list[bytes]) -> None:
        texts = [p.decode("utf-8", "replace") for p in parts]
        self.index.update(zip(parts, range(len(self.fit), len(self.fit) + len(parts))))
        self.held += sum(map(len, parts))
        ids_a, n_a = self.encode_a(texts)
        ids_b, n_b = self.encode_b(texts)
        self.fit = np.concatenate([self.fit, self._spells(parts, ids_a, n_a, self.size_a, self.spelt_a) & self._spells(parts, ids_b, n_b, self.size_b, self.spelt_b)])
        self.ids_a.add(ids_a, n_a)
        self.ids_b.add(ids_b, n_b)

    def _spells(self, parts: list[bytes], ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray, spelt: Remembered) -> np.ndarray:
        """Whether the tokens of each part, joined, are its bytes."""
        joined = np.diff(np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])])
        own = np.fromiter(map(len, parts), np.int64, len(parts))
        same = joined == own
        if same.all():
            given, found = np.frombuffer(b"".join(parts), np.uint8), spelt.of(ids)
            wrong = np.flatnonzero(given != found)
            same[np.searchsorted(np.cumsum(own), wrong, side="right")] = False
            return same
        spell = self.bytes_a if sizes is self.size_a else self.bytes_b
        ends = np.cumsum(counts)
        return np.array([b"".join(map(spell.__getitem__, ids[e - n : e].tolist())) == part for part, e, n in zip(parts, ends, counts)])


class Aligned:
    """The tokens, groups and overlaps of one block of whole texts (or of one stretch of a text)."""

    def __init__(self, tokens: Tokens, data: np.ndarray, offsets: np.ndarray):
        self.tokens = tokens
        n = len(offsets) - 1
        edge = np.zeros(len(data) + 1, bool)
        if tokens.cuts:
            edge[safe_cuts(data)] = True
            # A space that ends a text stays with the part before it: pieces have no token for an empty part.
            edge[offsets[1:] - 1] = False
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        parts = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        numbers = tokens.learn(parts.dictionary.to_pylist())[parts.indices.to_numpy()] if len(cuts) > 1 else np.zeros(0, np.int64)
        doc = np.searchsorted(offsets, cuts[:-1], side="right") - 1
        self.fit = np.ones(n, bool)
        self.fit[doc[~tokens.fit[numbers]]] = False
        kept = self.fit[doc]
        numbers, doc = numbers[kept], doc[kept]
        self.a, self.b = tokens.ids_a.of(numbers), tokens.ids_b.of(numbers)
        ends_a, ends_b = np.cumsum(tokens.size_a[self.a]), np.cumsum(tokens.size_b[self.b])
        ends, self.of_a, self.of_b, in_a, in_b = overlaps(ends_a, ends_b)
        both = in_a & in_b
        stops = np.cumsum(np.where(self.fit, np.diff(offsets), 0))
        upto = lambda where: np.concatenate([[0], np.searchsorted(where, stops, side="right")])
        self.at_a, self.at_b, self.at_link, self.at_group = upto(ends_a), upto(ends_b), upto(ends), upto(ends[both])
        # In a group, all of its A tokens come before all of its B tokens.
        group = np.cumsum(both) - both
        last_a, last_b = both[in_a], both[in_b]
        through_a, through_b = np.flatnonzero(last_a) + 1, np.concatenate([[0], np.flatnonzero(last_b) + 1])
        self.codes = np.zeros(len(self.a) + len(self.b), np.int64)
        self.codes[np.arange(len(self.a)) + through_b[group[in_a]]] = 2 * self.a.astype(np.int64) + last_a
        self.codes[np.arange(len(self.b)) + through_a[group[in_b]]] = 2 * tokens.n_a + 2 * self.b.astype(np.int64) + last_b

    def pairs(self) -> np.ndarray:
        """The id pair of each overlap, as one number."""
        return self.a[self.of_a].astype(np.int64) * self.tokens.n_b + self.b[self.of_b]

    def written(self, k: int) -> bytes:
        """The groups of the k-th text, each with its ``;``."""
        codes = self.codes[self.at_a[k] + self.at_b[k] : self.at_a[k + 1] + self.at_b[k + 1]]
        return b"".join(map(self.tokens.names.__getitem__, codes.tolist()))


def packed(places: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places and their repeat counts, in as many bytes a number as the largest needs."""
    steps = np.diff(places, prepend=0)
    kinds = [np.min_scalar_type(int(x.max(initial=0))) for x in (steps, times)]
    return b"".join([kinds[0].char.encode(), kinds[1].char.encode(), steps.astype(kinds[0]).tobytes(), times.astype(kinds[1]).tobytes()])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, second = np.dtype(chr(data[0])), np.dtype(chr(data[1]))
    n = (len(data) - 2) // (first.itemsize + second.itemsize)
    return np.cumsum(np.frombuffer(data, first, n, 2).astype(np.int64)), np.frombuffer(data, second, n, 2 + n * first.itemsize).astype(np.int64)


def stretches(data: np.ndarray, limit: int, cuts: bool) -> Iterator[np.ndarray]:
    """A long text in blocks of about ``limit`` bytes that end at safe cuts; one block without any."""
    places = safe_cuts(data[:-1]) if cuts else np.zeros(0, np.int64)
    at = 0
    while at < len(data):
        if len(data) - at <= limit:
            stop = len(data)
        else:
            before, after = np.searchsorted(places, [at + limit, at + 1], side="right")
            # The last cut inside the limit, else the first one beyond it.
            stop = int(places[before - 1]) if before and places[before - 1] > at else int(places[after]) if after < len(places) else len(data)
        yield data[at:stop]
        at = stop


def aligned_lot(tokens: Tokens, data: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Per text (n_a, n_b, n_groups, n_links, digest, packed places), the lot's distinct pairs, and their numbers of documents."""
    if len(offsets) == 2 and offsets[1] > limit:
        counts, digest, codes, times = np.zeros(4, np.int64), hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = b""
        for block in stretches(data, limit, tokens.cuts):
            found = Aligned(tokens, block, np.array([0, len(block)]))
            if not found.fit[0]:
                return [(0, 0, 0, 0, "", packed(codes[:0], times[:0]))], codes[:0], times[:0]
            counts += [x[1] for x in (found.at_a, found.at_b, found.at_group, found.at_link)]
            digest.update(held)
            held = found.written(0)
            digest.update(held[:-1])
            held = held[-1:]
            own, own_times = np.unique(found.pairs(), return_counts=True)
            codes, place = np.unique(np.concatenate([codes, own]), return_inverse=True)
            times = np.bincount(place, np.concatenate([times, own_times]), len(codes)).astype(np.int64)
        return [(*counts.tolist(), digest.hexdigest(), packed(np.arange(len(codes)), times))], codes, np.ones(len(codes), np.int64)
    found = Aligned(tokens, data, offsets)
    n = len(offsets) - 1
    pairs, place = np.unique(found.pairs(), return_inverse=True)
    doc = np.repeat(np.arange(n), np.diff(found.at_link))
    cells, times = np.unique(doc * max(1, len(pairs)) + place, return_counts=True)
    doc, place = np.divmod(cells, max(1, len(pairs)))
    bounds = np.searchsorted(doc, np.arange(n + 1))
    sizes = [np.diff(x).tolist() for x in (found.at_a, found.at_b, found.at_group, found.at_link)]
    rows = []
    for k, counts in enumerate(zip(*sizes)):
        own = slice(bounds[k], bounds[k + 1])
        rows.append((*counts, hashlib.sha256(found.written(k)[:-1]).hexdigest() if counts[0] else "", packed(place[own], times[own])))
    return rows, pairs, np.bincount(place, minlength=len(pairs))


def lots(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes at most; a longer row stands alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, last
        row = last


def spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a space and the text of each row; nothing for null and empty texts."""
    data, offsets = byte_column(column)
    sizes = np.diff(offsets)
    full = sizes > 0
    starts = np.concatenate([[0], np.cumsum(sizes + full)])
    out = np.full(int(starts[-1]), SPACE, np.uint8)
    inside = np.ones(len(out), bool)
    inside[starts[:-1][full]] = False
    out[inside] = data[offsets[0] : offsets[-1]]
    return out, starts


def alignments(docs: DataFrame, path_a: str, path_b: str, limit: int = LOT) -> DataFrame:
    """Rows of documents (``lot``, ``doc_id``, counts, digest, ``links``), and one row a lot with its distinct ``pairs`` and their ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path_a, path_b)
        lot = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = spaced(batch.column("text"))
            for first, last in lots(offsets, limit):
                rows, pairs, times = aligned_lot(tokens, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], limit)
                n = len(rows)
                columns = [pa.array([lot] * n, pa.int64()), batch.column("doc_id").slice(first, n)]
                columns += [pa.array(x, kind) for x, kind in zip(zip(*rows), [pa.int64()] * 4 + [pa.string(), pa.binary()])]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names)
                if len(pairs):
                    blank = [pa.nulls(1, c.type) for c in columns[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array([lot], pa.int64()), *blank, pa.array([pairs.tolist()], pa.list_(pa.int64())), pa.array([times.tolist()], pa.list_(pa.int64()))], names)
                lot += 1

    source = only(docs, "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["lot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "docs"]
    return source.mapInArrow(run, f"lot long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, docs array<long>")


def pair_counts(aligned: DataFrame, n_b: int) -> tuple[DataFrame, DataFrame]:
    """``listed`` (lot, place, pair) of all lots, and per pair its ``count`` of documents and whether that is its A id's ``top``."""
    both = F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "_at")
    listed = aligned.filter(F.col("pairs").isNotNull()).select("lot", both).select("lot", "place", F.col("_at.pairs").alias("pair"), F.col("_at.docs").alias("docs"))
    counts = materialize(listed.groupBy("pair").agg(F.sum("docs").alias("count")), "pair-counts")
    of_a = F.expr(f"pair div {n_b}")
    # One row for each id of A's vocabulary at most.
    best = F.broadcast(counts.groupBy(of_a.alias("a")).agg(F.max("count").alias("most")))
    ranked = counts.withColumn("a", of_a).join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("top"))
    return listed.select("lot", "place", "pair"), ranked


def linked(docs: DataFrame, path_a: str, path_b: str, limit: int = LOT) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    aligned = materialize(alignments(docs, path_a, path_b, limit), "aligned")
    listed, ranked = pair_counts(aligned, n_b)
    # A pair of every lot is a skewed key of this join, which the engine splits; its other side has one row a pair.
    answers = listed.join(ranked, "pair").select(F.col("lot").alias("of_lot"), "place", "count", "top")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        count, top = np.zeros(size, np.int64), np.zeros(size, bool)
        place = right.column("place").to_numpy()
        count[place], top[place] = right.column("count").to_numpy(), right.column("top").to_numpy()
        best, total = [], []
        for data in left.column("links").to_pylist():
            own, times = unpacked(data)
            best.append(int(times[top[own]].sum()))
            total.append(int((times * count[own]).sum()))
        for name, values in (("n_best", best), ("count_sum", total)):
            left = left.append_column(name, pa.array(values, pa.int64()))
        return left.select(names)

    rows = aligned.filter(F.col("links").isNotNull()).drop("pairs", "docs")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("lot").cogroup(answers.groupBy("of_lot")).applyInArrow(meet, schema)
