"""Packing token sequences by non-negative least squares on the length histogram.

Each text gives windows of ``WINDOW`` tokens that stand alone, and a tail. Tails
fall into bins of ``UNIT`` tokens, rounded up. Every combination of at most
three bins that fills a window is a column; the repeat counts that come nearest
to the histogram are the solution of a non-negative least-squares problem of
fixed size. Rounded down, they say how many sequences of each combination there
are; tails take their places by rank in their bin. What is left over is packed
greedily, best fit first; a tail that fits nowhere is cut at a multiple of
``GRID`` tokens. Only the histogram (at most ``WINDOW / UNIT`` counts) reaches
the driver, and only the combinations in use (at most three ranges of ranks for
each bin) go out.

Defined cases: null text is empty, and an empty text is its end id alone; equal
rows are packed each; a null doc_id is kept; only ``doc_id`` and ``text`` are
read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pupilage.llm.numbering import chunks_for, running
from pupilage.llm.texts import only
from pupilage.sources.storage import materialize

WINDOW = 2048
UNIT = 8
GRID = 512
END = 1
DEPTH = 3
#: Parts that a worker process remembers the ids of, in each of two ages.
MEMORY = 400_000
#: Characters of texts whose different parts are looked up or learned together.
GROUP = 1 << 22

#: What parts texts that are put together: a control character, which no such text has.
MARK = "\x00"
#: Fixed value of the tokenizer file: letters that its normaliser treats one by one.
PLAIN = re.compile(r"[\t\n\r -~¡-ɏ]*")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: The letter that stands for each byte in a byte-level vocabulary: itself if it is printed, else one of those after U+00FF.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {byte: 256 + k for k, byte in enumerate(byte for byte in range(256) if byte not in PRINTED)}


class WordTokens:
    """Ids of whole texts, put together from the ids of what stands between white space, which are remembered.

    Texts with letters outside the Latin blocks, control characters or the
    strings of special tokens go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The same split and merges for text that is normal already, without the search for special tokens.
        given = json.loads(Path(path).read_text())
        self.inner = Tokenizer.from_str(json.dumps(given | {"normalizer": None, "added_tokens": []}))
        self.mark = self.inner.encode(MARK, add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError("the tokenizer has no id for the mark between parts")
        steps = (given.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = steps[0].get("pattern", {}).get("Regex") if steps else None
        split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        known = pattern and len(steps) == 2 and steps[0] == split and {k: steps[1].get(k) for k in level} == level
        #: What finds the words of parts and the spaces between them, if the file does no more than split by a pattern; else None.
        self.words = regex.compile(f"(?:{pattern})| ") if known and not any(" " in word for word in regex.findall(pattern, " a  1 . ")) else None
        #: Parts in use, and those in use before; what is asked for again moves up, the rest goes.
        self.parts: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def of(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return next(self.of_all([text]))

    def of_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; about ``GROUP`` characters of texts are treated together."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        plain = [bool(PLAIN.fullmatch(text)) and not any(s in text for s in SPECIAL) and unicodedata.is_normalized("NFC", text) for text in texts]
        put = self._put_together([text.lower() for text, own in zip(texts, plain) if own])
        for text, own in zip(texts, plain):
            yield next(put) if own else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _put_together(self, texts: list[str]) -> Iterator[bytes]:
        # White space parts words, so what stands between it can be remembered as a whole.
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = parts.flatten().dictionary_encode()
        ids = self._known(coded.dictionary.to_pylist())
        data = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        code = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[code])])
        at = np.repeat((np.cumsum(size) - size)[code] - ends[:-1], size[code])
        at += np.arange(len(at))
        data, cuts = data[at].tobytes(), (4 * ends[parts.offsets.to_numpy()]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield data[a:b]

    def _known(self, parts: list[str]) -> list[bytes]:
        """The ids of different parts."""
        found = list(map(self.parts.get, parts))
        missing = [part for part, ids in zip(parts, found) if ids is None]
        if len(self.parts) > MEMORY:
            self.parts, self.before = {}, self.parts
        held = list(map(self.before.get, missing))
        new = [part for part, ids in zip(missing, held) if ids is None]
        learned = self._learned(new)
        held = [next(learned) if ids is None else ids for ids in held]
        self.parts.update(zip(missing, held))
        rest = iter(held)
        return [next(rest) if ids is None else ids for ids in found]

    def _learned(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of each part, made by the tokenizer."""
        if self.words is None:
            return self._marked(parts)
        words = self.words.findall(" ".join(parts))
        ids = {word: self.parts.get(word) or self.before.get(word) for word in dict.fromkeys(words)}
        ids[" "] = b""
        new = [word for word, own in ids.items() if own is None]
        made, size = [], [0]
        for letters in " ".join(new).encode().decode("latin-1").translate(BYTES).split(chr(BYTES[32])) if new else ():
            made += [token.id for token in self.inner.model.tokenize(letters)]
            size.append(4 * len(made))
        data = np.array(made, "<u4").tobytes()
        ids.update(zip(new, (data[a:b] for a, b in zip(size, size[1:]))))
        found = list(map(ids.__getitem__, words))
        at = [k for k, word in enumerate(words) if word == " "]
        cuts = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        data = b"".join(found)
        cuts = [0, *cuts[at].tolist(), len(data)]
        return (data[a:b] for a, b in zip(cuts, cuts[1:]))

    def _marked(self, parts: list[str]) -> Iterator[bytes]:
        """All parts in one call: each stands between spaces and marks, so it has the same ids there."""
        texts = [part for part in parts if part]
        ids = np.array(self.inner.encode(f" {MARK} ".join(texts), add_special_tokens=False).ids, "<u4")
        at = np.flatnonzero(ids == self.mark[0])
        if len(at) != max(0, len(texts) - 1):
            raise ValueError("the tokenizer cuts parts in another way")
        data = ids.tobytes()
        starts, ends = iter([0, *(4 * at + 4).tolist()]), iter([*(4 * at).tolist(), len(data)])
        return (data[next(starts) : next(ends)] if part else b"" for part in parts)


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for all tasks that a worker process runs."""
    return WordTokens(path)


def tokenized(docs: DataFrame, path: str, window: int = WINDOW, grid: int = GRID) -> DataFrame:
    """Per row: ``row`` (its number), ``doc_id``, ``n`` ids, CRC-32 of its windows and of its tail, and of the tail before and after each multiple of ``grid``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = word_tokens(path)
        for batch in batches:
            counts, windows, tails, befores, afters = [], [], [], [], []
            for own in tokens.of_all([text or "" for text in batch.column("text").to_pylist()]):
                ids = own + END.to_bytes(4, "little")
                n, size = len(ids) // 4, 4 * window
                tail = ids[n // window * size :]
                counts.append(n)
                windows.append([zlib.crc32(ids[k : k + size]) for k in range(0, n // window * size, size)])
                tails.append(zlib.crc32(tail))
                cuts = range(4 * grid, len(tail), 4 * grid)
                crc, at, before = 0, 0, []
                for cut in cuts:
                    crc, at = zlib.crc32(tail[at:cut], crc), cut
                    before.append(crc)
                befores.append(before)
                afters.append([[zlib.crc32(tail[a:b]) for b in [*range(a + 4 * grid, len(tail), 4 * grid), len(tail)]] for a in cuts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(windows, pa.list_(pa.int64())), pa.array(tails, pa.int64()), pa.array(befores, pa.list_(pa.int64())), pa.array(afters, pa.list_(pa.list_(pa.int64())))],
                ["row", "doc_id", "n", "window_crcs", "tail_crc", "before_crcs", "after_crcs"],
            )

    source = only(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"row long, doc_id {kind}, n long, window_crcs array<long>, tail_crc long, before_crcs array<long>, after_crcs array<array<long>>")


def combinations(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ways to fill ``bins`` with at most ``depth`` parts, each in order."""

    def fill(left: int, least: int, parts: int) -> Iterator[tuple[int, ...]]:
        if left >= least:
            yield (left,)
        if parts > 1:
            for first in range(least, left // 2 + 1):
                for rest in fill(left - first, first, parts - 1):
                    yield (first, *rest)

    return list(fill(bins, 1, depth))


def nonnegative(matrix: np.ndarray, target: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The x >= 0 with the least ``|matrix @ x - target|``, by growing and shrinking the set of free columns."""
    columns = matrix.shape[1]
    free = np.zeros(columns, bool)
    x = np.zeros(columns)
    for _ in range(3 * len(target)):
        slope = matrix.T @ (target - matrix @ x)
        slope[free] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        free[best] = True
        while True:
            chosen = np.flatnonzero(free)
            part = matrix[:, chosen]
            solved = np.linalg.solve(part.T @ part + 1e-10 * np.eye(len(chosen)), part.T @ target)
            if (solved > 0).all():
                x[:] = 0
                x[chosen] = solved
                break
            bad = solved <= 0
            step = min(1.0, (x[chosen][bad] / np.maximum(x[chosen][bad] - solved[bad], 1e-300)).min())
            x[chosen] += step * (solved - x[chosen])
            free[chosen[x[chosen] <= 1e-15]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def repeats(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is used; ``histogram[b]`` counts tails of bin ``b + 1``."""
    total = int(histogram.sum())
    if not total:
        return []
    ways = combinations(len(histogram))
    matrix = np.zeros((len(histogram), len(ways)))
    for k, way in enumerate(ways):
        for part in way:
            matrix[part - 1, k] += 1
    solved = np.floor(nonnegative(matrix, histogram / total) * total + 1e-6).astype(np.int64)
    left, used = histogram.astype(np.int64).copy(), []
    for k in np.argsort(-solved, kind="stable"):
        if solved[k] <= 0:
            break
        need = matrix[:, k].astype(np.int64)
        count = int(min(solved[k], min(left[b] // need[b] for b in np.flatnonzero(need))))
        if count:
            left -= count * need
            used.append((ways[k], count))
    return used


def places(used: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(bin, first rank, rank after the last, first sequence, slot) of every part of every combination in use."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for way, count in used:
        for slot, part in enumerate(way):
            start = taken.get(part, 0)
            out.append((part, start, start + count, sequence, slot))
            taken[part] = start + count
        sequence += count
    return out


def greedy(lengths: np.ndarray, window: int, grid: int) -> list[tuple[int, int, int, int, int]]:
    """(tail, start in it, length, sequence, offset) of tails packed by best fit; what fits nowhere is cut at the grid."""
    waiting = [(-int(n), k, 0) for k, n in enumerate(lengths)]
    heapq.heapify(waiting)
    open_: list[list[int]] = [[] for _ in range(window + 1)]  # sequences by free tokens
    free, out = np.zeros(window + 1, bool), []
    sequences = 0
    while waiting:
        size, tail, start = heapq.heappop(waiting)
        size = -size
        fits = np.flatnonzero(free[size:])
        if len(fits):
            room = size + int(fits[0])
            take = size
        else:
            rooms = np.flatnonzero(free[grid:])
            if len(rooms):
                room = grid + int(rooms[-1])
                take = room // grid * grid
                heapq.heappush(waiting, (-(size - take), tail, start + take))
            else:
                room, take = window, size
                open_[window].append(sequences)
                sequences += 1
        sequence = open_[room].pop()
        free[room] = bool(open_[room])
        out.append((tail, start, take, sequence, window - room))
        if room > take:
            open_[room - take].append(sequence)
            free[room - take] = True
    return out


def packed(docs: DataFrame, path: str, window: int = WINDOW, unit: int = UNIT, grid: int = GRID) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    texts = materialize(tokenized(docs, path, window, grid), "tokens")
    chunks = chunks_for(texts.count())
    tail = (F.col("n") % window).cast("int")
    tails = texts.withColumn("length", tail).filter("length > 0").withColumn("bin", F.ceil(F.col("length") / unit).cast("int"))
    histogram = np.zeros(window // unit, np.int64)
    for row in tails.groupBy("bin").count().collect():
        histogram[row["bin"] - 1] = row["count"]
    used = repeats(histogram)
    planned = sum(count for _, count in used)
    ranges = spark.createDataFrame(places(used), "bin int, first long, last long, base long, slot int")
    ranked = materialize(running(tails.select("row", "bin", "length").withColumn("one", F.lit(1)), "bin", "one", "row", chunks, "rank").drop("one"), "ranked")
    # At most three ranges for each combination in use, which are no more than the bins.
    sure = ranked.join(F.broadcast(ranges), "bin", "left").filter("rank >= first and rank < last").select("row", "length", (F.col("base") + F.col("rank") - F.col("first")).alias("sequence_id"), "slot")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sure = sure.select("row", F.lit(0).alias("at"), "length", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))

    covered = spark.createDataFrame([(b, int(sum(end - start for part, start, end, _, _ in places(used) if part == b))) for b in range(1, window // unit + 1)], "bin int, covered long")
    left = ranked.join(F.broadcast(covered), "bin").filter("rank >= covered").select("row", "length")
    groups = chunks_for(int(histogram.sum()) - sum(len(way) * count for way, count in used))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        found = np.array(greedy(rows["length"].to_numpy(), window, grid), np.int64).reshape(-1, 5)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[0], "row": rows["row"].to_numpy()[found[:, 0]], "at": found[:, 1], "length": found[:, 2], "own": found[:, 3], "offset": found[:, 4]})

    rest = left.withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(31)), F.lit(groups)).cast("int")).groupBy("chunk").applyInPandas(pack, "chunk int, row long, at int, length int, own long, offset long")
    rest = materialize(rest, "residual")
    sizes = rest.groupBy("chunk").agg((F.max("own") + 1).alias("sequences"))
    bases = sizes.select("chunk", (F.coalesce(F.sum("sequences").over(Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + planned).alias("base"))
    rest = rest.join(bases, "chunk").select("row", "at", "length", (F.col("base") + F.col("own")).alias("sequence_id"), "offset")

    # Tails, whole or cut: their checksum is looked up, not read from the ids again.
    parts = sure.unionAll(rest).join(tails.select("row", "doc_id", "n", F.col("length").alias("tail"), "tail_crc", "before_crcs", "after_crcs"), "row")
    index = lambda tokens: (tokens / grid).cast("int")
    end = F.col("at") + F.col("length")
    whole = (F.col("at") == 0) & (F.col("length") == F.col("tail"))
    crc = F.when(whole, F.col("tail_crc")).when(F.col("at") == 0, F.get("before_crcs", index(end) - 1)).otherwise(F.get(F.get("after_crcs", index(F.col("at")) - 1), F.ceil((end - F.col("at")) / grid).cast("int") - 1))
    parts = parts.select("doc_id", (F.col("n") - F.col("tail") + F.col("at")).cast("long").alias("start"), F.col("length").cast("long").alias("length"), crc.alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")

    last = rest.agg(F.coalesce(F.max("sequence_id") + 1, F.lit(planned)).alias("last")).first()["last"]
    full = texts.filter(F.size("window_crcs") > 0).withColumn("windows", F.size("window_crcs")).withColumn("all", F.lit(0))
    full = running(full, "all", "windows", "row", chunks, "first")
    full = full.select("doc_id", "n", "first", F.posexplode("window_crcs").alias("k", "crc"))
    full = full.select("doc_id", (F.col("k") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("first") + F.col("k") + last).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return parts.unionAll(full)
