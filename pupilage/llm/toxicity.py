"""Toxicity by multiple-instance learning: a text is toxic if any sentence is.

A sentence's score is the logistic of the summed weights of its distinct words
(runs of letters, lower case, and their beginnings, hashed). What a sentence without weight would
get is no evidence: a text has that chance once, whatever its length, and a
sentence's odds over it count. A text's score is the noisy-or of these:
``1 - (1 - base) * product((1 - score) / (1 - base))``. Weights are learned from labels of whole
texts alone, by adaptive gradient steps in numpy, on at most ``TRAIN_ROWS``
labelled rows chosen by a hash of their id; no sentence has a label.
``sentences`` then gives the sentences that make a text toxic.

Defined cases: null and empty texts have no sentence and get the score of one
sentence without words; without labelled rows, or with one label only, all
scores are the share of label 1; a null label is no label; a repeated row is
scored each time. Long texts are cut at sentence ends; a sentence longer than a
block is read in pieces, each a sentence of its own. Only ``doc_id`` and ``text`` are read, so other columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pupilage.llm.texts import Hashes, blocks, held_out, only, runs, sample_of

#: Documented bound of the sample that the model learns from.
TRAIN_ROWS = 6000
BUCKETS = 1 << 18
#: Bytes of text worked on at once.
LOT = 1 << 18
EPOCHS = 40
BATCH = 256
#: Small samples are gone through more often, until so many steps are made.
STEPS = 900
RATE = 0.1
DECAY = 2e-6
#: Chance of a text without any known word, as a logit.
START = -8.0
#: Bytes of word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True
STOP = np.zeros(256, bool)
STOP[[10, 33, 46, 63]] = True


@dataclass(frozen=True)
class ToxicModel:
    weights: np.ndarray
    bias: float
    #: Score of every text where nothing could be learned.
    constant: float | None = None


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (sentence, bucket) pairs of a block, sorted; a sentence is named by where its first letter run may start."""
    low = LOWER[data]
    hashes = Hashes(low)
    start, end = runs(LETTER[low], offsets)
    # Inflected words share a beginning: beginnings count as words too, each length on its own.
    kinds = [(hashes.of(start, end), start)]
    for n in BEGINNINGS:
        long = end - start > n
        kinds.append((hashes.of(start[long], start[long] + n) + np.uint64(n), start[long]))
    bucket = (np.concatenate([k[0] for k in kinds]) % np.uint64(BUCKETS)).astype(np.int64)
    start = np.concatenate([k[1] for k in kinds])
    cuts = np.union1d(np.flatnonzero(STOP[data]) + 1, offsets)
    sentence = cuts[np.searchsorted(cuts, start, side="right") - 1] if len(start) else start
    pairs = np.unique(sentence * BUCKETS + bucket)
    return pairs // BUCKETS, pairs % BUCKETS


def _instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: its buckets, and how many of them each sentence has."""
    for batch in batches:
        column = batch.column("text")
        found: list[list] = [[] for _ in range(len(column))]
        for rows, data, offsets in blocks(column, LOT, STOP):
            at, bucket = words(data, offsets)
            cut = np.searchsorted(at, offsets)
            for k, row in enumerate(rows):
                found[row].append((at[cut[k] : cut[k + 1]], bucket[cut[k] : cut[k + 1]]))
        ids, sizes = [], []
        for parts in found:
            ids.append(np.concatenate([b for _, b in parts] or [np.zeros(0, np.int64)]).astype(np.int32))
            sizes.append(np.concatenate([np.unique(a, return_counts=True)[1] for a, _ in parts] or [np.zeros(0, np.int64)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(ids, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], ["label", "ids", "sizes"])


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    end = np.cumsum(sizes)
    return total[end] - total[end - sizes]


def learn(ids: list[np.ndarray], sizes: list[np.ndarray], label: np.ndarray, seed: int = 11) -> ToxicModel:
    """Minimise the noisy-or log loss of texts.

    Words only add evidence (no weight falls below zero), so a long sentence
    cannot hide a word; ``DECAY`` pulls weights that explain little to zero.
    """
    share = float(label.mean()) if len(label) else 0.5
    if not len(label) or not 0 < share < 1:
        return ToxicModel(np.zeros(BUCKETS, np.float32), START, share)
    rng = np.random.default_rng(seed)
    weights, first, second = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias, step = START, 0
    epochs = max(EPOCHS, STEPS // -(-len(label) // BATCH))
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            step += 1
            some = order[at : at + BATCH]
            bucket = np.concatenate([ids[k] for k in some])
            size = np.concatenate([sizes[k] for k in some])
            texts = np.array([len(sizes[k]) for k in some])
            score = np.clip(_sums(weights[bucket], size) + bias, -30, 30)
            chance = 1 / (1 + np.exp(-score))
            base = np.log1p(np.exp(bias))
            miss = np.clip(_sums(base - np.log1p(np.exp(score)), texts) - base, -50, -base)
            toxic = -np.expm1(miss)
            # Of the log loss by a sentence's logit: its chance for a clean text, minus its odds share for a toxic one.
            factor = np.where(label[some] > 0, -(1 - toxic) / toxic, 1.0) / len(some)
            slope = np.repeat(factor, texts) * chance
            gradient = np.bincount(bucket, np.repeat(slope, size), BUCKETS) + DECAY * np.sign(weights)
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient * gradient - second)
            weights -= RATE * (1 - step / (epochs * -(-len(order) // BATCH) + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
            np.maximum(weights, 0, out=weights)
    return ToxicModel(weights.astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicModel:
    """Learn from a bounded sample of the labelled rows that are not held out."""
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = sample_of(marks, "doc_id", train_rows)
    rows = only(docs, "doc_id", "text").join(chosen, "doc_id").select("label", "text")
    bags = rows.mapInArrow(_instances, "label int, ids array<int>, sizes array<int>").toArrow()
    return learn([np.asarray(x.values, np.int64) for x in bags.column("ids")], [np.asarray(x.values, np.int64) for x in bags.column("sizes")], np.asarray(bags.column("label"), np.float64))


def _sentence_logits(data: np.ndarray, offsets: np.ndarray, model: ToxicModel) -> tuple[np.ndarray, np.ndarray]:
    at, bucket = words(data, offsets)
    if not len(at):
        return at, np.zeros(0)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(model.weights[bucket].astype(np.float64), first) + model.bias


def scores(docs: DataFrame, model: ToxicModel, *keep: str) -> DataFrame:
    """The kept columns and ``score``, the noisy-or of each text's sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column("text")
            miss, base = np.zeros(len(column)), np.log1p(np.exp(model.bias))
            for rows, data, offsets in blocks(column, LOT, STOP):
                at, logit = _sentence_logits(data, offsets, model)
                text = np.searchsorted(offsets, at, side="right") - 1
                miss[rows] += np.bincount(text, base - np.log1p(np.exp(np.clip(logit, -500, 500))), len(rows))
            score = -np.expm1(miss - base)
            score = np.full(len(column), model.constant) if model.constant is not None else np.clip(score, 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in keep), pa.array(score)], [*keep, "score"])

    source = only(docs, *dict.fromkeys((*keep, "text")))
    fields = [source.schema[name] for name in keep] + [T.StructField("score", T.DoubleType())]
    return source.mapInArrow(run, T.StructType(fields))


def sentences(docs: DataFrame, model: ToxicModel, least: float = 0.5) -> DataFrame:
    """Offending sentences: doc_id, start and length in UTF-8 bytes, score, sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column, out, before = batch.column("text"), [], {}
            for rows, data, offsets in blocks(column, LOT, STOP):
                at, logit = _sentence_logits(data, offsets, model)
                cuts = np.union1d(np.flatnonzero(STOP[data]) + 1, offsets)
                for start, score in zip(at, 1 / (1 + np.exp(-np.clip(logit, -500, 500)))):
                    if score >= least:
                        k = int(np.searchsorted(offsets, start, side="right")) - 1
                        end = int(cuts[np.searchsorted(cuts, start, side="right")])
                        row = int(rows[k])
                        out.append((row, int(start - offsets[k]) + before.get(row, 0), end - int(start), float(score), data[start:end].tobytes().decode("utf-8", "replace")))
                before[int(rows[-1])] = before.get(int(rows[-1]), 0) + int(offsets[-1] - offsets[-2])
            picked = batch.column("doc_id").take(pa.array([o[0] for o in out], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [picked, *(pa.array([o[k] for o in out], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.string())))],
                ["doc_id", "start", "length", "score", "sentence"],
            )

    source = only(docs, "doc_id", "text")
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *T.StructType.fromDDL("start long, length long, score double, sentence string").fields]))
