"""Quality classifier: learned vectors of hashed words and character n-grams.

A text is the mean of the vectors of its words, word pairs and the byte
n-grams inside its words (white space marks a word's ends), each hashed to a
bucket; a softmax over two labels stands on the mean. Both are learned together
by stochastic gradient descent in numpy on at most ``TRAIN_ROWS`` labelled
rows, chosen by a hash of their id. The mean is linear, so a text's score needs
one number per bucket: vector times the difference of the softmax rows.

Defined cases: null and empty texts have no features and get the score of the
bias alone; without any labelled row, or with one label only, all scores are the
share of label 1 (0.5 without rows); a doc_id with several labels counts once
for each; a null label is no label; a repeated row is scored each time; only
``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pupilage.llm.texts import SPACE, Hashes, blocks, held_out, only, runs, sample_of

#: Documented bound of the sample that the classifier learns from.
TRAIN_ROWS = 3000
BUCKETS = 1 << 16
#: Bytes of text worked on at once.
LOT = 1 << 18
WIDTH = 8
GRAMS = (3, 4)
EPOCHS = 6
BATCH = 32
#: Small samples are gone through more often, until so many steps are made.
STEPS = 560
RATE = 3.0


@dataclass(frozen=True)
class QualityModel:
    """``weights[b]``: what one occurrence of bucket b adds to the mean logit of label 1; ``bias`` as a logit."""

    weights: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and positions of all features of a block, in order of their kind."""
    space = SPACE[data]
    hashes = Hashes(np.where(space, np.uint8(32), data))
    start, end = runs(~space, offsets)
    word = hashes.of(start, end)
    text = np.searchsorted(offsets, start, side="right")
    pair = np.flatnonzero(text[1:] == text[:-1])
    found = [(word, start), (word[pair] * np.uint64(31) + word[pair + 1] + np.uint64(1), start[pair])]
    # The same word or pair again is a feature of its own: repetition shows in a mean.
    same = pair[word[pair] == word[pair + 1]]
    found.append((np.full(len(same), 7, np.uint64), start[same]))
    gaps = np.concatenate([[0], np.cumsum(space)])
    edge = np.zeros(len(data) + 1, np.int64)
    edge[offsets[1:-1]] = 1
    edge = np.concatenate([[0], np.cumsum(edge)])
    for n in GRAMS:
        if len(data) < n:
            continue
        at = np.arange(len(data) - n + 1)
        inside = (gaps[at + n - 1] == gaps[at + 1]) & (edge[at + n] == edge[at + 1])
        at = at[inside]
        found.append((hashes.of(at, at + n) + np.uint64(n), at))
    bucket = np.concatenate([f[0] for f in found])
    return ((bucket ^ (bucket >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([f[1] for f in found])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: its distinct buckets and their shares."""
    for batch in batches:
        column = batch.column("text")
        texts: dict[int, list] = {}
        for rows, data, offsets in blocks(column, LOT):
            bucket, at = features(data, offsets)
            text = rows[np.searchsorted(offsets, at, side="right") - 1]
            pairs, count = np.unique(text * BUCKETS + bucket, return_counts=True)
            cut = np.searchsorted(pairs, np.arange(rows[0], rows[-1] + 2) * BUCKETS)
            for k, row in enumerate(range(int(rows[0]), int(rows[-1]) + 1)):
                texts.setdefault(row, []).append((pairs[cut[k] : cut[k + 1]] % BUCKETS, count[cut[k] : cut[k + 1]]))
        ids, shares = [], []
        for row in range(len(column)):
            parts = texts.get(row, [])
            bucket = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            count = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            ids.append(bucket.astype(np.int32))
            shares.append((count / max(1, count.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["label", "ids", "shares"])


def learn(ids: list[np.ndarray], shares: list[np.ndarray], label: np.ndarray, seed: int = 7) -> QualityModel:
    """Vectors and softmax by mini-batch gradient descent with a falling rate."""
    share = float(label.mean()) if len(label) else 0.5
    if not len(label) or not 0 < share < 1:
        certain = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(BUCKETS, np.float32), float(np.log(certain / (1 - certain))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.uniform(-0.5, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    target = np.stack([1 - label, label], 1).astype(np.float32)
    epochs = max(EPOCHS, STEPS // -(-len(label) // BATCH))
    steps, step = epochs * -(-len(label) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            some = order[at : at + BATCH]
            bucket = np.concatenate([ids[k] for k in some])
            weight = np.concatenate([shares[k] for k in some])
            text = np.repeat(np.arange(len(some)), [len(ids[k]) for k in some])
            mean = np.stack([np.bincount(text, weight * vectors[bucket, d], len(some)) for d in range(WIDTH)], 1).astype(np.float32)
            logit = mean @ out + bias
            chance = np.exp(logit - logit.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            error = (chance - target[some]) / len(some)
            back = error @ out.T
            out -= rate * (mean.T @ error)
            bias -= rate * 0.1 * error.sum(0)
            touched, where = np.unique(bucket, return_inverse=True)
            change = np.stack([np.bincount(where, weight * back[text, d], len(touched)) for d in range(WIDTH)], 1)
            vectors[touched] -= (rate * 8 * change).astype(np.float32)
    difference = out[:, 1] - out[:, 0]
    return QualityModel((vectors @ difference).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Learn from a bounded sample of the labelled rows that are not held out."""
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = sample_of(marks, "doc_id", train_rows)
    rows = only(docs, "doc_id", "text").join(chosen, "doc_id").select("label", "text")
    bags = rows.mapInArrow(_bags, "label int, ids array<int>, shares array<float>").toArrow()
    ids = [np.asarray(x.values, np.int64) for x in bags.column("ids")]
    shares = [np.asarray(x.values, np.float32) for x in bags.column("shares")]
    return learn(ids, shares, np.asarray(bags.column("label"), np.float32))


def _score(column: pa.Array, model: QualityModel) -> np.ndarray:
    total, count = np.zeros(len(column)), np.zeros(len(column))
    for rows, data, offsets in blocks(column, LOT):
        bucket, at = features(data, offsets)
        text = np.searchsorted(offsets, at, side="right") - 1
        total[rows] += np.bincount(text, model.weights[bucket], len(rows))
        count[rows] += np.bincount(text, minlength=len(rows))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + model.bias, -500, 500)))


def scores(docs: DataFrame, model: QualityModel, *keep: str) -> DataFrame:
    """The kept columns and ``score``, the chance of label 1, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(_score(batch.column("text"), shared.value))
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in keep), score], [*keep, "score"])

    source = only(docs, *dict.fromkeys((*keep, "text")))
    fields = [source.schema[name] for name in keep] + [T.StructField("score", T.DoubleType())]
    return source.mapInArrow(run, T.StructType(fields))


def accepted(docs: DataFrame, model: QualityModel, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score(batch.column(at), shared.value) >= least))

    return docs.mapInArrow(run, docs.schema)
