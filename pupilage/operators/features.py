"""Feature tables: n-gram tokens, dense representations, statistics, schemes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pupilage.config import DataError, InputField, ModelError, TaskSpec, TrainingError
from pupilage.functions.ngrams import hashed_vector, hybrid_vector, token_bucket, word_columns
from pupilage.functions.probability import label_order
from pupilage.operators.keyed import lookup

SD_FLOOR = 1e-6
REPRESENTATION = "content_hash string, logits array<double>, options array<string>, pooled array<double>, source_fingerprint string"


@dataclass(frozen=True)
class FeatureDescriptor:
    """How a stored student turns a row into its vector."""

    scheme: str
    dimensions: int
    mean: tuple[float, ...] | None = None
    sd: tuple[float, ...] | None = None
    question_hash: str | None = None
    source_fingerprint: str | None = None

    @property
    def dense(self) -> int:
        return len(self.mean) if self.mean else 0

    def check(self, spec: TaskSpec) -> None:
        """Statistics as long as the scheme's dense part, made for this question."""
        sizes = {len(self.mean or ()), len(self.sd or ())}
        if sizes != {dense_size(self.scheme, len(spec.labels), self.dense)}:
            raise ModelError(f"a {self.scheme} student has statistics of {sorted(sizes)} values")
        if self.scheme == "hashed":
            wanted: tuple = (None, None)
        else:
            wanted = (spec.question_hash, self.source_fingerprint or "a source fingerprint")
            # Hybrid students put hashed words behind the dense part, the others have nothing there.
            if (self.dimensions > self.dense) != (self.scheme == "hybrid") or self.dense < len(spec.labels):
                raise ModelError(f"{self.scheme}: {self.dimensions} dimensions do not go with {self.dense} dense values")
            numbers = np.array([self.mean, self.sd])
            if not np.isfinite(numbers).all() or numbers[1].min() < SD_FLOOR:
                raise ModelError(f"{self.scheme}: a mean or deviation is not usable")
        if (self.question_hash, self.source_fingerprint) != wanted:
            raise ModelError(f"{self.scheme}: another question or source than expected")


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs, joined by a space."""
    n = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def _prefixed(prefix: str):
    return lambda word: F.concat(F.lit(prefix), word)


def token_array(fields: tuple[InputField, ...], source: str = "input") -> Column:
    """Per field: words, ``field=word`` and bigrams; absent fields add none."""
    empty = F.array().cast("array<string>")
    parts = []
    for field, tokens in zip(fields, word_columns(fields, source)):
        named = F.transform(tokens, _prefixed(f"{field.name}="))
        parts += [F.coalesce(p, empty) for p in (tokens, named, bigrams(tokens))]
    return F.concat(*parts)


def ngram_tokens(df: DataFrame, fields: tuple[InputField, ...], keep: list[str]) -> DataFrame:
    """One row per token occurrence."""
    return df.select(*keep, F.explode(token_array(fields)).alias("token"))


def term_counts(df: DataFrame, fields: tuple[InputField, ...], dimensions: int, key: str = "id") -> DataFrame:
    """Long table (key, bucket, count), for audit and for SQL users.

    Training uses ``hashed_vector`` instead, which needs no shuffle.
    """
    bucketed = ngram_tokens(df, fields, [key]).select(key, token_bucket(F.col("token"), dimensions).alias("bucket"))
    return bucketed.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("count"))


def l2_normalize(counts: DataFrame, key: str = "id") -> DataFrame:
    """``log1p(count)`` over the row's L2 norm; a row has at most as many
    buckets as there are dimensions."""
    raw = counts.withColumn("raw", F.log1p(F.col("count").cast("double")))
    norm = F.greatest(F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key))), F.lit(1e-12))
    return raw.select(key, "bucket", (F.col("raw") / norm).alias("value"))


def distinct_content(rows: DataFrame) -> DataFrame:
    """One row per content hash, so each text is represented once."""
    return rows.groupBy("content_hash").agg(F.min_by("input", "seq").alias("input"))


def representations_from(contents: DataFrame, scorer, fingerprint: str) -> DataFrame:
    """Run a user's batch scorer once per distinct content.

    ``scorer`` maps an iterator of pandas frames (content_hash, input) to
    frames with content_hash, logits, options and pooled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in scorer(batches):
            yield frame.assign(source_fingerprint=fingerprint)

    return contents.select("content_hash", "input").mapInPandas(run, REPRESENTATION)


def dense_vector(spec: TaskSpec) -> Column:
    """Of columns content_hash, logits, options and pooled: label-ordered logits, then the pooled vector.

    A row whose options or values do not fit the task stops the job; one without
    a representation has no vector.
    """
    ordered = label_order(F.col("logits"), F.col("options"), spec)
    pooled_ok = F.forall("pooled", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    problem = F.raise_error(F.concat(F.lit("representation does not fit the task: content "), F.col("content_hash")))
    fits = F.when(ordered.isNotNull() & pooled_ok, F.concat(ordered, F.col("pooled"))).otherwise(problem.cast("array<double>"))
    return F.when(F.col("logits").isNotNull() | F.col("options").isNotNull() | F.col("pooled").isNotNull(), fits)


def dense_features(representations: DataFrame, spec: TaskSpec) -> DataFrame:
    """(content_hash, dense), as ``dense_vector``; here every row must fit."""
    missing = F.raise_error(F.concat(F.lit("representation does not fit the task: content "), F.col("content_hash"))).cast("array<double>")
    return representations.select("content_hash", F.coalesce(dense_vector(spec), missing).alias("dense"))


def attach_features(rows: DataFrame, cache: DataFrame, distinct: bool = False) -> DataFrame:
    """Look up cached features by content hash.

    Hot contents stay balanced; rows known to have ``distinct`` contents need
    no such care and take a plain join.
    """
    if distinct:
        return rows.join(cache, "content_hash", "left").select(*rows.columns, *[c for c in cache.columns if c != "content_hash"])
    return lookup(rows, cache, "content_hash", "id")


def feature_statistics(df: DataFrame, column: str = "dense") -> DataFrame:
    """Per dimension mean and population sd (at least 1e-6).

    The exploded rows collapse to one group per dimension before any shuffle.
    """
    cells = df.select(F.posexplode(column).alias("dimension", "x"))
    return cells.groupBy("dimension").agg(
        F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(SD_FLOOR)).alias("sd")
    )


def collect_statistics(df: DataFrame, column: str, size: int) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Mean and sd vectors on the driver: two numbers per dimension."""
    table = feature_statistics(df.select(F.slice(column, 1, size).alias(column)), column).orderBy("dimension").toPandas()
    if len(table) != size:
        raise TrainingError(f"expected {size} dense dimensions, found {len(table)}")
    return tuple(table["mean"].tolist()), tuple(table["sd"].tolist())


def standardize(values: Column, mean: tuple[float, ...], sd: tuple[float, ...]) -> Column:
    """``(x - mean) / sd`` on the leading ``len(mean)`` values."""
    size = len(mean)
    means, sds = F.lit(list(map(float, mean))), F.lit(list(map(float, sd)))
    centered = F.zip_with(F.slice(values, 1, size), means, lambda x, m: x - m)
    return F.zip_with(centered, sds, lambda x, s: x / s)


def dense_size(scheme: str, labels: int, available: int) -> int:
    """How many leading dense values a scheme uses."""
    return {"hashed": 0, "logits": labels}.get(scheme, available)


def feature_vector(descriptor: FeatureDescriptor, spec: TaskSpec) -> Column:
    """The student's vector of a row with ``input`` and, for dense schemes, ``dense``."""
    if descriptor.scheme == "hashed":
        return hashed_vector(spec.fields, descriptor.dimensions)
    missing = F.raise_error(F.concat(F.lit("no representation for content "), F.col("content_hash"))).cast("array<double>")
    scaled = standardize(F.coalesce("dense", missing), descriptor.mean, descriptor.sd)
    if descriptor.scheme != "hybrid":
        return array_to_vector(scaled)
    return hybrid_vector(scaled, descriptor.dense, spec.fields, descriptor.dimensions - descriptor.dense)


def with_features(rows: DataFrame, descriptor: FeatureDescriptor, spec: TaskSpec, cache: DataFrame | None = None) -> DataFrame:
    """Adds ``features``; dense schemes need the representation cache."""
    if descriptor.scheme != "hashed":
        if cache is None:
            raise DataError(f"{descriptor.scheme} features need representations")
        rows = attach_features(rows, cache)
    return rows.withColumn("features", feature_vector(descriptor, spec))


def describe_features(train: DataFrame, spec: TaskSpec, cache: DataFrame | None, fingerprint: str | None) -> FeatureDescriptor:
    """Descriptor for the task's scheme, with statistics of the training rows,
    whose contents are distinct."""
    scheme = spec.student.features
    if scheme == "hashed":
        return FeatureDescriptor("hashed", spec.student.hash_dimensions)
    if cache is None or not fingerprint:
        raise TrainingError(f"{scheme} features need representations and their fingerprint")
    rows = attach_features(train.select("id", "content_hash"), cache, distinct=True)
    widest = cache.agg(F.max(F.size("dense")).alias("n")).first()["n"]
    size = dense_size(scheme, len(spec.labels), widest or 0)
    mean, sd = collect_statistics(rows, "dense", size)
    total = size + (spec.student.hash_dimensions if scheme == "hybrid" else 0)
    return FeatureDescriptor(scheme, total, mean, sd, spec.question_hash, fingerprint)
