"""Stored students: weights as a long Parquet table plus one metadata row."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pupilage.config import ModelError, TaskSpec, canonical_json, sha256_hex
from pupilage.operators.features import FeatureDescriptor
from pupilage.operators.student import LinearModel

FORMAT = "pupilage.student"
FORMAT_VERSION = 1
WEIGHTS = "class int, index int, weight double"


@dataclass(frozen=True)
class Student:
    """A fitted student with everything needed to serve and re-check it.

    ``training`` holds small facts only; the content hashes of the training
    rows are a table of their own (``trained``), however long.
    """

    spec: TaskSpec
    features: FeatureDescriptor
    model: LinearModel
    training: dict[str, Any]
    trained: DataFrame | None = None
    evaluation: list[dict[str, Any]] = field(default_factory=list)

    def check(self) -> None:
        self.model.check()
        self.features.check(self.spec)
        if self.features.scheme != self.spec.student.features or self.model.classes != len(self.spec.labels):
            raise ModelError(f"{self.spec.name}: {self.model.classes} classes of {self.features.scheme} features, the task has {len(self.spec.labels)} labels and {self.spec.student.features} features")
        if self.model.dimensions != self.features.dimensions:
            raise ModelError(f"{self.spec.name}: weights for {self.model.dimensions} dimensions, features of {self.features.dimensions}")


def weight_table(model: LinearModel) -> pa.Table:
    """Long form; index -1 is the bias. Bounded by the task's own limits."""
    klass, index = np.indices(model.weights.shape)
    k = model.classes
    return pa.table(
        {
            "class": pa.array(np.concatenate([klass.ravel(), np.arange(k)]).astype(np.int32)),
            "index": pa.array(np.concatenate([index.ravel(), np.full(k, -1)]).astype(np.int32)),
            "weight": pa.array(np.concatenate([model.weights.ravel(), model.bias])),
        }
    )


def model_from_table(table: pa.Table) -> LinearModel:
    klass, index, weight = (table.column(c).to_numpy() for c in ("class", "index", "weight"))
    if not len(klass) or klass.min() < 0 or index.min() < -1:
        raise ModelError(f"weight table of {len(klass)} cells with a class or index below its range")
    weights = np.full((klass.max() + 1, max(index.max() + 1, 1)), np.nan)
    bias = np.full(klass.max() + 1, np.nan)
    cell = index >= 0
    if len(klass) != weights.size + bias.size:
        raise ModelError(f"weight table of {len(klass)} cells, {weights.shape[0]} classes of {weights.shape[1]} dimensions have {weights.size + bias.size}")
    weights[klass[cell], index[cell]] = weight[cell]
    bias[klass[~cell]] = weight[~cell]
    return LinearModel(weights, bias)


def _seal(metadata: dict[str, Any], model: LinearModel) -> str:
    weights = sha256_hex(model.weights.astype("<f8").tobytes().hex() + model.bias.astype("<f8").tobytes().hex())
    return sha256_hex(canonical_json(metadata) + weights)


def save_model(student: Student, spark: SparkSession, path: str) -> None:
    student.check()
    metadata = {
        "format": FORMAT,
        "format_version": FORMAT_VERSION,
        "spec": json.loads(student.spec.to_json()),
        "spec_hash": student.spec.spec_hash,
        "features": asdict(student.features),
        "training": student.training,
        "evaluation": student.evaluation,
    }
    document = canonical_json(metadata)
    spark.createDataFrame(weight_table(student.model)).write.parquet(f"{path}/weights")
    if student.trained is not None:
        student.trained.select("content_hash").distinct().write.parquet(f"{path}/trained")
    # Written last: a student without its metadata row is not a student.
    seal = _seal(json.loads(document), student.model)
    spark.createDataFrame([(document, seal)], "document string, integrity string").coalesce(1).write.parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> Student:
    """Read, then verify the format, integrity, spec hash, shape and values."""
    row = spark.read.schema("document string, integrity string").parquet(f"{path}/metadata").first()
    if row is None:
        raise ModelError(f"{path}/metadata has 0 rows")
    metadata = json.loads(row["document"])
    if metadata.get("format") != FORMAT or metadata.get("format_version") != FORMAT_VERSION:
        raise ModelError(f"{path}: {metadata.get('format')} {metadata.get('format_version')}, this package reads {FORMAT} {FORMAT_VERSION}")
    model = model_from_table(spark.read.schema(WEIGHTS).parquet(f"{path}/weights").toArrow())
    if (seal := _seal(metadata, model)) != row["integrity"]:
        raise ModelError(f"{path}: integrity {row['integrity']} is stored, the contents give {seal}")
    spec = TaskSpec.from_dict(metadata["spec"])
    if spec.spec_hash != metadata["spec_hash"]:
        raise ModelError(f"{path}: task hash {metadata['spec_hash']} is stored, the task gives {spec.spec_hash}")
    raw = metadata["features"]
    stats = {k: tuple(raw[k]) if raw[k] is not None else None for k in ("mean", "sd")}
    descriptor = FeatureDescriptor(**{**raw, **stats})
    trained = None
    if metadata["training"].get("examples"):
        trained = spark.read.schema("content_hash string").parquet(f"{path}/trained")
    student = Student(spec, descriptor, model, metadata["training"], trained, metadata["evaluation"])
    student.check()
    return student


def check_compatible(student: Student, fingerprint: str | None, cache: DataFrame | None = None) -> None:
    """Refuse dense features from another source than the student's own."""
    if student.features.scheme == "hashed":
        return
    if fingerprint != student.features.source_fingerprint:
        raise ModelError(f"{student.spec.name} was trained on source {student.features.source_fingerprint}, not {fingerprint}")
    if cache is not None and "source_fingerprint" in cache.columns:
        foreign = cache.filter(~F.col("source_fingerprint").eqNullSafe(fingerprint)).select("content_hash").first()
        if foreign is not None:
            raise ModelError(f"content {foreign['content_hash']} is represented by another source than {fingerprint}")


def sources_for(representations: DataFrame, students: dict[str, Student]) -> DataFrame:
    """Per source of a representation table its rows and the students that may read them, names in order.

    Hashed students read no representation, so any source, and none, fits them.
    ``students`` are at most ``MAX_STUDENTS`` and go out to the sources.
    """
    spark = representations.sparkSession
    known = [(name, s.features.scheme == "hashed", s.features.source_fingerprint) for name, s in sorted(students.items())]
    table = F.broadcast(spark.createDataFrame(known, "student string, any_source boolean, own string"))
    counted = representations.groupBy("source_fingerprint").agg(F.count(F.lit(1)).alias("rows"))
    met = counted.join(table, F.col("any_source") | (F.col("own") == F.col("source_fingerprint")), "left")
    return met.groupBy("source_fingerprint", "rows").agg(F.array_join(F.array_sort(F.collect_list("student")), ",").alias("students"))
