"""Score tables with one or many students."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pupilage.config import MAX_STUDENTS, DataError, ModelError
from pupilage.functions.probability import index_of, served_label
from pupilage.operators.features import attach_features, dense_vector, feature_vector, with_features
from pupilage.operators.identity import with_content_hash
from pupilage.operators.jointfit import MAX_PARAMETERS
from pupilage.operators.student import chosen_probabilities, many_probabilities, prediction_rows, with_probabilities
from pupilage.operators.validation import settle, validate_input, with_parsed_input
from pupilage.sources.models import Student, check_compatible
from pupilage.sources.storage import materialize


def predict(rows: DataFrame, student: Student, cache: DataFrame | None = None, fingerprint: str | None = None, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Predictions of rows with a typed ``input``; no shuffle for hashed students."""
    check_compatible(student, fingerprint, cache)
    if cache is not None and student.features.scheme != "hashed":
        rows = with_content_hash(rows, student.spec.fields)
    scored = with_probabilities(with_features(rows, student.features, student.spec, cache), student.model)
    return prediction_rows(scored, student.spec, keep)


def predict_json(requests: DataFrame, student: Student, on_error: str = "fail") -> DataFrame:
    """Predictions of (seq, id, input) rows whose input is JSON text."""
    fields = student.spec.fields
    clean = settle(validate_input(requests, fields), on_error, "requests")
    return predict(with_parsed_input(clean, fields), student)


def registry(students: list[Student]) -> dict[str, Student]:
    if len(students) > MAX_STUDENTS:
        raise ModelError(f"more than {MAX_STUDENTS} students")
    named = {s.spec.name: s for s in students}
    if len(named) != len(students):
        raise ModelError("student names must be unique")
    return named


def student_list(students: dict[str, Student], spark) -> DataFrame:
    """What is served: name, version, teacher and feature scheme."""
    rows = [(n, s.spec.version, s.training.get("teacher"), s.features.scheme) for n, s in sorted(students.items())]
    return spark.createDataFrame(rows, "name string, version string, teacher string, features string")


def layout_of(student: Student) -> tuple:
    """Students with equal layouts read the same vector; dense ones only if their logits are of the same options."""
    options = None if student.features.scheme == "hashed" else tuple(student.spec.options)
    return student.features, student.spec.fields, options


def shared_passes(students: dict[str, Student]) -> list[list[Student]]:
    """Students that read the same features score in one pass over the rows,
    as long as their weights together stay within the broadcast bound."""
    passes: list[list[Student]] = []
    sizes: list[int] = []
    for _, student in sorted(students.items()):
        kind = layout_of(student)
        size = student.model.weights.size
        for i, group in enumerate(passes):
            if layout_of(group[0]) == kind and sizes[i] + size <= MAX_PARAMETERS:
                group.append(student)
                sizes[i] += size
                break
        else:
            passes.append([student])
            sizes.append(size)
    return passes


def with_representations(rows: DataFrame, students: dict[str, Student], representations: DataFrame, fingerprint: str | None) -> DataFrame:
    """Rows with the representation of their content, looked up once for all dense students and written once."""
    dense = [s for _, s in sorted(students.items()) if s.features.scheme != "hashed"]
    for student in dense:
        check_compatible(student, fingerprint)
    check_compatible(dense[0], fingerprint, representations)
    if len({s.spec.fields for s in dense}) > 1:
        raise ModelError("dense students that are served together read the same input fields, as a representation belongs to a content")
    known = representations.select("content_hash", "logits", "options", "pooled")
    hashed = with_content_hash(rows, dense[0].spec.fields)
    return materialize(attach_features(hashed, known), "represented")


def scored_features(rows: DataFrame, student: Student) -> DataFrame:
    """Adds ``features`` in the student's own layout: which labels its logits are of, how many dense values it reads, where its words begin."""
    spec = student.spec
    if student.features.scheme != "hashed":
        rows = rows.withColumn("dense", dense_vector(spec))
    return rows.withColumn("features", feature_vector(student.features, spec))


def score_many(rows: DataFrame, students: dict[str, Student], name_col: str | None = None, on_unknown: str = "fail",
               representations: DataFrame | None = None, fingerprint: str | None = None) -> DataFrame:
    """Score rows with every student, or with the one each row names.

    ``on_unknown`` says what happens to rows naming nobody: fail or drop. Dense
    students need ``representations`` (content_hash, logits, options, pooled) of one
    source and its ``fingerprint``; a row's representation is looked up once,
    whatever the layouts of the students that read it.
    """
    if not students:
        raise ModelError("no students")
    if name_col is not None and on_unknown == "fail":
        unknown = rows.filter(~F.coalesce(F.col(name_col).isin(*students), F.lit(False))).select(name_col).first()
        if unknown is not None:
            raise DataError(f"unknown classifier {unknown[name_col]}")
    if any(s.features.scheme != "hashed" for s in students.values()):
        if representations is None:
            raise ModelError("dense students need representations")
        kept = ["id", "input", *([] if name_col is None else [name_col])]
        rows = with_representations(rows.select(*kept), students, representations, fingerprint)
    spark = rows.sparkSession
    parts = []
    for group in shared_passes(students):
        names = [s.spec.name for s in group]
        models = [s.model for s in group]
        mine = rows if name_col is None else rows.filter(F.col(name_col).isin(*names))
        featured = scored_features(mine, group[0]).select("id", "features", *([] if name_col is None else [name_col]))
        if name_col is None:
            scored = featured.select("id", F.posexplode(many_probabilities(models, spark)).alias("which", "p"))
        else:
            which = featured.withColumn("which", index_of(names, F.col(name_col)))
            scored = which.select("id", "which", chosen_probabilities(models, spark).alias("p"))
        served = F.lit(None)
        for position, student in reversed(list(enumerate(group))):
            spec = student.spec
            answer = F.struct(F.lit(spec.name).alias("classifier"), F.lit(spec.version).alias("version"), served_label(F.col("p"), spec).alias("s"))
            served = answer if position == len(group) - 1 else F.when(F.col("which") == position, answer).otherwise(served)
        parts.append(scored.select("id", served.alias("served")).select("id", "served.classifier", "served.version", "served.s.*"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
