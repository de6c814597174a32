"""Small result tables and their written form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed order of the rows of an evaluation.
SCOPES = (
    ("Teacher labels", "student_argmax"),
    ("Teacher labels", "student_served"),
    ("Teacher labels", "majority"),
    ("Human gold", "student_served"),
    ("Human gold", "student_argmax"),
    ("Human gold", "teacher_raw"),
    ("Human gold", "teacher_gated"),
    ("Human gold", "zero_shot"),
    ("Human gold", "majority"),
)


def report_rows(metrics_table: DataFrame) -> DataFrame:
    """Metrics by position, as (position, reference, model, n, accuracy, macro_f1)."""
    names = F.array(*[F.struct(F.lit(r).alias("reference"), F.lit(m).alias("model")) for r, m in SCOPES])
    named = metrics_table.withColumn("s", F.element_at(names, F.col("position") + 1))
    return named.select("position", "s.reference", "s.model", F.col("examples").alias("n"), "accuracy", "macro_f1")


def write_report(report: DataFrame, path: str) -> None:
    """At most nine rows, one file, in position order."""
    report.orderBy("position").coalesce(1).write.json(path)


def report_document(report: DataFrame, per_label: DataFrame, confusion: DataFrame, labels: list[str], counters: dict[str, int], facts: dict[str, float | str | None]) -> DataFrame:
    """All of an evaluation as rows (section, model, name, value, text).

    Sections: ``metrics`` of each model, ``labels`` (precision, recall, F1 and
    support of each label), ``confusion`` cells, ``split`` counters, and a
    ``summary`` of single facts; numbers are values, the rest is text.
    """
    spark = report.sparkSession
    models = F.array(*[F.lit(f"{r}/{m}") for r, m in SCOPES])
    names = F.array(*[F.lit(n) for n in labels])

    def rows(df: DataFrame, section: str, cells: list[tuple[Column, str]]) -> DataFrame:
        pairs = F.array(*[F.struct(name.alias("name"), F.col(value).cast("double").alias("value")) for name, value in cells])
        model = F.get(models, F.col("position").cast("int")).alias("model")
        return df.select(F.lit(section).alias("section"), model, F.explode(pairs).alias("c")).select("section", "model", "c.name", "c.value", F.lit(None).cast("string").alias("text"))

    label = F.get(names, F.col("label_index").cast("int"))
    cell = F.concat(F.get(names, F.col("reference").cast("int")), F.lit(" -> "), F.get(names, F.col("predicted").cast("int")))
    found = rows(report, "metrics", [(F.lit(n), n) for n in ("n", "accuracy", "macro_f1")])
    found = found.unionAll(rows(per_label, "labels", [(F.concat(label, F.lit(f".{n}")), n) for n in ("precision", "recall", "f1", "support")]))
    found = found.unionAll(rows(confusion, "confusion", [(cell, "n")]))
    known = [("split", None, name, float(value), None) for name, value in counters.items()]
    known += [("summary", None, name, None if isinstance(v, str) or v is None else float(v), v if isinstance(v, str) else None) for name, v in facts.items()]
    return found.unionAll(spark.createDataFrame(known, found.schema))


def write_report_document(document: DataFrame, path: str) -> None:
    """One file of JSON lines, in order; nine models and 32 labels are the most there can be."""
    document.orderBy("section", "model", "name").coalesce(1).write.json(path)


def write_predictions(predictions: DataFrame, path: str, file_format: str = "parquet") -> None:
    predictions.write.format(file_format).save(path)
