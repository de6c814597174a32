"""Datasets as JSON lines: bounded, strict reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pupilage.config import DataError, TaskSpec
from pupilage.operators.validation import (
    input_violations,
    parse_input,
    settle,
    undeclared_keys,
    validate_rows,
)
from pupilage.sources.lines import declared_files, opened, placed_lines
from pupilage.sources.storage import materialize

ROW_KEYS = ["id", "input", "group", "gold"]


def ordered_lines(spark: SparkSession, path: str | list[str], max_line_bytes: int | None = None) -> DataFrame:
    """(seq, line, bytes) of all lines; ``seq`` counts files as declared, then position.

    A list of paths declares the order of its files; the files of a folder come by
    age, then name. The texts are read once, into a table of lines with the number
    of their part; the parts (one small row each) are summed in their order. Of a
    line above ``max_line_bytes`` only the beginning is kept.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = declared_files(spark, paths)
    if not files:
        return spark.createDataFrame([], "seq bigint, line string, bytes bigint")
    if not opened(files):
        return _engine_lines(spark, [uri for uri, _ in files])
    lines = materialize(placed_lines(spark, files, max_line_bytes).select("part", "at", "bytes", "line"), "lines")
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("_base"))
    return lines.join(bases, "part").select((F.col("at") + F.col("_base")).alias("seq"), "line", "bytes")


def _engine_lines(spark: SparkSession, uris: list[str]) -> DataFrame:
    """The same by the engine's own text reader, for packed files and stores that only it opens; it reads lines whole."""
    part = ["_order", "_block"]
    order = F.array_position(F.array(*[F.lit(uri) for uri in uris]), F.col("_file"))
    lines = spark.read.text(uris).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("line"),
    ).withColumn("_order", order)
    parts = lines.groupBy(*part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = F.sum("_lines").over(W.orderBy(*part).rowsBetween(W.unboundedPreceding, -1))
    bases = parts.select(*part, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base"))
    return lines.join(bases, part).select((F.col("_at") + F.col("_base")).alias("seq"), "line", F.octet_length("line").cast("bigint").alias("bytes"))


def read_lines(spark: SparkSession, path: str | list[str], max_line_bytes: int | None) -> DataFrame:
    """(seq, line, violations) of the non-blank lines, in the order of ``ordered_lines``."""
    full = ordered_lines(spark, path, max_line_bytes).filter(~F.col("line").rlike(r"^[ \t\r]*$"))
    if max_line_bytes is None:
        return full.withColumn("violations", F.array().cast("array<string>")).drop("bytes")
    too_long = F.when(F.col("bytes") > max_line_bytes, F.lit(f"line exceeds {max_line_bytes} bytes"))
    return full.withColumn("violations", F.array_compact(F.array(too_long))).drop("bytes")


def parse_rows(lines: DataFrame, spec: TaskSpec) -> DataFrame:
    """Dataset rows with all their violations; nothing is dropped here."""
    document = F.try_parse_json("line")
    unknown = undeclared_keys(F.col("line"), ROW_KEYS)

    def text(key: str):
        return F.try_variant_get("_doc", f"$.{key}", "string")

    def wrong_type(key: str):
        kind = F.schema_of_variant(F.variant_get("_doc", f"$.{key}", "variant"))
        return F.when(kind.isNotNull() & ~kind.isin("STRING", "VOID"), F.lit(f"{key} must be of type string"))

    opened = (
        lines.withColumn("_doc", document)
        .withColumn("_input", F.variant_get("_doc", "$.input", "variant"))
        .withColumn("_input_text", F.to_json("_input"))
    )
    shaped = opened.select(
        "seq",
        text("id").alias("id"),
        parse_input(F.col("_input"), spec.fields).alias("input"),
        text("group").alias("group"),
        text("gold").alias("gold"),
        F.concat(
            "violations",
            F.array_compact(
                F.array(
                    F.when(F.col("_doc").isNull() & (F.size("violations") == 0), F.lit("malformed JSON")),
                    F.when(F.size(unknown) > 0, F.concat(F.lit("unknown field(s) "), F.array_join(unknown, ", "))),
                    *[wrong_type(k) for k in ("id", "group", "gold")],
                )
            ),
            F.when(F.col("_doc").isNull(), F.array().cast("array<string>")).otherwise(
                input_violations(F.col("_input"), F.col("_input_text"), spec.fields)
            ),
        ).alias("_found"),
    )
    checked = validate_rows(shaped, spec)
    return checked.withColumn("violations", F.concat("_found", "violations")).drop("_found")


def read_dataset(spark: SparkSession, path: str | list[str], spec: TaskSpec, on_error: str = "fail") -> DataFrame:
    """Validated rows (seq, id, input, group, gold).

    The lines are parsed once into a columnar table in the shared folder; the
    checks and all later passes read that.
    """
    parsed = parse_rows(read_lines(spark, path, spec.dataset.max_line_bytes), spec)
    rows = materialize(parsed, "dataset")
    bound = spec.dataset.max_rows
    if bound is not None and (found := rows.count()) > bound:
        raise DataError(f"{path}: {found} rows, max_rows is {bound}")
    return settle(mark_repeated(rows), on_error, "dataset")


def mark_repeated(rows: DataFrame) -> DataFrame:
    """Adds a violation to every row whose id came before: the first one stands."""
    first = rows.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    marked = rows.join(first.filter("_rows > 1").select("id", "_first"), "id", "left")
    again = F.when(F.col("seq") > F.col("_first"), F.array(F.concat(F.lit("duplicate id "), F.col("id"))))
    marked = marked.withColumn("violations", F.concat("violations", F.coalesce(again, F.array().cast("array<string>"))))
    return marked.select(*rows.columns)


def write_dataset(rows: DataFrame, path: str) -> None:
    """Dataset rows back to JSON lines, without the order column."""
    rows.select(*ROW_KEYS).write.json(path)
