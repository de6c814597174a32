"""Row checks. Each adds or returns a ``violations`` array; callers choose
what to do with broken rows (``settle``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pupilage.config import ROW_ID_PATTERN, DataError, InputField, TaskSpec
from pupilage.functions.probability import index_of
from pupilage.functions.text import field_text

VARIANT_KINDS = {
    "string": r"^STRING$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "json": r".*",
}
COLUMN_TYPES = {"string": "string", "number": "double", "boolean": "boolean", "json": "string"}


def undeclared_keys(json_text: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that are not declared, sorted."""
    return F.array_sort(F.array_except(F.json_object_keys(json_text), F.array(*[F.lit(a) for a in allowed])))


def strict_keys(df: DataFrame, json_col: str, allowed: list[str]) -> DataFrame:
    """Adds ``unknown_keys``; an empty array means the object is strict."""
    return df.withColumn("unknown_keys", undeclared_keys(F.col(json_col), allowed))


def input_type(fields: tuple[InputField, ...]) -> T.StructType:
    names = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(f.name, names[COLUMN_TYPES[f.type]]) for f in fields])


def typed_value(document: Column, field: InputField) -> Column:
    """One declared value out of a variant; JSON fields keep their JSON text."""
    path = f"$.{field.name}"
    if field.type == "json":
        found = F.variant_get(document, path, "variant")
        return F.when(F.schema_of_variant(found) != "VOID", F.to_json(found))
    return F.try_variant_get(document, path, COLUMN_TYPES[field.type])


def field_violations(document: Column, field: InputField) -> list[Column]:
    """Messages for one field of a parsed object; null where it is fine."""
    kind = F.schema_of_variant(F.variant_get(document, f"$.{field.name}", "variant"))
    absent = kind.isNull() | (kind == "VOID")
    right_kind = kind.rlike(VARIANT_KINDS[field.type])
    too_long = F.length(field_text(field, typed_value(document, field))) > field.max_chars
    missing = F.when(absent, F.lit(f"{field.name} is required")) if field.required else F.lit(None).cast("string")
    return [
        missing,
        F.when(~absent & ~right_kind, F.lit(f"{field.name} must be of type {field.type}")),
        F.when(~absent & right_kind & too_long, F.lit(f"{field.name} exceeds max_chars {field.max_chars}")),
    ]


def input_violations(document: Column, json_text: Column, fields: tuple[InputField, ...]) -> Column:
    """Messages for one input, given as a variant and as its JSON text."""
    is_object = F.coalesce(F.schema_of_variant(document).startswith("OBJECT"), F.lit(False))
    unknown = undeclared_keys(json_text, [f.name for f in fields])
    messages = [F.when(F.size(unknown) > 0, F.concat(F.lit("undeclared field(s) "), F.array_join(unknown, ", ")))]
    for field in fields:
        messages += field_violations(document, field)
    found = F.array_compact(F.array(*messages))
    return F.when(is_object, found).otherwise(F.array(F.lit("input must be a JSON object")))


def validate_input(df: DataFrame, fields: tuple[InputField, ...], json_col: str = "input") -> DataFrame:
    """Adds ``violations``; each text is parsed once, in a column of its own."""
    opened = df.withColumn("_document", F.try_parse_json(F.col(json_col)))
    return opened.withColumn("violations", input_violations(F.col("_document"), F.col(json_col), fields)).drop("_document")


def parse_input(document: Column, fields: tuple[InputField, ...]) -> Column:
    """Struct of the declared fields of a variant, in declared order."""
    return F.struct(*[typed_value(document, f).alias(f.name) for f in fields])


def with_parsed_input(df: DataFrame, fields: tuple[InputField, ...], json_col: str = "input") -> DataFrame:
    """Replaces a JSON text column by the struct of its declared fields."""
    opened = df.withColumn("_document", F.try_parse_json(F.col(json_col)))
    return opened.withColumn(json_col, parse_input(F.col("_document"), fields)).drop("_document")


def validate_rows(df: DataFrame, spec: TaskSpec) -> DataFrame:
    """Checks id form, declared gold label and group length."""
    size = F.length("group")
    messages = F.array(
        F.when(~F.coalesce(F.col("id").rlike(ROW_ID_PATTERN), F.lit(False)), F.lit(f"id must match {ROW_ID_PATTERN}")),
        F.when(
            F.col("gold").isNotNull() & index_of(spec.label_names, F.col("gold")).isNull(),
            F.concat(F.lit("gold '"), F.col("gold"), F.lit("' is not a declared label")),
        ),
        F.when((size < 1) | (size > 128), F.lit("group must be 1-128 characters")),
    )
    return df.withColumn("violations", F.array_compact(messages))


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def settle(df: DataFrame, on_error: str, what: str) -> DataFrame:
    """Apply the error policy to a table with a ``violations`` column.

    ``fail`` stops with the count and a few sample messages, ``drop`` keeps the
    clean rows, ``quarantine`` keeps every row and its violations.
    """
    if on_error == "quarantine":
        return df
    clean = df.filter(F.size("violations") == 0).drop("violations")
    if on_error == "drop":
        return clean
    if on_error != "fail":
        raise DataError(f"unknown error policy {on_error}")
    broken = df.filter(F.size("violations") > 0).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.concat(F.lit("row "), F.col("seq").cast("string"), F.lit(": "), F.array_join("violations", "; "))).alias("sample"),
    )
    row = broken.first()
    if row["rows"]:
        raise DataError(f"{what}: {row['rows']} bad row(s), for example {row['sample']}")
    return clean
