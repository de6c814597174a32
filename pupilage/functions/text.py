"""Text columns: number and JSON text, rendering, normalising, tokenising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pupilage.config import InputField

WHITESPACE = r"\p{IsWhite_Space}+"
# A letter or digit with the combining marks that follow it counts as one
# character of a word.
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


def normalize(text: Column) -> Column:
    """Lower case, inner whitespace collapsed to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), WHITESPACE, " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def number_text(x: Column) -> Column:
    """Shortest text of a double; whole numbers below 1e15 have no decimals."""
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(1e15))
    shortest = x.cast("string")
    plain = F.regexp_replace(x.cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    mantissa = F.regexp_replace(F.split_part(shortest, F.lit("E"), F.lit(1)), r"\.0$", "")
    exponent = F.split_part(shortest, F.lit("E"), F.lit(2)).try_cast("int")
    scientific = F.concat(
        mantissa, F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(exponent).cast("string"), 2, "0")
    )
    return (
        F.when(whole, x.cast("decimal(38,0)").cast("string"))
        .when(~shortest.contains("E"), shortest)
        .when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain)
        .otherwise(scientific)
    )


def json_field_text(raw: Column) -> Column:
    """A JSON value as text: strings as they are, all else printed compactly with sorted keys."""
    value = F.parse_json(raw)
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string")).otherwise(F.to_json(value))


def field_text(field: InputField, value: Column) -> Column:
    """Text of one declared input value; null stays null."""
    if field.type == "number":
        return number_text(value)
    if field.type == "json":
        return json_field_text(value)
    return value.cast("string")


def render(fields: tuple[InputField, ...], value_of) -> Column:
    """``name: value`` lines in declared order; absent values leave no line."""
    lines = [F.concat(F.lit(f"{f.name}: "), field_text(f, value_of(f.name))) for f in fields]
    return F.concat_ws("\n", *lines)
