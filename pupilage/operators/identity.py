"""What identifies a row: rendering, content hash, split key, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pupilage.config import InputField, TaskSpec
from pupilage.functions import hashing
from pupilage.functions.text import normalize, render

FAN_IN = 4096
TREE_LEVELS = 4


def rendered(fields: tuple[InputField, ...], source: str = "input") -> Column:
    return render(fields, lambda name: F.col(f"{source}.{name}"))


def with_content_hash(df: DataFrame, fields: tuple[InputField, ...], source: str = "input") -> DataFrame:
    """Adds ``content_hash``: equal for copies that differ in case or spacing."""
    return df.withColumn("content_hash", F.sha2(normalize(rendered(fields, source)), 256))


def with_split(df: DataFrame, spec: TaskSpec) -> DataFrame:
    """Adds ``split_key`` and its deterministic side, train or holdout."""
    keyed = df.withColumn("split_key", hashing.split_key(F.col("group"), F.col("content_hash")))
    held = hashing.is_holdout(F.col("split_key"), spec.dataset.split_seed, spec.dataset.holdout_fraction)
    return keyed.withColumn("side", F.when(held, F.lit("holdout")).otherwise(F.lit("train")))


def with_fold(df: DataFrame, spec: TaskSpec, folds: int) -> DataFrame:
    key = hashing.split_key(F.col("group"), F.col("content_hash"))
    return df.withColumn("fold", hashing.fold(key, spec.dataset.split_seed, folds))


def row_line(*cols: Column) -> Column:
    """Tab-joined text of one row; nulls are empty."""
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def fingerprint_small(df: DataFrame, line: Column, order: Column, alias: str = "fingerprint") -> DataFrame:
    """SHA-256 over ordered lines, in one piece: for tables of bounded size."""
    rows = df.select(order.alias("o"), line.alias("l"))
    return rows.agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda x: x["l"]), "\n"), 256).alias(alias)
    )


def hash_children(df: DataFrame, parent: Column) -> DataFrame:
    """Nodes (k, h) of the next level from the nodes below, each hashed in order of ``k``."""
    children = F.array_sort(F.collect_list(F.struct("k", "h")))
    return (
        df.groupBy(parent.alias("p"))
        .agg(F.sha2(F.array_join(F.transform(children, lambda x: x["h"]), "\n"), 256).alias("h"))
        .select(F.col("p").alias("k"), "h")
    )


def fingerprint_ordered(df: DataFrame, line: Column, seq: Column, alias: str = "fingerprint") -> DataFrame:
    """Hash tree over rows in ``seq`` order (unique, non-negative longs).

    Every node covers at most 4096 consecutive positions, so no task sees more
    than 4096 children whatever the table's size. Its value differs from the
    one-piece form.
    """
    level = df.select(seq.cast("bigint").alias("k"), F.sha2(line, 256).alias("h"))
    for _ in range(TREE_LEVELS):
        level = hash_children(level, F.floor(F.col("k") / FAN_IN).cast("bigint"))
    return fingerprint_small(level, F.col("h"), F.col("k"), alias)


def fingerprint_keyed(df: DataFrame, line: Column, key: Column, alias: str = "fingerprint") -> DataFrame:
    """Hash tree over rows with a unique text key, independent of row order.

    Rows are spread by the hash of their key: 24 bits at the leaves, then 12,
    then the root, sorted by key inside a leaf.
    """
    leaves = df.select(key.alias("k"), F.substring(F.sha2(key, 256), 1, 6).alias("leaf"), F.sha2(line, 256).alias("h"))
    level = leaves.groupBy("leaf").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "\n"), 256).alias("h")
    ).select(F.col("leaf").alias("k"), "h")
    level = hash_children(level, F.substring("k", 1, 3))
    return fingerprint_small(level, F.col("h"), F.col("k"), alias)


def dataset_line() -> Column:
    return row_line(F.col("id"), F.col("content_hash"), F.col("group"), F.col("gold"))


def label_line() -> Column:
    columns = [F.col(c) for c in ("id", "content_hash", "question_hash", "teacher", "status")]
    return row_line(*columns, F.coalesce(F.col("label"), F.lit("-")))
