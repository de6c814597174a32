"""Joins and lookups that stay balanced when one key holds much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pupilage.sources.storage import materialize

# A key is heavy if it holds more than this share of a shuffle partition's even
# part of the rows; there are fewer such keys than 4 x partitions, whatever the
# size of either table, so their lookup values may be broadcast.
HEAVY_SHARE = 0.25
SPREAD = 1 << 20


def heavy_keys(df: DataFrame, key: str) -> DataFrame:
    """The non-null keys that hold more than ``HEAVY_SHARE`` of an even partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    counts = materialize(counts.filter(F.col("copies") > 1), "key-counts")
    # Keys that occur once only lower the bar; the list stays as short.
    total = counts.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    return counts.filter(F.col("copies") > HEAVY_SHARE * total / parts).select(key)


def lookup(left: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join against ``right``, which has one row per non-null ``key``.

    Rows of heavy keys take their values from a broadcast of their few rows and
    are spread over the shuffle by ``spread_by``; all other rows meet
    ``right`` in an ordinary equi-join that the optimizer may turn into a
    broadcast join when ``right`` is small.
    """
    values = [c for c in right.columns if c != key]
    # Each is read twice, so each is written once.
    left, right = materialize(left, "rows"), materialize(right, "values")
    keys = heavy_keys(left, key)
    # Both broadcasts have a row per heavy key; ``right`` is not shuffled here.
    known = right.join(F.broadcast(keys), key)
    heavy = keys.join(F.broadcast(known), key, "left").select(
        F.col(key), F.lit(True).alias("_heavy"), *[F.col(v).alias(f"_h_{v}") for v in values]
    )
    salt = F.when(
        F.col("_heavy").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("int") + 1
    ).otherwise(F.lit(0))
    spread = left.join(F.broadcast(heavy), key, "left").withColumn("_salt", salt)
    # Always 0, but not a literal: the optimizer would turn a literal into a
    # filter and partition by the key alone.
    light = right.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(1)).cast("int"))
    joined = spread.join(light, [key, "_salt"], "left")
    return joined.select(
        *[F.col(c) for c in left.columns],
        *[F.when(F.col("_heavy"), F.col(f"_h_{v}")).otherwise(F.col(v)).alias(v) for v in values],
    )


def flag_members(left: DataFrame, keys: DataFrame, key: str, spread_by: str, alias: str) -> DataFrame:
    """Adds a boolean: is this row's ``key`` among ``keys``?"""
    distinct = keys.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(alias, F.lit(True))
    return lookup(left, distinct, key, spread_by).withColumn(alias, F.coalesce(F.col(alias), F.lit(False)))
