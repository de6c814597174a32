"""Running sums over tables of any size, however hot a key is."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 50_000


def chunks_for(rows: int) -> int:
    return max(1, math.ceil(rows / CHUNK_ROWS))


def running(rows: DataFrame, key: str, weight: str, order: str, chunks: int, name: str) -> DataFrame:
    """``name``: the sum of ``weight`` over the rows of the same ``key`` that come before, in an order of our own.

    Rows are dealt to ``chunks`` by a hash of ``order`` (unique in a key); each
    chunk is summed by itself and begins where the chunks before it ended.
    """
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64(F.col(order), F.lit(29)), F.lit(chunks)))
    sums = dealt.groupBy(key, "_chunk").agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(key, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.withColumn("_own", F.coalesce(F.sum(weight).over(own), F.lit(0)))
    return counted.join(bases, [key, "_chunk"]).withColumn(name, (F.col("_base") + F.col("_own")).cast("long")).drop("_chunk", "_base", "_own")
