"""Order-dependent steps: error runs in request order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pupilage.config import MAX_CONSECUTIVE_ERRORS
from pupilage.operators.keyed import lookup

# A run is cut into chunks of this many sequence numbers. A chunk is sorted in
# one task; a run of N rows has at most N / 2^20 chunk summaries.
CHUNK = 1 << 20


def error_runs(df: DataFrame, run: str, is_error: str, seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """Adds ``run_length``: how many errors in a row end at this record.

    It is the running error count minus its value at the last success. Both
    are taken inside a chunk, and what a chunk inherits comes from the chunk
    summaries, so a run holding most of the table is still spread out.
    ``seq`` is a unique, non-negative long.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(seq) / chunk).cast("bigint"))
    inside = W.partitionBy(run, "_chunk").orderBy(seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = chunked.withColumn("_errors", F.sum(F.col(is_error).cast("bigint")).over(inside))
    local = counted.withColumn("_reset", F.max(F.when(~F.col(is_error), F.col("_errors"))).over(inside))

    ends = local.groupBy(run, "_chunk").agg(F.max("_errors").alias("_sum"), F.max("_reset").alias("_last"))
    earlier = W.partitionBy(run).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    before = ends.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    inherited = F.col("_before") - F.coalesce(F.max(F.col("_before") + F.col("_last")).over(earlier), F.lit(0))
    carries = before.select(run, "_chunk", inherited.alias("_carry"))

    length = F.when(F.col("_reset").isNull(), F.col("_errors") + F.col("_carry")).otherwise(F.col("_errors") - F.col("_reset"))
    return local.join(carries, [run, "_chunk"]).select(*df.columns, length.alias("run_length"))


def first_stops(df: DataFrame, run: str, is_error: str, limit: int = MAX_CONSECUTIVE_ERRORS, seq: str = "seq") -> DataFrame:
    """(run, stop_seq): where each run first reaches ``limit`` errors in a row."""
    reached = error_runs(df, run, is_error, seq).filter(F.col("run_length") >= limit)
    return reached.groupBy(run).agg(F.min(seq).alias("stop_seq"))


def stop_after_errors(df: DataFrame, run: str, is_error: str, limit: int = MAX_CONSECUTIVE_ERRORS, seq: str = "seq") -> DataFrame:
    """Drop the records of a run that come after its stop point."""
    marked = lookup(df, first_stops(df, run, is_error, limit, seq), run, seq)
    return marked.filter(F.col("stop_seq").isNull() | (F.col(seq) <= F.col("stop_seq"))).select(df.columns)
