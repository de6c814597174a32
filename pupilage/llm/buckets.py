"""Comparing rows that share a bucket, whatever the bucket's size.

A bucket of more than ``limit`` rows is cut into chunks by a hash of the row,
and every pair of chunks becomes a bucket of its own, so that each pair of rows
still meets exactly once and no task has to hold more than two chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pupilage.sources.storage import materialize

LIMIT = 20_000
CHUNK = 100_000


def spread(rows: DataFrame, key: str, node: str, limit: int = LIMIT) -> DataFrame:
    """``rows`` with ``bucket`` and ``side``: in a bucket, sides 1 and 2 meet each other only, side 0 meets itself."""
    hot = materialize(rows.groupBy(key).count().filter(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).cast("int").alias("parts")), "hot-buckets")
    own = F.pmod(F.xxhash64(F.col(node), F.lit(3)), F.col("parts")).cast("int")
    found = rows.join(hot, key, "left").withColumn("own", own)
    found = found.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))))
    bucket = F.when(F.col("parts").isNull(), F.col(key)).otherwise(F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("parts").isNull() | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return found.withColumn("bucket", bucket).withColumn("side", side.cast("byte")).drop("parts", "own", "other", key)


def by_bucket(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``work`` on tables of whole buckets, sorted by bucket; a table has about ``CHUNK`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            bucket = table.column("bucket").to_numpy()
            whole = int(np.searchsorted(bucket, bucket[-1]))
            if whole:
                yield from work(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            count = table.num_rows - whole
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of rows i and j in ``label``, where each class is named by its least row."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
