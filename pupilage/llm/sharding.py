"""Resharding by minimum-cost flow: near-equal bytes, the fewest bytes moved.

Rows lie in blocks by a hash of their text, so equal texts stay together; a
block has an old shard. Old shards supply their bytes, new shards take an equal
share each, a byte that stays costs nothing and a byte that moves costs one. The
flow between shards is solved exactly on the driver (a few dozen nodes); blocks
are then picked to carry it. Only block sizes reach the driver, ``PER_SHARD``
for each new shard. Shards that gained or lost a block are written anew; the
others keep their files.

Groups of equal texts larger than a whole new shard cannot stay together in
equal shards: they alone are split, by a hash of the row.

Defined cases: null text is empty; sizes are UTF-8 bytes plus ``OVERHEAD``, so
no row is weightless; an empty table gives no rows; repeated rows take a slot
each; a null doc_id is kept; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pupilage.llm.numbering import chunks_for, running
from pupilage.llm.texts import only
from pupilage.sources.storage import fresh_path, materialize

OVERHEAD = 16
PER_SHARD = 256
FILE_BYTES = 64 << 20


def cheapest_flow(supply: np.ndarray, capacity: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Integer flow from every supply into the capacities at the least cost, by shortest augmenting paths with potentials."""
    left, right = len(supply), len(capacity)
    flow = np.zeros((left, right), np.int64)
    supply, room = supply.astype(np.int64).copy(), capacity.astype(np.int64).copy()
    price_left, price_right = np.zeros(left), np.zeros(right)
    while supply.sum() > 0:
        far_left, far_right = np.where(supply > 0, 0.0, np.inf), np.full(right, np.inf)
        from_right, from_left = np.full(left, -1), np.full(right, -1)
        done_left, done_right = np.zeros(left, bool), np.zeros(right, bool)
        while True:
            open_left, open_right = np.where(done_left, np.inf, far_left), np.where(done_right, np.inf, far_right)
            a, b = int(open_left.argmin()), int(open_right.argmin())
            if min(open_left[a], open_right[b]) == np.inf:
                break
            if open_left[a] <= open_right[b]:
                done_left[a] = True
                reach = far_left[a] + cost[a] + price_left[a] - price_right
                better = ~done_right & (reach < far_right - 1e-12)
                far_right[better], from_left[better] = reach[better], a
            else:
                done_right[b] = True
                reach = np.where(flow[:, b] > 0, far_right[b] - cost[:, b] + price_right[b] - price_left, np.inf)
                better = ~done_left & (reach < far_left - 1e-12)
                far_left[better], from_right[better] = reach[better], b
        ends = np.where(room > 0, far_right + price_right, np.inf)
        end = int(ends.argmin())
        path, b = [], end
        while True:
            a = int(from_left[b])
            path.append((a, b, 1))
            if from_right[a] < 0:
                break
            b = int(from_right[a])
            path.append((a, b, -1))
        amount = min([int(room[end]), int(supply[path[-1][0]])] + [int(flow[a, b]) for a, b, sign in path if sign < 0])
        for a, b, sign in path:
            flow[a, b] += sign * amount
        supply[path[-1][0]] -= amount
        room[end] -= amount
        price_left += np.where(np.isfinite(far_left), far_left, 0)
        price_right += np.where(np.isfinite(far_right), far_right, 0)
    return flow


def assign(sizes: np.ndarray, old: np.ndarray, shards: int) -> np.ndarray:
    """New shard of every block, near the cheapest flow from the old shards to equal ones."""
    total = int(sizes.sum())
    share = np.full(shards, total // shards, np.int64)
    share[: total % shards] += 1
    olds = int(old.max()) + 1 if len(old) else 0
    supply = np.bincount(old, sizes, olds).astype(np.int64)
    cost = np.ones((olds, shards))
    cost[np.arange(min(olds, shards)), np.arange(min(olds, shards))] = 0
    flow = cheapest_flow(supply, share, cost)
    new = np.full(len(sizes), -1, np.int64)
    load = np.zeros(shards, np.int64)
    for a in range(olds):
        blocks = np.flatnonzero(old == a)
        blocks = blocks[np.argsort(-sizes[blocks], kind="stable")]
        wanted = flow[a].copy()
        # Largest first, each to the transfer that it leaves nearest to done; what stays counts as a transfer too.
        for block in blocks:
            target = int(np.where((flow[a] > 0) | (np.arange(shards) == a), wanted, np.iinfo(np.int64).min).argmax())
            new[block] = target
            wanted[target] -= sizes[block]
            load[target] += sizes[block]
    # Rounding to blocks leaves small differences: move or swap between the fullest and the emptiest shard while that helps.
    for _ in range(20 * shards):
        high, low = int(load.argmax()), int(load.argmin())
        gap = (load[high] - load[low]) / 2
        if gap < 1:
            break
        give = np.flatnonzero(new == high)
        take = np.flatnonzero(new == low)
        gain = np.concatenate([sizes[give][:, None], sizes[give][:, None] - sizes[take][None, :]], axis=1)
        best = np.unravel_index(np.abs(gain - gap).argmin(), gain.shape)
        moved = gain[best]
        if moved <= 0 or moved >= 2 * gap:
            break
        new[give[best[0]]] = low
        if best[1] > 0:
            new[take[best[1] - 1]] = high
        load[high] -= moved
        load[low] += moved
    return new


def plan(docs: DataFrame, shards: int, old_shards: int) -> tuple[DataFrame, DataFrame]:
    """The rows with ``size`` and ``block``, and the table ``block``, ``old``, ``shard``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, "doc_id", "text").select("doc_id", text.alias("text"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.xxhash64(text).alias("mark"), F.xxhash64(text, F.lit(1)).alias("second"))
    groups = rows.groupBy("mark", "second").agg(F.sum("size").alias("bytes"))
    total = materialize(groups, "groups")
    share = (total.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]) / shards
    # No more groups than shards can be larger than a shard.
    giant = total.filter(F.col("bytes") > share).select("mark", "second", F.lit(True).alias("giant"))
    blocks = PER_SHARD * shards
    spread = F.pmod(F.xxhash64("mark", "second", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(blocks))
    rows = rows.join(F.broadcast(giant), ["mark", "second"], "left").withColumn("block", F.when(F.col("giant"), spread).otherwise(F.pmod(F.xxhash64("mark", "second"), F.lit(blocks))).cast("int"))
    rows = rows.select("doc_id", "text", "size", "block")
    sums = rows.groupBy("block").agg(F.sum("size").alias("bytes")).orderBy("block").collect()
    sizes, names = np.array([r["bytes"] for r in sums], np.int64), np.array([r["block"] for r in sums], np.int64)
    new = assign(sizes, names % old_shards, shards) if len(sizes) else names
    table = docs.sparkSession.createDataFrame([(int(b), int(b % old_shards), int(s)) for b, s in zip(names, new)], "block int, old int, shard int")
    return rows, table


def reshard(docs: DataFrame, shards: int = 40, old_shards: int = 32) -> DataFrame:
    """doc_id, text, size and shard of every row, read back from the shards written anew and those left alone."""
    spark = docs.sparkSession
    rows, table = plan(docs, shards, old_shards)
    moved = table.filter("old <> shard")
    touched = moved.select(F.col("old").alias("shard")).unionAll(moved.select("shard")).distinct().withColumn("touched", F.lit(True))
    # As many rows as blocks, and shards: both bounded by the plan.
    placed = rows.join(F.broadcast(table), "block").join(F.broadcast(touched), "shard", "left").select("doc_id", "text", "size", "shard", "touched")
    path = fresh_path(spark, "shards")
    # Each shard is dealt to as many tasks as it gets files.
    files = max(1, int(rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"] / shards / FILE_BYTES))
    dealt = placed.filter("touched").select("doc_id", "text", "size", "shard")
    dealt.repartition(shards * files, "shard", F.pmod(F.xxhash64("doc_id", "size"), F.lit(files))).write.partitionBy("shard").parquet(path)
    schema = dealt.schema
    written = spark.read.schema(schema).parquet(path).select("doc_id", "text", "size", "shard")
    return written.unionAll(placed.filter("touched is null").select("doc_id", "text", "size", "shard"))


def placements(docs: DataFrame, shards: int = 40, old_shards: int = 32) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    rows = reshard(docs, shards, old_shards).select("doc_id", "size", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.col("shard").cast("int").alias("shard"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("one", F.lit(1)), "placements")
    return running(rows, "shard", "one", "row", chunks_for(rows.count()), "slot").drop("row", "one")
