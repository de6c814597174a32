"""Exact order statistics per group, by counting digits of ordered keys.

Every value gets a 64-bit key that orders as the values do. A wanted position
starts with all keys of its group. While more than ``SMALL`` rows are left and
they differ, one pass counts the rows left by their next digit of up to 16 bits
(at most 65,536 counts a position, added up where the rows are), and the digit
that holds the position is kept, with the least and greatest key seen in it. Keys
have 64 bits, so four such passes are the most there can be, whatever the values
are; groups of at most ``SMALL`` rows need none. The last pass counts the keys
that are left, of which no position has more than ``SMALL``. No sketch is trusted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pupilage.config import DataError
from pupilage.sources.storage import materialize

SMALL = 1 << 16
#: Positions up to which the table of positions goes out to all rows.
BROADCAST = 100_000


def _key_of_doubles(values: pa.Array) -> pa.Array:
    x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # the two zeros are one
    x[np.isnan(x)] = np.nan  # and all NaNs, which come last
    bits = x.view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits), mask=np.asarray(values.is_null()))


def ordered_key(value: Column, kind: T.DataType) -> Column:
    """A long that orders as ``value`` does, and is equal where it is."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.arrow_udf(_key_of_doubles, "bigint")(value.cast("double"))
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (value * F.lit(10**kind.scale)).cast("long")
    raise DataError(f"no 64-bit order of {kind.simpleString()} values")


def _meet(rows: DataFrame, positions: DataFrame, group: str, count: int) -> DataFrame:
    """Rows beside the positions of their group that they are still left for."""
    side = F.broadcast(positions) if count <= BROADCAST else positions
    return rows.join(side, F.col(group).eqNullSafe(F.col("_group"))).filter((F.col("_key") >= F.col("low")) & (F.col("_key") <= F.col("high")))


def latency_summary(df: DataFrame, group: str, value: str, quantiles: tuple[float, ...] = (0.5, 0.95), small: int = SMALL) -> DataFrame:
    """n, min, max and the values at sorted position ``min(n-1, int(n q))``.

    Nulls do not count; a group of nulls has no row; NaN comes last. ``df`` is
    read once a pass, of which there are two if no group has over ``small`` rows.
    """
    known = df.filter(F.col(value).isNotNull()).select(group, value).withColumn("_key", ordered_key(F.col(value), df.schema[value].dataType))
    stats = known.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.min("_key").alias("low"), F.max("_key").alias("high")
    )
    stats = materialize(stats, "order-groups")
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(float(q)))).alias("position")) for i, q in enumerate(quantiles)]))
    state = stats.select(F.col(group).alias("_group"), "n", "low", "high", wanted.alias("w"))
    state = state.select("_group", "low", "high", F.col("n").alias("left"), F.col("w.q").alias("q"), F.col("w.position").alias("position"))
    while True:
        state = materialize(state, "order-positions")
        open_ = (F.col("left") > small) & (F.col("low") < F.col("high"))
        count = state.agg(F.count_if(open_).alias("open"), F.count(F.lit(1)).alias("all")).first()
        if not count["open"]:
            break
        # The shift that leaves 16 bits of the keys' differences; doubles may round it up by one.
        spread = F.col("high").cast("double") - F.col("low").cast("double")
        shifted = state.filter(open_).withColumn("s", F.least(F.lit(48), F.greatest(F.lit(0), F.ceil(F.log2(spread + 1)).cast("int") - 16)))
        digit = F.expr("shiftright(_key, s)")
        digits = _meet(known.select(group, "_key"), shifted, group, count["open"]).groupBy("_group", "q", digit.alias("digit"))
        digits = digits.agg(F.count(F.lit(1)).alias("c"), F.min("_key").alias("low"), F.max("_key").alias("high"), F.first("position").alias("position"))
        upto = F.sum("c").over(W.partitionBy("_group", "q").orderBy("digit").rowsBetween(W.unboundedPreceding, W.currentRow))
        placed = digits.withColumn("upto", upto).filter((F.col("upto") > F.col("position")) & (F.col("upto") - F.col("c") <= F.col("position")))
        narrowed = placed.select("_group", "low", "high", F.col("c").alias("left"), "q", (F.col("position") - F.col("upto") + F.col("c")).alias("position"))
        state = state.filter(~open_).unionByName(narrowed)
    keys = _meet(known, state, group, count["all"]).groupBy("_group", "q", "_key").agg(F.count(F.lit(1)).alias("c"), F.min(value).alias("v"), F.first("position").alias("position"))
    upto = F.sum("c").over(W.partitionBy("_group", "q").orderBy("_key").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = keys.withColumn("upto", upto).filter((F.col("upto") > F.col("position")) & (F.col("upto") - F.col("c") <= F.col("position")))
    picked = [F.max(F.when(F.col("q") == i, F.col("v"))).alias(f"p{round(q * 100)}") for i, q in enumerate(quantiles)]
    values = found.groupBy("_group").agg(*picked)
    joined = stats.join(values, F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(group, "n", *[f"p{round(q * 100)}" for q in quantiles], "min", "max")
