"""Connected components of links, by large-star and small-star rounds.

No neighbour list is ever gathered: each round takes the least neighbour of
every node (an aggregate with map-side partial results) and joins it back, so a
node with very many links is a skewed join key that the engine may split. Every
round is written to the shared folder and only a count and a checksum reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pupilage.sources.storage import materialize


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of all nodes but the roots.

    ``links`` has two columns of longs; direction, repeats and self links do
    not matter, a link with a null end is ignored, and no links give no rows.
    """
    a, b = (F.col(name) for name in links.columns)
    pairs = materialize(links.filter(a != b).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct(), "links")
    seen = None
    while True:
        state = pairs.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("node", "root")), F.lit(0)).alias("x")).first()
        if (state.n, state.x) == seen or state.n == 0:
            return pairs
        seen = (state.n, state.x)
        both = pairs.unionAll(pairs.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("to"))
        large = both.join(least, "node").filter(F.col("root") > F.col("node")).select(F.col("root").alias("node"), F.least("node", "to").alias("root"))
        large = materialize(large.distinct(), "links")
        least = large.groupBy("node").agg(F.min("root").alias("to"))
        small = large.join(least, "node").filter(F.col("root") != F.col("to")).select(F.col("root").alias("node"), F.col("to").alias("root"))
        pairs = materialize(small.unionAll(least.select("node", F.col("to").alias("root"))).distinct(), "links")
