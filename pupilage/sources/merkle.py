"""A hash tree kept beside a table that grows: an append hashes its own rows and the nodes above them.

Level 0 has the hashes of rows by their place, and a node of the next level is the
hash of up to ``fan`` consecutive nodes below, so the root is the fingerprint that
``identity.fingerprint_ordered`` finds over the whole table. An append writes one
part with its rows and every node it changes; of a node in several parts the last
one counts. Parts are folders by level and zone (``fan * fan`` nodes), and only the
zones that hold siblings of changed nodes are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pupilage.config import DataError
from pupilage.operators.identity import FAN_IN, TREE_LEVELS, fingerprint_small, hash_children
from pupilage.sources.commits import CommitLog
from pupilage.sources.storage import list_names, materialize

NODE = "k bigint, h string"


class StoredTree:
    def __init__(self, spark: SparkSession, path: str, fan: int = FAN_IN, levels: int = TREE_LEVELS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.fan, self.levels = fan, levels
        self.log = CommitLog(spark, f"{self.path}/log")

    def _state(self) -> tuple[int, dict]:
        version, state = self.log.newest()
        return version, state or {"parts": [], "zones": {}}

    def _zone(self, key: Column) -> Column:
        return F.floor(key / (self.fan * self.fan)).cast("bigint")

    def _stored(self, state: dict, level: int, zones: list[int]) -> DataFrame:
        """Nodes of some zones of a level as they are now; no other folder is opened."""
        found = None
        for place, part in enumerate(state["parts"]):
            held = set(state["zones"][part].get(str(level), []))
            paths = [f"{self.path}/data/{part}/level={level}/zone={z}" for z in zones if z in held]
            if paths:
                rows = self.spark.read.schema(NODE).parquet(*paths).withColumn("part", F.lit(place))
                found = rows if found is None else found.unionAll(rows)
        return found if found is not None else self.spark.createDataFrame([], f"{NODE}, part int")

    def append(self, rows: DataFrame, line: Column, seq: Column) -> None:
        """Add rows whose ``seq`` (non-negative longs) no row of the table has.

        Another append that commits first makes this one start again.
        """
        nodes = materialize(rows.select(seq.cast("bigint").alias("k"), F.sha2(line, 256).alias("h")), "tree-rows")
        while not self._append(nodes):
            pass

    def _append(self, nodes: DataFrame) -> bool:
        version, state = self._state()
        part = f"part-{uuid.uuid4().hex}"
        out = f"{self.path}/data/{part}"
        zones: dict[str, list[int]] = {}
        for level in range(self.levels + 1):
            nodes.withColumn("zone", self._zone(F.col("k"))).repartition("zone").sortWithinPartitions("k").write.partitionBy("zone").parquet(f"{out}/level={level}")
            zones[str(level)] = sorted(int(n.removeprefix("zone=")) for n in list_names(self.spark, f"{out}/level={level}") if n.startswith("zone="))
            if level == self.levels:
                break
            own = self.spark.read.schema(NODE).parquet(*[f"{out}/level={level}/zone={z}" for z in zones[str(level)]]) if zones[str(level)] else nodes
            parent = F.floor(F.col("k") / self.fan).cast("bigint")
            changed = own.select(parent.alias("p")).distinct()
            # Siblings lie in the zones of the changed nodes, as a zone has whole families.
            old = self._stored(state, level, zones[str(level)]).withColumn("p", parent).join(changed, "p", "left_semi")
            both = old.select("k", "h", "part").unionAll(own.select("k", "h", F.lit(len(state["parts"])).alias("part")))
            now = both.groupBy("k").agg(F.max(F.struct("part", "h"))["h"].alias("h"))
            nodes = materialize(hash_children(now, parent), "tree-nodes")
        state["parts"].append(part)
        state["zones"][part] = zones
        return self.log.put(version + 1, state)

    def fingerprint(self, alias: str = "fingerprint") -> DataFrame:
        """The root over the few nodes of the last level."""
        _, state = self._state()
        zones = sorted({z for part in state["parts"] for z in state["zones"][part].get(str(self.levels), [])})
        if len(zones) > 1:
            raise DataError(f"{self.path}: places beyond {self.fan ** (self.levels + 2)} take more levels than {self.levels}")
        top = self._stored(state, self.levels, zones).groupBy("k").agg(F.max(F.struct("part", "h"))["h"].alias("h"))
        return fingerprint_small(top, F.col("h"), F.col("k"), alias)
