"""A table that grows by parts, readable as of any commit that is kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pupilage.sources.commits import CommitLog
from pupilage.sources.storage import delete_path


class VersionedTable:
    """Parts under one folder; the newest commit lists them in the order they came."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.log = CommitLog(spark, f"{self.path}/log")

    def state(self, version: int | None = None) -> tuple[int, dict]:
        found, state = self.log.newest() if version is None else self.log.at(version)
        return found, state or {"parts": [], "tags": []}

    def append(self, rows: DataFrame, tag: str | None = None) -> bool:
        """Add a part; false if its tag is there already."""
        if tag is not None and tag in self.state()[1]["tags"]:
            return False
        folder = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{folder}")
        while True:
            version, state = self.state()
            if tag is not None and tag in state["tags"]:
                delete_path(self.spark, f"{self.path}/data/{folder}")
                return False
            state["parts"].append(folder)
            if tag is not None:
                state["tags"].append(tag)
            if self.log.put(version + 1, state):
                return True

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, with ``part``: the place of their part."""
        _, state = self.state(version)
        if not state["parts"]:
            return self.spark.createDataFrame([], self.schema).withColumn("part", F.lit(0))
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{p}" for p in state["parts"]])
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/(part-[0-9a-f]{32})/", 1)
        return rows.withColumn("part", F.array_position(F.array(*[F.lit(p) for p in state["parts"]]), name).cast("int"))


def pinned(pins: CommitLog, batch: int, newest: int) -> int:
    """The version that a micro-batch reads: the newest when it was first tried, and that one again when it is replayed."""
    while True:
        _, found = pins.at(batch + 1)
        if found:
            return found["version"]
        if pins.put(batch + 1, {"version": newest}):
            return newest
