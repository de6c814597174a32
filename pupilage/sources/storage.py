"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from pupilage.config import DataError


_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise DataError("set spark.checkpoint.dir to a folder all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="pupilage-"))
    return _local_folder[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: survives lost executors and cuts the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, width: int, name: str = "bucketed") -> DataFrame:
    """Write once in ``width`` buckets of ``key``: joins with another table of as many buckets need no shuffle."""
    spark = df.sparkSession
    table = f"pupilage_{uuid.uuid4().hex}"
    df.repartition(width, key).write.format("parquet").bucketBy(width, key).sortBy(key).option("path", fresh_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder; none if it does not exist."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


def list_ages(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Names directly under a folder and the seconds since each was last changed."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    now = time.time()
    return [(s.getPath().getName(), now - s.getModificationTime() / 1000) for s in files.listStatus(target)] if files.exists(target) else []


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
