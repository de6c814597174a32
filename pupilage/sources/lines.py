"""Text files as lines with their place: a data source that reads byte ranges.

A file is cut into ranges of ``splitBytes``; a range has the lines that begin in
it. A line longer than ``maxLineBytes`` is read in pieces and only its beginning is
kept, with its full length beside it, so no task ever holds such a line. Files come
in the order in which they are declared.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "pupilage_lines"
SCHEMA = "part int, at bigint, file int, offset bigint, bytes bigint, line string"
CHUNK = 1 << 20
BATCH_BYTES = 4 << 20
BATCH_LINES = 10_000
#: Schemes that Arrow's file systems open.
OPENED = ("file", "hdfs", "s3", "gs")


@dataclass
class ByteRange(InputPartition):
    part: int
    file: int
    uri: str
    start: int
    end: int


def lines_between(stream: BinaryIO, start: int, end: int, bound: int | None) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, beginning) of the lines that begin in [start, end); line ends do not count."""
    at = start
    if start:
        # The line before ends at the first line break from the byte before ``start`` on.
        stream.seek(start - 1)
        at = start - 1
        while True:
            chunk = stream.read(CHUNK)
            found = chunk.find(b"\n")
            if found >= 0:
                at += found + 1
                break
            at += len(chunk)
            if not chunk or at >= end:
                return
        stream.seek(at)
    head, size, tail = b"", 0, b""

    def begun(text: bytes, full: int, last: bytes) -> tuple[int, int, bytes]:
        """The line without a carriage return at its end, and at most one byte more than allowed."""
        ended = last == b"\r"
        text = text[:-1] if ended and len(text) == full else text
        return at, full - ended, text if bound is None else text[: bound + 1]

    while at < end:
        chunk = stream.read(CHUNK)
        *whole, rest = chunk.split(b"\n")
        for part in whole:
            full = size + len(part)
            yield begun(part if not size else head + (part if bound is None else part[: max(0, bound + 2 - len(head))]), full, part[-1:] or tail)
            at += full + 1
            head, size, tail = b"", 0, b""
            if at >= end:
                return
        head += rest if bound is None else rest[: max(0, bound + 2 - len(head))]
        size, tail = size + len(rest), rest[-1:] or tail
        if not chunk:
            if size:
                yield begun(head, size, tail)
            return


def strings(values: list[bytes]) -> pa.Array:
    try:
        return pa.array(values, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # not all is UTF-8, or a long line was cut inside a letter
        return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.split = int(options.get("splitbytes", 128 << 20))
        bound = options.get("maxlinebytes")
        self.bound = int(bound) if bound else None

    def partitions(self) -> list[ByteRange]:
        found: list[ByteRange] = []
        for file, (uri, size) in enumerate(self.files):
            for start in range(0, size, self.split):
                found.append(ByteRange(len(found), file, uri, start, min(size, start + self.split)))
        return found

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.uri)
        schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("file", pa.int32()), ("offset", pa.int64()), ("bytes", pa.int64()), ("line", pa.string())])
        held, weight, count = [], 0, 0

        def batch() -> pa.RecordBatch:
            n = len(held)
            columns = [pa.array([partition.part] * n, pa.int32()), pa.array(range(count - n, count), pa.int64()), pa.array([partition.file] * n, pa.int32())]
            columns += [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), strings([h[2] for h in held])]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        with system.open_input_file(path) as stream:
            for found in lines_between(stream, partition.start, partition.end, self.bound):
                held.append(found)
                weight, count = weight + len(found[2]), count + 1
                if len(held) >= BATCH_LINES or weight >= BATCH_BYTES:
                    yield batch()
                    held, weight = [], 0
            if held:
                yield batch()


class LinesSource(DataSource):
    """Options: ``files`` (JSON list of [uri, bytes]), ``splitBytes``, ``maxLineBytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinesReader:
        return LinesReader({k.lower(): v for k, v in dict(self.options).items()})


def declared_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """(uri, bytes) of the files in the order of ``paths``; a folder's files by age, then name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: list[tuple[str, int]] = []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(conf)
        if files.getFileStatus(target).isFile():
            listed = [files.getFileStatus(target)]
        else:
            listed = [s for s in files.listStatus(target) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
            listed.sort(key=lambda s: (s.getModificationTime(), s.getPath().getName()))
        found += [(str(s.getPath().toUri()), int(s.getLen())) for s in listed]
    return found


def opened(files: list[tuple[str, int]]) -> bool:
    """Whether Arrow can open these files; plain text only, as the engine unpacks packed files itself."""
    return all(uri.split(":", 1)[0] in OPENED and not uri.endswith((".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")) for uri, _ in files)


def placed_lines(spark: SparkSession, files: list[tuple[str, int]], max_line_bytes: int | None) -> DataFrame:
    """(part, at, file, offset, bytes, line): parts and lines in a part are numbered in order."""
    spark.dataSource.register(LinesSource)
    whole = [(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri, size) for uri, size in files]
    reader = spark.read.format(NAME).option("files", json.dumps(whole)).option("splitBytes", str(split_bytes(spark)))
    if max_line_bytes is not None:
        reader = reader.option("maxLineBytes", str(max_line_bytes))
    return reader.load()


def split_bytes(spark: SparkSession) -> int:
    said = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return max(1, int(said))
