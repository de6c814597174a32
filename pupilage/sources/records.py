"""The label store: immutable files, a log of commits, last record wins."""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pupilage.config import DataError
from pupilage.operators.ledger import LEDGER
from pupilage.operators.records import RECORD, latest_per_id
from pupilage.operators.validation import settle
from pupilage.sources.commits import CommitLog
from pupilage.sources.dataset import read_lines
from pupilage.sources.storage import delete_path, list_ages, list_names, materialize, path_exists

STORED = T.StructType([*RECORD.fields, T.StructField("run", T.LongType())])
PLACED = T.StructType([*STORED.fields, T.StructField("gen", T.LongType())])
BUCKETS = 16
#: Where the states of the store are, and its data.
LOG, DATA = "log", "data"
#: Data that no state of the last week refers to may be deleted.
RETAIN_SECONDS = 7 * 24 * 3600


class Conflict(Exception):
    """Another merge has replaced records that this one was made from."""


@dataclass
class Merge:
    """A merge that is written but not committed: what it saw, and what it made."""

    version: int
    base: int
    folded: list[str]
    buckets: list[int]
    folder: str | None
    gen: int
    run: int
    width: int


class LabelStore:
    """Teacher records under one folder, last record wins.

    The newest commit of a numbered log says what the store holds: the appends not
    folded yet, and for each bucket of ids (Spark's own bucket hash) the generation
    that has its records, one per id. Data files are never changed. An append adds
    one folder. A merge reads and rewrites only the buckets of the ids it touches,
    folds the appends it saw, and leaves those that land meanwhile; when another
    merge was first, it is made again from the state that one left. Readers list the
    log, open one commit and then the folders it names, however many appends there
    have ever been.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets
        self.log = CommitLog(spark, f"{self.path}/{LOG}")

    # ---- reading ---------------------------------------------------------------

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """The newest commit, or the one of a version; if that one is cleared, the newest."""
        found, state = (0, {}) if version is None else self.log.at(version)
        if version != 0 and not state:
            found, state = self.log.newest()
        blank = {"base": 0, "merges": 0, "run": 0, "width": self.buckets, "buckets": {}, "generations": {}, "appends": [], "tags": [], "writers": {}}
        return found, state or blank

    def generation(self) -> int:
        """How many merges the store has seen."""
        return self.state()[1]["merges"]

    def _appended(self, state: dict) -> DataFrame | None:
        folders = [f"{self.path}/{DATA}/{name}" for name in state["appends"]]
        return self.spark.read.schema(STORED).parquet(*folders) if folders else None

    def _base(self, state: dict) -> DataFrame | None:
        """The merged records, as a table bucketed by id: joins and groups by id need no shuffle."""
        if not state["buckets"]:
            return None
        name = f"pupilage_labels_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in PLACED.fields)
        live = sorted({gen for gen in state["buckets"].values()})
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (gen) CLUSTERED BY (id) SORTED BY (id) INTO {state['width']} BUCKETS LOCATION '{self.path}/{DATA}/{name}'")
        places = " ".join(f"PARTITION (gen = {gen}) LOCATION '{self.path}/{DATA}/{state['generations'][str(gen)]}'" for gen in live)
        self.spark.sql(f"ALTER TABLE {name} ADD {places}")
        rows = self.spark.table(name)
        if len(live) == 1 and len(state["buckets"]) == state["width"]:
            return rows.select(*STORED.fieldNames())
        # Of each bucket, the rows of the generation that holds it now.
        holder = F.array(*[F.lit(state["buckets"].get(str(b), -1)).cast("long") for b in range(state["width"])])
        return rows.filter(F.col("gen") == F.get(holder, bucket_of(F.col("id"), state["width"]))).select(*STORED.fieldNames())

    def _of(self, state: dict) -> DataFrame:
        parts = [p for p in (self._base(state), self._appended(state)) if p is not None]
        if not parts:
            return self.spark.createDataFrame([], STORED)
        return parts[0] if len(parts) == 1 else parts[0].select(*STORED.fieldNames()).unionByName(parts[1])

    def records(self) -> DataFrame:
        """Every stored record, with the order of its append in ``run``."""
        return self._of(self.state()[1])

    def latest(self, version: int | None = None) -> DataFrame:
        """One record per id: the last of the last run, now or as of a commit that is kept.

        With no append since the last merge these are the merged records as they
        lie, bucketed by id.
        """
        _, state = self.state(version)
        if not state["appends"]:
            return self._of(state).drop("run")
        return latest_per_id(self._of(state), order=F.struct("run", "seq")).drop("run")

    # ---- writing ---------------------------------------------------------------

    def _seen(self, state: dict, tag: str | None, writer: str | None, number: int | None) -> bool:
        return (tag is not None and tag in state["tags"]) or (writer is not None and state["writers"].get(writer, -1) >= number)

    def append(self, records: DataFrame, tag: str | None = None, writer: str | None = None, number: int | None = None) -> bool:
        """Add records; false if they are there already, folded or not.

        A replay is known by its ``tag``, or by a ``writer`` that numbers its
        appends upwards, of which one number is kept however many there are.
        Later commits have later runs, whatever the clocks of their drivers say.
        """
        _, state = self.state()
        if self._seen(state, tag, writer, number):
            return False
        run = max(time.time_ns() // 1000, state["run"] + 1)
        folder = f"append-{uuid.uuid4().hex}"
        records.select(*RECORD.fieldNames()).withColumn("run", F.lit(run)).write.parquet(f"{self.path}/{DATA}/{folder}")
        while True:
            version, state = self.state()
            if self._seen(state, tag, writer, number):  # somebody replayed it meanwhile
                delete_path(self.spark, f"{self.path}/{DATA}/{folder}")
                return False
            state["appends"].append(folder)
            state["run"] = max(run, state["run"])
            if tag is not None:
                state["tags"].append(tag)
            if writer is not None:
                state["writers"][writer] = number
            if self.log.put(version + 1, state):
                return True

    def prepare(self, records: DataFrame) -> Merge:
        """Write what a merge would commit: the touched buckets with ``records`` and all appends folded in."""
        version, state = self.state()
        width, run = state["width"], max(time.time_ns() // 1000, state["run"] + 1)
        new = materialize(records.select(*RECORD.fieldNames()).withColumn("run", F.lit(run)), "merging")
        appended = self._appended(state)
        # A record of the merge comes before any append it saw.
        ranked = new.withColumn("_rank", F.lit(1))
        if appended is not None:
            ranked = ranked.unionByName(appended.withColumn("_rank", F.lit(0)))
        touched = sorted(r["b"] for r in ranked.filter(F.col("id").isNotNull()).select(bucket_of(F.col("id"), width).alias("b")).distinct().collect())
        found = Merge(version, state["base"], list(state["appends"]), touched, None, run, run, width)
        if not touched:
            return found
        held = [(state["generations"][str(state["buckets"][str(b)])], b) for b in touched if str(b) in state["buckets"]]
        paths = bucket_files(self.spark, f"{self.path}/{DATA}", held)
        if paths:
            ranked = ranked.unionByName(self.spark.read.schema(STORED).parquet(*paths).withColumn("_rank", F.lit(0)))
        merged = latest_per_id(ranked.filter(F.col("id").isNotNull()), order=F.struct("_rank", "run", "seq")).drop("_rank")
        found.folder = f"gen-{uuid.uuid4().hex}"
        name = f"pupilage_{uuid.uuid4().hex}"
        # As many tasks as buckets, dealt by the same hash: each writes the one file of its bucket.
        writer = merged.repartition(width, "id").write.format("parquet").bucketBy(width, "id").sortBy("id")
        writer.option("path", f"{self.path}/{DATA}/{found.folder}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        return found

    def commit(self, merge: Merge) -> None:
        """Commit a prepared merge after any appends that came between; ``Conflict`` after another merge."""
        while True:
            version, state = self.state()
            if state["base"] != merge.base:
                raise Conflict(f"the store was merged by commit {state['base']}, this merge began at {merge.version}")
            gone = set(merge.folded)
            state["appends"] = [name for name in state["appends"] if name not in gone]
            if merge.folder is not None:
                state["generations"][str(merge.gen)] = merge.folder
                state["buckets"] |= {str(b): merge.gen for b in merge.buckets}
                held = {str(gen) for gen in state["buckets"].values()}
                state["generations"] = {gen: folder for gen, folder in state["generations"].items() if gen in held}
            state |= {"base": version + 1, "merges": state["merges"] + 1, "run": max(state["run"], merge.run), "width": merge.width}
            if self.log.put(version + 1, state):
                return

    def merge(self, records: DataFrame) -> int:
        """Replace records by id; returns how often it had to start again behind another merge."""
        for again in range(100):
            found = self.prepare(records)
            try:
                self.commit(found)
                return again
            except Conflict:
                if found.folder is not None:
                    delete_path(self.spark, f"{self.path}/{DATA}/{found.folder}")
        raise DataError("other merges came first a hundred times")

    def compact(self) -> None:
        """Fold all appends, so that there is one record per id."""
        self.merge(self.spark.createDataFrame([], RECORD))

    def vacuum(self, older_than: float = RETAIN_SECONDS) -> int:
        """Delete data folders that the newest commit does not name and that are older; readers of older states need them till then."""
        _, state = self.state()
        live = {*state["appends"], *state["generations"].values()}
        gone = [name for name, age in list_ages(self.spark, f"{self.path}/{DATA}") if name not in live and age >= older_than]
        for name in gone:
            delete_path(self.spark, f"{self.path}/{DATA}/{name}")
        return len(gone)


def bucket_of(key: Column, width: int) -> Column:
    """The bucket of a bucketed table that a key belongs to."""
    return F.pmod(F.hash(key), F.lit(width))


def bucket_files(spark: SparkSession, root: str, held: list[tuple[str, int]]) -> list[str]:
    """Files of the named (folder, bucket) pairs; the writer puts the bucket's number into the name."""
    wanted: dict[str, set[int]] = {}
    for folder, bucket in held:
        wanted.setdefault(folder, set()).add(bucket)
    number = re.compile(r"_(\d+)(?:\.c\d+)?\.[^_]*$")
    return [f"{root}/{folder}/{name}" for folder, buckets in wanted.items() for name in list_names(spark, f"{root}/{folder}") if (m := number.search(name)) and not name.startswith((".", "_")) and int(m[1]) in buckets]


def read_labels(spark: SparkSession, path: str, max_line_bytes: int | None = None) -> DataFrame:
    """Last record per id of JSON-lines label files; none if they are missing.

    Records carry the ``run`` they were written in; inside a run, and for files
    without runs, the order is that of the files and their lines.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], RECORD)
    lines = settle(read_lines(spark, path, max_line_bytes), "fail", "labels")
    record = F.from_json("line", STORED, {"mode": "FAILFAST"})
    parsed = lines.select(F.col("seq").alias("_line"), record.alias("r")).select("_line", "r.*")
    placed = parsed.withColumn("seq", F.coalesce("seq", "_line")).withColumn("run", F.coalesce("run", F.lit(0)))
    return latest_per_id(placed, order=F.struct("run", "_line")).drop("run", "_line")


def write_labels(records: DataFrame, path: str) -> None:
    """Append records as JSON lines, marked with the run that wrote them."""
    stamped = records.select(*RECORD.fieldNames()).withColumn("run", F.lit(time.time_ns() // 1000))
    stamped.write.mode("append").json(path)


def read_ledger_lines(spark: SparkSession, path: str, name: str, version: int, max_line_bytes: int | None = None) -> DataFrame:
    """All ledger lines; fields the import does not use fall away."""
    lines = settle(read_lines(spark, path, max_line_bytes), "fail", "ledger")
    parsed = lines.select("seq", F.from_json("line", LEDGER, {"mode": "FAILFAST"}).alias("r")).select("seq", "r.*")
    foreign = parsed.filter(~(F.col("ledger").eqNullSafe(name) & F.col("ledger_version").eqNullSafe(version))).select("seq").first()
    if foreign is not None:
        raise DataError(f"ledger line {foreign['seq']}: expected ledger {name} v{version}")
    return parsed


def read_ledger(spark: SparkSession, path: str, name: str, version: int) -> DataFrame:
    """The last ledger line per id."""
    return latest_per_id(read_ledger_lines(spark, path, name, version))
