"""Structured Streaming forms: scoring, last-wins labels, pending rows, and both against tables that change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pupilage.config import TaskSpec
from pupilage.operators.features import dense_features
from pupilage.operators.identity import with_content_hash
from pupilage.operators.records import latest_per_id, pending
from pupilage.operators.validation import validate_input, with_parsed_input
from pupilage.plans.score import predict
from pupilage.sources.commits import CommitLog
from pupilage.sources.models import Student, check_compatible
from pupilage.sources.records import LabelStore
from pupilage.sources.storage import materialize
from pupilage.sources.versions import VersionedTable, pinned


def checked_stream(lines: DataFrame, student: Student) -> DataFrame:
    """JSON-text inputs with their violations; stateless."""
    return validate_input(lines, student.spec.fields)


def score_stream(lines: DataFrame, student: Student) -> DataFrame:
    """Predictions for the valid rows of a stream of (id, input JSON text).

    Row-local throughout: no state, no shuffle, so append mode works with any
    trigger.
    """
    fields = student.spec.fields
    valid = checked_stream(lines, student).filter(F.size("violations") == 0)
    return predict(with_parsed_input(valid.select("id", "input"), fields), student)


def quarantine_stream(lines: DataFrame, student: Student) -> DataFrame:
    """The rows ``score_stream`` leaves out, with the reasons."""
    return checked_stream(lines, student).filter(F.size("violations") > 0).select("id", "input", "violations")


def upsert_labels(records: DataFrame, store: LabelStore, checkpoint: str, fold_every: int = 0) -> DataStreamWriter:
    """Keep ``store`` current from a stream of teacher records.

    Each micro-batch is one append numbered by its batch id, so its cost follows
    the batch and a replayed batch is known without a list of all that came
    before; the checkpoint names the writer. Readers see the last record per id.
    After every ``fold_every`` batches the appends are folded into the buckets they
    touch (0: never; ``store.compact()`` does it at any time).
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        store.append(latest_per_id(batch), writer=checkpoint, number=batch_id)
        if fold_every and (batch_id + 1) % fold_every == 0:
            store.compact()

    return records.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def pending_stream(rows: DataFrame, labels: DataFrame, spec: TaskSpec) -> DataFrame:
    """Incoming rows that still need a label, against a table that stays as it is: stream-static left join, filter."""
    settled = labels.filter((F.col("question_hash") == spec.question_hash) & (F.col("status") != "error")).select(
        "id", "content_hash", F.lit(True).alias("settled")
    )
    return rows.join(settled, ["id", "content_hash"], "left").filter(F.col("settled").isNull()).drop("settled")


def batch_folder(out: str, batch: int) -> str:
    return f"{out}/batch={batch:012d}"


def pending_fresh(rows: DataFrame, store: LabelStore, spec: TaskSpec, out: str, checkpoint: str) -> DataStreamWriter:
    """Incoming rows that still need a label, against the labels there are when their micro-batch begins.

    A batch pins the store's version before it reads and writes a folder of its own,
    so a replayed batch reads the same labels and replaces its own output.
    """
    pins = CommitLog(rows.sparkSession, f"{checkpoint}-pins")

    def write(batch: DataFrame, batch_id: int) -> None:
        labels = store.latest(pinned(pins, batch_id, store.state()[0]))
        pending(batch, labels, spec).write.mode("overwrite").parquet(batch_folder(out, batch_id))

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def score_fresh(lines: DataFrame, student: Student, table: VersionedTable, out: str, checkpoint: str) -> DataStreamWriter:
    """Predictions of a dense student for a stream of (id, input JSON text), with the representations there are when a micro-batch begins.

    ``table`` has the columns of ``features.REPRESENTATION`` and grows while the
    stream runs; of a content that came in several parts the last one counts. Valid
    rows without a representation yet go to ``waiting`` beside ``scored``, with
    their content hash, to be represented and sent again.
    """
    pins = CommitLog(lines.sparkSession, f"{checkpoint}-pins")
    spec = student.spec

    def write(batch: DataFrame, batch_id: int) -> None:
        valid = validate_input(batch, spec.fields).filter(F.size("violations") == 0)
        hashed = with_content_hash(with_parsed_input(valid.select("id", "input"), spec.fields), spec.fields)
        rows = materialize(hashed, "batch")
        known = table.read(pinned(pins, batch_id, table.state()[0])).join(rows.select("content_hash").distinct(), "content_hash", "left_semi")
        known = known.withColumn("_seq", F.col("part"))
        current = materialize(latest_per_id(known, "content_hash", "_seq").drop("_seq", "part"), "batch-representations")
        check_compatible(student, student.features.source_fingerprint, current)
        found = rows.join(current.select("content_hash"), "content_hash", "left_semi")
        cache = dense_features(current, spec)
        predict(found.select("id", "input"), student, cache, student.features.source_fingerprint).write.mode("overwrite").parquet(batch_folder(f"{out}/scored", batch_id))
        rows.join(current.select("content_hash"), "content_hash", "left_anti").select("id", "content_hash").write.mode("overwrite").parquet(batch_folder(f"{out}/waiting", batch_id))

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
