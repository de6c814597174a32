"""A small permission task: verbs decide the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pupilage.config import Abstain, DatasetSettings, Gate, InputField, Label, StudentSettings, TaskSpec
from pupilage.operators.identity import with_content_hash
from pupilage.operators.records import RECORD

VERBS = {
    "allow": ("read", "list", "show"),
    "deny": ("delete", "drop", "wipe"),
    "ask": ("move", "rename", "share"),
}
OBJECTS = "logs files tables rows users keys disks mails notes charts backups tickets".split()
ROWS = "seq bigint, id string, input struct<request:string,note:string>, `group` string, gold string"


def task(**changes) -> TaskSpec:
    values = dict(
        name="permission",
        version="1",
        instructions="What should the operator do with this order?",
        fields=(InputField("request", max_chars=200), InputField("note", required=False)),
        labels=tuple(Label(n, f"{n} description") for n in ("allow", "deny", "ask")),
        abstain=Abstain("ask", 0.4),
        teacher=Gate("choice", 0.6, "abstain", min_margin=0.2),
        dataset=DatasetSettings(holdout_fraction=0.25, split_seed="test"),
        student=StudentSettings(hash_dimensions=1024, epochs=60, l2=0.001),
    )
    return TaskSpec(**{**values, **changes})


def rows_of(spark: SparkSession, spec: TaskSpec, rows: list[tuple]) -> DataFrame:
    """(id, request, group, gold) tuples in order, hashed."""
    data = [(i, r[0], {"request": r[1], "note": None}, r[2], r[3]) for i, r in enumerate(rows)]
    return with_content_hash(spark.createDataFrame(data, ROWS), spec.fields)


def verb_rows(spark: SparkSession, spec: TaskSpec, gold_every: int = 5) -> DataFrame:
    rows = []
    for label, verbs in VERBS.items():
        for verb in verbs:
            for thing in OBJECTS:
                rows.append((label, f"{verb} the {thing}"))
    rows.sort(key=lambda r: hash_order(r[1]))
    return rows_of(spark, spec, [(f"r{i}", text, None, label if i % gold_every == 0 else None) for i, (label, text) in enumerate(rows)])


def hash_order(text: str) -> str:
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def truth_of(text: str) -> str:
    return next(label for label, verbs in VERBS.items() if text.split()[0] in verbs)


def records_for(spark: SparkSession, spec: TaskSpec, hashed: DataFrame, overrides: dict | None = None) -> DataFrame:
    """One record per row, labelled by its verb or as overridden."""
    overrides = overrides or {}
    data = []
    for row in hashed.select("seq", "id", "content_hash", "input").orderBy("seq").collect():
        base = dict.fromkeys(RECORD.fieldNames())
        try:
            label = truth_of(row["input"]["request"])
        except StopIteration:
            label = "allow"
        base.update(seq=row["seq"], id=row["id"], content_hash=row["content_hash"], question_hash=spec.question_hash,
                    teacher="fake", status="accepted", teacher_label=label, label=label)
        base.update(overrides.get(row["id"], {}))
        data.append(tuple(base[c] for c in RECORD.fieldNames()))
    return spark.createDataFrame(data, RECORD)


def ids(df: DataFrame) -> set[str]:
    return {r["id"] for r in df.select("id").collect()}


def counts(df: DataFrame) -> dict:
    return df.first().asDict()


__all__ = ["counts", "ids", "records_for", "rows_of", "task", "verb_rows"]
