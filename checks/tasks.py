"""Tasks over the given tables: who labels what, and what the teacher says.

Every choice a task needs (gold rows, wrong or stale answers, failed calls) is
drawn from the hash of the row's id, so Spark and SQL agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pupilage.config import Abstain, DatasetSettings, Gate, InputField, Label, StudentSettings, TaskSpec
from pupilage.functions.hashing import unit_interval
from pupilage.functions.probability import gate, name_at, to_label_map
from pupilage.operators.identity import with_content_hash
from pupilage.operators.records import RECORD
from pupilage.sources.tables import table

GOLD_SHARE = 0.25
FLIP_SHARE = 0.15
STALE_SHARE = 0.05
ERROR_SHARE = 0.05
DROP_SHARE = 0.3


def labels_of(*names: str) -> tuple[Label, ...]:
    return tuple(Label(n, f"{n} rows") for n in names)


DOCUMENTS = TaskSpec(
    name="document-quality",
    version="1",
    instructions="Judge the document.",
    fields=(InputField("text", max_chars=20_000), InputField("lang", max_chars=8)),
    labels=labels_of("good", "poor", "toxic"),
    abstain=Abstain("poor", 0.5),
    teacher=Gate("choice", 0.6, "abstain", min_margin=0.2),
    dataset=DatasetSettings(split_seed="documents"),
    student=StudentSettings(hash_dimensions=1024, l2=0.001, l2_grid=(0.0001, 0.01)),
)
CONVERSATIONS = TaskSpec(
    name="turn-role",
    version="1",
    instructions="Who is speaking?",
    fields=(InputField("text", max_chars=20_000),),
    labels=labels_of("assistant", "system", "user"),
    teacher=Gate("choice", 0.6, "drop", min_margin=0.2),
    dataset=DatasetSettings(split_seed="conversations"),
    student=StudentSettings(hash_dimensions=512, l2=0.001),
)
VECTORS = TaskSpec(
    name="vector-class",
    version="1",
    instructions="Which cluster?",
    fields=(InputField("key"),),
    labels=labels_of(*[f"c{i}" for i in range(10)]),
    abstain=Abstain("c0", 0.2),
    teacher=Gate("choice", 0.6, "abstain"),
    dataset=DatasetSettings(split_seed="vectors"),
    student=StudentSettings(hash_dimensions=64, l2=0.01, l2_grid=(0.001, 0.1), features="embedding"),
)
GATED = TaskSpec(
    name="gated",
    version="1",
    instructions="Pick one.",
    fields=(InputField("key"),),
    labels=labels_of("allow", "deny", "ask"),
    abstain=Abstain("ask", 0.5),
    teacher=Gate("choice", 0.5, "abstain", min_margin=0.2),
)


def chance(kind: str, key: Column) -> Column:
    return unit_interval(F.concat(F.lit(f"{kind}:"), key))


def true_label() -> Column:
    return F.when(F.col("toxic") == 1, F.lit(2)).when(F.col("quality") == 1, F.lit(0)).otherwise(F.lit(1))


def document_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, id, input) of all documents; row-local."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.struct("text", "lang").alias("input")
    )


def hashed_inputs(spark: SparkSession, folder: str) -> DataFrame:
    return with_content_hash(document_inputs(spark, folder), DOCUMENTS.fields)


def with_gold(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Adds the (empty) group and the human label of a quarter of the labelled rows."""
    truth = table(spark, folder, "labels").select(F.col("doc_id").alias("seq"), true_label().alias("truth"))
    is_gold = F.col("truth").isNotNull() & (chance("gold", F.col("id")) < GOLD_SHARE)
    gold = F.when(is_gold, name_at(DOCUMENTS.label_names, F.col("truth")))
    return rows.join(truth, "seq", "left").select(*rows.columns, F.lit(None).cast("string").alias("group"), gold.alias("gold"))


def document_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, id, input, group, gold) of all documents."""
    return with_gold(document_inputs(spark, folder), spark, folder)


def hashed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, id, content_hash, group, gold): texts are hashed where they are
    read, so only hashes take part in the joins."""
    return with_gold(hashed_inputs(spark, folder).select("seq", "id", "content_hash"), spark, folder)


def teacher_probabilities(spec: TaskSpec, truth: Column, key: Column) -> Column:
    """The teacher picks the truth, or the next label for 15 % of the rows."""
    k = len(spec.labels)
    pick = F.when(chance("flip", key) < FLIP_SHARE, (truth + 1) % k).otherwise(truth)
    sure = 0.4 + 0.6 * chance("sure", key)
    return F.array(*[F.when(pick == i, sure).otherwise((1.0 - sure) / (k - 1)) for i in range(k)])


def records_of(rows: DataFrame, spec: TaskSpec) -> DataFrame:
    """Teacher records of rows with id, content_hash and a ``truth`` position."""
    key = F.col("id")
    failed = chance("error", key) < ERROR_SHARE
    dropped = chance("drop", key) < DROP_SHARE
    answered = rows.withColumn("p", teacher_probabilities(spec, F.col("truth"), key)).withColumn("g", gate(F.col("p"), spec))
    stale = F.sha2(F.concat(F.lit("old:"), key), 256)
    uncertain = F.col("g.status") == "uncertain"

    def unless_failed(column: Column) -> Column:
        return F.when(~failed, column)

    return answered.select(
        "seq",
        "id",
        F.when(chance("stale", key) < STALE_SHARE, stale).otherwise(F.col("content_hash")).alias("content_hash"),
        F.lit(spec.question_hash).alias("question_hash"),
        F.concat(F.lit("teacher-"), F.when(chance("who", key) < 0.5, F.lit("a")).otherwise(F.lit("b"))).alias("teacher"),
        F.when(failed, F.lit("error")).otherwise(F.col("g.status")).alias("status"),
        unless_failed(F.col("g.teacher_label")).alias("teacher_label"),
        F.when(~failed & ~(uncertain & dropped), F.col("g.label")).alias("label"),
        unless_failed(to_label_map(spec.label_names, F.col("p"))).alias("probabilities"),
        unless_failed(F.col("g.top")).alias("top"),
        unless_failed(F.col("g.margin")).alias("margin"),
        F.lit(None).cast("double").alias("teacher_confidence"),
        F.lit(None).cast("double").alias("act_probability"),
        F.when(failed, F.lit("timeout")).alias("reason"),
    ).select(*RECORD.fieldNames())


def document_records(spark: SparkSession, folder: str) -> DataFrame:
    truth = table(spark, folder, "labels").select(F.col("doc_id").alias("seq"), true_label().alias("truth"))
    rows = hashed_inputs(spark, folder).select("seq", "id", "content_hash")
    return records_of(rows.join(truth, "seq"), DOCUMENTS)


def conversation_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Grouped rows; a fifth of the conversations give one gold turn each."""
    group = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    is_gold = (F.col("turn") == 0) & (chance("gold", F.col("group")) < 0.2)
    named = table(spark, folder, "conversations").withColumn("group", group)
    return named.select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("seq"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.struct("text").alias("input"),
        "group",
        F.when(is_gold, F.col("role")).alias("gold"),
        "role",
    )


def hashed_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return with_content_hash(conversation_rows(spark, folder), CONVERSATIONS.fields)


def role_position() -> Column:
    return F.when(F.col("role") == "assistant", 0).when(F.col("role") == "system", 1).otherwise(2)


def conversation_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = hashed_conversations(spark, folder).select("seq", "id", "content_hash", role_position().alias("truth"))
    return records_of(rows, CONVERSATIONS)


def vector_table(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings with double values ``x`` and the label position."""
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("label_index")
    )


def vector_rows(spark: SparkSession, folder: str) -> DataFrame:
    key = F.concat(F.lit("vec-"), F.col("vec_id").cast("string"))
    named = vector_table(spark, folder).withColumn("id", key)
    is_gold = chance("gold", F.col("id")) < GOLD_SHARE
    return named.select(
        F.col("vec_id").alias("seq"),
        "id",
        F.struct(F.col("id").alias("key")).alias("input"),
        F.lit(None).cast("string").alias("group"),
        F.when(is_gold, name_at(VECTORS.label_names, F.col("label_index"))).alias("gold"),
        F.col("label_index").alias("truth"),
        "x",
    )


def hashed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return with_content_hash(vector_rows(spark, folder), VECTORS.fields)


def vector_records(spark: SparkSession, folder: str) -> DataFrame:
    return records_of(hashed_vectors(spark, folder).select("seq", "id", "content_hash", "truth"), VECTORS)


def vector_representations(spark: SparkSession, folder: str) -> DataFrame:
    """Option logits in reversed option order, and the whole vector as pooled."""
    k = len(VECTORS.labels)
    logits = F.reverse(F.transform(F.slice("x", 1, k), lambda v: v * 10.0))
    options = F.array(*[F.lit(o) for o in reversed(VECTORS.options)])
    return hashed_vectors(spark, folder).select(
        "seq", "id", "content_hash", logits.alias("logits"), options.alias("options"), F.col("x").alias("pooled"),
        F.lit("vectors-1").alias("source_fingerprint"), "truth",
    )
