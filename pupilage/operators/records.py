"""Teacher records: schema, last-wins, merging, joining to rows, pending rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pupilage.config import TaskSpec
from pupilage.functions.probability import index_of

RECORD = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("question_hash", T.StringType()),
        T.StructField("teacher", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("teacher_label", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("top", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("teacher_confidence", T.DoubleType()),
        T.StructField("act_probability", T.DoubleType()),
        T.StructField("reason", T.StringType()),
    ]
)
CHUNK = 1 << 16
USABLE = ("accepted", "uncertain_to_abstain")


def latest_per_id(df: DataFrame, key: str = "id", order: Column | str = "seq") -> DataFrame:
    """The last row per key. Partial aggregation keeps one row per key and
    task, so an id with very many records stays cheap."""
    position = F.col(order) if isinstance(order, str) else order
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), position).alias("_last")).select("_last.*")


def merge_records(new: DataFrame, base: DataFrame) -> DataFrame:
    """One row per id: the last new record, else the last base record."""
    ranked = new.withColumn("_rank", F.lit(1)).unionByName(base.withColumn("_rank", F.lit(0)))
    return latest_per_id(ranked, order=F.struct("_rank", "seq")).drop("_rank")


def sorted_by_id(df: DataFrame) -> DataFrame:
    """Globally ordered over many files: ranges of ids, each sorted."""
    return df.repartitionByRange(F.col("id")).sortWithinPartitions("id")


def outcome(spec: TaskSpec, question_hash: str) -> Column:
    """How a row's joined record (prefixed ``r_``) may be used.

    The order of the tests is the precedence. An accepted record whose label
    is not declared is a teacher error; an uncertain one is dropped.
    """
    declared = index_of(spec.label_names, F.col("r_label")).isNotNull()
    stale = ~(F.col("r_content_hash").eqNullSafe(F.col("content_hash")) & F.col("r_question_hash").eqNullSafe(F.lit(question_hash)))
    return (
        F.when(F.col("r_status").isNull(), F.lit("unlabeled"))
        .when(stale, F.lit("stale"))
        .when(F.col("r_status") == "error", F.lit("teacher_error"))
        .when((F.col("r_status") == "uncertain") & ~declared, F.lit("uncertain_dropped"))
        .when(F.col("r_status") == "uncertain", F.lit("uncertain_to_abstain"))
        .when(~declared, F.lit("teacher_error"))
        .otherwise(F.lit("accepted"))
    )


def join_labels(rows: DataFrame, labels: DataFrame, spec: TaskSpec) -> DataFrame:
    """Left join on id; adds ``outcome``, ``label_index`` and ``teacher``.

    ``rows`` has unique ids and ``labels`` one record per id.
    """
    wanted = ("content_hash", "question_hash", "status", "label", "teacher_label", "teacher")
    records = labels.select("id", *[F.col(c).alias(f"r_{c}") for c in wanted])
    joined = rows.join(records, "id", "left").withColumn("outcome", outcome(spec, spec.question_hash))
    index = F.when(F.col("outcome").isin(*USABLE), index_of(spec.label_names, F.col("r_label")))
    return joined.select(
        *rows.columns, "outcome", index.alias("label_index"), F.col("r_teacher_label").alias("teacher_label"),
        F.col("r_label").alias("record_label"), F.col("r_teacher").alias("teacher"),
    )


def current_labels(rows: DataFrame, labels: DataFrame, spec: TaskSpec) -> DataFrame:
    """Rows whose record answers the current content and question."""
    current = labels.filter(F.col("question_hash") == spec.question_hash).select("id", "content_hash")
    return rows.join(current, ["id", "content_hash"], "left_semi")


def pending(rows: DataFrame, labels: DataFrame, spec: TaskSpec) -> DataFrame:
    """Rows without a usable record; errors are asked again."""
    settled = labels.filter((F.col("question_hash") == spec.question_hash) & (F.col("status") != "error"))
    return rows.join(settled.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


def first_n(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows in ``seq`` order (unique, non-negative longs).

    Rows are not gathered or ordered: counts per chunk of sequence numbers find
    the chunk where the n-th row is, that chunk (of bounded size) gives the
    cut-off, and a filter does the rest, where the rows are.
    """
    if n is None:
        return df
    if n <= 0:
        return df.limit(0)
    chunked = df.select("seq", F.floor(F.col("seq") / CHUNK).cast("bigint").alias("chunk"))
    counts = chunked.groupBy("chunk").agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)))
    edge = upto.filter(F.col("upto") >= n).orderBy("chunk").first()
    if edge is None:
        return df
    inside = chunked.filter(F.col("chunk") == edge["chunk"]).orderBy("seq").limit(n - edge["upto"] + edge["c"])
    return df.filter(F.col("seq") <= inside.agg(F.max("seq").alias("last")).first()["last"])


def pending_requests(rows: DataFrame, labels: DataFrame, spec: TaskSpec, limit: int | None = None) -> DataFrame:
    return first_n(pending(rows, labels, spec), limit)


def request_table(rows: DataFrame, spec: TaskSpec, state: Column) -> DataFrame:
    """One question per row, ready for any batch teacher."""
    return rows.select(
        "seq",
        "id",
        "content_hash",
        F.lit(spec.question_hash).alias("question_hash"),
        F.lit(spec.teacher.question_type).alias("question_type"),
        F.lit(spec.instructions).alias("instructions"),
        F.array(*[F.lit(o) for o in spec.options]).alias("options"),
        state.alias("state"),
    )


def teacher_identities(df: DataFrame, alias: str = "teachers") -> DataFrame:
    """Sorted distinct teacher names, comma-joined."""
    return df.agg(F.array_join(F.array_sort(F.collect_set("teacher")), ",").alias(alias))


def usage(df: DataFrame) -> DataFrame:
    """Requests and summed input tokens per teacher."""
    return df.groupBy("teacher").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").cast("bigint").alias("input_tokens")
    )


def labeling_summary(records: DataFrame) -> DataFrame:
    """How one labeling run ended, as counts."""
    uncertain = F.col("status") == "uncertain"
    return records.agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if(uncertain & F.col("label").isNotNull()).alias("uncertain_to_abstain"),
        F.count_if(uncertain & F.col("label").isNull()).alias("uncertain_dropped"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
