"""Leakage controls and the train / holdout / gold split.

A content hash may have any number of copies, so nothing here gathers the
copies of one hash: every decision about them is an aggregate with map-side
partial results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pupilage.config import TaskSpec
from pupilage.functions.probability import index_of
from pupilage.operators.identity import with_split
from pupilage.operators.keyed import flag_members, lookup
from pupilage.operators.records import USABLE, join_labels


def dedupe(df: DataFrame, label: str = "label") -> DataFrame:
    """One row per content hash: the first copy, with ``copies`` and ``conflict``.

    A hash whose copies carry different labels is a conflict; callers drop it
    with ``filter(~conflict)``.
    """
    first = F.min_by(F.struct(*df.columns), F.col("seq"))
    grouped = df.groupBy(F.col("content_hash").alias("_key")).agg(
        first.alias("_first"),
        F.count(F.lit(1)).alias("copies"),
        # Copies without any label do not disagree.
        F.coalesce(F.min(label) != F.max(label), F.lit(False)).alias("conflict"),
    )
    return grouped.select("_first.*", "copies", "conflict")


def dedupe_report(deduped: DataFrame) -> DataFrame:
    return deduped.agg(
        F.count_if(~F.col("conflict")).alias("kept"),
        F.coalesce(F.sum(F.when(~F.col("conflict"), F.col("copies") - 1)), F.lit(0)).alias("duplicates_removed"),
        F.coalesce(F.sum(F.when(F.col("conflict"), F.col("copies"))), F.lit(0)).alias("conflicts_dropped"),
    )


def flag_gold_overlap(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds ``gold_content`` and ``gold_group``: what a pool row shares with gold."""
    by_hash = flag_members(pool, gold, "content_hash", "id", "gold_content")
    return flag_members(by_hash, gold, "group", "id", "gold_group")


def exclude_gold_overlap(pool: DataFrame, gold: DataFrame) -> DataFrame:
    flagged = flag_gold_overlap(pool, gold)
    return flagged.filter(~F.col("gold_content") & ~F.col("gold_group")).select(pool.columns)


def flag_trained(rows: DataFrame, trained: DataFrame) -> DataFrame:
    """Adds ``was_trained``: this content was in an earlier training set."""
    return flag_members(rows, trained, "content_hash", "id", "was_trained")


def exclude_trained(rows: DataFrame, trained: DataFrame) -> DataFrame:
    return flag_trained(rows, trained).filter(~F.col("was_trained")).select(rows.columns)


def label_rows(rows: DataFrame, labels: DataFrame, spec: TaskSpec) -> DataFrame:
    """Slim labelled rows: ids and hashes, outcome, label, group overlap.

    Gold rows carry their human label and the outcome ``gold``; pool rows that
    share a gold row's group are ``gold_overlap`` before labels are looked at.
    """
    slim = rows.select("seq", "id", "content_hash", "group", "gold")
    gold_groups = slim.filter(F.col("gold").isNotNull()).select("group")
    grouped = flag_members(slim, gold_groups, "group", "id", "gold_group")
    flagged = join_labels(grouped, labels, spec)
    is_gold = F.col("gold").isNotNull()
    outcome = F.when(is_gold, F.lit("gold")).when(F.col("gold_group"), F.lit("gold_overlap")).otherwise(F.col("outcome"))
    label = F.when(is_gold, index_of(spec.label_names, F.col("gold"))).otherwise(F.col("label_index"))
    return flagged.withColumn("outcome", outcome).withColumn("label_index", label)


def by_content(labeled: DataFrame) -> DataFrame:
    """Everything the split needs to know about one content hash, one row each."""
    is_gold = F.col("outcome") == "gold"
    usable = F.col("outcome").isin(*USABLE)

    def count(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome).alias(f"n_{outcome}")

    rank = F.when(is_gold, F.lit(0)).when(usable, F.lit(1))
    row = F.struct("id", "seq", "group", "label_index", "teacher", "teacher_label", "record_label")
    first = F.min_by(row, F.when(rank.isNotNull(), F.struct(rank, "seq")))
    return labeled.groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(is_gold).alias("n_gold"),
        F.count_if(usable).alias("n_usable"),
        *[count(o) for o in ("gold_overlap", "unlabeled", "stale", "teacher_error", "uncertain_dropped", "uncertain_to_abstain")],
        F.min(F.when(is_gold, F.col("label_index"))).alias("gold_low"),
        F.max(F.when(is_gold, F.col("label_index"))).alias("gold_high"),
        F.min(F.when(usable, F.col("label_index"))).alias("pool_low"),
        F.max(F.when(usable, F.col("label_index"))).alias("pool_high"),
        first.alias("first"),
    )


def assign_splits(contents: DataFrame, spec: TaskSpec, trained: DataFrame | None = None) -> DataFrame:
    """Adds ``n_candidates``, ``conflict``, ``split`` and ``was_trained`` per hash.

    Where a hash has gold rows they are the candidates and all pool copies
    count as gold overlap. Train rows are never filtered by ``trained``.
    """
    has_gold = F.col("n_gold") > 0
    low = F.when(has_gold, F.col("gold_low")).otherwise(F.col("pool_low"))
    high = F.when(has_gold, F.col("gold_high")).otherwise(F.col("pool_high"))
    flat = (
        contents.withColumn("n_candidates", F.when(has_gold, F.col("n_gold")).otherwise(F.col("n_usable")))
        .withColumn("conflict", (F.col("n_candidates") > 0) & (low != high))
        .withColumn("group", F.col("first.group"))
    )
    sided = with_split(flat, spec)
    if trained is None:
        marked = sided.withColumn("was_trained", F.lit(False))
    else:
        # Both sides have one row per hash, so this join cannot be skewed.
        known = trained.select("content_hash").distinct().withColumn("was_trained", F.lit(True))
        marked = sided.join(known, "content_hash", "left").withColumn("was_trained", F.coalesce("was_trained", F.lit(False)))
    kept = (F.col("n_candidates") > 0) & ~F.col("conflict")
    side = F.when(F.col("n_gold") > 0, F.lit("gold")).otherwise(F.col("side"))
    blocked = F.col("was_trained") & (side != "train")
    return marked.withColumn("train_overlap", kept & blocked).withColumn("split", F.when(kept & ~blocked, side)).drop("side")


def split_contents(rows: DataFrame, labels: DataFrame, spec: TaskSpec, trained: DataFrame | None = None) -> DataFrame:
    return assign_splits(by_content(label_rows(rows, labels, spec)), spec, trained)


def kept_rows(contents: DataFrame) -> DataFrame:
    """The rows of train, holdout and gold, without their inputs."""
    return contents.filter(F.col("split").isNotNull()).select(
        "split", "content_hash", "split_key", "first.*"
    )


def split_report(contents: DataFrame) -> DataFrame:
    """The thirteen counters, one row."""
    pool_only = F.col("n_gold") == 0

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    def pool_total(column: str) -> Column:
        return total(F.when(pool_only, F.col(column)))

    overlap = F.when(pool_only, F.col("n_gold_overlap")).otherwise(F.col("n_rows") - F.col("n_gold"))
    return contents.agg(
        total(F.col("n_rows")).alias("total"),
        F.count_if(F.col("split") == "gold").alias("gold"),
        total(overlap).alias("gold_overlap_excluded"),
        pool_total("n_unlabeled").alias("unlabeled"),
        pool_total("n_teacher_error").alias("teacher_errors"),
        pool_total("n_stale").alias("stale_labels"),
        pool_total("n_uncertain_to_abstain").alias("uncertain_to_abstain"),
        pool_total("n_uncertain_dropped").alias("uncertain_dropped"),
        total(F.when((F.col("n_candidates") > 0) & ~F.col("conflict"), F.col("n_candidates") - 1)).alias("duplicates_removed"),
        total(F.when(F.col("conflict"), F.col("n_candidates"))).alias("conflicts_dropped"),
        F.count_if(F.col("train_overlap")).alias("train_overlap_excluded"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "holdout").alias("holdout"),
    )


def row_outcomes(labeled: DataFrame, contents: DataFrame) -> DataFrame:
    """What became of every single row, for audit: ``outcome`` and ``split``."""
    facts = contents.select("content_hash", F.col("n_gold").alias("_gold"), "conflict", "train_overlap", "split", F.col("first.id").alias("_first"))
    joined = lookup(labeled, facts, "content_hash", "id")
    is_gold = F.col("outcome") == "gold"
    candidate = is_gold | (F.col("outcome").isin(*USABLE) & (F.col("_gold") == 0))
    is_first = F.col("id") == F.col("_first")
    outcome = (
        F.when(~is_gold & (F.col("_gold") > 0), F.lit("gold_overlap"))
        .when(candidate & F.col("conflict"), F.lit("conflict"))
        .when(candidate & ~is_first, F.lit("duplicate"))
        .when(candidate & F.col("train_overlap"), F.lit("train_overlap"))
        .otherwise(F.col("outcome"))
    )
    kept = candidate & is_first & F.col("split").isNotNull()
    return joined.select("id", "content_hash", outcome.alias("outcome"), F.when(kept, F.col("split")).alias("split"), "label_index")


def coverage(kept: DataFrame, spec: TaskSpec) -> DataFrame:
    """Train and holdout sizes, labels seen in training, labels never seen."""
    counts = kept.agg(
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "holdout").alias("holdout"),
        F.array_sort(F.collect_set(F.when(F.col("split") == "train", F.col("label_index")))).alias("seen"),
    )
    every = F.array(*[F.lit(i) for i in range(len(spec.labels))])
    names = F.array(*[F.lit(n) for n in spec.label_names])
    unseen = F.transform(F.array_except(every, "seen"), lambda i: F.element_at(names, i + 1))
    return counts.select("train", "holdout", F.size("seen").alias("train_labels"), F.array_join(unseen, ",").alias("labels_without_rows"))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present on both sides; empty when the two are disjoint."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def is_disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    return shared_keys(a, b, key).isEmpty()


def straddling_groups(assigned: DataFrame, side: str = "side") -> DataFrame:
    """Groups found on more than one side; min and max suffice and combine early."""
    grouped = assigned.filter(F.col("group").isNotNull()).groupBy("group").agg((F.min(side) != F.max(side)).alias("straddles"))
    return grouped.filter("straddles").select("group")
