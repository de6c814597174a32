"""One query per operator over the given tables."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import tasks as t
from pupilage.config import InputField, TaskSpec
from pupilage.functions import hashing
from pupilage.functions import probability as prob
from pupilage.functions.ngrams import hashed_vector
from pupilage.functions.text import normalize, words
from pupilage.operators import features, identity, jointfit, latency, ledger, metrics, parity, records, runs, split, student, teacher, validation
from pupilage.operators.keyed import lookup
from pupilage.plans import importing, score
from pupilage.plans import train as training
from pupilage.sources import dataset as dataset_source
from pupilage.sources import models
from pupilage.sources import records as record_source
from pupilage.sources import reports
from pupilage.sources.merkle import StoredTree
from pupilage.sources.storage import fresh_path
from pupilage.sources.tables import table
from pupilage.sources.versions import VersionedTable
from pupilage.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(column: Column | str) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, 6) + F.lit(0.0)


def position_columns(values: Column, names: list[str]) -> list[Column]:
    return [r6(values[i]).alias(n) for i, n in enumerate(names)]


# ---- identity ------------------------------------------------------------------


@query
def normalized_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2(normalize(F.col("text")), 256).alias("text_hash"))


@query
def tokenize(spark, folder):
    tokens = words(F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.sha2(F.array_join(tokens, " "), 256).alias("tokens_hash")
    )


@query
def rendered_input(spark, folder):
    return t.document_inputs(spark, folder).select("id", F.sha2(identity.rendered(t.DOCUMENTS.fields), 256).alias("rendered_hash"))


@query
def content_hash(spark, folder):
    return t.hashed_inputs(spark, folder).select("id", "content_hash")


@query
def unit_interval(spark, folder):
    return t.document_inputs(spark, folder).select("id", hashing.unit_interval(F.col("id")).alias("u"))


@query
def fnv_bucket(spark, folder):
    return table(spark, folder, "part").select("p_partkey", hashing.fnv_bucket(F.col("p_name"), 4096).alias("bucket"))


@query
def number_text(spark, folder):
    """Declared number fields rendered as text."""
    fields = (InputField("quantity", "number"), InputField("price", "number"), InputField("flag"))
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.struct(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag")).alias("input"),
    )
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(identity.rendered(fields)).alias("rendered"), F.count(F.lit(1)).alias("n"))


@query
def split_assignment(spark, folder):
    return identity.with_split(t.hashed_conversations(spark, folder), t.CONVERSATIONS).select("id", "split_key", "side")


@query
def cv_folds(spark, folder):
    return identity.with_fold(t.hashed_conversations(spark, folder), t.CONVERSATIONS, 5).select("id", F.col("fold").cast("bigint").alias("fold"))


@query
def fingerprint_small(spark, folder):
    line = identity.row_line(F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey"))
    return identity.fingerprint_small(table(spark, folder, "nation"), line, F.col("n_nationkey"))


@query
def fingerprint_dataset(spark, folder):
    return identity.fingerprint_ordered(t.hashed_documents(spark, folder), identity.dataset_line(), F.col("seq"))


@query
def fingerprint_incremental(spark, folder):
    """Three appends to a stored tree, the second of every seventh place between the others' rows: the root is that of the whole table."""
    rows = t.hashed_documents(spark, folder)
    tree = StoredTree(spark, fresh_path(spark, "tree"))
    late, half = F.col("seq") % 7 == 3, F.col("seq") % 1000 < 500
    for part in (rows.filter(half & ~late), rows.filter(late), rows.filter(~half & ~late)):
        tree.append(part, identity.dataset_line(), F.col("seq"))
    return tree.fingerprint()


@query
def fingerprint_labels(spark, folder):
    return identity.fingerprint_keyed(t.document_records(spark, folder), identity.label_line(), F.col("id"))


# ---- validation ----------------------------------------------------------------

CHECKED = (
    InputField("text", max_chars=4000),
    InputField("lang", max_chars=8),
    InputField("n_chars", "number"),
    InputField("flag", "boolean", required=False),
)


@query
def validate_input(spark, folder):
    """German rows carry an undeclared field, src0 rows lack the language, src1
    rows have a text where a boolean is declared."""
    source = F.col("source")
    document = F.to_json(
        F.struct(
            "text",
            F.when(source != "src0", F.col("lang")).alias("lang"),
            "n_chars",
            F.when(source == "src1", F.lit("yes")).alias("flag"),
            F.when(F.col("lang") == "de", source).alias("source"),
        )
    )
    checked = validation.validate_input(table(spark, folder, "documents").select("doc_id", document.alias("input")), CHECKED)
    return checked.select("doc_id", F.array_join("violations", "; ").alias("violations"))


@query
def validate_rows(spark, folder):
    """Group is the e-mail like customer name padded or emptied by segment."""
    spec = t.GATED
    name = F.col("c_name")
    rows = table(spark, folder, "customer").select(
        F.when(F.col("c_acctbal") < 0, F.concat(name, F.lit(" !"))).otherwise(name).alias("id"),
        F.when(F.col("c_nationkey") == 3, F.lit("")).when(F.col("c_nationkey") == 4, F.repeat(name, 10)).otherwise(name).alias("group"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("allow")).when(F.col("c_mktsegment") == "MACHINERY", F.lit("never")).alias("gold"),
        "c_custkey",
    )
    return validation.validate_rows(rows, spec).select("c_custkey", F.array_join("violations", "; ").alias("violations"))


@query
def duplicate_ids(spark, folder):
    keyed = table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("id"))
    return validation.duplicate_ids(keyed)


@query
def strict_keys(spark, folder):
    marked = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.regexp_replace("props", "^\\{", '{"z": 1, "a": null, ')).otherwise(F.col("props")).alias("props"),
    )
    strict = validation.strict_keys(marked, "props", ["k"])
    return strict.select("event_id", F.array_join("unknown_keys", ",").alias("unknown_keys"))


@query
def read_dataset(spark, folder):
    """Rows written as JSON lines and read back through all checks."""
    path = fresh_path(spark, "dataset")
    dataset_source.write_dataset(t.conversation_rows(spark, folder), path)
    read = dataset_source.read_dataset(spark, path, t.CONVERSATIONS)
    return identity.with_content_hash(read, t.CONVERSATIONS.fields).select("id", "content_hash", "group", "gold")


# ---- records, ledger ------------------------------------------------------------


def event_records(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as a label log: user is the row, event the record."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("id"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("content_hash"),
        F.lit(t.GATED.question_hash).alias("question_hash"),
        F.concat(F.lit("teacher-"), kind).alias("teacher"),
        F.when(kind == "error", F.lit("error")).when(F.col("value") < 10, F.lit("uncertain")).otherwise(F.lit("accepted")).alias("status"),
        F.when(kind != "error", kind).alias("teacher_label"),
        F.when((kind != "error") & (F.col("value") >= 5), kind).alias("label"),
        F.lit(None).cast("map<string,double>").alias("probabilities"),
        F.lit(None).cast("double").alias("top"),
        F.lit(None).cast("double").alias("margin"),
        F.lit(None).cast("double").alias("teacher_confidence"),
        F.lit(None).cast("double").alias("act_probability"),
        F.lit(None).cast("string").alias("reason"),
    )


SHOWN = ("id", "seq", "status", "label", "teacher")


@query
def latest_per_id(spark, folder):
    return records.latest_per_id(event_records(spark, folder)).select(*SHOWN)


@query
def label_store(spark, folder):
    """Append twice, then read: the last record per id wins."""
    store = record_source.LabelStore(spark, fresh_path(spark, "labels"))
    log = event_records(spark, folder)
    store.append(log.filter(F.col("status") != "accepted"))
    store.append(log.filter(F.col("status") == "accepted"))
    return store.latest().select(*SHOWN)


@query
def merge_labels(spark, folder):
    """Uncertain records replace the merged base of all others, by id."""
    log = event_records(spark, folder)
    store = record_source.LabelStore(spark, fresh_path(spark, "labels"))
    store.append(log.filter(F.col("status") != "uncertain"))
    store.merge(log.filter(F.col("status") == "uncertain"))
    return store.latest().select(*SHOWN)


@query
def read_labels(spark, folder):
    path = fresh_path(spark, "labels-json")
    record_source.write_labels(t.document_records(spark, folder), path)
    return record_source.read_labels(spark, path).select("id", "content_hash", "status", "label", "teacher", r6("top").alias("top"))


@query
def join_labels(spark, folder):
    joined = records.join_labels(t.hashed_documents(spark, folder), t.document_records(spark, folder), t.DOCUMENTS)
    return joined.select("id", "outcome", F.col("label_index").cast("bigint").alias("label_index"))


@query
def current_labels(spark, folder):
    return records.current_labels(t.hashed_documents(spark, folder), t.document_records(spark, folder), t.DOCUMENTS).select("id")


@query
def pending(spark, folder):
    return records.pending(t.hashed_documents(spark, folder), t.document_records(spark, folder), t.DOCUMENTS).select("id")


@query
def first_pending(spark, folder):
    """A labeling run with a limit: the first 25 pending rows in order."""
    hashed = t.hashed_documents(spark, folder)
    return records.pending_requests(hashed, t.document_records(spark, folder), t.DOCUMENTS, limit=25).select("seq", "id")


@query
def request_table(spark, folder):
    hashed = t.hashed_inputs(spark, folder)
    asked = records.request_table(hashed, t.DOCUMENTS, identity.rendered(t.DOCUMENTS.fields))
    return asked.select(
        "seq", "id", "question_hash", "question_type", F.array_join("options", " | ").alias("options"), F.sha2("state", 256).alias("state_hash")
    )


@query
def teacher_identities(spark, folder):
    return records.teacher_identities(t.document_records(spark, folder))


@query
def labeling_summary(spark, folder):
    return records.labeling_summary(t.document_records(spark, folder))


@query
def usage(spark, folder):
    """Input tokens of a request are the words of its text."""
    asked = t.document_inputs(spark, folder).select("id", F.size(words(F.col("input.text"))).alias("input_tokens"))
    return records.usage(t.document_records(spark, folder).select("id", "teacher").join(asked, "id"))


def ledger_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Two ledger lines per labelled document, the second one final, and
    ghosts for items no dataset row has."""
    spec = t.DOCUMENTS
    key = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    truth = table(spark, folder, "labels").select(F.col("doc_id"), key.alias("id"), t.true_label().alias("truth"))
    u = t.chance("ledger", F.col("id"))
    p = t.teacher_probabilities(spec, F.col("truth"), F.col("id"))
    status = F.when(u < 0.1, F.lit("failed")).when(u < 0.2, F.lit("forbidden")).otherwise(F.lit("labeled"))
    # One line in ten of the labelled ones does not sum to 1.
    shown = F.when(u > 0.92, F.transform(p, lambda v: v / 2)).otherwise(p)
    final = truth.select(
        (F.col("doc_id") * 2 + 1).alias("seq"), "id", status.alias("status"),
        F.when(status == "labeled", prob.to_label_map(spec.label_names, shown)).alias("probabilities"),
        F.when(status == "labeled", F.lit("m-2")).alias("answered_model"),
        F.when(status == "failed", F.repeat(F.lit("rate limited "), 30)).alias("error"),
    )
    first = truth.select(
        (F.col("doc_id") * 2).alias("seq"), "id", F.lit("failed").alias("status"),
        F.lit(None).cast("map<string,double>").alias("probabilities"), F.lit(None).cast("string").alias("answered_model"), F.lit("timeout").alias("error"),
    )
    ghosts = table(spark, folder, "benchmark").select(
        (F.lit(1 << 40) + F.col("item_id")).alias("seq"), F.concat(F.lit("ghost-"), F.col("item_id").cast("string")).alias("id"), F.lit("forbidden").alias("status"),
        F.lit(None).cast("map<string,double>").alias("probabilities"), F.lit(None).cast("string").alias("answered_model"), F.lit(None).cast("string").alias("error"),
    )
    lines = first.unionByName(final).unionByName(ghosts)
    return lines.select(
        "seq", F.lit("teacher.labels").alias("ledger"), F.lit(1).alias("ledger_version"), "id", "status", F.lit(None).cast("string").alias("choice"),
        "probabilities", F.lit("m-1").alias("requested_model"), "answered_model", "error",
    )


def imported(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = ledger_lines(spark, folder)
    latest = records.latest_per_id(lines)
    matched = ledger.match_ledger(t.hashed_documents(spark, folder), latest)
    return lines, latest, ledger.import_records(matched, t.DOCUMENTS)


@query
def ledger_import(spark, folder):
    _, _, found = imported(spark, folder)
    return found.select("id", "outcome", "status", "label", "teacher", r6("top").alias("top"), r6("margin").alias("margin"), "reason")


@query
def import_summary(spark, folder):
    return ledger.import_summary(*imported(spark, folder))


@query
def unknown_ledger_ids(spark, folder):
    return ledger.unknown_ledger_ids(records.latest_per_id(ledger_lines(spark, folder)), t.document_inputs(spark, folder))


@query
def missing_rows(spark, folder):
    return ledger.missing_rows(t.document_inputs(spark, folder), records.latest_per_id(ledger_lines(spark, folder)))


@query
def validate_ledger(spark, folder):
    """Ledger lines checked against a task with other labels and statuses."""
    spec = t.DOCUMENTS
    broken = broken_lines(spark, folder)
    matched = ledger.match_ledger(t.hashed_documents(spark, folder), records.latest_per_id(broken))
    return ledger.validate_ledger(matched, spec).select("id", F.array_join("violations", "; ").alias("violations"))


def broken_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Some lines lack a label, some have an unknown status, some an undeclared choice."""
    u = t.chance("break", F.col("id"))
    lines = ledger_lines(spark, folder).withColumn(
        "probabilities", F.when(u < 0.1, F.map_filter("probabilities", lambda k, v: k != "toxic")).otherwise(F.col("probabilities"))
    )
    return lines.withColumn("status", F.when(u > 0.95, F.lit("waiting")).otherwise(F.col("status"))).withColumn("choice", F.when(u.between(0.2, 0.3), F.lit("bad")))


@query
def import_labels(spark, folder):
    """Import a ledger with wrong lines: they are refused, the rest is gated and stored."""
    store = record_source.LabelStore(spark, fresh_path(spark, "imported-labels"))
    importing.import_labels(t.hashed_documents(spark, folder), broken_lines(spark, folder), t.DOCUMENTS, store, "drop")
    return store.latest().select("id", "status", "label", "teacher", r6("top").alias("top"))


@query
def read_ledger(spark, folder):
    """Two appends of many files each: the second has the final lines."""
    path = fresh_path(spark, "ledger")
    lines = ledger_lines(spark, folder)
    first = F.col("seq") % 2 == 0
    lines.filter(first).drop("seq").write.json(path)
    lines.filter(~first).drop("seq").write.mode("append").json(path)
    latest = record_source.read_ledger(spark, path, "teacher.labels", 1)
    return latest.select("id", "status", "answered_model")


@query
def read_labels_appended(spark, folder):
    """The second append is larger, so it is read first; its records win all the same."""
    path = fresh_path(spark, "labels-json")
    found = t.document_records(spark, folder)
    record_source.write_labels(found.filter("length(id) < 7").withColumn("teacher", F.lit("before")), path)
    record_source.write_labels(found, path)
    return record_source.read_labels(spark, path).select("id", "status", "teacher")


@query
def merge_with_late_append(spark, folder):
    """An append that lands while a merge is running is still there afterwards."""
    log = event_records(spark, folder)
    store = record_source.LabelStore(spark, fresh_path(spark, "labels"))
    store.append(log.filter(F.col("status") == "accepted"))
    merge = store.prepare(spark.createDataFrame([], records.RECORD))
    store.append(log.filter(F.col("status") != "accepted"))
    store.commit(merge)
    return store.latest().select(*SHOWN)


@query
def merge_conflict(spark, folder):
    """Two merges begin at one state: the second commit is refused and made again on top of the first."""
    log = event_records(spark, folder)
    store = record_source.LabelStore(spark, fresh_path(spark, "labels"))
    store.append(log.filter(F.col("status") == "accepted"))
    first = store.prepare(log.filter(F.col("status") == "uncertain"))
    second = store.prepare(log.filter(F.col("status") == "error"))
    store.commit(first)
    try:
        store.commit(second)
    except record_source.Conflict:
        store.merge(log.filter(F.col("status") == "error"))
    return store.latest().select(*SHOWN, F.lit(store.generation()).alias("merges"))


@query
def merge_touched_buckets(spark, folder):
    """A merge of every 50th user rewrites the buckets of those users and leaves the others where they were."""
    log = event_records(spark, folder)
    store = record_source.LabelStore(spark, fresh_path(spark, "labels"), buckets=64)
    store.append(log)
    store.compact()
    before = store.state()[1]["buckets"]
    few = log.filter((F.regexp_extract("id", "[0-9]+", 0).cast("bigint") % 50 == 0) & (F.col("status") == "accepted"))
    store.merge(few)
    after = store.state()[1]["buckets"]
    moved = spark.createDataFrame([(int(b), before.get(b) != gen) for b, gen in after.items()], "bucket int, rewritten boolean")
    bucket = record_source.bucket_of(F.col("id"), 64).alias("bucket")
    asked = few.select(bucket, F.lit(True).alias("asked")).distinct()
    found = moved.join(asked, "bucket", "left").agg(
        F.count_if(F.col("rewritten") & F.col("asked").isNull()).alias("needless"), F.count_if(~F.col("rewritten") & F.col("asked")).alias("missed")
    )
    return store.latest().select(*SHOWN).crossJoin(F.broadcast(found))  # one row beside each


@query
def upsert_stream_replay(spark, folder):
    """Two batches, then the first one again: nothing changes."""
    log = event_records(spark, folder)
    store = record_source.LabelStore(spark, fresh_path(spark, "replayed"))
    early = log.filter(F.col("status") != "accepted")
    store.append(early, tag="stream-000000000000")
    store.append(log.filter(F.col("status") == "accepted"), tag="stream-000000000001")
    store.append(early, tag="stream-000000000000")
    store.compact()
    store.append(early, tag="stream-000000000000")
    return store.latest().select(*SHOWN)


# ---- split -----------------------------------------------------------------------


@query
def dedupe(spark, folder):
    """Copies with one teacher label collapse, others are dropped."""
    truth = table(spark, folder, "labels").select(F.col("doc_id").alias("seq"), t.true_label().alias("label"))
    labeled = t.hashed_documents(spark, folder).join(truth, "seq").select("seq", "id", "content_hash", "label")
    return split.dedupe(labeled).filter(~F.col("conflict")).select("id", "content_hash", F.col("label").cast("bigint").alias("label"), "copies")


@query
def dedupe_conflicts(spark, folder):
    sources = table(spark, folder, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("label"))
    labeled = t.hashed_documents(spark, folder).join(sources, "seq").select("seq", "id", "content_hash", "label")
    return split.dedupe_report(split.dedupe(labeled))


def document_contents(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_contents(t.hashed_documents(spark, folder), t.document_records(spark, folder), t.DOCUMENTS)


def conversation_contents(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_contents(t.hashed_conversations(spark, folder), t.conversation_records(spark, folder), t.CONVERSATIONS)


@query
def split_report(spark, folder):
    return split.split_report(document_contents(spark, folder))


@query
def split_report_grouped(spark, folder):
    return split.split_report(conversation_contents(spark, folder))


@query
def split_kept(spark, folder):
    kept = split.kept_rows(conversation_contents(spark, folder))
    return kept.select("id", "split", "split_key", F.col("label_index").cast("bigint").alias("label_index"))


@query
def row_outcomes(spark, folder):
    labeled = split.label_rows(t.hashed_documents(spark, folder), t.document_records(spark, folder), t.DOCUMENTS)
    outcomes = split.row_outcomes(labeled, split.assign_splits(split.by_content(labeled), t.DOCUMENTS))
    return outcomes.select("id", "outcome", "split")


@query
def gold_overlap(spark, folder):
    rows = t.hashed_conversations(spark, folder)
    pool, gold = rows.filter(F.col("gold").isNull()), rows.filter(F.col("gold").isNotNull())
    return split.flag_gold_overlap(pool, gold).select("id", "gold_content", "gold_group")


@query
def exclude_gold_overlap(spark, folder):
    rows = t.hashed_documents(spark, folder)
    pool, gold = rows.filter(F.col("gold").isNull()), rows.filter(F.col("gold").isNotNull())
    return split.exclude_gold_overlap(pool, gold).select("id")


@query
def train_overlap(spark, folder):
    """Rows whose content an earlier training run has already seen."""
    rows = t.hashed_documents(spark, folder)
    seen = t.chance("trained", F.col("id")) < 0.6
    return split.flag_trained(rows.filter(~seen), rows.filter(seen)).select("id", "was_trained")


@query
def group_straddle(spark, folder):
    """Turns assigned on their own instead of by group do straddle."""
    rows = t.hashed_conversations(spark, folder)
    alone = rows.withColumn("side", F.when(t.chance("alone", F.col("id")) < 0.25, F.lit("holdout")).otherwise(F.lit("train")))
    return split.straddling_groups(alone)


@query
def disjoint_check(spark, folder):
    """Contents shared by pool and gold before the leakage controls."""
    rows = t.hashed_documents(spark, folder)
    return split.shared_keys(rows.filter(F.col("gold").isNull()), rows.filter(F.col("gold").isNotNull()), "content_hash")


@query
def union_parts(spark, folder):
    kept = split.kept_rows(document_contents(spark, folder))
    parts = [kept.filter(F.col("split") == side) for side in ("train", "holdout", "gold")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query
def coverage_check(spark, folder):
    found = split.coverage(split.kept_rows(document_contents(spark, folder)), t.DOCUMENTS)
    return found.withColumn("train_labels", F.col("train_labels").cast("bigint"))


# ---- teacher answers --------------------------------------------------------------


def three_way(spark: SparkSession, folder: str) -> DataFrame:
    scaled = F.transform(F.slice("x", 1, 3), lambda v: v * 10.0)
    return t.vector_table(spark, folder).select("vec_id", prob.softmax(scaled).alias("p"))


@query
def valid_probabilities(spark, folder):
    """Every third vector class is left unnormalised."""
    broken = F.when(F.col("label_index") == 3, F.transform("p", lambda v: v * 1.03)).when(F.col("label_index") == 6, F.slice("p", 1, 2)).otherwise(F.col("p"))
    joined = three_way(spark, folder).join(t.vector_table(spark, folder).select("vec_id", "label_index"), "vec_id")
    return joined.select("vec_id", prob.valid_probabilities(broken, 3).alias("valid"))


@query
def confidence_gate(spark, folder):
    return three_way(spark, folder).select("vec_id", prob.gate(F.col("p"), t.GATED).alias("g")).select(
        "vec_id", "g.status", "g.teacher_label", "g.label", r6("g.top").alias("top"), r6("g.margin").alias("margin")
    )


@query
def top_two(spark, folder):
    p = F.col("p")
    return three_way(spark, folder).select(
        "vec_id", prob.argmax(p).cast("bigint").alias("best"), r6(F.array_max(p)).alias("top"), r6(prob.runner_up(p)).alias("second")
    )


@query
def answer_mapping(spark, folder):
    """One answer in three question types, back in label order."""
    names = t.GATED.label_names
    two = TaskSpec("two", "1", "Yes?", (InputField("key"),), t.labels_of("no", "yes"), t.Gate("noul", 0.5, "drop"))
    levels = TaskSpec("levels", "1", "How much?", (InputField("key"),), t.labels_of("low", "mid", "high"), t.Gate("score", 0.5, "drop"))
    p = F.col("p")
    shuffled = F.map_from_arrays(F.array(*[F.lit(n) for n in (names[2], names[0], names[1])]), F.array(p[2], p[0], p[1]))
    by_level = F.map_from_arrays(F.array(F.lit("0"), F.lit("1"), F.lit("2")), p)
    empty = F.lit(None).cast("map<string,double>")
    nothing = F.lit(None).cast("double")
    mapped = three_way(spark, folder).select(
        "vec_id",
        prob.answer_to_probabilities(t.GATED, shuffled, nothing).alias("choice"),
        prob.answer_to_probabilities(levels, by_level, nothing).alias("score"),
        prob.answer_to_probabilities(two, empty, p[0]).alias("noul"),
        prob.answer_to_probabilities(t.GATED, F.map_filter(shuffled, lambda k, v: v > 0.1), nothing).isNull().alias("incomplete"),
    )
    return mapped.select(
        "vec_id",
        *position_columns(F.col("choice"), ["choice_0", "choice_1", "choice_2"]),
        *position_columns(F.col("score"), ["score_0", "score_1", "score_2"]),
        *position_columns(F.col("noul"), ["noul_0", "noul_1"]),
        "incomplete",
    )


BY_TYPE = {"choice": 1.2, "score": 9.0, "noul": 1.0}
BY_OPTIONS = {"choice:3-5": 0.3, "choice:6-10": 2.0}


@query
def calibrated_answers(spark, folder):
    """Five logits per vector; the bucket's temperature 0.3 is raised to 0.5."""
    logits = F.transform(F.slice("x", 1, 5), lambda v: v * 4.0)
    named = [f"o{i}" for i in range(5)]
    rows = t.vector_table(spark, folder).select("vec_id", logits.alias("logits"))
    choice = teacher.decoded_answers(rows, "choice", named, BY_TYPE, BY_OPTIONS)
    level = teacher.decoded_answers(rows, "score", named, BY_TYPE, BY_OPTIONS).select("vec_id", F.col("score").alias("level"), F.col("p")[0].alias("level_0"))
    flat = choice.select("vec_id", "choice", "confidence", F.col("p")[0].alias("p_0"), F.col("p")[4].alias("p_4"))
    return flat.join(level, "vec_id")


@query
def act_features(spark, folder):
    return three_way(spark, folder).select("vec_id", prob.act_features(F.col("p")).alias("a")).select(
        "vec_id", r6("a.top").alias("top"), r6("a.gap").alias("gap"), r6("a.entropy").alias("entropy"), r6("a.count_share").alias("count_share")
    )


@query
def entropy_confidence(spark, folder):
    return three_way(spark, folder).select("vec_id", r6(prob.entropy_confidence(F.col("p"))).alias("confidence"))


@query
def label_order(spark, folder):
    ordered = prob.label_order(F.col("logits"), F.col("options"), t.VECTORS)
    return t.vector_representations(spark, folder).select("id", r6(ordered[0]).alias("first"), r6(ordered[9]).alias("last"))


# ---- features -----------------------------------------------------------------------


@query
def ngram_tokens(spark, folder):
    tokens = features.ngram_tokens(t.conversation_rows(spark, folder), t.CONVERSATIONS.fields, ["id"])
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def term_counts(spark, folder):
    return features.term_counts(t.conversation_rows(spark, folder), t.CONVERSATIONS.fields, 512)


@query
def l2_normalize(spark, folder):
    counts = features.term_counts(t.conversation_rows(spark, folder), t.CONVERSATIONS.fields, 512)
    return features.l2_normalize(counts).select("id", "bucket", r6("value").alias("value"))


@query
def hashed_ngrams(spark, folder):
    """The row-local vector form, opened up into (row, index, value)."""
    from pyspark.ml.functions import vector_to_array

    rows = t.conversation_rows(spark, folder).select("id", hashed_vector(t.CONVERSATIONS.fields, 512).alias("v"))
    cells = rows.select("id", F.posexplode(vector_to_array("v")).alias("bucket", "value")).filter(F.col("value") != 0)
    return cells.select("id", F.col("bucket").cast("bigint").alias("bucket"), r6("value").alias("value"))


def vector_cache(spark: SparkSession, folder: str) -> DataFrame:
    return features.dense_features(t.vector_representations(spark, folder), t.VECTORS)


@query
def dense_features(spark, folder):
    cells = vector_cache(spark, folder).select("content_hash", F.posexplode("dense").alias("dimension", "x"))
    return cells.select("content_hash", F.col("dimension").cast("bigint").alias("dimension"), r6("x").alias("x"))


@query
def scored_representations(spark, folder):
    """A user's batch scorer, run once per distinct document content."""
    rows = t.hashed_inputs(spark, folder)

    def scorer(batches):
        for frame in batches:
            sizes = frame["input"].map(lambda value: float(len(value["text"])))
            yield frame[["content_hash"]].assign(
                logits=sizes.map(lambda n: [n, -n, 0.0]), options=[["a", "b", "c"]] * len(frame), pooled=sizes.map(lambda n: [n / 2])
            )

    found = features.representations_from(features.distinct_content(rows), scorer, "lengths-1")
    return found.select("content_hash", F.col("logits")[0].alias("n_chars"), F.col("pooled")[0].alias("half"), "source_fingerprint")


@query
def attach_features(spark, folder):
    """Per distinct content one feature, looked up again for every row."""
    rows = t.hashed_inputs(spark, folder)
    cache = features.distinct_content(rows).select("content_hash", F.size(words(F.col("input.text"))).cast("bigint").alias("n_tokens"))
    return features.attach_features(rows.select("id", "content_hash"), cache)


@query
def feature_statistics(spark, folder):
    stats = features.feature_statistics(t.vector_table(spark, folder).select("x"), "x")
    return stats.select(F.col("dimension").cast("bigint").alias("dimension"), r6("mean").alias("mean"), r6("sd").alias("sd"))


@query
def standardize(spark, folder):
    rows = t.vector_table(spark, folder)
    mean, sd = features.collect_statistics(rows, "x", 64)
    scaled = rows.select("vec_id", features.standardize(F.col("x"), mean, sd).alias("z"))
    return scaled.select("vec_id", F.posexplode("z").alias("dimension", "value")).select(
        "vec_id", F.col("dimension").cast("bigint").alias("dimension"), r6("value").alias("value")
    )


@query
def hybrid_features(spark, folder):
    """Standardised vectors, then hashed n-grams of the key, in one vector."""
    from pyspark.ml.functions import vector_to_array

    rows, cache = t.hashed_vectors(spark, folder), vector_cache(spark, folder)
    mean, sd = features.collect_statistics(cache, "dense", 74)
    descriptor = features.FeatureDescriptor("hybrid", 74 + 64, mean, sd, t.VECTORS.question_hash, "vectors-1")
    vectors = features.with_features(rows, descriptor, t.VECTORS, cache).select("id", vector_to_array("features").alias("v"))
    cells = vectors.select("id", F.posexplode("v").alias("position", "value")).filter(F.col("value") != 0)
    return cells.select("id", F.col("position").cast("bigint").alias("position"), r6("value").alias("value"))


# ---- training, metrics -----------------------------------------------------------------


def rule_model(classes: int = 10, dimensions: int = 64) -> student.LinearModel:
    """Weights from a plain rule, so SQL can score with them too."""
    c, i = np.indices((classes, dimensions))
    k = np.arange(classes)
    return student.LinearModel(((c * 31 + i * 7) % 11 - 5) / 10.0, ((k * 5) % 7 - 3) / 10.0)


def vector_features(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return t.vector_table(spark, folder).select("vec_id", "label_index", array_to_vector("x").alias("features"))


@query
def class_weights(spark, folder):
    truth = table(spark, folder, "labels").select(t.true_label().alias("label_index"))
    weights = metrics.class_weights(truth, 4)
    return weights.select(F.col("label_index").cast("bigint").alias("label_index"), r6("weight").alias("weight"))


def gradient_table(spark: SparkSession, folder: str, model: student.LinearModel) -> DataFrame:
    rows = student.weighted_rows(vector_features(spark, folder), 10, "balanced")
    sums = student.gradient_sums(rows, model)
    return sums.select(
        F.col("class").cast("bigint").alias("class_index"), F.col("index").cast("bigint").alias("dimension"),
        r6("gradient").alias("gradient"), r6("loss").alias("loss"), r6("weight").alias("weight"),
    )


@query
def gradient_at_zero(spark, folder):
    return gradient_table(spark, folder, student.LinearModel(np.zeros((10, 64)), np.zeros(10)))


@query
def gradient_step(spark, folder):
    return gradient_table(spark, folder, rule_model())


@query
def adam_step(spark, folder):
    """The parity mode after one epoch from zero; the bias is left out, since
    balanced weights make its first gradient zero."""
    spec = dataclasses.replace(t.VECTORS, student=dataclasses.replace(t.VECTORS.student, epochs=1, learning_rate=0.05, class_weighting="balanced"))
    fitted = jointfit.fit_student(vector_features(spark, folder), spec, 64, 0.01, "adam")
    weights = spark.createDataFrame(models.weight_table(fitted.model)).filter(F.col("index") >= 0)
    return weights.select(F.col("class").cast("bigint").alias("class_index"), F.col("index").cast("bigint").alias("dimension"), r6("weight").alias("weight"))


@query
def fit_optimum(spark, folder):
    """The default fit ends where the gradient vanishes, and says so."""
    spec = dataclasses.replace(t.VECTORS, student=dataclasses.replace(t.VECTORS.student, epochs=200, class_weighting="balanced"))
    rows = vector_features(spark, folder)
    fitted = jointfit.fit_student(rows, spec, 64, 0.05)
    _, *gradient = student.loss_and_gradient(student.weighted_rows(rows, 10, "balanced"), fitted.model, 0.05)
    steepest = max(float(np.abs(g).max()) for g in gradient)
    counts = rows.agg(F.count(F.lit(1)).alias("examples"), F.countDistinct("label_index").alias("classes"))
    return counts.select("examples", "classes", F.lit(fitted.converged).alias("converged"), F.lit(steepest < 2e-3).alias("flat"))


@query
def save_load_predict(spark, folder):
    """A stored student predicts what its rule says."""
    path = fresh_path(spark, "student")
    models.save_model(models.Student(t.VECTORS, features.FeatureDescriptor("embedding", 64, (0.0,) * 64, (1.0,) * 64, t.VECTORS.question_hash, "vectors-1"), rule_model(), {}), spark, path)
    loaded = models.load_model(spark, path)
    models.check_compatible(loaded, "vectors-1")
    served = student.prediction_rows(student.with_probabilities(vector_features(spark, folder), loaded.model), loaded.spec, ("vec_id",))
    return served.select("vec_id", "classifier", "version", "label", "argmax", "confidence", "abstained", F.col("probabilities")["c3"].alias("p_c3"))


@query
def compatible_sources(spark, folder):
    """Documents as representations of their source: how many rows each source has, and which of three students may read them."""

    def made_from(name: str, source: str) -> models.Student:
        spec = dataclasses.replace(t.VECTORS, name=name)
        return models.Student(spec, features.FeatureDescriptor("embedding", 64, (0.0,) * 64, (1.0,) * 64, spec.question_hash, source), rule_model(), {})

    students = score.registry([made_from("zero", "src0"), made_from("one", "src1"), rule_student(t.CONVERSATIONS, "words", 0)])
    rows = table(spark, folder, "documents").select(F.col("source").alias("source_fingerprint"))
    return models.sources_for(rows, students).select(F.col("source_fingerprint").alias("source"), "rows", "students")


def rule_scored(spark: SparkSession, folder: str) -> DataFrame:
    return student.with_probabilities(vector_features(spark, folder), rule_model())


@query
def predict_probabilities(spark, folder):
    cells = rule_scored(spark, folder).select("vec_id", F.posexplode("p").alias("class_index", "p"))
    return cells.select("vec_id", F.col("class_index").cast("bigint").alias("class_index"), r6("p").alias("p"))


@query
def prediction_rows(spark, folder):
    served = student.prediction_rows(rule_scored(spark, folder), t.VECTORS, ("vec_id",))
    return served.select("vec_id", "classifier", "version", "label", "argmax", "confidence", "abstained", F.col("probabilities")["c3"].alias("p_c3"))


def rule_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rule_scored(spark, folder).select(
        "vec_id", F.col("label_index").alias("reference"), prob.argmax(F.col("p")).alias("predicted"), "p"
    )


@query
def confusion(spark, folder):
    cells = metrics.confusion(rule_pairs(spark, folder), 10)
    return cells.select(F.col("reference").cast("bigint").alias("reference"), F.col("predicted").cast("bigint").alias("predicted"), "n")


@query
def class_metrics(spark, folder):
    found = metrics.class_metrics(rule_pairs(spark, folder), 10)
    return found.select(
        F.col("label_index").cast("bigint").alias("label_index"), r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support"
    )


@query
def metrics_overall(spark, folder):
    found = metrics.metrics(rule_pairs(spark, folder), 10)
    return found.select("examples", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query
def majority_label(spark, folder):
    truth = table(spark, folder, "labels").select(t.true_label().alias("label_index"))
    return metrics.majority_label(truth).select(F.col("label_index").cast("bigint").alias("label_index"), "n")


@query
def majority_baseline(spark, folder):
    """The majority of the training rows, measured on the gold rows."""
    kept = split.kept_rows(document_contents(spark, folder))
    first = metrics.majority_label(kept.filter(F.col("split") == "train")).first()
    gold = kept.filter(F.col("split") == "gold").select(F.col("label_index").alias("reference"))
    found = metrics.metrics(metrics.with_constant_prediction(gold, first and first["label_index"]), 3)
    return found.select("examples", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query
def abstain_rate(spark, folder):
    served = prob.index_of(t.VECTORS.label_names, prob.served_label(F.col("p"), t.VECTORS)["label"])
    return metrics.abstain_rate(rule_pairs(spark, folder).select(served.alias("served"), F.col("predicted").alias("argmax"))).select(
        r6("abstain_rate").alias("abstain_rate")
    )


@query
def teacher_on_gold(spark, folder):
    """The teacher's own and its gated label on gold rows with a current record."""
    spec = t.DOCUMENTS
    labels = t.document_records(spark, folder)
    gold = t.hashed_documents(spark, folder).filter(F.col("gold").isNotNull())
    current = records.current_labels(gold, labels, spec).select("id", prob.index_of(spec.label_names, F.col("gold")).alias("reference"))
    said = current.join(labels.select("id", "teacher_label", "label"), "id")
    views = F.array(
        F.struct(F.lit("raw").alias("view"), prob.index_of(spec.label_names, F.col("teacher_label")).alias("predicted")),
        F.struct(F.lit("gated").alias("view"), prob.index_of(spec.label_names, F.col("label")).alias("predicted")),
    )
    pairs = said.select("reference", F.explode(views).alias("v")).select("v.view", "reference", "v.predicted").filter(F.col("predicted").isNotNull())
    return metrics.metrics(pairs, 3, ("view",)).select("view", "examples", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query
def zero_shot(spark, folder):
    """Argmax of the label-ordered raw logits, measured on gold."""
    gold = t.hashed_vectors(spark, folder).filter(F.col("gold").isNotNull()).select("id", "content_hash", F.col("truth").alias("reference"))
    joined = features.attach_features(gold, vector_cache(spark, folder))
    found = metrics.metrics(joined.select("reference", prob.argmax(F.slice("dense", 1, 10)).alias("predicted")), 10)
    return found.select("examples", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query
def best_candidate(spark, folder):
    """Per user the event with the highest value, then the best user of all."""
    return training.best_candidate(table(spark, folder, "events").select(F.col("value").alias("accuracy"), F.col("event_id").cast("double").alias("l2")))


# ---- order, latency, parity --------------------------------------------------------------


@query
def error_runs(spark, folder):
    log = table(spark, folder, "events").withColumn("is_error", F.col("event_type") == "error")
    found = runs.error_runs(log.select("event_id", "user_id", "is_error"), "user_id", "is_error", "event_id", chunk=1000)
    return found.select("event_id", "run_length")


@query
def stop_after_errors(spark, folder):
    log = table(spark, folder, "events").withColumn("is_error", F.col("event_type").isin("error", "view"))
    return runs.stop_after_errors(log.select("event_id", "user_id", "is_error"), "user_id", "is_error", 5, "event_id").select("event_id", "user_id")


@query
def latency_summary(spark, folder):
    return latency.latency_summary(table(spark, folder, "events"), "event_type", "value")


@query
def keyed_lookup(spark, folder):
    """A lookup whose busiest keys are taken out of the shuffle."""
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return lookup(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), people, "o_custkey", "o_orderkey")


@query
def answer_parity(spark, folder):
    """Answers against themselves rounded to one decimal; ten classes differ in
    which side lacks the answer."""
    names = t.GATED.label_names
    base = three_way(spark, folder).join(t.vector_table(spark, folder).select("vec_id", "label_index"), "vec_id")

    def answers(p: Column, act: Column) -> list[Column]:
        return [
            F.col("vec_id").cast("string").alias("case"), F.lit("q").alias("question"), F.lit("choice").alias("type"),
            prob.name_at(names, prob.argmax(p)).alias("choice"), prob.to_label_map(names, p).alias("probabilities"), act.alias("act_probability"),
        ]

    rough = F.transform("p", lambda v: F.round(v, 1))
    expected = base.filter(F.col("label_index") != 1).select(*answers(F.col("p"), F.col("p")[0]))
    actual = base.filter(F.col("label_index") != 2).select(*answers(rough, F.col("p")[0] + 0.01))
    found = parity.answer_parity(expected, actual)
    return found.select("case", "answered", "same_choice", r6("max_gap").alias("max_gap"), "agrees")


# ---- whole workflows ------------------------------------------------------------------------


@query
def fit_predict(spark, folder):
    """Fit on the training rows of the documents task, predict all documents."""
    spec = t.DOCUMENTS
    rows = t.document_rows(spark, folder)
    kept = training.split_rows(rows, t.document_records(spark, folder), spec).kept
    descriptor = features.FeatureDescriptor("hashed", spec.student.hash_dimensions)
    featured = training.featured_rows(kept.filter(F.col("split") == "train"), rows, descriptor, spec, None)
    result = jointfit.fit_student(featured, spec, descriptor.dimensions, spec.student.l2)
    fitted = models.Student(spec, descriptor, result.model, {})
    return score.predict(rows, fitted).select("id", "label", "argmax", "confidence", "abstained")


def vector_training(spark: SparkSession, folder: str):
    return training.train(
        t.vector_rows(spark, folder), t.vector_records(spark, folder), t.VECTORS, vector_cache(spark, folder), "vectors-1"
    )


@query
def select_l2(spark, folder):
    """Cross-validated accuracy per candidate of the vector task's grid."""
    fitted, _ = vector_training(spark, folder)
    chosen = fitted.training["selection"]["candidates"]
    rows = [(float(l2), float(accuracy), l2 == fitted.training["l2"]) for l2, accuracy in chosen]
    return spark.createDataFrame(rows, "l2 double, accuracy double, chosen boolean")


@query
def train_evaluate(spark, folder):
    """At the published setting: 4,096 dimensions and a grid of three."""
    spec = dataclasses.replace(t.DOCUMENTS, student=dataclasses.replace(t.DOCUMENTS.student, hash_dimensions=4096, l2_grid=(0.0001, 0.001, 0.01)))
    _, evaluation = training.train(t.document_rows(spark, folder), t.document_records(spark, folder), spec)
    return evaluation.report


@query
def full_report(spark, folder):
    """Train, evaluate, write the whole report and read it back: every count in it that does not depend on the weights, and the sum of each model's confusion cells."""
    spec = dataclasses.replace(t.DOCUMENTS, student=dataclasses.replace(t.DOCUMENTS.student, epochs=20))
    _, evaluation = training.train(t.document_rows(spark, folder), t.document_records(spark, folder), spec, with_fingerprints=False)
    path = fresh_path(spark, "full-report")
    document = training.full_report(evaluation, spec)
    reports.write_report_document(document, path)
    read = spark.read.schema(document.schema).json(path)
    cells = read.filter("section = 'confusion'").groupBy("section", "model").agg(F.lit("all").alias("name"), F.sum("value").alias("value"), F.lit(None).cast("string").alias("text"))
    known = (F.col("section") == "split") | (F.col("name") == "n") | F.col("name").endswith(".support") | (F.col("name") == "teacher")
    return read.filter(known & (F.col("section") != "confusion")).unionByName(cells)


@query
def selection_folds(spark, folder):
    """Cross-validation of the document task: what each fit is tested on, and whether the best candidate (ties: the stronger) was chosen."""
    spec = dataclasses.replace(t.DOCUMENTS, student=dataclasses.replace(t.DOCUMENTS.student, l2_grid=(0.0001, 0.01, 1.0), epochs=20))
    rows = t.document_rows(spark, folder)
    kept = training.split_rows(rows, t.document_records(spark, folder), spec).kept
    descriptor = features.FeatureDescriptor("hashed", spec.student.hash_dimensions)
    selection = training.select_l2(training.featured_rows(kept.filter(F.col("split") == "train"), rows, descriptor, spec, None), spec, descriptor.dimensions)
    found = spark.createDataFrame([(f.l2, f.fold, f.hits, f.tested) for f in selection.tests], "l2 double, fold long, hits long, tested long")
    pooled = found.groupBy("l2").agg((F.sum("hits") / F.sum("tested")).alias("accuracy"))
    best = pooled.agg(F.max(F.struct("accuracy", "l2"))["l2"].alias("best"))
    return found.crossJoin(F.broadcast(best)).select("l2", "fold", "tested", (F.col("best") == selection.l2).alias("chosen"), (F.col("hits") <= F.col("tested")).alias("fits"))


@query
def save_load_evaluate(spark, folder):
    """Train dense, store, load, evaluate again, write and read the report."""
    fitted, _ = vector_training(spark, folder)
    path = fresh_path(spark, "student")
    models.save_model(fitted, spark, path)
    loaded = models.load_model(spark, path)
    again = training.evaluate(loaded, t.vector_rows(spark, folder), t.vector_records(spark, folder), vector_cache(spark, folder))
    out = fresh_path(spark, "report")
    reports.write_report(again.report, out)
    return spark.read.schema(again.report.schema).json(out)


def rule_student(spec: TaskSpec, name: str, shift: int) -> models.Student:
    """A hashed student with weights from a rule."""
    dimensions = spec.student.hash_dimensions
    c, i = np.indices((len(spec.labels), dimensions))
    model = student.LinearModel((((c + shift) * 31 + i * 7) % 11 - 5) / 10.0, np.zeros(len(spec.labels)))
    named = dataclasses.replace(spec, name=name)
    return models.Student(named, features.FeatureDescriptor("hashed", dimensions), model, {"teacher": "rule"})


def two_students() -> dict[str, models.Student]:
    return score.registry([rule_student(t.CONVERSATIONS, "first", 0), rule_student(t.CONVERSATIONS, "second", 1)])


@query
def score_many(spark, folder):
    served = score.score_many(t.conversation_rows(spark, folder), two_students())
    return served.select("id", "classifier", "label", "confidence")


def dense_student(name: str, scheme: str, weights: np.ndarray, dense: int, mean: float, sd: float) -> models.Student:
    """A student of the vector task with weights from a rule."""
    spec = dataclasses.replace(t.VECTORS, name=name, student=dataclasses.replace(t.VECTORS.student, features=scheme))
    found = features.FeatureDescriptor("hashed", weights.shape[1]) if scheme == "hashed" else features.FeatureDescriptor(
        scheme, weights.shape[1], (mean,) * dense, (sd,) * dense, spec.question_hash, "vectors-1"
    )
    return models.Student(spec, found, student.LinearModel(weights, np.arange(10) / 10.0), {"teacher": "rule"})


def three_layouts() -> dict[str, models.Student]:
    """Hashed words that do not count, the option logits, and logits with pooled values before hashed words."""
    c = np.arange(10)
    mixed = np.zeros((10, 74 + 32))
    mixed[c, c], mixed[c, 30 + c] = 0.2, 6.0
    return score.registry([
        dense_student("by-words", "hashed", np.zeros((10, 32)), 0, 0.0, 1.0),
        dense_student("by-logits", "logits", np.eye(10), 10, 0.0, 1.0),
        dense_student("by-both", "hybrid", mixed, 74, 0.25, 2.0),
    ])


@query
def score_many_dense(spark, folder):
    """Students of three layouts over one looked-up representation."""
    served = score.score_many(t.vector_rows(spark, folder), three_layouts(), representations=t.vector_representations(spark, folder), fingerprint="vectors-1")
    return served.select("id", "classifier", "label", "argmax", "confidence")


@query
def score_named_dense(spark, folder):
    """Each vector names the student that scores it."""
    names = F.array(*[F.lit(n) for n in ("by-words", "by-logits", "by-both")])
    rows = t.vector_rows(spark, folder).withColumn("wanted", F.get(names, (F.col("seq") % 3).cast("int")))
    served = score.score_many(rows.select("id", "input", "wanted"), three_layouts(), "wanted", representations=t.vector_representations(spark, folder), fingerprint="vectors-1")
    return served.select("id", "classifier", "label", "argmax", "confidence")


@query
def score_named(spark, folder):
    """Each row names the student that scores it."""
    rows = t.conversation_rows(spark, folder).withColumn("classifier", F.when(F.col("role") == "user", F.lit("first")).otherwise(F.lit("second")))
    served = score.score_many(rows.select("id", "input", F.col("classifier").alias("wanted")), two_students(), "wanted")
    return served.select("id", "classifier", "label", "confidence")


@query
def evaluate_student(spark, folder):
    """The whole report of a student with known weights on the turns task."""
    fixed = rule_student(t.CONVERSATIONS, t.CONVERSATIONS.name, 0)
    found = training.evaluate(fixed, t.conversation_rows(spark, folder), t.conversation_records(spark, folder))
    return found.report.select(F.col("position").cast("bigint").alias("position"), "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query
def write_predictions(spark, folder):
    path = fresh_path(spark, "predictions")
    served = score.predict(t.conversation_rows(spark, folder), two_students()["first"])
    reports.write_predictions(served, path)
    return spark.read.schema(served.schema).parquet(path).select("id", "label", "argmax", "abstained")


@query
def label_with_teacher(spark, folder):
    """Ask a batch teacher about every conversation turn, store and re-read."""
    spec = t.CONVERSATIONS
    names = spec.label_names
    store = record_source.LabelStore(spark, fresh_path(spark, "asked"))

    def answer(batches):
        for frame in batches:
            size = frame["state"].str.len() % 97 / 97.0
            rest = (1.0 - size) / 2
            yield frame[["seq", "id", "content_hash", "question_hash"]].assign(
                probabilities=[{names[0]: s, names[1]: r, names[2]: r} for s, r in zip(size, rest)],
                noul=float("nan"), confidence=size, act_probability=rest, error=None,
            )

    teacher.label(t.hashed_conversations(spark, folder), spec, teacher.Teacher("length", answer), store, state=F.col("input.text"))
    return store.latest().select("id", "status", "teacher_label", "label", r6("top").alias("top"), r6("margin").alias("margin"))


# ---- streams -----------------------------------------------------------------------------------


def streamed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = fresh_path(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def drained(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a stream over what is there and read its output table."""
    out = fresh_path(spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint")
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query
def score_stream(spark, folder):
    requests = t.conversation_rows(spark, folder).select("id", F.to_json("input").alias("input"))
    served = flows.score_stream(streamed(spark, requests, "requests"), two_students()["first"])
    return drained(served, spark, "served").select("id", "label", "argmax", "abstained")


@query
def quarantine_stream(spark, folder):
    """System turns lose their text and are set aside."""
    requests = t.conversation_rows(spark, folder).select(
        "id", F.when(F.col("role") == "system", F.lit("{}")).otherwise(F.to_json("input")).alias("input")
    )
    aside = flows.quarantine_stream(streamed(spark, requests, "requests"), two_students()["first"])
    return drained(aside, spark, "aside").select("id", F.array_join("violations", "; ").alias("violations"))


@query
def upsert_stream(spark, folder):
    store = record_source.LabelStore(spark, fresh_path(spark, "stream-labels"))
    incoming = streamed(spark, event_records(spark, folder), "incoming")
    writer = flows.upsert_labels(incoming, store, fresh_path(spark, "stream-checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    store.compact()
    return store.latest().select(*SHOWN)


@query
def pending_stream(spark, folder):
    incoming = streamed(spark, t.hashed_documents(spark, folder).select("id", "content_hash"), "rows")
    waiting = flows.pending_stream(incoming, t.document_records(spark, folder), t.DOCUMENTS)
    return drained(waiting, spark, "waiting").select("id")


@query
def pending_stream_fresh(spark, folder):
    """Half of the rows come, then half of the labels land, then the other rows come: each half meets the labels of its time."""
    rows = t.hashed_documents(spark, folder).select("id", "content_hash", (F.col("seq") % 2).alias("half"))
    said = t.document_records(spark, folder)
    store = record_source.LabelStore(spark, fresh_path(spark, "landing"))
    store.append(said.filter(t.chance("early", F.col("id")) < 0.5))
    incoming, out, checkpoint = (fresh_path(spark, name) for name in ("arriving", "still-pending", "pending-checkpoint"))
    for half in (0, 1):
        rows.filter(F.col("half") == half).drop("half").write.mode("append").parquet(incoming)
        stream = spark.readStream.schema("id string, content_hash string").parquet(incoming)
        flows.pending_fresh(stream, store, t.DOCUMENTS, out, checkpoint).trigger(availableNow=True).start().awaitTermination()
        store.append(said.filter(t.chance("early", F.col("id")) >= 0.5), tag="late")
    return spark.read.parquet(out).select("id", F.col("batch").cast("bigint").alias("half"))


@query
def score_stream_dense(spark, folder):
    """Representations of half of the vectors are there at first: the other half waits and is scored when it is sent again."""
    rows = t.vector_rows(spark, folder).select("id", F.to_json("input").alias("input"))
    said = t.vector_representations(spark, folder).select("id", "content_hash", "logits", "options", "pooled", "source_fingerprint")
    known = VersionedTable(spark, fresh_path(spark, "represented"), features.REPRESENTATION)
    early = t.chance("early", F.col("id")) < 0.5
    known.append(said.filter(early).drop("id"))
    requests, out, checkpoint = (fresh_path(spark, name) for name in ("requests", "scored-stream", "scored-checkpoint"))
    student_of = three_layouts()["by-both"]
    rows.write.parquet(requests)
    for _ in range(2):
        stream = spark.readStream.schema("id string, input string").parquet(requests)
        flows.score_fresh(stream, student_of, known, out, checkpoint).trigger(availableNow=True).start().awaitTermination()
        known.append(said.filter(~early).drop("id"), tag="late")
        waiting = spark.read.schema("id string, content_hash string").parquet(f"{out}/waiting/{flows.batch_folder('', 0)[1:]}")
        rows.join(waiting.select("id"), "id", "left_semi").write.mode("append").parquet(requests)
    return spark.read.parquet(f"{out}/scored").select("id", "label", "argmax", "confidence", F.col("batch").cast("bigint").alias("batch"))
