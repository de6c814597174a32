import io
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from pupilage.config import DataError, DatasetSettings, Gate
from pupilage.operators import ledger, records, runs, split
from pupilage.operators.identity import fingerprint_small, hash_children, with_content_hash
from pupilage.operators.teacher import Teacher, label
from pupilage.plans import importing
from pupilage.sources import lines
from pupilage.sources.dataset import ordered_lines, read_dataset
from pupilage.sources.commits import CommitLog
from pupilage.sources.merkle import StoredTree
from pupilage.sources.records import Conflict, LabelStore, bucket_of, read_labels, read_ledger, read_ledger_lines, write_labels
from pupilage.sources.storage import bucketed
from pupilage.sources.versions import VersionedTable, pinned
from tests.fixtures import counts, ids, records_for, rows_of, task


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def line(row_id, status="labeled", shares=None, **more):
    """A line of the ledger "review" of model m-7; ``shares`` in the order of the labels."""
    said = {} if shares is None else {"probabilities": dict(zip(("allow", "deny", "ask"), shares)), "answered_model": "m-7"}
    return json.dumps({"ledger": "review", "ledger_version": 1, "id": row_id, "status": status, "requested_model": "m-6", "tokens": 11, **said, **more})


# Row 6 was refused before it was labelled, row 1 labelled before it was refused; rows 4, 8, 9 have no line.
LINES = [
    line("pool-6", "forbidden"),
    line("pool-2", shares=(0.2, 0.1, 0.7)),
    line("pool-1", shares=(0.1, 0.1, 0.8)),
    line("visitor-1", "failed", error="no route"),
    line("pool-7", "failed", error="w" * 300),
    line("pool-0", shares=(0.45, 0.4, 0.15)),
    line("pool-6", shares=(0.9, 0.1, 0.0)),
    line("pool-1", "forbidden"),
    line("pool-3", shares=(0.7, 0.7, 0.0)),
    line("visitor-2", shares=(0.0, 0.0, 1.0)),
    line("pool-5", shares=(0.0, 0.75, 0.25)),
]


def pool(spark, spec, n=9):
    return rows_of(spark, spec, [(f"pool-{i}", f"row {i}", None, None) for i in range(n)])


def test_ledger_import(spark, tmp_path):
    spec = task()
    rows = pool(spark, spec, 10)
    path = write(tmp_path, "ledger.jsonl", LINES)
    lines, latest = read_ledger_lines(spark, path, "review", 1), read_ledger(spark, path, "review", 1)
    matched = ledger.match_ledger(rows, latest)
    assert ledger.validate_ledger(matched, spec).filter(F.size("violations") > 0).isEmpty()
    found = ledger.import_records(matched, spec)
    summary = counts(ledger.import_summary(lines, latest, found))
    assert summary.pop("teacher") == "ledger:m-6,ledger:m-7"
    assert summary == dict(ledger_rows=11, imported=7, accepted=3, uncertain_to_abstain=1, uncertain_dropped=0, forbidden=1, failed=1, invalid=1, unknown_ids=2, missing=3)
    told = {r["id"]: (r["status"], r["teacher_label"], r["label"]) for r in found.collect()}
    assert told == {
        "pool-2": ("accepted", "ask", "ask"), "pool-5": ("accepted", "deny", "deny"), "pool-6": ("accepted", "allow", "allow"),
        "pool-0": ("uncertain", "allow", "ask"), "pool-1": ("error", None, None), "pool-3": ("error", None, None), "pool-7": ("error", None, None),
        "pool-4": (None, None, None), "pool-8": (None, None, None), "pool-9": (None, None, None),
    }
    assert len(found.filter("id = 'pool-7'").first()["reason"]) == 200

    store = LabelStore(spark, str(tmp_path / "labels"))
    for _ in range(2):
        result = importing.import_labels(rows, lines, spec, store)
    assert result.refused.isEmpty() and counts(result.summary)["imported"] == 7
    labels = store.latest()
    assert labels.count() == 7
    contents = split.split_contents(rows, labels, spec)
    assert ids(split.kept_rows(contents)) == {"pool-0", "pool-2", "pool-5", "pool-6"}
    assert ids(records.pending(rows, labels, spec)) == {f"pool-{i}" for i in (1, 3, 4, 7, 8, 9)}


def test_import_refuses_what_is_not_of_the_task(spark, tmp_path):
    spec = task()
    rows = pool(spark, spec, 5)
    wrong = [
        json.dumps({"ledger": "review", "ledger_version": 1, "id": "pool-0", "status": "labeled", "probabilities": {"allow": 0.6, "deny": 0.2, "ask": 0.1, "wait": 0.1}}),
        line("pool-1", "queued"),
        line("pool-2", shares=(0.1, 0.8, 0.1), choice="postpone"),
    ]
    path = write(tmp_path, "mixed.jsonl", [*wrong, line("pool-3", shares=(0.1, 0.8, 0.1), choice="deny")])
    lines = read_ledger_lines(spark, path, "review", 1)
    store = LabelStore(spark, str(tmp_path / "labels"))
    with pytest.raises(DataError, match="3 bad row"):
        importing.import_labels(rows, lines, spec, store)
    assert store.latest().isEmpty()
    assert importing.import_labels(rows, lines, spec, store, "drop").refused.isEmpty()
    assert ids(store.latest()) == {"pool-3"}
    assert ids(importing.import_labels(rows, lines, spec, store, "quarantine").refused) == {"pool-0", "pool-1", "pool-2"}
    with pytest.raises(DataError, match="expected ledger"):
        read_ledger(spark, path, "review", 2)


def test_order_follows_files_not_their_size(spark, tmp_path):
    """The later file is the larger one, and each is longer than a read task."""
    folder = tmp_path / "logs"
    folder.mkdir()
    for age, count in ((1, 3), (2, 4000), (3, 50)):
        text = "".join(line(f"pool-{k}", error=f"file {age}") + "\n" for k in range(count))
        (folder / f"z{9 - age}.jsonl").write_text(text)
        os.utime(folder / f"z{9 - age}.jsonl", (age, age))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        latest = {r["id"]: r["error"] for r in read_ledger(spark, str(folder), "review", 1).collect()}
        seqs = [r["seq"] for r in read_ledger_lines(spark, str(folder), "review", 1).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert latest == {f"pool-{k}": "file 3" if k < 50 else "file 2" for k in range(4000)}
    assert sorted(seqs) == list(range(4053))


def test_appended_labels_win_whatever_their_size(spark, tmp_path):
    spec = task()
    found = records_for(spark, spec, pool(spark, spec, 6))
    path = str(tmp_path / "labels-json")
    write_labels(found.filter("id = 'pool-2'").withColumn("label", F.lit("deny")), path)
    write_labels(found.withColumn("label", F.lit("ask")), path)
    assert {r["label"] for r in read_labels(spark, path).collect()} == {"ask"}


def test_dataset_reader(spark, tmp_path):
    spec = task()
    good = '{"id": "a", "input": {"request": "read"}, "gold": "allow"}'
    assert read_dataset(spark, write(tmp_path, "d.jsonl", [good, "", "  "]), spec).count() == 1
    bad = {
        "unknown field": '{"id": "a", "input": {"request": "read"}, "label": "allow"}',
        "id must match": '{"id": "a b", "input": {"request": "read"}}',
        "not a declared label": '{"id": "a", "input": {"request": "read"}, "gold": "maybe"}',
        "group must be": '{"id": "a", "input": {"request": "read"}, "group": ""}',
        "undeclared field": '{"id": "a", "input": {"request": "read", "extra": "x"}}',
        "request is required": '{"id": "a", "input": {"note": "x"}}',
        "must be of type string": '{"id": "a", "input": {"request": 3}}',
        "exceeds max_chars": json.dumps({"id": "a", "input": {"request": "a" * 201}}),
        "malformed JSON": '{"id": "a", ',
        "JSON object": '{"id": "a", "input": "text"}',
        "input must be a JSON object": '{"id": "a"}',
        "id must be of type string": '{"id": 7, "input": {"request": "read"}}',
    }
    for message, text in bad.items():
        path = write(tmp_path, "d.jsonl", [good.replace('"a"', '"z"'), text])
        with pytest.raises(DataError, match=message):
            read_dataset(spark, path, spec)
        assert ids(read_dataset(spark, path, spec, "drop")) == {"z"}
        assert read_dataset(spark, path, spec, "quarantine").filter(F.size("violations") > 0).count() == 1
    twice = write(tmp_path, "d.jsonl", [good, good])
    with pytest.raises(DataError, match="duplicate id"):
        read_dataset(spark, twice, spec)
    assert read_dataset(spark, twice, spec, "drop").count() == 1
    assert [r["seq"] for r in read_dataset(spark, twice, spec, "quarantine").filter(F.size("violations") > 0).collect()] == [1]
    with pytest.raises(DataError, match="2 rows, max_rows is 1"):
        read_dataset(spark, twice, task(dataset=DatasetSettings(max_rows=1)))
    with pytest.raises(DataError, match="exceeds 256 bytes"):
        long = json.dumps({"id": "a", "input": {"request": "r", "note": "n" * 300}})
        read_dataset(spark, write(tmp_path, "d.jsonl", [long]), task(dataset=DatasetSettings(max_line_bytes=256)))


def test_label_files(spark, tmp_path):
    spec = task()
    rows = pool(spark, spec, 4)
    path = str(tmp_path / "labels-json")
    assert read_labels(spark, path).isEmpty()
    write_labels(records_for(spark, spec, rows), path)
    assert read_labels(spark, path).count() == 4


def test_store_appends_replays_and_compacts(spark, tmp_path):
    spec = task()
    found = records_for(spark, spec, pool(spark, spec, 4))
    store = LabelStore(spark, str(tmp_path / "store"))
    assert store.latest().isEmpty()
    store.append(found, tag="batch-1")
    store.append(found, tag="batch-1")
    store.append(found.filter("id = 'pool-1'").withColumn("label", F.lit("ask")))
    assert store.records().count() == 5
    store.compact()
    assert store.generation() == 1 and store.records().count() == 4
    assert store.latest().filter("id = 'pool-1'").first()["label"] == "ask"
    store.append(found, tag="batch-1")
    assert store.latest().filter("id = 'pool-1'").first()["label"] == "ask"


def test_append_during_a_merge_is_not_lost(spark, tmp_path):
    spec = task()
    found = records_for(spark, spec, pool(spark, spec, 4))
    store = LabelStore(spark, str(tmp_path / "store"))
    store.append(found.filter("id <> 'pool-3'"))
    merge = store.prepare(found.filter("id = 'pool-0'").withColumn("label", F.lit("ask")))
    store.append(found.filter("id in ('pool-1', 'pool-3')").withColumn("label", F.lit("deny")), tag="late")
    store.commit(merge)
    assert {r["id"]: r["label"] for r in store.latest().collect()} == {"pool-0": "ask", "pool-1": "deny", "pool-2": "allow", "pool-3": "deny"}
    store.compact()
    assert store.generation() == 2 and store.records().count() == 4


def labelled(found, wanted, label):
    return found.filter(F.col("id").isin(wanted)).withColumn("label", F.lit(label))


def labels_in(store):
    return {r["id"]: r["label"] for r in store.latest().collect()}


def test_of_two_mergers_the_later_one_starts_again(spark, tmp_path):
    """Both begin at one state, from two sessions' stores; no record of either is lost, and an append between them stays."""
    spec = task()
    found = records_for(spark, spec, pool(spark, spec, 6))
    here, there = (LabelStore(spark, str(tmp_path / "store")) for _ in range(2))
    here.append(found)
    first, second = here.prepare(labelled(found, ["pool-0", "pool-1"], "ask")), there.prepare(labelled(found, ["pool-1", "pool-2"], "deny"))
    here.commit(first)
    here.append(labelled(found, ["pool-5"], "ask"))
    with pytest.raises(Conflict):
        there.commit(second)
    between = there.prepare

    def raced(records):
        """While the second merger writes, another merge commits once more."""
        merge = between(records)
        if here.generation() == 1:
            here.merge(labelled(found, ["pool-3"], "deny"))
        return merge

    there.prepare = raced
    assert there.merge(labelled(found, ["pool-1", "pool-2"], "deny")) == 1
    want = {r["id"]: r["label"] for r in found.collect()} | {"pool-0": "ask", "pool-1": "deny", "pool-2": "deny", "pool-3": "deny", "pool-5": "ask"}
    assert labels_in(here) == labels_in(there) == want and here.generation() == 3


def test_commits_are_made_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.newest() == (0, {})
    assert log.put(1, {"a": 1}) and not log.put(1, {"a": 2})
    assert log.newest() == (1, {"a": 1})
    with ThreadPoolExecutor(8) as many:
        won = list(many.map(lambda k: log.put(2, {"by": k}), range(8)))
    assert sum(won) == 1 and log.newest() == (2, {"by": won.index(True)})
    for number in range(3, 60):
        assert log.put(number, {"n": number})
    assert log.newest() == (59, {"n": 59}) and len(log.numbers()) <= 21
    assert not [n for n in os.listdir(tmp_path / "log") if n.startswith(".") and not n.endswith(".crc")]


def test_a_store_of_many_folded_appends_reads_few_files(spark, tmp_path):
    """Replays are still known, by writer and number, when their appends are folded and deleted."""
    spec = task()
    found = records_for(spark, spec, pool(spark, spec, 4)).coalesce(1)
    store = LabelStore(spark, str(tmp_path / "store"), buckets=4)
    for number in range(12):
        assert store.append(labelled(found, [f"pool-{number % 4}"], "ask"), writer="a", number=number)
        if number % 4 == 3:
            store.compact()
    assert not store.append(found, writer="a", number=7) and store.append(labelled(found, ["pool-2"], "deny"), writer="b", number=0)
    assert len(store.state()[1]["appends"]) == 1 and len(store.records().inputFiles()) <= 4 + 1
    store.compact()
    before = labels_in(store)
    assert store.vacuum(older_than=0) > 12
    assert labels_in(store) == before == {"pool-0": "ask", "pool-1": "ask", "pool-2": "deny", "pool-3": "ask"}
    folders = os.listdir(tmp_path / "store" / "data")
    assert len(folders) <= 4 and len(os.listdir(tmp_path / "store" / "log")) <= 2 * 21
    assert not store.append(found, writer="a", number=11)


def test_merge_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    spec = task()
    found = records_for(spark, spec, pool(spark, spec, 60))
    store = LabelStore(spark, str(tmp_path / "store"), buckets=32)
    store.merge(found)
    before, files = store.state()[1]["buckets"], set(store.records().inputFiles())
    own = {r["id"]: r["b"] for r in found.select("id", bucket_of(F.col("id"), 32).alias("b")).collect()}
    touched = {str(own["pool-7"]), str(own["pool-30"])}
    merge = store.prepare(labelled(found, ["pool-7", "pool-30"], "ask"))
    assert {str(b) for b in merge.buckets} == touched
    store.commit(merge)
    after = store.state()[1]["buckets"]
    assert {b for b in after if after[b] != before.get(b)} == touched
    assert len(set(store.records().inputFiles()) - files) == len(touched)
    want = {r["id"]: r["label"] for r in found.collect()} | {"pool-7": "ask", "pool-30": "ask"}
    assert labels_in(store) == want and store.records().count() == 60


def test_joining_bucketed_rows_to_merged_labels_needs_no_shuffle(spark, tmp_path):
    spec = task()
    rows = pool(spark, spec, 60)
    store = LabelStore(spark, str(tmp_path / "store"), buckets=8)
    store.merge(records_for(spark, spec, rows))
    placed = bucketed(rows, "id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(2):  # with one generation, and with one bucket rewritten
            joined = records.join_labels(placed, store.latest(), spec)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan
            assert sorted(joined.select("id", "outcome").collect()) == sorted(records.join_labels(rows, store.latest(), spec).select("id", "outcome").collect())
            store.merge(labelled(records_for(spark, spec, rows), ["pool-1"], "ask"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def teacher_of(answers):
    """``answers(text)`` gives probabilities or an error text."""

    def answer(batches):
        for frame in batches:
            said = [answers(state) for state in frame["state"]]
            yield frame[["seq", "id", "content_hash", "question_hash"]].assign(
                probabilities=[None if isinstance(s, str) else dict(zip(("allow", "deny", "ask"), s)) for s in said],
                noul=None, confidence=0.5, act_probability=0.25, error=[s if isinstance(s, str) else None for s in said],
            )

    return Teacher("fake-1", answer)


def test_labeling_resumes_and_asks_errors_again(spark, tmp_path):
    spec = task()
    rows = pool(spark, spec, 9)
    store = LabelStore(spark, str(tmp_path / "store"))
    said = teacher_of(lambda text: "offline" if "row 3" in text else (0.4, 0.35, 0.25) if "row 4" in text else (0.9, 0.05, 0.05))
    first = label(rows, spec, said, store, limit=5)
    assert (first["pending"], first["selected"], first["accepted"], first["uncertain_to_abstain"], first["errors"]) == (9, 5, 3, 1, 1)
    again = label(rows, spec, teacher_of(lambda text: (0.9, 0.05, 0.05)), store, round_rows=2)
    assert (again["pending"], again["accepted"], again["stop_reason"]) == (5, 5, None)
    record = store.latest().filter("id = 'pool-4'").first()
    assert record["status"] == "uncertain" and record["label"] == "ask" and record["teacher"] == "fake-1" and record["teacher_confidence"] == 0.5
    assert label(rows, spec, said, store)["pending"] == 0
    with pytest.raises(DataError):
        label(rows, task(teacher=Gate("choice", 0.6, "abstain", 0.2, "import")), said, store)


@pytest.mark.parametrize("round_rows", [2, 3, 100])
def test_labeling_stops_after_five_errors_in_a_row(spark, tmp_path, round_rows):
    spec = task()
    rows = pool(spark, spec, 9)
    store = LabelStore(spark, str(tmp_path / "store"))
    said = teacher_of(lambda text: (0.9, 0.05, 0.05) if "row 1" in text else "offline")
    summary = label(rows, spec, said, store, round_rows=round_rows)
    assert summary["errors"] == 6 and summary["stop_reason"]
    assert ids(store.latest()) == {f"pool-{i}" for i in range(7)}


def test_error_runs_across_chunks(spark):
    import random

    random.seed(5)
    data = [(i, f"run-{random.choice('aab')}", random.random() < 0.7) for i in range(400)]
    df = spark.createDataFrame(data, "seq bigint, run string, bad boolean")
    expected, current = {}, {}
    for seq, run, bad in data:
        current[run] = current.get(run, 0) + 1 if bad else 0
        expected[seq] = current[run]
    for chunk in (7, 64, 1 << 20):
        found = {r["seq"]: r["run_length"] for r in runs.error_runs(df, "run", "bad", chunk=chunk).collect()}
        assert found == expected


def test_latest_survives_repartition(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}", f"v{i}") for i in range(50)], "seq bigint, id string, v string")
    assert sorted(r["v"] for r in records.latest_per_id(df.repartition(9)).collect()) == ["v47", "v48", "v49"]


def test_hash_follows_the_declared_fields(spark):
    spec = task()
    assert with_content_hash(pool(spark, spec, 1).drop("content_hash"), spec.fields).first()["content_hash"]


def test_a_round_uses_all_cores(spark, tmp_path):
    from pyspark import TaskContext

    def answer(batches):
        for frame in batches:
            part = f"{TaskContext.get().partitionId()}"
            yield frame[["seq", "id", "content_hash", "question_hash"]].assign(probabilities=None, noul=None, confidence=0.5, act_probability=0.1, error=None).assign(
                probabilities=[{"allow": 0.9, "deny": 0.05, "ask": 0.05} if int(part) >= 0 else None] * len(frame), confidence=float(part)
            )

    spec = task()
    store = LabelStore(spark, str(tmp_path / "store"))
    assert label(pool(spark, spec, 1000), spec, Teacher("many", answer), store, round_rows=400)["accepted"] == 1000
    assert store.latest().select("teacher_confidence").distinct().count() > 1


def test_large_first_n_cuts_at_the_same_row(spark, monkeypatch):
    monkeypatch.setattr(records, "CHUNK", 16)
    df = spark.createDataFrame([(i * 3, f"r{i}") for i in range(60)], "seq bigint, id string").repartition(5)
    for n in (1, 4, 17, 33, 60, 99):
        assert ids(records.first_n(df, n)) == {f"r{i}" for i in range(min(n, 60))}


def test_latency_positions_with_ties(spark):
    import random

    from pupilage.operators.latency import latency_summary

    random.seed(8)
    data = [("hot", float(random.choice([1, 1, 1, 2, 3, 50]))) for _ in range(5000)] + [("one", 4.0), ("two", 1.0), ("two", 9.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    found = {r["g"]: r for r in latency_summary(df, "g", "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    for group in ("hot", "one", "two"):
        values = sorted(v for g, v in data if g == group)
        for q, column in ((0.0, "p0"), (0.5, "p50"), (0.95, "p95"), (1.0, "p100")):
            assert found[group][column] == values[min(len(values) - 1, int(len(values) * q))]
        assert (found[group]["n"], found[group]["min"], found[group]["max"]) == (len(values), values[0], values[-1])
    assert set(found) == {"hot", "one", "two"}


@pytest.mark.parametrize("small", [2, 40, 1 << 16])
def test_order_statistics_of_hostile_values(spark, small):
    """Heavy tails, clusters one bit apart, signed zeros, infinities, NaN, and a null group; few rows may be left at the end."""
    import math
    import struct

    from pupilage.operators.latency import latency_summary

    near = [struct.unpack("<d", struct.pack("<q", 4607182418800017408 + k))[0] for k in range(300)]
    groups = {
        "near": near * 2 + [1e300, -1e300],
        "tail": [math.copysign(10.0 ** (k % 600 - 300), (-1) ** k) for k in range(700)],
        "zeros": [0.0, -0.0] * 50 + [5e-324, -5e-324],
        "ends": [math.inf, -math.inf, math.nan, 1.0, math.nan],
        "same": [7.5] * 400,
        None: [3.0, 1.0, 2.0],
    }
    data = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    qs = (0.0, 0.25, 0.5, 0.95, 1.0)
    found = {r["g"]: r for r in latency_summary(df, "g", "v", qs, small).collect()}
    assert set(found) == set(groups)
    for group, values in groups.items():
        ordered = sorted((v for v in values if v == v)) + [v for v in values if v != v]
        for q in qs:
            want, got = ordered[min(len(ordered) - 1, int(len(ordered) * q))], found[group][f"p{round(q * 100)}"]
            assert want == got or (want != want and got != got)


def test_order_statistics_of_other_types(spark):
    import datetime
    from decimal import Decimal

    from pupilage.operators.latency import latency_summary

    data = [("a", k * 7919 % 101 - 50, Decimal(k * 7919 % 101 - 50) / 100, datetime.date(2020, 1, 1) + datetime.timedelta(k * 7919 % 101)) for k in range(101)]
    df = spark.createDataFrame(data, "g string, i bigint, d decimal(10,2), t date")
    for column, position in (("i", 1), ("d", 2), ("t", 3)):
        row = latency_summary(df, "g", column, (0.5,), 4).first()
        assert row["p50"] == sorted(r[position] for r in data)[50]
    with pytest.raises(DataError, match="no 64-bit order"):
        latency_summary(df, "i", "g")


def test_a_label_that_lands_between_two_batches_is_seen_by_the_second(spark, tmp_path):
    from pupilage.streaming import flows

    spec = task()
    rows = pool(spark, spec, 6)
    store, out, checkpoint = LabelStore(spark, str(tmp_path / "store")), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    store.append(records_for(spark, spec, rows).filter("id = 'pool-0'"))
    incoming = str(tmp_path / "incoming")
    for step in range(2):
        rows.filter(F.col("seq") % 2 == step).select("id", "content_hash").write.mode("append").parquet(incoming)
        stream = spark.readStream.schema("id string, content_hash string").parquet(incoming)
        flows.pending_fresh(stream, store, spec, out, checkpoint).trigger(availableNow=True).start().awaitTermination()
        store.append(records_for(spark, spec, rows).filter("id in ('pool-1', 'pool-2', 'pool-3')"))
    found = {(r["batch"], r["id"]) for r in spark.read.parquet(out).collect()}
    assert found == {(0, "pool-2"), (0, "pool-4"), (1, "pool-5")}
    # A replay of the first batch reads what it read then, though labels have come since.
    version = pinned(CommitLog(spark, f"{checkpoint}-pins"), 0, store.state()[0])
    assert version == 1 and ids(records.pending(rows.filter("seq % 2 = 0"), store.latest(version), spec)) == {"pool-2", "pool-4"}


def test_versions_of_a_growing_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "table"), "k long, v string")
    assert table.read().isEmpty()
    assert table.append(spark.createDataFrame([(1, "a")], "k long, v string"), "one") and not table.append(spark.createDataFrame([(9, "z")], "k long, v string"), "one")
    table.append(spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string"))
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 1), (1, "b", 2), (2, "c", 2)]
    assert [tuple(r) for r in table.read(1).collect()] == [(1, "a", 1)]


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_byte_ranges_have_every_line_once(monkeypatch, chunk):
    monkeypatch.setattr(lines, "CHUNK", chunk)
    text = "a\n\nlong line é漢\r\n\r\nb\n\n".encode() + b"x" * 20 + b"\r\nend"
    want, at = [], 0
    for part in text.split(b"\n"):
        if at < len(text):
            want.append((at, len(part.removesuffix(b"\r")), part.removesuffix(b"\r")))
        at += len(part) + 1
    for size in range(1, len(text) + 2):
        ranges = [(k, min(k + size, len(text))) for k in range(0, len(text), size)]
        assert [x for a, b in ranges for x in lines.lines_between(io.BytesIO(text), a, b, None)] == want
        cut = [x for a, b in ranges for x in lines.lines_between(io.BytesIO(text), a, b, 5)]
        assert [x[:2] for x in cut] == [x[:2] for x in want]
        assert all(x[2] == y[2] if y[1] <= 5 else x[2] == y[2][:6] for x, y in zip(cut, want))


def test_declared_files_keep_their_order_when_they_are_touched(spark, tmp_path):
    names = ["late.jsonl", "early.jsonl", "middle.jsonl"]
    paths = [write(tmp_path, n, [line(f"pool-{k}", error=n) for k in range(50)]) for n in names]
    for k, path in enumerate(paths):
        os.utime(path, (100 - k, 100 - k))
    assert {r["error"] for r in read_ledger(spark, paths, "review", 1).collect()} == {"middle.jsonl"}
    assert {r["error"] for r in read_ledger(spark, paths[::-1], "review", 1).collect()} == {"late.jsonl"}


def test_one_scan_of_the_text_and_packed_files(spark, tmp_path):
    import gzip

    path = write(tmp_path, "plain.jsonl", [line(f"pool-{k}") for k in range(30)])
    plan = ordered_lines(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.lower().replace("context", "") and "BatchScan" not in plan
    with gzip.open(tmp_path / "packed.jsonl.gz", "wt") as out:
        out.write(open(path).read())
    packed = [tuple(r) for r in ordered_lines(spark, str(tmp_path / "packed.jsonl.gz")).orderBy("seq").collect()]
    assert packed == [tuple(r) for r in ordered_lines(spark, path).orderBy("seq").collect()]


def test_a_very_long_line_is_not_held(tmp_path):
    """One line of a gigabyte: its length is known, a kilobyte of it is kept, in a process that may not take 400 MB."""
    import subprocess
    import sys

    path = tmp_path / "huge.jsonl"
    with open(path, "wb") as out:
        out.write(b"first\n")
        out.truncate(1 << 30)
        out.seek(1 << 30)
        out.write(b"\nlast\n")
    code = (
        "import resource, sys; from pupilage.sources.lines import lines_between\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "found = [(o, n, len(t)) for a in range(0, (1 << 30) + 7, 1 << 28) for o, n, t in lines_between(open(sys.argv[1], 'rb'), a, min(a + (1 << 28), (1 << 30) + 6), 1000)]\n"
        "print(found, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"
    )
    done = subprocess.run([sys.executable, "-c", code, str(path)], capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": os.getcwd()})
    found, grown = done.stdout.rsplit(" ", 1)
    assert found == str([(0, 5, 5), (6, (1 << 30) - 6, 1001), ((1 << 30) + 1, 4, 4)]) and int(grown) < 100_000


def test_a_stored_tree_follows_appends_without_reading_untouched_zones(spark, tmp_path, monkeypatch):
    """Fan 4: a zone has 16 places. The root equals that of a tree made at once; an append opens its own zones and those above."""
    rows = spark.createDataFrame([(k, f"row {k}") for k in range(200)], "seq long, text string")
    line, seq = F.col("text"), F.col("seq")
    at_once = StoredTree(spark, str(tmp_path / "once"), 4, 4)
    at_once.append(rows, line, seq)
    grown, opened = StoredTree(spark, str(tmp_path / "grown"), 4, 4), []
    stored = grown._stored
    monkeypatch.setattr(grown, "_stored", lambda state, level, zones: opened.append((level, tuple(zones))) or stored(state, level, zones))
    for low, high in ((0, 90), (95, 200), (90, 95)):
        opened.clear()
        grown.append(rows.filter(seq.between(low, high - 1)), line, seq)
    assert opened == [(0, (5,)), (1, (1,)), (2, (0,)), (3, (0,))]
    assert grown.fingerprint().first() == at_once.fingerprint().first()
    level = rows.select(seq.alias("k"), F.sha2(line, 256).alias("h"))
    for _ in range(4):
        level = hash_children(level, F.floor(F.col("k") / 4).cast("bigint"))
    assert grown.fingerprint().first() == fingerprint_small(level, F.col("h"), F.col("k")).first()
    other = StoredTree(spark, str(tmp_path / "other"), 4, 4)
    other.append(rows.withColumn("text", F.when(seq == 92, "changed").otherwise(line)), line, seq)
    assert other.fingerprint().first() != grown.fingerprint().first()
