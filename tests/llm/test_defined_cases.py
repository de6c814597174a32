"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pupilage.llm import chat, edits, lattice, licenses, packing, quality, sharding, simhash, suffix, toxicity
from tests.llm import plain


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(15)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(0, "onti erre shnd blea than wh ing tion ouha ndst"), (1, None), (2, ""), (3, "short")], "item_id long, text string")


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.mark.parametrize("made", [plain.messy, plain.empty])
def test_classifiers(spark, made):
    docs = made(spark)
    count = docs.count()
    for module in (quality, toxicity):
        model = module.fit(docs, labels(spark), train_rows=5)
        found = module.scores(docs, model, "doc_id").collect()
        assert len(found) == count and all(0 <= r.score <= 1 for r in found)
        nothing = module.fit(docs, labels(spark).limit(0))
        assert all(abs(r.score - 0.5) < 1e-6 for r in module.scores(docs, nothing, "doc_id").collect())
    assert quality.accepted(docs, model=quality.fit(docs, labels(spark).limit(0)), least=0.3).count() == count
    assert quality.accepted(docs, quality.fit(docs, labels(spark))).columns == docs.columns
    assert {"doc_id", "start", "length", "score", "sentence"} == set(toxicity.sentences(docs, toxicity.fit(docs, labels(spark))).columns)


@pytest.mark.parametrize("made", [plain.messy, plain.empty])
def test_suffix(spark, made):
    docs = made(spark)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(docs).collect()), key=key)
    assert got == sorted(plain.substring_digests(rows_of(docs)), key=key)
    cut = suffix.cut(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    kept = {r.kept_sha256 for r in suffix.digests(docs).filter("doc_id <> 8 and doc_id <> 9").collect()}
    assert {hashlib.sha256((t or "").encode()).hexdigest() for k, t in rows_of(cut.filter("doc_id <> 8 and doc_id <> 9"))} <= kept


@pytest.mark.parametrize("made", [plain.messy, plain.empty])
def test_simhash(spark, made):
    docs = made(spark)
    rows = rows_of(docs.filter("length(text) < 100000 or text is null"))
    prints = [plain.simhash(text, 4) for _, text in rows]
    root = plain.components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {}
    for (doc, _), r in zip(rows, root):
        least[r] = min([x for x in (doc, least.get(r)) if x is not None], default=None)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [(r.doc_id, r.f0 % 2**64, r.component_id) for r in simhash.grouped(docs).filter("doc_id <> 11 or doc_id is null").collect()]
    assert sorted(got, key=key) == sorted(((doc, p, least[r]) for (doc, _), p, r in zip(rows, prints, root)), key=key)
    kept = simhash.survivors(docs)
    assert kept.columns == docs.columns
    if rows:
        texts = [t for _, t in rows_of(kept)]
        assert len(texts) == len(set(texts)) and sum((t or "").strip() == "" for t in texts) == 1


@pytest.mark.parametrize("made", [plain.messy, plain.empty])
def test_decontamination(spark, made):
    docs = made(spark)
    assert edits.report(docs, benchmark(spark)).count() == docs.count()
    clean = edits.clean(docs, benchmark(spark))
    assert clean.columns == docs.columns and clean.count() == edits.report(docs, benchmark(spark)).filter("not contaminated").count()
    assert edits.clean(docs, benchmark(spark).limit(0)).count() == docs.count()


@pytest.mark.parametrize("made", [plain.messy, plain.empty])
def test_packing(spark, made):
    docs = made(spark).filter("length(text) < 100000 or text is null")
    got = packing.packed(docs, tokenizer()).toPandas()
    assert got["length"].sum() == sum(n for n in got.groupby(["doc_id", "doc_tokens"], dropna=False)["length"].sum())
    counts = packing.tokenized(docs, tokenizer()).select("n").toPandas()
    assert got["length"].sum() == counts["n"].sum() and len(counts) == docs.count()
    if len(got):
        whole = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
        assert all((g["offset"].to_numpy() == g["length"].cumsum().shift(fill_value=0).to_numpy()).all() for _, g in whole)
        assert whole["length"].sum().max() <= packing.WINDOW


@pytest.mark.parametrize("made", [plain.messy, plain.empty])
def test_sharding(spark, made):
    docs = made(spark)
    got = sharding.placements(docs, shards=4, old_shards=3).collect()
    want = sorted(((d is None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows_of(docs)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("made", [plain.messy, plain.empty])
def test_licenses(spark, made):
    docs = made(spark).withColumn("path", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("/a/b/"), F.col("doc_id").cast("string"))))
    notice = spark.createDataFrame([(100, "prose\nReleased under the MIT License.", "/a/LICENSE"), (101, "Licensed under CC BY-NC 4.0.", "/a/b/own"), (102, "Licensed under the Apache License, Version 2.0.", "/c/LICENSE.txt")], "doc_id long, text string, path string")
    got = {(r.doc_id, r.license, r.inherited_from) for r in licenses.scan(docs.select("doc_id", "text", "path").unionAll(notice)).collect()}
    assert {(100, "MIT", None), (101, "CC-BY-NC-4.0", None), (102, "Apache-2.0", None)} <= got
    if docs.count():
        assert (5, "MIT", "/a") in got and (8, None, None) in got
    assert licenses.scan(docs).count() == docs.count()


def test_chat(spark):
    given = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (2, None, "assistant", ""), (None, 0, "tool", "[INST]"), (3, 0, "assistant", "a\\"), (3, 1, "assistant", "</s>")]
    rows = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(rows)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, 2: 1, None: 1, 3: 2}
    assert got[3].loss_sha256 == hashlib.sha256(b"a\\</s>").hexdigest() and got[3].loss_chars == 6
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\n\nx\n\nx\n").hexdigest()
    assert chat.read_back(chat.formatted(rows.limit(0))).count() == 0


def test_lattice(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    given = [(1, a, 0), (2, a, 0), (3, b, 0), (4, a, 1), (5, None, 0), (6, a, None), (7, [0.0] * 3, 0), (8, [1.0, float("nan"), 0.0], 0), (9, [1.0, None, 0.0], 0), (10, [1.0, 2.0], 0), (11, [], 0), (None, b, 0), (12, [-1.0, -2.0, -3.0], 0), (1, a, 0), (13, [1e-30, 2e-30, 3e-30], 0)]
    rows = spark.createDataFrame([(*r, 5) for r in given], "vec_id long, embedding array<float>, label int, node long")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(rows).collect()]
    linked = {(1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), (13, 5, 1, False), (None, 5, 1, True)}
    alone = {(k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12)}
    assert set(got) == linked | alone and len(got) == len(given)
    assert lattice.near_duplicates(rows.limit(0)).count() == 0


def test_pipeline_stages_on_messy_rows(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = plain.messy(spark).filter("length(text) < 100000 or text is null")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and after.count() <= docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
