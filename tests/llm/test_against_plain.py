"""Operators against plain versions, exact round trips and held-out labels."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pupilage.llm import chat, components, edits, lattice, packing, quality, sharding, simhash, suffix
from pupilage.llm.queries import QUERIES
from tests.llm import plain

FOLDER = "/root/testdata/sf0.01"


def test_transform_finds_all_repeats():
    rng = np.random.default_rng(0)
    for _ in range(60):
        base = bytes(rng.integers(97, 97 + rng.integers(1, 4), 60).astype(np.uint8))
        pieces = []
        for _ in range(rng.integers(1, 12)):
            a = rng.integers(0, 40)
            pieces.append(base[a : a + rng.integers(0, 30)] + bytes(rng.integers(97, 100, rng.integers(0, 10)).astype(np.uint8)))
        window = int(rng.integers(2, 9))
        count = Counter(p[k : k + window] for p in pieces for k in range(len(p) - window + 1))
        want = sorted((n, k) for n, p in enumerate(pieces) for k in range(len(p) - window + 1) if count[p[k : k + window]] > 1)
        assert sorted(zip(*(x.tolist() for x in suffix.repeated(pieces, window)))) == want


def test_suffix_with_hot_anchors(spark, monkeypatch):
    """A common passage between different contexts, with the limit so low that anchors are divided twice."""
    monkeypatch.setattr(suffix, "LIMIT", 5)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(230))
    word = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    rows = [(k, word(rng.randint(0, 300)) + passage + word(rng.randint(0, 300))) for k in range(40)]
    rows += [(100 + k, passage[k : k + 201]) for k in range(6)] + [(200, "z" * 900), (201, "ab" * 300)]
    got = suffix.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain.substring_digests(rows))


def test_suffix_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in suffix.digests(docs).collect())
    assert got == sorted(plain.substring_digests([(r.doc_id, r.text) for r in docs.collect()]))


@pytest.mark.parametrize("limit", [0, 4, 9])
def test_index_finds_all_close_pairs(limit):
    rng = np.random.default_rng(limit)
    centre = rng.integers(0, 2**63, 40).astype(np.uint64)
    words = np.unique(np.concatenate([centre ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(15)]))[:, None]
    bucket = rng.integers(0, 3, len(words))
    want = {(i, j) for i, j in itertools.combinations(range(len(words)), 2) if bucket[i] == bucket[j] and int(words[i, 0] ^ words[j, 0]).bit_count() <= limit}
    got = {tuple(sorted(p)) for i, j in simhash.Index(bucket, words).pairs(limit) for p in zip(i.tolist(), j.tolist())}
    assert got == want


def test_gray_rank_is_the_place_in_the_sequence():
    codes = np.array([k ^ (k >> 1) for k in range(64)], np.uint64)[:, None]
    assert simhash.gray_rank(codes)[0].tolist() == list(range(64))


def test_near_copies_survive_once(spark):
    rng = random.Random(4)
    rows, doc = [], 0
    for group in range(30):
        words = [rng.choice(plain.WORDS) + str(rng.randint(0, 9999)) for _ in range(400)]
        for copy in range(4):
            own = list(words)
            for _ in range(copy * 2):
                own[rng.randrange(400)] = "changed"
            rows.append((doc, " ".join(own)))
            doc += 1
    kept = simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 120, 4))


def test_only_similar_shingle_sets_link(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: rng.choice(plain.WORDS) + str(rng.randint(0, 99999))
    shared, repeated = [word() for _ in range(170)], "word " * 1500
    # Families that share half to two thirds of their shingles, or one shingle very often, and a large group of near copies.
    rows = [" ".join(shared + [word() for _ in range(45)]) for _ in range(150)]
    rows += [repeated + " ".join(word() for _ in range(30)) for _ in range(20)]
    base = [word() for _ in range(200)]
    rows += [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 200, 2)] + ["?!", " ", None]
    sets = [set(simhash.distinct((t or "").encode(), 5).tolist()) for t in rows]
    root = plain.components(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "DENSE", 4)
    assert len(set(root)) == 150 + 20 + 1 + 2
    assert sorted(r.doc_id for r in simhash.survivors(docs).collect()) == sorted({min(k for k in range(len(rows)) if root[k] == r) for r in set(root)})


def test_families_below_the_similarity_write_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: rng.choice(plain.WORDS) + str(rng.randint(0, 99999))
    # All 11,175 pairs share 0.7 of their shingles, near enough for the fingerprints' limit.
    shared = [word() for _ in range(126)]
    rows = [" ".join(shared + [word() for _ in range(26)]) for _ in range(150)]
    rows += [" ".join(shared + rows[0].split()[126:-1] + ["changed"])]
    tested, similar = [], simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda pairs, *rest: tested.append(pairs.count()) or similar(pairs, *rest))
    kept = simhash.survivors(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(150))
    assert 1 <= sum(tested) <= 1000


def test_sets_differ_in_no_less_than_their_sketches():
    rng = np.random.default_rng(3)
    for size in (simhash.BRIEF, simhash.SKETCH):
        for _ in range(200):
            pool = rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)
            a, b = (np.unique(pool[rng.random(len(pool)) < share]) for share in rng.random(2))
            bits = int.from_bytes(simhash.sketch(a, size), "little") ^ int.from_bytes(simhash.sketch(b, size), "little")
            differ = len(np.setxor1d(a, b))
            assert bits.bit_count() <= differ and (differ - bits.bit_count()) % 2 == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (7, 7)] + [(2000 - k, 1999 - k) for k in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, **{1000 + k: 1000 for k in range(1, 300)}, **{1951 + k: 1950 for k in range(50)}}


def test_bit_parallel_distance():
    rng = np.random.default_rng(1)
    patterns = [bytes(rng.integers(97, 101, rng.integers(1, 200)).astype(np.uint8)) for _ in range(20)]
    texts = [bytes(rng.integers(97, 101, 15).astype(np.uint8)) + p[: len(p) // 2] + b"x" + p[len(p) // 2 + 1 :] for p in patterns]

    def table(rows):
        out = np.zeros((len(rows), max(map(len, rows))), np.uint8)
        for k, row in enumerate(rows):
            out[k, : len(row)] = np.frombuffer(row, np.uint8)
        return out, np.array([len(r) for r in rows])

    best, where = edits.distances(*table(patterns), *table(texts))
    assert list(zip(best.tolist(), where.tolist())) == [plain.best_match(p, t) for p, t in zip(patterns, texts)]


def test_edit_matches(spark):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(plain.WORDS) for _ in range(rng.randint(5, 30)))) for k in range(8)]
    docs = []
    for doc in range(80):
        text = " ".join(rng.choice(plain.WORDS) for _ in range(rng.randint(0, 50)))
        if doc % 2:
            passage = list(rng.choice(items)[1])
            for _ in range(int(len(passage) * rng.choice([0, 0.05, 0.1, 0.14]))):
                at = rng.randrange(len(passage))
                rng.choice([lambda: passage.__setitem__(at, "q"), lambda: passage.insert(at, "z"), lambda: passage.pop(at)])()
            text = text[: len(text) // 2] + "".join(passage).upper() + text[len(text) // 2 :]
        docs.append((doc, text))
    known = edits.Items.of(items, edits.BUDGET)
    want = set()
    for doc, text in docs:
        clean = edits.normal(np.frombuffer(text.encode(), np.uint8))[0].tobytes()
        for k, item in enumerate(known.ids):
            distance, _ = plain.best_match(known.data[known.start[k] : known.start[k + 1]].tobytes(), clean)
            if distance <= known.errors[k]:
                want.add((doc, item, distance))
    found = edits.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.distance) for r in found.collect()} == want


def test_spaced_out_passage_across_parts(spark):
    rng = random.Random(12)
    item = " ".join(rng.choice(plain.WORDS) + str(rng.randint(0, 999)) for _ in range(60))
    wide = item.replace(" ", " \n" + " " * 40)
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    # The passage lies across the first cut, begins or ends there, or has a whole part of white space inside.
    texts = ["z" * ((1 << 20) - before) + " " + wide + " " + "y" * 5000 for before in (10, len(wide) // 2, len(wide) - 10, len(wide) + 1)]
    texts += [item[:200] + " " * (3 << 20) + item[200:], "q" * (1 << 20) + item[:200] + "\n" * (5 << 20) + item[200:] + "q" * (2 << 20), "z" * (3 << 20)]
    found = edits.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), benchmark).collect()
    assert {r.doc_id for r in found} == set(range(6))


def test_packing_gives_back_the_ids(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300).unionAll(spark.createDataFrame([(-1, "漢字 ΑΣ İx <|endoftext|> it's 1,2", None, None, 0), (-2, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = docs.select("doc_id", "text").collect()
    ids = {r.doc_id: Tokenizer.from_file(path).encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows}
    got = packing.packed(docs, path).toPandas().sort_values(["doc_id", "start"])
    for doc, pieces in got.groupby("doc_id"):
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[doc])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[doc])
    total = got.groupby("sequence_id")["length"].sum()
    assert total.sum() / (packing.WINDOW * len(total)) > 0.98


def test_word_ids_are_the_tokenizers(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    rng = random.Random(5)
    odd = ["it's", "'single'", "l'été.", "''ll", "²³¼ a1b22", "ǄŉĲ", "aªº_b", "\u00ad", "…", "a  b\r\n\t", " ", "", "x\x0by", "İ", "漢字", "<|endoftext|>", "---'s", "É,É;É"]
    texts = [" ".join(rng.choice(odd + plain.WORDS) + rng.choice(["", ".", ",\n", "'t"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    monkeypatch.setattr(packing, "MEMORY", 20)
    monkeypatch.setattr(packing, "GROUP", 700)
    tokens = packing.WordTokens(path)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in tokens.of_all(texts)] == [whole.encode(text, add_special_tokens=False).ids for text in texts]


def test_words_are_tokenized_once(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    tokens, seen = packing.WordTokens(path), []

    class Model:
        def tokenize(self, word):
            seen.append(word)
            return model.tokenize(word)

    class Inner:
        model = Model()

    model, want = tokens.inner.model, tokens.tokenizer.encode("blending. blending, (blending) é blending", add_special_tokens=False).ids
    monkeypatch.setattr(tokens, "inner", Inner())
    tokens.of("blending")
    assert np.frombuffer(tokens.of("blending. blending, (blending) é blending"), "<u4").tolist() == want
    assert sorted(seen) == sorted(["blending", ".", ",", "(", ")", "Ã©"])


def test_least_squares_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        matrix, target = rng.random((6, 9)), rng.random(6)
        x = packing.nonnegative(matrix, target)
        slope = matrix.T @ (target - matrix @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(6)
    for _ in range(60):
        olds, news = rng.randint(1, 5), rng.randint(1, 5)
        supply = np.array([rng.randint(0, 30) for _ in range(olds)])
        room = np.full(news, -(-int(supply.sum()) // news))
        cost = np.ones((olds, news))
        cost[range(min(olds, news)), range(min(olds, news))] = 0
        flow = sharding.cheapest_flow(supply, room, cost)
        assert (flow.sum(1) == supply).all() and (flow.sum(0) <= room).all() and (flow >= 0).all()
        stays = sum(min(int(supply[k]), int(room[k])) for k in range(min(olds, news)))
        assert (flow * cost).sum() == supply.sum() - stays


def test_shards_are_near_equal(spark):
    got = QUERIES["op6_sharding"](spark, FOLDER).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 40 and size.max() / size.min() < 1.02
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()


def test_grammar_reads_back_what_it_writes():
    rng = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<role:", "</role>", "\\", " ", "\n", "a", ">", "<", "[/INS", "T]"]
    for _ in range(5000):
        turns = [(rng.choice(["user", "assistant", "system", "", "to>ol", "x\\", "<s>"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(0, 4))]
        assert chat.parse("".join(chat.render(*turn) for turn in turns)) == turns
    assert chat.render("user", "plain") == "[INST] plain [/INST]"


def test_nearest_lattice_points():
    steps = lattice.roots()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    x = np.random.default_rng(0).standard_normal((300, 8)) * 2
    near = lattice.decode(x)
    assert (((x[:, None] - near[:, None] - steps) ** 2).sum(2) >= ((x - near) ** 2).sum(1)[:, None] - 1e-9).all()


def test_recall_at_the_limit():
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((1500, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    side = rng.standard_normal(unit.shape)
    side -= (side * unit).sum(1, keepdims=True) * unit
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = lattice.COSINE * unit + np.sqrt(1 - lattice.COSINE**2) * side
    a, b = lattice.cells(unit), lattice.cells(near)
    assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() > 0.95


def test_lattice_counts_every_link_once(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 32))
    vectors = np.concatenate([c + rng.standard_normal((25, 32)) * s for c, s in zip(centres, np.linspace(0.05, 0.4, 12))]).astype(np.float32)
    rows = [(k, [float(x) for x in v], k % 2) for k, v in enumerate(vectors)]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= lattice.COSINE) & (np.arange(len(unit))[:, None] % 2 == np.arange(len(unit)) % 2)
    np.fill_diagonal(near, False)
    found = np.array([got[k].n_links for k in range(len(unit))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.95 * near.sum()


def area(score, label):
    rank = score.argsort().argsort()
    return (rank[label == 1].mean() - ((label == 1).sum() - 1) / 2) / (label == 0).sum()


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    for query, column, least in (("op2_toxicity", "toxic", 0.95), ("op3_quality", "quality", 0.98)):
        found = QUERIES[query](spark, folder).toPandas()
        assert (found["held_out"] == [zlib.crc32(str(k).encode()) % 5 == 0 for k in found["doc_id"]]).all()
        held = found[found["held_out"]].merge(labels, on="doc_id")
        assert area(held["score"].to_numpy(), held[column].to_numpy()) > least


def test_offending_sentences(spark):
    from pupilage.llm import toxicity

    folder = FOLDER
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    found = toxicity.sentences(docs, model).collect()
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert found and all(texts[r.doc_id][r.start : r.start + r.length].decode("utf-8", "replace") == r.sentence for r in found)


def test_long_texts_are_not_toxic_by_length(spark):
    from pupilage.llm import toxicity

    weights = np.zeros(toxicity.BUCKETS, np.float32)
    bad = np.frombuffer(b"vile words", np.uint8)
    weights[toxicity.words(bad, np.array([0, len(bad)]))[1]] = 4.0
    model = toxicity.ToxicModel(weights, toxicity.START)
    clean, filler = "This sentence says nothing of note at all. ", "a" * (toxicity.LOT - 60)
    # The last two have the offending sentence alone and across the end of a block.
    texts = [clean * 10_000, None, clean, "some vile words here.", filler + ". " + "some " * 11 + "vile words here, and more of it. " + filler]
    got = {r.doc_id: r.score for r in toxicity.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, "doc_id").collect()}
    assert abs(got[0] - got[1]) < 1e-9 and abs(got[2] - got[1]) < 1e-9 and got[0] < 0.001
    assert abs(got[4] - got[3]) < 1e-9 and got[3] > 0.5


def test_pipeline_does_what_its_stages_say(spark):
    folder, docs = FOLDER, spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    quality_stage, near, substring, leaks, packs = (stage for _, stage in corpus_pipeline.STAGES)
    good = quality_stage(spark, docs, folder).cache()
    score = quality.scores(docs, quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")), "doc_id").collect()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in score if r.score >= 0.3}
    one = near(spark, good, folder).cache()
    texts = [r.text for r in one.collect()]
    assert len(set(texts)) == len(texts) < good.count()
    cut = substring(spark, one, folder).cache()
    want = plain.substring_digests([(r.doc_id, r.text) for r in one.collect()])
    lost = {doc for doc, _, removed, _, _ in want if removed}
    before = {r.doc_id: r.text for r in one.collect()}
    after = {r.doc_id: r.text for r in cut.collect()}
    assert set(after) == set(before) and {k for k in before if before[k] != after[k]} == lost
    clean = leaks(spark, cut, folder)
    plain_text = lambda t: " ".join(t.lower().split())
    leaked = {k for k, t in after.items() if any(plain_text(b) in plain_text(t) for b in benchmark)}
    assert not leaked & {r.doc_id for r in clean.collect()} and clean.count() >= 0.95 * len(after)
    assert packs(spark, clean, folder).agg({"length": "sum"}).first()[0] > 0
