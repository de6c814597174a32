"""Alignment, periodic runs and exact top k against plain versions, and their defined cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pupilage.llm import alignment, periodic, voronoi
from pupilage.llm.queries import QUERIES
from tests.llm import plain

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {chr(k): k for k in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + n): k for n, k in enumerate(k for k in range(256) if chr(k) not in letters)}

    def of(text):
        if not text:
            return None
        whole = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelt_a = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
        spelt_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        return (ids_a, spelt_a, ids_b, spelt_b) if b"".join(spelt_a) == whole == b"".join(spelt_b) else None

    return of


def plain_alignment(texts, given):
    """One row per text: n_a, n_b, n_groups, n_links, n_best, count_sum, digest."""
    found = []
    for text in texts:
        tokens = given(text)
        if tokens is None:
            found.append(None)
            continue
        ids_a, spelt_a, ids_b, spelt_b = tokens
        ends_a, ends_b = np.cumsum([len(x) for x in spelt_a]).tolist(), np.cumsum([len(x) for x in spelt_b]).tolist()
        i = j = first_a = first_b = 0
        links, groups = [], []
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, ids_a[first_a:i])) + "|" + ",".join(map(str, ids_b[first_b:j])))
                first_a, first_b = i, j
        found.append((len(ids_a), len(ids_b), groups, links))
    count = Counter(pair for f in found if f for pair in set(f[3]))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None
        else (f[0], f[1], len(f[2]), len(f[3]), sum(count[p] == most[p[0]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest())
        for f in found
    ]


ALPHABET = " \n\t  ab'sé漢​　 x1<|endoftext|></s>▁\ŕ"


def odd_texts(n):
    rng = random.Random(3)
    fixed = [None, "", " ", "  ", "a ", " a", "a  b", "▁", "\x00", "x" * 500, " " * 50, "a b  c", "é x", "<s> </s>", "tail \n"]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("limit", [alignment.LOT, 900])
def test_alignment(spark, given, limit):
    """A low limit makes long texts go through in stretches, and gives many lots."""
    texts = odd_texts(300) + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.linked(docs, A, B, limit).collect()}
    assert [rows[k] for k in range(len(texts))] == plain_alignment(texts, given)


def test_alignment_query(spark, given):
    rows = sorted(QUERIES["op11_cross_tokenizer"](spark, SMALL).collect())
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    assert [tuple(r)[1:] for r in rows] == plain_alignment(texts, given)


@pytest.mark.parametrize("work", [1, 2, 3, 7, 1000])
def test_pieces_of_any_size_give_the_same_overlaps(work):
    rng = np.random.default_rng(work)
    for _ in range(50):
        end = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(end) < rng.random()), end) for _ in range(2))
        want = [(e, int((a < e).sum()), int((b < e).sum()), e in a, e in b) for e in sorted({*a.tolist(), *b.tolist()})]
        assert list(zip(*(x.tolist() for x in alignment.overlaps(a, b, work)))) == want


def test_both_ways_to_encode_agree():
    tokens = alignment.Tokens(A, B)
    assert tokens.cuts and tokens.ranked is not None
    texts = [" " + t for t in odd_texts(200) if t]
    fast = tokens.encode_a(texts)
    tokens.ranked = None
    slow = tokens.encode_a(texts)
    assert all((x == y).all() for x, y in zip(fast, slow))


def plain_runs(words):
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i >= 3 * p:
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items() if n >= max(6, 4 * p))


def repetitive(rng):
    kinds, words, size = rng.choice([1, 2, 2, 3, 5, 50]), [], rng.choice([0, 3, 20, 100, 400])
    while len(words) < size:
        unit = [rng.randint(0, kinds) for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 30, 33, 60]))]
        unit = unit[:3] * 5 + unit if rng.random() < 0.3 else unit
        words += (unit * 8)[: rng.randint(1, len(unit) * 7)] if rng.random() < 0.7 else unit
    return words


def test_runs_of_words():
    rng = random.Random(0)
    for _ in range(120):
        docs = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        rows = np.concatenate([[0], np.cumsum([len(w) for w in docs])]).astype(np.int64)
        got = list(zip(*(x.tolist() for x in periodic.periodic_runs(np.array(sum(docs, []), np.int64), rows))))
        assert got == [(int(rows[k]) + s, n, p) for k, w in enumerate(docs) for s, n, p in plain_runs(w)]


def test_equal_names_alone_decide_nothing(monkeypatch):
    """With names of two bits nearly all contexts look alike; proposals are wrong, reported runs are not."""
    monkeypatch.setattr(periodic, "mixed", lambda x: (x ^ (x >> np.uint64(7))) & np.uint64(3))
    rng = random.Random(1)
    for _ in range(40):
        words = repetitive(rng)
        got = set(zip(*(x.tolist() for x in periodic.periodic_runs(np.array(words, np.int64), np.array([0, len(words)])))))
        assert {(s, n) for s, n, _ in got} <= {(s, n) for s, n, _ in plain_runs(words)}


def words_of(text):
    return [w.decode("utf-8", "replace") for w in (text or "").encode().translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if w]


def plain_digest(words):
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(((-n, s, p) for s, n, p in runs), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (len(runs), *longest, hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("limit", [periodic.LOT, 50])
def test_periodic_scan(spark, limit):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a", "a a a a a a", "é " * 9, " a\vb\fa b\ra b a\tb  a b a b c"] + [" ".join(map(str, repetitive(rng))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in periodic.digests(periodic.scan(docs, limit)).collect()}
    assert [got[k] for k in range(len(texts))] == [plain_digest(words_of(t)) for t in texts]


def test_periodic_query(spark):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    hit = 0
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        words, h = words_of(r.text), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            hit += 1
        assert got[r.doc_id] == plain_digest(words)
    assert hit > 5 and sum(v[0] > 0 for v in got.values()) > 5


def plain_top(rows, k=5):
    known = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        known.setdefault(i, [int(np.floor(256 * float(x))) for x in v])
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q in known:
        if q % 50 == 0:
            best = sorted((-score(known[q], v), i) for i, v in known.items() if i != q)[:k]
            out += [(q, rank + 1, i, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, i) in enumerate(best)]
    return sorted(out)


def top(spark, rows, **limits):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).repartition(3)
    return sorted(tuple(r) for r in voronoi.top_k(table, table.filter("vec_id % 50 = 0"), **limits).collect())


def clustered(n, copies):
    rng = np.random.default_rng(n)
    centre = rng.normal(size=(6, 8)) * 3
    rows = [(k, (centre[k % 6] + 0.05 * rng.normal(size=8)).tolist()) for k in range(n)]
    return rows + [(n + k, rows[50][1]) for k in range(copies)]


@pytest.mark.parametrize("limits", [{}, {"pivots": 6, "block": 1, "part": 20}, {"pivots": 40, "block": 2, "part": 7}])
def test_top_k(spark, limits):
    """Clusters, so that cells are pruned; many copies of one vector; blocks and parts of a few rows."""
    rows = clustered(200, 120)
    assert top(spark, rows, **limits) == plain_top(rows)


def test_top_k_defined_cases(spark):
    odd = [(None, [1.0, 2.0]), (1, None), (2, [1.0, None]), (50, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (100, [0.0, 0.0]), (4, []), (5, [1.0]), (150, [-1.5, 0.25, 7.0]), (6, [1.0, 2.0, 3.0])]
    odd += [(7, [1e14, -1e14]), (200, [1e14, 1.0]), (250, [-0.001, 0.0])]
    assert top(spark, odd) == plain_top(odd)
    assert top(spark, odd + odd) == plain_top(odd)
    assert top(spark, []) == [] and top(spark, [(50, [1.0])]) == []
    assert top(spark, [(50, [1.0]), (51, [2.0])]) == [(50, 1, 51, 256 * 512)]


def test_messy_and_empty_tables(spark):
    for docs in (plain.messy(spark), plain.empty(spark)):
        n = docs.count()
        assert alignment.linked(docs, A, B).count() == n
        assert periodic.digests(periodic.scan(periodic.planted(docs))).count() == n
