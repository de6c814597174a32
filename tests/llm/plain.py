"""Plain versions of the operators, one row or pair at a time, and shared fixtures."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

WORDS = "onti erre shnd blea than wh ing tion ouha ndst are was for".split()

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, hash long, node long, length long, bucket long, label int, _hash long"


def messy(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, extra columns with names used inside."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = prose(120)
    texts = [None, "", "   \n\t", "a", base, base, base + " x", prose(300), "É" * 300, "é" * 150 + base, "word " * 100, "x" * 3_000_000, prose(2), "-" * 199, "=" * 200]
    rows = [(k, t, "en", "s", len(t or ""), 0.5, k, k, k, 1, 2, 1, 3) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], rows[1]]
    rows += [(None, base[:250] + prose(30), None, None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 11), (7, "another text with the same id", "en", "s", 3, None, 1, 1, 1, 1, 1, 1, 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def substring_digests(rows, window=200):
    count: Counter = Counter()
    data = [(doc, (text or "").encode()) for doc, text in rows]
    for _, b in data:
        if len(b) < 100_000:
            count.update(b[k : k + window] for k in range(len(b) - window + 1))
    out = []
    for doc, b in data:
        gone = np.zeros(len(b) + 1, np.int64)
        if len(b) < 100_000:
            for k in range(len(b) - window + 1):
                if count[b[k : k + window]] > 1:
                    gone[k] += 1
                    gone[k + window] -= 1
        else:  # the fixture's one long text is a single letter
            gone[0] += 1
            gone[len(b)] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int((mask & ~np.concatenate([[False], mask[:-1]])).sum()) if len(b) else 0
        out.append((doc, len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


def simhash(text, shingle):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(count, linked):
    label = list(range(count))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(count):
        for j in range(i + 1, count):
            if linked(i, j):
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(count)]


def best_match(pattern, text):
    """Least edit distance of the pattern to any part of the text, and the first end that has it."""
    column = list(range(len(pattern) + 1))
    best, end = len(pattern), 0
    for k, symbol in enumerate(text):
        new = [0]
        for i, own in enumerate(pattern):
            new.append(min(column[i] + (own != symbol), column[i + 1] + 1, new[i] + 1))
        column = new
        if column[-1] < best:
            best, end = column[-1], k + 1
    return best, end
