"""Embedding near-duplicates by lattice hashing.

In each of ``TABLES`` tables a vector of unit length is projected to eight
random directions and decoded to the nearest point of the lattice E8; its cell,
and the ``PROBES`` neighbouring cells nearest to it, are its keys. Vectors that
share a key meet, and those whose cosine in double precision reaches the limit
are linked. Only keys that two vectors share carry vectors on, so most vectors
travel once. A pair that meets more than once counts where it first meets, in
order of tables and keys; equal vectors are one class with a count. Tasks pass
on counts and a spanning forest of their links, never the pairs.

Defined cases: a null label or vector, a vector of length zero and one with
null or non-finite parts links with nothing (0 links, its own component); only
vectors of one label and one number of parts are compared; equal vectors and
repeated rows link with each other; a null vec_id never names a component unless
all its ids are null; only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pupilage.llm.buckets import by_bucket, spread, union
from pupilage.llm.components import components
from pupilage.llm.texts import mixed
from pupilage.sources.storage import materialize

COSINE = 0.93
TABLES = 6
PROBES = 3
SCALE = 2.6
BLOCK = 1024


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two ones of either sign, or halves with an even number of minus signs."""
    out = []
    for a, b in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[a], v[b] = s, t
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1.0, -1.0), repeat=8) if s.count(-1.0) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: whole or half coordinates of even sum."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(nearer[:, None], half, whole)


def directions(dim: int, tables: int, scale: float, seed: int = 13) -> np.ndarray:
    rng = np.random.default_rng(seed + dim)
    return rng.standard_normal((tables, dim, 8)) * (scale / np.sqrt(8))


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Keys by vector, table and cell: the own cell, then the nearest neighbours."""
    steps = roots()
    out = np.zeros((len(unit), tables, 1 + probes), np.uint64)
    weights = mixed(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
    for t, matrix in enumerate(directions(unit.shape[1], tables, scale)):
        x = unit @ matrix
        point = decode(x)
        nearest = np.argsort(-(x - point) @ steps.T, axis=1, kind="stable")[:, :probes]
        for k in range(1 + probes):
            coordinates = np.rint(2 * (point if k == 0 else point + steps[nearest[:, k - 1]])).astype(np.int64).view(np.uint64)
            out[:, t, k] = mixed((coordinates * weights).sum(1, dtype=np.uint64) + np.uint64(t))
    return out


def _units(column: pa.Array, dim: int) -> np.ndarray:
    vectors = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    # Scaled first, so that very large and very small parts neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.asarray(batch.column("dim"))
        keys: list = [None] * batch.num_rows
        salt = np.asarray(batch.column("salt")).view(np.uint64)
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            found = cells(_units(batch.column("embedding").take(pa.array(rows)), int(dim)))
            found = mixed(found ^ salt[rows][:, None, None]).reshape(len(rows), -1).view(np.int64)
            for k, row in enumerate(rows):
                keys[row] = found[k]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])


def _first_meeting(a: np.ndarray, b: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether ``code`` is the least key of the first table in which the rows of a and b share one."""
    out, open_ = np.zeros(len(a), bool), np.ones(len(a), bool)
    for t in range(a.shape[1]):
        same = a[:, t, :, None] == b[:, t, None, :]
        met = same.any((1, 2))
        least = np.where(same.any(2), a[:, t], np.iinfo(np.int64).max).min(1)
        out |= open_ & met & (least == code)
        open_ &= ~met
    return out


def _linked(limit: float):
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, side, node, code, count, sizes = (np.asarray(table.column(c)) for c in ("bucket", "side", "node", "code", "n", "dim"))
        keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(len(node), TABLES, 1 + PROBES)
        vectors = table.column("embedding").combine_chunks()
        label, links = np.arange(len(node)), np.zeros(len(node), np.int64)
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for start, end in zip(edge[:-1], edge[1:]):
            if end - start < 2:
                continue
            unit = _units(vectors.slice(start, end - start), int(sizes[start]))
            for a in range(0, len(unit), BLOCK):
                for b in range(a, len(unit), BLOCK):
                    i, j = np.nonzero(unit[a : a + BLOCK] @ unit[b : b + BLOCK].T >= limit)
                    i, j = i + a + start, j + b + start
                    keep = (i < j) & ((side[i] == 0) | (side[i] != side[j])) & (node[i] != node[j])
                    i, j = i[keep], j[keep]
                    for lot in range(0, len(i), 1 << 16):
                        x, y = i[lot : lot + (1 << 16)], j[lot : lot + (1 << 16)]
                        first = _first_meeting(keys[x], keys[y], code[x])
                        np.add.at(links, x[first], count[y[first]])
                        np.add.at(links, y[first], count[x[first]])
                    union(label, i, j)
        some = np.flatnonzero((links > 0) | (label != np.arange(len(label))))
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]), pa.array(links[some])], ["a", "b", "links"])

    return work


def near_duplicates(embeddings: DataFrame, limit: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = embeddings.select("vec_id", "embedding", "label")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.filter(valid)
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "vectors")
    keyed = classes.select("node", "embedding", "dim", F.xxhash64("label", "dim").alias("salt")).mapInArrow(_keys, "node long, keys array<long>")
    keyed = materialize(keyed, "cells")
    exploded = keyed.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    shared = exploded.groupBy("key").count().filter("count > 1").select("key")
    met = exploded.join(shared, "key").withColumn("code", F.col("key"))
    met = spread(met, "key", "node").join(keyed, "node").join(classes.select("node", "embedding", "dim", "n"), "node")
    found = materialize(by_bucket(met, _linked(limit), "a long, b long, links long"), "vector-links")
    roots_ = components(found.filter("a <> b").select("a", "b"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    placed = classes.join(roots_, "node", "left").join(links, "node", "left")
    placed = materialize(placed.select("label", "embedding", "first", F.coalesce("root", "node").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")), "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("label", "embedding", "n_links", "component_id")
    linked = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
