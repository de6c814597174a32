"""Exact top k by integer inner product, as a Voronoi join.

Pivots are rows of a bounded sample (``SAMPLE`` rows by a hash of their id,
far apart from each other); every vector joins the cell of its nearest pivot.
A cell's summary is its ``k + 1`` vectors nearest to the pivot. The summaries of
all cells together (at most ``PIVOTS * (k + 1)`` vectors) give each query an
exact score that at least ``k`` other vectors reach: its floor.

For a query q and a vector x of the cell of pivot p, x = p + r, the score is
q.p + q.r, at most q.p + |q| |r|. So x can only matter to q when its distance |r|
from the pivot is at least (floor - q.p) / |q|. The least of these over a group of
queries is what the group needs from the cell: a table of at most ``PIVOTS`` x
``PIVOTS`` distances. Only vectors that far out are replicated to the group, and
every group is solved locally, by exact integer products. Cells whose queries need
nearly the same vectors are one group, so that a vector that all need is not sent
to every cell.

Nothing is lost to skew: of equal vectors only the ``k + 1`` smallest ids can be
among the first ``k`` of any query, so the others go before the join (each by
that rule, none by chance), and equal queries are solved once, for ``k + 1``
places, from which each takes out its own id. A group with many queries is cut
into blocks of ``QUERIES``, and what is replicated to a block into parts of
``ROWS`` vectors; parts are merged by rank.

Defined cases: vectors that are null, hold a null or non-finite component, or one
beyond 2^1015, and rows without an id take no part; shorter vectors are filled
with zeros, so an empty one scores 0; an id that is repeated counts once, with
its least vector (as bytes of its components); with fewer candidates than ``k``
all are returned; products that could leave the exact range of doubles are made
with Python integers, and a score beyond a long is returned as the nearest long;
an empty table gives no rows. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pupilage.llm.texts import sample_of
from pupilage.sources.storage import materialize

SCALE = 256
SAMPLE = 4096
PIVOTS = 128
QUERIES = 4096
#: Cells are one group if together they need at most so many times what either needs.
SAME = 1.25
ROWS = 65_536
#: Products below this bound are exact in doubles.
EXACT = 2.0**53
LONGEST = 2**63 - 1


def integers(column: pa.Array) -> tuple[np.ndarray, list[bytes | None]]:
    """Which vectors take part, and their components floor(SCALE * x) as bytes: 16-bit, else 64-bit whole numbers in doubles.

    Zeros at the end are left out, so that vectors equal but for them are one.
    """
    out: list[bytes | None] = []
    for row in column.to_pylist() if column.null_count else _rows(column):
        if row is None:
            out.append(None)
            continue
        x = np.array([math.nan if v is None else v for v in row] if isinstance(row, list) else row, np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(SCALE * x)
        out.append(encoded(x) if np.isfinite(x).all() else None)
    return np.array([b is not None for b in out], bool), out


def _rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    values = column.flatten()
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    for a, b in zip(ends[:-1], ends[1:]):
        yield flat[a:b]


def encoded(x: np.ndarray) -> bytes:
    full = np.flatnonzero(x)
    x = x[: full[-1] + 1] if len(full) else x[:0]
    return b"h" + x.astype("<i2").tobytes() if np.abs(x).max(initial=0) < 1 << 15 else b"d" + (x + 0.0).astype("<f8").tobytes()


def decoded(rows: list[bytes], width: int | None = None) -> np.ndarray:
    """Vectors as a matrix of whole numbers in doubles, filled with zeros."""
    if rows and width is None and rows[0][:1] == b"h" and all(len(b) == len(rows[0]) and b[:1] == b"h" for b in rows):
        flat = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)[:, 1:]
        return np.ascontiguousarray(flat).view("<i2").astype(np.float64)
    vectors = [np.frombuffer(b, "<i2" if b[:1] == b"h" else "<f8", offset=1) for b in rows]
    out = np.zeros((len(rows), max(map(len, vectors), default=0) if width is None else width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v[: out.shape[1]]
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``q`` and ``x``: doubles if they hold them, else Python integers."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    if len(q) == 0 or len(x) == 0 or float(np.abs(q).max(0, initial=0) @ np.abs(x).max(0, initial=0)) < EXACT:
        return q @ x.T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return whole(q) @ whole(x).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the places of the ``k`` highest scores, ties to the smaller id; ``ids`` ascend."""
    if scores.shape[1] <= k:
        return [np.array(sorted(range(len(row)), key=lambda j: (-row[j], j)), np.int64) for row in scores]
    if scores.dtype == object:
        return [np.array(sorted(range(len(row)), key=lambda j: (-row[j], j))[:k], np.int64) for row in scores]
    edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    out = []
    for row, least in zip(scores, edge):
        at = np.flatnonzero(row >= least)
        out.append(at[np.argsort(-row[at], kind="stable")][:k])
    return out


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows at most, each the farthest from those before; no row twice."""
    chosen = [0]
    distance = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


class Cells:
    """Pivots, and what is true of a vector's place among them."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.norms = (pivots**2).sum(1)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot, and a distance from it that is not too small by rounding."""
        width = max(x.shape[1], self.pivots.shape[1])
        x, pivots = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, self.pivots))
        with np.errstate(over="ignore", invalid="ignore"):
            cell = np.argmin(np.nan_to_num(self.norms - 2 * (x @ pivots.T), nan=np.inf), axis=1)
            distance = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            # Rounding is far below a billionth of the numbers that enter.
            return cell, np.nan_to_num(distance + 1e-9 * (np.sqrt((x**2).sum(1)) + np.sqrt(self.norms[cell]) + 1), nan=np.inf)

    def needed(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Per query and cell, the distance from which on its vectors may reach ``floor``; rounded down."""
        width = max(q.shape[1], self.pivots.shape[1])
        q, pivots = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, self.pivots))
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            length = np.sqrt((q**2).sum(1))[:, None]
            slack = 1e-9 * (length * np.sqrt(self.norms) + np.abs(floor)[:, None] + 1)
            apart = (floor[:, None] - q @ pivots.T - slack) / (length * (1 + 1e-9))
        # A query of zeros scores 0 with all; where numbers leave the range, all is needed.
        return np.where(np.isfinite(apart), apart, -np.inf)


def vectors(embeddings: DataFrame, id_column: str, column: str) -> DataFrame:
    """``id`` and ``v`` (components as bytes) of the rows that take part, one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, rows = integers(batch.column("v"))
            part &= ~batch.column("id").is_null().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array([rows[k] for k in at], pa.binary())], ["id", "v"])

    given = embeddings.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("v"))
    return given.mapInArrow(run, "id long, v binary").withColumn("_r", rank).filter("_r = 1").drop("_r")


def first_of_equals(rows: DataFrame, keep: int) -> DataFrame:
    """Of each vector the rows with the ``keep`` smallest ids; ranks are limited before the shuffle, so copies do not travel."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= keep).drop("_r")


def in_cells(rows: DataFrame, cells: Cells) -> DataFrame:
    """Adds ``cell`` and ``distance``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance = cells.of(decoded(batch.column("v").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(distance, pa.float64())], [*batch.schema.names, "cell", "distance"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kept}, cell int, distance double")


def floors(q: np.ndarray, summary: np.ndarray, k: int) -> np.ndarray:
    """A score that ``k + 1`` vectors of the summary reach, so that ``k`` others do; minus infinity if there are fewer."""
    if len(summary) <= k:
        return np.full(len(q), -np.inf)
    scores = products(q, summary)
    if scores.dtype == object:
        return np.array([float(sorted(row)[-k - 1]) * (1 - 1e-12) - 1 if sorted(row)[-k - 1] > 0 else float(sorted(row)[-k - 1]) * (1 + 1e-12) - 1 for row in scores])
    return np.partition(scores, -k - 1, axis=1)[:, -k - 1]


def thresholds(queries: DataFrame, cells: Cells, summary: list[bytes], k: int) -> DataFrame:
    """Per cell of queries (``own``) and cell of vectors the least distance (``apart``) that any of the queries needs, and the cell's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = decoded(summary)
        for batch in batches:
            q, own = decoded(batch.column("v").to_pylist()), batch.column("cell").to_numpy()
            names, place, count = np.unique(own, return_inverse=True, return_counts=True)
            least = np.full((len(names), len(cells.pivots)), np.inf)
            for a in range(0, len(q), 1024):
                part = slice(a, a + 1024)
                np.minimum.at(least, place[part], cells.needed(q[part], floors(q[part], known, k)))
            width = least.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, width)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(names))), pa.array(least.ravel()), pa.array(np.repeat(count, width))], ["own", "cell", "apart", "queries"])

    return queries.select("cell", "v").mapInArrow(run, "own int, cell int, apart double, queries long").groupBy("own", "cell").agg(F.min("apart").alias("apart"), F.sum("queries").alias("queries"))


def grouped(apart: np.ndarray, spread: dict[int, tuple[int, list[float]]], pivots: np.ndarray, queries: np.ndarray, limit: int) -> list[list[int]]:
    """Cells of queries in groups: a cell joins the group before it if both need nearly the same vectors.

    ``spread`` has the count and the quantiles of the distances of each cell of vectors.
    """

    def reach(least: np.ndarray) -> float:
        return sum(n * (1 - np.searchsorted(q, least[c]) / len(q)) for c, (n, q) in spread.items())

    left = {int(c) for c in np.flatnonzero(queries)}
    groups: list[list[int]] = []
    at = min(left, default=None)
    while left:
        left.discard(at)
        if groups:
            together = np.minimum(apart[groups[-1]].min(0), apart[at])
            least = min(reach(apart[groups[-1]].min(0)), reach(apart[at]))
            if reach(together) <= SAME * least and queries[groups[-1]].sum() + queries[at] <= limit:
                groups[-1].append(at)
            else:
                groups.append([at])
        else:
            groups.append([at])
        at = min(left, key=lambda c: float(((pivots[c] - pivots[at]) ** 2).sum()), default=None)
    return groups


def solved(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The ``k`` best of ``rows`` for each query."""
    ids = rows.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, known = ids[order], decoded(rows.column("v").take(pa.array(order)).to_pylist())
    given = queries.column("query").to_numpy()
    asked = decoded(queries.column("v").to_pylist())
    query, found, score = [], [], []
    step = max(1, (1 << 22) // max(1, len(ids)))
    for a in range(0, len(given), step):
        scores = products(asked[a : a + step], known)
        for row, at in zip(range(a, a + step), best(scores, ids, k)):
            query += [given[row]] * len(at)
            found.append(ids[at])
            score += [max(-LONGEST - 1, min(LONGEST, int(v))) for v in scores[row - a][at]]
    return pa.table({"query": pa.array(query, pa.int64()), "id": pa.array(np.concatenate(found) if found else [], pa.int64()), "score": pa.array(score, pa.int64())})


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", column: str = "embedding", pivots: int = PIVOTS, block: int = QUERIES, part: int = ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row of ``queries`` its ``k`` best rows of ``embeddings``, but its own."""
    base = materialize(vectors(embeddings, id_column, column), "vectors")
    asked = materialize(vectors(queries, id_column, column), "query-vectors")
    places = k + 1
    sample = sample_of(base, "id", SAMPLE).select("v").toArrow().column("v").to_pylist()
    if not sample:
        return base.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    cells = Cells(far_apart(decoded(sample), pivots))
    n = len(cells.pivots)
    rows = materialize(in_cells(first_of_equals(base, places), cells), "cells")
    near = F.row_number().over(Window.partitionBy("cell").orderBy("distance", "id"))
    summary = rows.withColumn("_r", near).filter(F.col("_r") <= places).select("v").toArrow().column("v").to_pylist()
    # Equal queries are one, named by the smallest id.
    distinct = materialize(in_cells(asked.groupBy("v").agg(F.min("id").alias("query")), cells), "distinct-queries")
    # What reaches the driver is at most a row for each pair of cells.
    apart, count = np.full((n, n), np.inf), np.zeros(n, np.int64)
    for r in thresholds(distinct, cells, summary, k).collect():
        apart[r.own, r.cell], count[r.own] = r.apart, r.queries
    steps = F.array(*[F.lit(j / 16) for j in range(17)])
    spread = {r.cell: (r.n, r.q) for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("distance", steps, 1000).alias("q")).collect()}
    groups = grouped(apart, spread, cells.pivots, count, block)
    spark = base.sparkSession
    least = [(g, c, float(apart[own][:, c].min())) for g, own in enumerate(groups) for c in range(n)]
    needed = spark.createDataFrame([r for r in least if r[2] < np.inf], "group int, cell int, apart double")
    reached = rows.join(F.broadcast(needed), "cell").filter(F.col("distance") >= F.col("apart")).select("group", "id", "v")
    sizes = {r.group: r.n for r in reached.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    shape = [(g, c, max(1, math.ceil(sizes.get(g, 0) / part)), max(1, math.ceil(int(count[own].sum()) / block))) for g, own in enumerate(groups) for c in own]
    by_cell = F.broadcast(spark.createDataFrame(shape, "group int, cell int, parts int, blocks int"))
    by_group = F.broadcast(spark.createDataFrame(sorted({(g, p, b) for g, _, p, b in shape}), "group int, parts int, blocks int"))
    share = lambda key, seed, of: F.pmod(F.xxhash64(key, F.lit(seed)), F.col(of)).cast("int")
    each_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    unit = ["group", "block", "part"]
    right = reached.join(by_group, "group").withColumn("part", share("id", 5, "parts")).withColumn("block", each_of("blocks")).select(*unit, "id", "v")
    left = distinct.join(by_cell, "cell").withColumn("block", share("query", 11, "blocks")).withColumn("part", each_of("parts")).select(*unit, "query", "v")

    def meet(own: pa.Table, others: pa.Table) -> pa.Table:
        return solved(own, others, places)

    local = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(meet, "query long, id long, score long")
    ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    merged = local.withColumn("_r", ranked).filter(F.col("_r") <= places).drop("_r")
    # Each query takes out its own id and the place that is over.
    each = asked.join(distinct.select("v", "query"), "v").select(F.col("id").alias("query_id"), "query")
    others = each.join(merged, "query").filter(F.col("id") != F.col("query_id"))
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return others.withColumn("rank", last).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
