"""License scans: TF-IDF cosine of lines to license templates, then inheritance by path.

Every line of every text is a vector of its words, weighted by term frequency
and inverse document frequency; document frequencies of the templates' words are
counted over all texts, and any other word weighs one. A line is a notice of the
template with the greatest cosine, if that reaches ``LEAST``. Lines without any
of the words that a cosine of ``LEAST`` needs are passed over; that bound is
exact. Files named like a license speak for their directory, and a file without
a notice takes the license of its nearest ancestor directory that has one: the
directories' ancestors are joined with the licensed directories, so no file is
copied for its ancestors.

Defined cases: null and empty texts have no notice; ties go to the template that
comes first by name, for a directory to the greater score and then the first
path; a null path has no directory and inherits nothing; repeated rows are
scanned each; lines longer than three times the longest template are read in
windows of that length that overlap by half; only ``doc_id``, ``path`` and
``text`` are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pupilage.sources.storage import materialize

LEAST = 0.6
#: Short notices, written from the licenses' names; a parameter of every function.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD style license",
    "CC-BY-4.0": "Licensed under Creative Commons CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0",
}
WORD = re.compile(r"[a-z0-9]+(?:[.][0-9]+)*")
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([._-].*)?$"


def words(line: str) -> list[str]:
    return WORD.findall(line.lower())


@dataclass(frozen=True)
class Templates:
    names: tuple[str, ...]
    weight: dict[str, float]
    vectors: tuple[dict[str, float], ...]
    #: Words of which a line must have one to reach the least cosine.
    needed: frozenset[str]
    width: int

    @classmethod
    def of(cls, templates: dict[str, str], frequency: dict[str, int], texts: int, least: float) -> Templates:
        names = tuple(sorted(templates))
        counts = [Counter(words(templates[name])) for name in names]
        weight = {w: 1 + math.log((1 + texts) / (1 + frequency.get(w, 0))) for c in counts for w in c}
        vectors = []
        for count in counts:
            vector = {w: n * weight[w] for w, n in count.items()}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            vectors.append({w: v / norm for w, v in vector.items()})
        # A line of other words alone has a cosine of at most the length of its part of a template.
        common: set[str] = set()
        for w in sorted(weight, key=lambda w: (weight[w], w)):
            if any(math.sqrt(sum(v.get(x, 0) ** 2 for x in common | {w})) >= least for v in vectors):
                break
            common.add(w)
        return cls(names, weight, tuple(vectors), frozenset(set(weight) - common), 3 * max((sum(c.values()) for c in counts), default=1))

    def best(self, line: list[str]) -> tuple[float, str]:
        count = Counter(line)
        vector = {w: n * self.weight.get(w, 1.0) for w, n in count.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        scores = [sum(v * vector.get(w, 0.0) for w, v in template.items()) / norm for template in self.vectors]
        top = int(np.argmax(scores))
        return scores[top], self.names[top]


def _lines(text: str, width: int) -> Iterator[list[str]]:
    for line in text.splitlines():
        found = words(line)
        if len(found) <= width:
            if found:
                yield found
            continue
        for at in range(0, len(found) - width // 2, width // 2):
            yield found[at : at + width]


def frequencies(files: DataFrame, templates: dict[str, str]) -> tuple[dict[str, int], int]:
    """In how many texts each word of the templates occurs, and the number of texts."""
    vocabulary = frozenset(w for text in templates.values() for w in words(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        rows = 0
        for batch in batches:
            for text in batch.column("text"):
                count.update(vocabulary.intersection(words(text.as_py() or "")))
                rows += 1
        yield pa.RecordBatch.from_arrays([pa.array([*count, ""], pa.string()), pa.array([*count.values(), rows], pa.int64())], ["word", "n"])

    # One row for each word of the templates.
    found = {r["word"]: r["n"] for r in files.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop("", 0)


def notices(files: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, path, and the best notice of each file: ``own_license`` and ``own_score``, or null."""
    model = Templates.of(templates, *frequencies(files, templates), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text"):
                best: tuple[float, str] | None = None
                for line in _lines(text.as_py() or "", model.width):
                    if model.needed.isdisjoint(line):
                        continue
                    score, name = model.best(line)
                    if score >= least and (best is None or (-score, name) < (-best[0], best[1])):
                        best = (score, name)
                names.append(best and best[1])
                scores.append(best and best[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "path", "own_license", "own_score"])

    source = files.select("doc_id", "path", "text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, path string, own_license string, own_score double")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """The notices, with ``license`` (own or inherited) and ``inherited_from`` (the directory, or null)."""
    found = materialize(notices(files, templates, least).withColumn("dir", directory(F.col("path"))), "notices")
    speaking = found.filter(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILE) & F.col("own_license").isNotNull())
    # A directory's license: greatest score, then first path and name. Few files are license files, and a hot directory is pre-aggregated.
    first = F.min(F.struct((-F.col("own_score")).alias("rank"), "path", "own_license")).alias("best")
    licensed = speaking.groupBy("dir").agg(first).select(F.col("dir").alias("ancestor"), F.col("best.own_license").alias("dir_license"))
    dirs = found.select("dir").filter("dir is not null").distinct()
    parts = F.split("dir", "/")
    ancestors = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "ancestor"))
    nearest = ancestors.join(licensed, "ancestor")
    deepest = Window.partitionBy("dir").orderBy(F.desc("depth"))
    nearest = nearest.withColumn("place", F.row_number().over(deepest)).filter("place = 1").select("dir", "ancestor", "dir_license")
    joined = found.join(nearest, "dir", "left")
    own = F.col("own_license").isNotNull()
    return joined.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"), F.when(~own, F.col("ancestor")).alias("inherited_from"))
