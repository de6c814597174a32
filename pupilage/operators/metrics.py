"""Confusion, per-class metrics and the numbers made from them.

All operators take long tables of (reference, predicted) label positions and
may group by further columns, so many models are measured in one job. The
first aggregation leaves at most labels x labels rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, labels: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per (reference, predicted), zero cells included."""
    cells = df.groupBy(*by, "reference", "predicted").agg(F.count(F.lit(1)).alias("n"))
    positions = F.sequence(F.lit(0), F.lit(labels - 1))
    grid = F.explode(F.flatten(F.transform(positions, lambda r: F.transform(positions, lambda p: F.struct(r.alias("reference"), p.alias("predicted"))))))
    if by:
        every = df.select(*by).distinct().select(*by, grid.alias("cell"))
    else:
        every = df.sparkSession.range(1).select(grid.alias("cell"))
    frame = every.select(*by, "cell.reference", "cell.predicted")
    return frame.join(cells, [*by, "reference", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def class_metrics(df: DataFrame, labels: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label; undefined ratios are 0."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("reference") == F.col("predicted"), F.col("n")).otherwise(zero)
    parts = F.array(
        F.struct(F.col("reference").alias("label_index"), F.col("n").alias("support"), zero.alias("predicted_count"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("label_index"), zero.alias("support"), F.col("n").alias("predicted_count"), zero.alias("hits")),
    )
    sides = confusion(df, labels, by).select(*by, F.explode(parts).alias("part")).select(*by, "part.*")
    sums = sides.groupBy(*by, "label_index").agg(
        F.sum("support").alias("support"), F.sum("predicted_count").alias("predicted_count"), F.sum("hits").alias("hits")
    )
    scored = sums.withColumn("precision", ratio("hits", "predicted_count")).withColumn("recall", ratio("hits", "support"))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both == 0, F.lit(0.0)).otherwise(F.lit(2.0) * F.col("precision") * F.col("recall") / both)
    return scored.withColumn("f1", f1).select(*by, "label_index", "precision", "recall", "f1", "support", "hits")


def ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) == 0, F.lit(0.0)).otherwise(F.col(part).cast("double") / F.col(whole).cast("double"))


def metrics(df: DataFrame, labels: int, by: tuple[str, ...] = ()) -> DataFrame:
    """n, accuracy and macro-F1 over the labels that have support."""
    per_label = class_metrics(df, labels, by)
    supported = F.when(F.col("support") > 0, F.col("f1"))
    return per_label.groupBy(*by).agg(
        F.sum("support").alias("examples"),
        F.when(F.sum("support") == 0, F.lit(0.0)).otherwise(F.sum("hits").cast("double") / F.sum("support").cast("double")).alias("accuracy"),
        F.coalesce(F.avg(supported), F.lit(0.0)).alias("macro_f1"),
    )


def majority_label(train: DataFrame, column: str = "label_index") -> DataFrame:
    """The most frequent label, the lowest position on ties; one row."""
    counts = train.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(F.col(column), F.struct(-F.col("n"), F.col(column))).alias("label_index"), F.max("n").alias("n"))


def with_constant_prediction(df: DataFrame, label_index: int | None) -> DataFrame:
    return df.withColumn("predicted", F.lit(0 if label_index is None else label_index))


def abstain_rate(df: DataFrame) -> DataFrame:
    """Share of rows whose served label differs from the model's own top label."""
    return df.agg(F.avg((F.col("served") != F.col("argmax")).cast("double")).alias("abstain_rate"))


def class_weights(train: DataFrame, labels: int, mode: str = "balanced", column: str = "label_index") -> DataFrame:
    """(label_index, weight): n / (present x n_c), 0 for absent classes."""
    every = F.array(*[F.lit(i) for i in range(labels)])
    if mode == "none":
        return train.sparkSession.range(1).select(F.explode(every).alias("label_index"), F.lit(1.0).alias("weight"))
    # One row of at most 32 counters: no shuffle of labels, no join.
    counted = train.agg(F.array(*[F.count_if(F.col(column) == i) for i in range(labels)]).alias("counts"))
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    present = F.size(F.filter("counts", lambda n: n > 0))
    sized = counted.select("counts", total.alias("total"), present.alias("present"))
    cells = sized.select("total", "present", F.posexplode("counts").alias("label_index", "n"))
    weight = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("total").cast("double") / (F.col("present") * F.col("n")))
    return cells.select("label_index", weight.alias("weight"))
