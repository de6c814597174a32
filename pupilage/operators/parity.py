"""Compare two sets of answers to the same questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["case", "question"]


def answer_parity(expected: DataFrame, actual: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """One row per (case, question): largest probability gap and a verdict.

    Both tables have ``case, question, type, choice, probabilities,
    act_probability`` and one row per pair. A label the actual answer lacks
    counts as probability 0; an answer missing on either side fails.
    """
    columns = ("type", "choice", "probabilities", "act_probability")
    left = expected.select(*KEYS, *[F.col(c).alias(f"e_{c}") for c in columns], F.lit(True).alias("in_expected"))
    right = actual.select(*KEYS, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("in_actual"))
    both = left.join(right, KEYS, "full")
    gaps = F.transform(
        F.map_keys("e_probabilities"),
        lambda k: F.abs(F.coalesce(F.try_element_at("a_probabilities", k), F.lit(0.0)) - F.try_element_at("e_probabilities", k)),
    )
    comparable = F.col("e_probabilities").isNotNull() & F.col("a_probabilities").isNotNull()
    judged = both.select(
        *KEYS,
        (F.col("in_expected").isNotNull() & F.col("in_actual").isNotNull()).alias("answered"),
        F.coalesce((F.col("e_type") != "choice") | F.col("e_choice").eqNullSafe(F.col("a_choice")), F.lit(False)).alias("same_choice"),
        F.coalesce(F.when(comparable, F.array_max(gaps)), F.lit(0.0)).alias("max_gap"),
        F.abs(F.col("a_act_probability") - F.col("e_act_probability")).alias("act_gap"),
    )
    close = (F.col("max_gap") <= tolerance) & (F.col("act_gap") <= tolerance)
    return judged.withColumn("agrees", F.coalesce(F.col("answered") & F.col("same_choice") & close, F.lit(False)))
