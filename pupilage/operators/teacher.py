"""Asking a teacher: answers to records, in bounded resumable rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pupilage.config import MAX_CONSECUTIVE_ERRORS, DataError, TaskSpec
from pupilage.functions.probability import (
    act_features,
    answer_to_probabilities,
    argmax,
    calibrate,
    entropy_confidence,
    expected_level,
    gate,
    name_at,
    round4,
    temperature,
    to_label_map,
    valid_probabilities,
)
from pupilage.operators.ledger import REASON_LENGTH, gate_reason
from pupilage.operators.records import first_n, labeling_summary, pending, request_table
from pupilage.operators.runs import first_stops
from pupilage.sources.records import LabelStore
from pupilage.sources.storage import fresh_path, materialize

ANSWER = (
    "seq bigint, id string, content_hash string, question_hash string, "
    "probabilities map<string,double>, noul double, confidence double, act_probability double, error string"
)
ROUND_ROWS = 1_000_000

BatchTeacher = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass(frozen=True)
class Teacher:
    """A batch teacher and the name recorded with its labels.

    ``answer`` maps frames of the request table to frames with the columns of
    ``ANSWER``; a row it cannot answer carries a text in ``error``.
    """

    identity: str
    answer: BatchTeacher


def decoded_answers(df: DataFrame, question_type: str, names: list[str], by_type: dict, by_options: dict) -> DataFrame:
    """Raw option logits (label order) to calibrated, rounded answers.

    Adds p, choice, score, noul, confidence and the act features.
    """
    heat = temperature(F.lit(question_type), F.size("logits"), by_type, by_options)
    scored = df.withColumn("p", calibrate(F.col("logits"), heat))
    is_noul = question_type == "noul"
    sure = F.greatest(F.col("p")[1], 1.0 - F.col("p")[1]) if is_noul else entropy_confidence(F.col("p"))
    empty = F.lit(None).cast("double")
    return scored.select(
        *df.columns,
        F.transform("p", round4).alias("p"),
        (name_at(names, argmax(F.col("p"))) if question_type == "choice" else F.lit(None).cast("string")).alias("choice"),
        (round4(expected_level(F.col("p"))) if question_type == "score" else empty).alias("score"),
        (round4(F.col("p")[1]) if is_noul else empty).alias("noul"),
        round4(sure).alias("confidence"),
        act_features(F.col("p")).alias("act"),
    )


def answers_to_records(answers: DataFrame, spec: TaskSpec, identity: str) -> DataFrame:
    """Gate answers into teacher records; unusable ones become errors."""
    p = answer_to_probabilities(spec, F.col("probabilities"), F.col("noul"))
    fits = F.col("p").isNotNull() & valid_probabilities(F.col("p"), len(spec.labels))
    gated = answers.withColumn("p", p).withColumn("g", F.when(F.col("error").isNull() & fits, gate(F.col("p"), spec)))
    ok = F.col("g").isNotNull()
    problem = (
        F.when(F.col("error").isNotNull(), F.substring("error", 1, REASON_LENGTH))
        .when(F.col("p").isNull(), F.lit("teacher answer lacks a label"))
        .otherwise(F.lit("teacher probabilities are not a distribution over the labels"))
    )
    reason = F.when(~ok, problem).when(F.col("g.status") == "uncertain", F.lit(gate_reason(spec)))

    def when_ok(column: Column) -> Column:
        return F.when(ok, column)

    return gated.select(
        "seq",
        "id",
        "content_hash",
        "question_hash",
        F.lit(identity).alias("teacher"),
        F.coalesce(F.col("g.status"), F.lit("error")).alias("status"),
        F.col("g.teacher_label").alias("teacher_label"),
        F.col("g.label").alias("label"),
        when_ok(to_label_map(spec.label_names, F.col("p"))).alias("probabilities"),
        F.col("g.top").alias("top"),
        F.col("g.margin").alias("margin"),
        when_ok(F.col("confidence")).alias("teacher_confidence"),
        when_ok(F.col("act_probability")).alias("act_probability"),
        reason.alias("reason"),
    )


def label(rows: DataFrame, spec: TaskSpec, teacher: Teacher, store: LabelStore, limit: int | None = None,
          round_rows: int = ROUND_ROWS, state: Column | None = None) -> dict[str, int | str | None]:
    """Label pending rows in rounds, appending each round to ``store``.

    A round has about ``round_rows`` rows; it is written once and cut at the
    first run of five errors; the next call resumes from what the store holds.
    Returns the summary counts.
    """
    if spec.teacher.source == "import":
        raise DataError("this task imports its labels; asking a teacher would overwrite them")
    view = F.to_json("input") if state is None else state
    counts = {"pending": pending(rows, store.latest(), spec).count(), "selected": 0, "accepted": 0,
              "uncertain_to_abstain": 0, "uncertain_dropped": 0, "errors": 0}
    counts["selected"] = counts["pending"] if limit is None else min(limit, counts["pending"])
    # The rows still to ask are fixed before the first round, so errors of this
    # run are not asked twice in it. They are written once, by ranges of ``seq``;
    # a round reads its own folders only and is dealt to all cores.
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rounds = max(1, -(-counts["selected"] // round_rows))
    asking = request_table(first_n(pending(rows, store.latest(), spec), limit), spec, view)
    path = fresh_path(spark, "requests")
    asking.repartitionByRange(rounds, "seq").withColumn("round", F.spark_partition_id()).write.partitionBy("round").parquet(path)
    todo = spark.read.schema(StructType([*asking.schema.fields, StructField("round", IntegerType())])).parquet(path)
    stop, carried = None, 0
    for number in range(rounds if counts["selected"] else 0):
        asked = todo.filter(F.col("round") == number).drop("round").repartition(cores, "seq")
        answers = asked.mapInPandas(teacher.answer, ANSWER)
        records = materialize(answers_to_records(answers, spec, teacher.identity), "round")
        shaped = records.withColumn("run", F.lit(0)).withColumn("is_error", F.col("status") == "error")
        edge = shaped.agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"), F.max(F.when(~F.col("is_error"), F.col("seq"))).alias("good"),
                          F.min(F.when(~F.col("is_error"), F.col("seq"))).alias("first_good")).first()
        stop = _stop_seq(shaped, edge, carried)
        kept = records if stop is None else records.filter(F.col("seq") <= stop)
        store.append(kept)
        summary = labeling_summary(kept).first()
        for name in ("accepted", "uncertain_to_abstain", "uncertain_dropped", "errors"):
            counts[name] += summary[name]
        if edge["good"] is None:
            carried += edge["n"]
        else:
            carried = shaped.filter(F.col("seq") > edge["good"]).count()
        if stop is not None:
            break
    reason = None if stop is None else f"stopped after {MAX_CONSECUTIVE_ERRORS} consecutive teacher errors"
    return {"teacher": teacher.identity, "question_type": spec.teacher.question_type, **counts, "stop_reason": reason}


def _stop_seq(shaped: DataFrame, edge, carried: int) -> int | None:
    """Sequence number of the fifth error in a row, errors of earlier rounds included."""
    need = MAX_CONSECUTIVE_ERRORS - carried
    if carried:
        head = shaped if edge["first_good"] is None else shaped.filter(F.col("seq") < edge["first_good"])
        leading = [r["seq"] for r in head.orderBy("seq").limit(need).select("seq").collect()]
        if len(leading) == need:
            return leading[-1]
    found = first_stops(shaped, "run", "is_error").first()
    return None if found is None else found["stop_seq"]
