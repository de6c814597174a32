"""Small-vector columns: one array of at most 32 label probabilities per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pupilage.config import TaskSpec

# Fixed values of the gate and of calibration.
GATE_TOLERANCE = 1e-9
SUM_TOLERANCE = 0.02
MIN_TEMPERATURE = 0.5
MAX_TEMPERATURE = 5.0
ENTROPY_FLOOR = 1e-9


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    exps = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(exps, lambda e: e / total(exps))


def argmax(values: Column) -> Column:
    """Position of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def runner_up(values: Column) -> Column:
    return F.element_at(F.sort_array(values, asc=False), 2)


def round4(x: Column) -> Column:
    """Four decimals, half away from zero."""
    return F.round(x * 10000) / 10000


def name_at(names: list[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), position + 1)


def index_of(names: list[str], name: Column) -> Column:
    """Spec position of a label; null for null or undeclared names."""
    chosen = F.lit(None).cast("int")
    for i, declared in reversed(list(enumerate(names))):
        chosen = F.when(name == declared, F.lit(i)).otherwise(chosen)
    return chosen


def to_label_map(names: list[str], values: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), values)


def from_label_map(names: list[str], probabilities: Column) -> Column:
    return F.array(*[F.try_element_at(probabilities, F.lit(n)) for n in names])


def valid_probabilities(p: Column, size: int) -> Column:
    """Right length, every value finite and in [0, 1], sum within 0.02 of 1."""
    in_range = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0.0) & (x <= 1.0))
    return F.coalesce(p.isNotNull() & (F.size(p) == size) & in_range & (F.abs(total(p) - 1.0) <= SUM_TOLERANCE), F.lit(False))


def gate(p: Column, spec: TaskSpec) -> Column:
    """Struct (status, teacher_label, label, top, margin) for valid ``p``."""
    top = F.array_max(p)
    margin = top - runner_up(p)
    teacher_label = name_at(spec.label_names, argmax(p))
    sure = (top + GATE_TOLERANCE >= spec.teacher.min_confidence) & (margin + GATE_TOLERANCE >= spec.teacher.min_margin)
    fallback = spec.abstain.label if spec.teacher.uncertain == "abstain" and spec.abstain else None
    return F.struct(
        F.when(sure, F.lit("accepted")).otherwise(F.lit("uncertain")).alias("status"),
        teacher_label.alias("teacher_label"),
        F.when(sure, teacher_label).otherwise(F.lit(fallback).cast("string")).alias("label"),
        top.alias("top"),
        margin.alias("margin"),
    )


def answer_to_probabilities(spec: TaskSpec, probabilities: Column, noul: Column) -> Column:
    """Teacher answer in label order; null when the answer lacks a label."""
    if spec.teacher.question_type == "noul":
        return F.when(noul.isNotNull(), F.array(1.0 - noul, noul))
    keys = spec.label_names
    if spec.teacher.question_type == "score":
        keys = [str(i) for i in range(len(spec.labels))]
    values = F.array(*[F.try_element_at(probabilities, F.lit(k)) for k in keys])
    return F.when(probabilities.isNotNull() & F.forall(values, lambda v: v.isNotNull()), values)


def option_bucket(count: Column) -> Column:
    return F.when(count <= 2, F.lit("2")).when(count <= 5, F.lit("3-5")).when(count <= 10, F.lit("6-10")).otherwise(F.lit("11+"))


def temperature(question_type: Column, count: Column, by_type: dict[str, float], by_options: dict[str, float]) -> Column:
    """Temperature for ``type:bucket``, else the type's own, kept in [0.5, 5]."""
    key = F.concat_ws(":", question_type, option_bucket(count))
    chosen = F.lit(None).cast("double")
    for name, value in by_type.items():
        chosen = F.when(question_type == name, F.lit(float(value))).otherwise(chosen)
    for name, value in by_options.items():
        chosen = F.when(key == name, F.lit(float(value))).otherwise(chosen)
    return F.least(F.lit(MAX_TEMPERATURE), F.greatest(F.lit(MIN_TEMPERATURE), chosen))


def calibrate(logits: Column, heat: Column) -> Column:
    return softmax(F.transform(logits, lambda x: x / heat))


def entropy_confidence(p: Column) -> Column:
    """1 - H(p)/ln k in [0, 1]; a single option is certain."""
    entropy = F.aggregate(p, F.lit(0.0), lambda acc, x: F.when(x > 0, acc - x * F.ln(x)).otherwise(acc))
    scaled = 1.0 - entropy / F.ln(F.size(p).cast("double"))
    return F.when(F.size(p) <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def expected_level(p: Column) -> Column:
    indexed = F.transform(p, lambda x, i: x * i)
    return total(indexed)


def act_features(p: Column) -> Column:
    """Struct (top, gap, entropy, count_share) describing one answer."""
    count = F.greatest(F.lit(2), F.size(p)).cast("double")
    entropy = F.aggregate(p, F.lit(0.0), lambda acc, x: acc - x * F.ln(F.greatest(x, F.lit(ENTROPY_FLOOR))))
    return F.struct(
        F.array_max(p).alias("top"),
        (F.array_max(p) - runner_up(p)).alias("gap"),
        (entropy / F.ln(count)).alias("entropy"),
        (count / 255.0).alias("count_share"),
    )


def label_order(logits: Column, options: Column, spec: TaskSpec) -> Column:
    """Logits in label order; null when counts or option texts do not match.

    Choice options come in the source's own order and are matched by text;
    score and noul options already are in label order.
    """
    finite = F.forall(logits, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    right_size = (F.size(logits) == len(spec.labels)) & (F.size(options) == len(spec.labels)) & finite
    if spec.teacher.question_type != "choice":
        return F.when(right_size, logits)
    positions = [F.array_position(options, F.lit(text)) for text in spec.options]
    ordered = F.array(*[F.try_element_at(logits, F.nullif(p, F.lit(0)).cast("int")) for p in positions])
    return F.when(right_size & F.forall(ordered, lambda x: x.isNotNull()), ordered)


def served_label(p: Column, spec: TaskSpec) -> Column:
    """Struct (label, argmax, confidence, probabilities, abstained)."""
    best = name_at(spec.label_names, argmax(p))
    top = F.array_max(p)
    abstains = top < F.lit(spec.abstain.min_confidence) if spec.abstain else F.lit(False)
    return F.struct(
        F.when(abstains, F.lit(spec.abstain.label if spec.abstain else None)).otherwise(best).alias("label"),
        best.alias("argmax"),
        round4(top).alias("confidence"),
        to_label_map(spec.label_names, F.transform(p, round4)).alias("probabilities"),
        abstains.alias("abstained"),
    )
