"""Labels from another teacher's ledger, checked, gated and stored in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pupilage.config import TaskSpec
from pupilage.operators.ledger import import_records, import_summary, match_ledger, validate_ledger
from pupilage.operators.records import latest_per_id
from pupilage.operators.validation import settle
from pupilage.sources.records import LabelStore
from pupilage.sources.storage import materialize


@dataclass(frozen=True)
class Imported:
    """``refused`` has the ledger rows that do not belong to the task, with ``violations``."""

    records: DataFrame
    summary: DataFrame
    refused: DataFrame


def import_labels(dataset: DataFrame, lines: DataFrame, spec: TaskSpec, store: LabelStore, on_error: str = "fail") -> Imported:
    """Match the last line per id, refuse what is not of this task, gate, merge.

    ``fail`` stops before anything is stored; ``drop`` and ``quarantine`` store
    the rest, and a refused row keeps the label it had. The two differ in
    ``refused``, which is empty for ``drop``.
    """
    latest = materialize(latest_per_id(lines), "ledger")
    matched = materialize(validate_ledger(match_ledger(dataset, latest), spec), "matched")
    settle(matched, on_error, "ledger")
    bad = F.size("violations") > 0
    refused = matched.filter(bad) if on_error == "quarantine" else matched.limit(0)
    records = materialize(import_records(matched.filter(~bad).drop("violations"), spec), "imported")
    store.merge(records.filter("outcome <> 'missing'").drop("outcome"))
    return Imported(records, import_summary(lines, latest, records), refused)
