"""Chat formatting with a grammar that reads back what was written.

    conversation := turn*
    turn         := open text close
    open, close  := by role, see MARKS; other roles use "<role:NAME> " and " </role>"

A backslash takes the next character literally. Text is first written as it is;
if the deterministic parser does not give back exactly the turn, every backslash
and every control string in it is escaped and the result is parsed again, until
it does. So a control string inside a text never reads as one.

Defined cases: null text and null role are empty; turns go by ``turn``, then
role, then text, nulls first; repeated turns are all kept; a conversation may
start and end with any role; an empty table gives no rows; only ``conv_id``,
``turn``, ``role`` and ``text`` are read. Rows are written where they are read.
A conversation is read back in order by one task, one turn at a time, as its
digest is one sequence; no conversation is held in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER, CLOSE_OTHER = "<role:", " </role>"
CONTROL = re.compile(r"<</?SYS>>|\[/?INST\]|</?s>|<role:|</role>")
ESCAPE = "\\"


class Conflict(ValueError):
    """The text does not follow the grammar."""


def _escaped(text: str) -> str:
    return CONTROL.sub(lambda m: ESCAPE + m[0], text.replace(ESCAPE, ESCAPE * 2))


def _written(role: str, text: str) -> str:
    if role in MARKS:
        start, end = MARKS[role]
        return start + text + end
    name = role.replace(ESCAPE, ESCAPE * 2).replace(">", ESCAPE + ">")
    return f"{OTHER}{name}> {text}{CLOSE_OTHER}"


def render(role: str, text: str) -> str:
    """One turn as text that ``parse`` turns back into it."""
    out = _written(role, text)
    tries = 0
    while True:
        try:
            if parse(out) == [(role, text)]:
                return out
        except Conflict:
            pass
        if tries:
            raise Conflict(f"cannot write a turn of role {role!r}")
        tries, out = 1, _written(role, _escaped(text))


def _take(source: str, at: int, end: re.Pattern) -> tuple[str, re.Match, int]:
    """Unescaped text from ``at`` to the first match of ``end`` that is not escaped."""
    parts = []
    while True:
        stop = end.search(source, at)
        slash = source.find(ESCAPE, at)
        if stop is None and slash < 0:
            raise Conflict("a turn is not closed")
        if slash >= 0 and (stop is None or slash < stop.start()):
            parts.append(source[at:slash] + source[slash + 1 : slash + 2])
            at = slash + 2
            continue
        parts.append(source[at : stop.start()])
        return "".join(parts), stop, stop.end()


NAME_END = re.compile(">")


def parse(source: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(source):
        for role, (start, end) in MARKS.items():
            if source.startswith(start, at):
                at += len(start)
                break
        else:
            if not source.startswith(OTHER, at):
                raise Conflict("a turn has no mark")
            role, _, at = _take(source, at + len(OTHER), NAME_END)
            if not source.startswith(" ", at):
                raise Conflict("a role's name is not followed by a space")
            at, end = at + 1, CLOSE_OTHER
        text, found, after = _take(source, at, CONTROL)
        core = end.strip()
        lead, tail = end[: end.index(core)], end[end.index(core) + len(core) :]
        if found[0] != core or not text.endswith(lead) or not source.startswith(tail, after):
            raise Conflict("a control string stands in a text")
        turns.append((role, text[: len(text) - len(lead)]))
        at = after + len(tail)
    return turns


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        written = [render(role.as_py() or "", text.as_py() or "") for role, text in zip(batch.column("role"), batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(written, pa.string())], ["conv_id", "turn", "role", "formatted"])


def formatted(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``formatted`` of every turn; a conversation's text is its turns' in order."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    kinds = [rows.schema[name].dataType.simpleString() for name in ("conv_id", "turn")]
    return rows.mapInArrow(_render, f"conv_id {kinds[0]}, turn {kinds[1]}, role string, formatted string")


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, from its formatted turns: number of turns, digests of turns and of the text under the loss mask, lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, state = None, None

        def close() -> None:
            if state is not None:
                done.append((conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]))

        for batch in batches:
            for own, source in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist()):
                if state is None or own != conv:
                    close()
                    conv, state = own, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                state["all"] += len(source)
                for role, text in parse(source):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        state["chars"] += len(text)
                        state["loss"].update(text.encode())
            if len(done) > 10_000:
                yield table(done)
                done = []
        close()
        yield table(done)

    def table(done: list[tuple]) -> pa.RecordBatch:
        kinds = (None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], arrow if k == 0 else kind) for k, kind in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = turns.schema["conv_id"].dataType
    arrow = pa.string() if kind.simpleString() == "string" else pa.int32() if kind.simpleString() == "int" else pa.int64()
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), "formatted")
    return ordered.select("conv_id", "formatted").mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
