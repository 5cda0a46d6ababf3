"""Chat formatting with a grammar round trip.

A turn is rendered as ``<turn ROLE LEVEL>``, a line feed, the body, ``</turn>`` and a line feed. A body is first
rendered as it is (level 0) and parsed back by the deterministic parser; if that does not give the source, it is
rendered with its control strings escaped (level 1) and parsed again, until the turn is identical. The level
stands in the header, so a reader needs no guess.

Rows stream through in the order of (conversation, turn): one turn is in memory at a time, however long a
conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import project

OPEN, CLOSE = "<turn ", "</turn>"
_HEADER = re.compile(r"<turn ((?:[^\\ >\n]|\\[\\sgn])*) ([01])>\n")
_ROLE = {"\\": "\\\\", " ": "\\s", ">": "\\g", "\n": "\\n"}
_ROLE_BACK = {v: k for k, v in _ROLE.items()}
#: Role whose texts are under the loss mask.
LOSS_ROLE = "assistant"


def escape(text: str, level: int) -> str:
    if not level:
        return text
    return text.replace("\\", "\\\\").replace(CLOSE, "<\\/turn>").replace(OPEN, "<\\turn ")


def unescape(body: str, level: int) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", body) if level else body


def render_at(role: str, text: str, level: int) -> str:
    name = re.sub(r"[\\ >\n]", lambda m: _ROLE[m[0]], role)
    return f"{OPEN}{name} {level}>\n{escape(text, level)}{CLOSE}\n"


def parse(rendered: str, at: int = 0) -> Iterator[tuple[str, str]]:
    """Roles and texts of rendered turns; ValueError where the text is not of the grammar."""
    while at < len(rendered):
        head = _HEADER.match(rendered, at)
        if not head:
            raise ValueError(f"no turn header at {at}")
        end = rendered.find(CLOSE + "\n", head.end())
        body = rendered[head.end() : end]
        if end < 0 or OPEN in body or CLOSE in body:
            raise ValueError(f"the turn at {at} is not closed, or holds a control string")
        yield re.sub(r"\\[\\sgn]", lambda m: _ROLE_BACK[m[0]], head[1]), unescape(body, int(head[2]))
        at = end + len(CLOSE) + 1


def render(role: str, text: str) -> str:
    """The turn at the lowest level that parses back to itself."""
    for level in (0, 1):
        out = render_at(role, text, level)
        try:
            if list(parse(out)) == [(role, text)]:
                return out
        except ValueError:
            pass
    raise AssertionError("level 1 parses back for every text")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, formatted: the rendered turns; those of a conversation, by ``turn``, are its formatted text.

    Null roles and texts count as empty. Rows with equal turn numbers (a null one comes first) follow by role, then text;
    repeated rows are turns of their own; rows without a conv_id are one conversation. A very long turn is rendered whole.
    Other columns take no part; an empty table gives an empty one.
    """
    rows = project(conversations, conv_id="long", turn="long", role="string", text="string").fillna("", ["role", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(made, pa.string())], names=["conv_id", "turn", "role", "text", "formatted"])

    ordered = rows.mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string")
    return ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "formatted")


class _Digest:
    """What is read back from one conversation, turn by turn."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.n = conv_id, hashlib.sha256(), 0
        self.loss, self.loss_chars, self.chars = hashlib.sha256(), 0, 0

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == LOSS_ROLE:
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation with what the parser recovers from its formatted turns (as ``format_turns`` deals them)."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for conv, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if now is None or now.conv_id != conv:
                    if now:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(text)
            if len(done) > 10_000:
                yield out()
                done.clear()
        if now:
            done.append(now.row())
        yield out()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame, conv_id: int, turns: list[tuple[str, str]]) -> DataFrame:
    """The conversations and one more, given as (role, text) pairs."""
    spark = conversations.sparkSession
    rows = [spark.range(1).select(F.lit(conv_id).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(t).alias("text")) for i, (r, t) in enumerate(turns)]
    out = project(conversations, conv_id="long", turn="long", role="string", text="string")
    for r in rows:
        out = out.unionByName(r)
    return out
