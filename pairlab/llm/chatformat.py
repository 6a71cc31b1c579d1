"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>role LF text <|im_end|> LF``.  The rendered turn is read
back by a deterministic parser; when the recovered role and text differ from the source, the
conflicting content is escaped and the turn is rendered again until they are identical.
Escaping puts one backslash more between ``<`` and ``|`` of every ``<``, backslashes, ``|``,
and the parser takes one away, so it is reversible; in roles, line feeds and backslashes are
escaped too.

Rendering is local to a turn.  Conversations are then streamed: rows are dealt by
conversation and sorted inside the partition by turn, and the digest of one conversation is
carried from batch to batch, so a conversation of any length takes bounded memory.

Edge cases: a null text or role is an empty one; turns with equal numbers are ordered by role
and text, null turns come first; a null conversation id is a conversation of its own; repeated
rows are turns of their own; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import slices

START, END = "<|im_start|>", "<|im_end|>"
_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ROLE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\p")


def unescape_role(role: str) -> str:
    return _ROLE.sub(lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered text, or None when it isn't a sequence of whole turns."""
    out, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if m is None or "<|" in m[1] or "<|" in m[2]:
            return None
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and start and end of the text in it."""
    r, t = role, text
    for step in range(4):
        out = f"{START}{r}\n{t}{END}\n"
        if parse(out) == [(role, text)]:
            at = len(START) + len(r) + 1
            return out, at, at + len(t)
        if step == 0:
            t = escape(text)
        elif step == 1:
            r, t = escape_role(role), text
        else:
            r, t = escape_role(role), escape(text)
    raise ValueError("a turn can't be rendered reversibly")


TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                      T.StructField("rendered", T.StringType()), T.StructField("loss_start", T.IntegerType()),
                      T.StructField("loss_end", T.IntegerType())])


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a turn: its rendered form and the part of it under the loss mask
    (loss_start = loss_end for turns outside the mask)."""
    src = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                       F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            for b in slices(batch, 2048):
                done = [render_turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                mask = [(s, e) if r in loss_roles else (s, s)
                        for (_, s, e), r in zip(done, b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([d[0] for d in done], pa.string()),
                     pa.array([m[0] for m in mask], pa.int32()), pa.array([m[1] for m in mask], pa.int32())],
                    TURNS.fieldNames())

    return src.mapInArrow(run, TURNS)


DIGEST = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
                       T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                       T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])


class _Running:
    """Digest of one conversation, read back from its rendered turns."""

    def __init__(self, conv):
        self.conv, self.n, self.loss, self.chars = conv, 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str, lo: int, hi: int) -> None:
        for role, text in parse(rendered):
            self.n += 1
            self.turns_hash.update(f"{role}\n{text}\n".encode())
        masked = unescape(rendered[lo:hi])
        self.loss += len(masked)
        self.loss_hash.update(masked.encode())
        self.chars += len(rendered)

    def row(self) -> dict:
        return {"conv_id": self.conv, "n_turns": self.n, "turns_sha256": self.turns_hash.hexdigest(),
                "loss_chars": self.loss, "loss_sha256": self.loss_hash.hexdigest(), "formatted_chars": self.chars}


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what a reader recovers from its rendered turns in order."""
    src = (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
           .select("conv_id", "rendered", "loss_start", "loss_end"))
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        now = None
        for batch in batches:
            rows = []
            for conv, rendered, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    if now is not None:
                        rows.append(now.row())
                    now = _Running(conv)
                now.add(rendered, lo, hi)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    return src.mapInArrow(run, DIGEST)
