"""Conversations as marked-up text with a loss mask.

A message holds typed content parts (text, image, audio, document). A visitor
flattens them in order: text is escaped, every other part becomes a placeholder
with its number in the message, and an attachment record keeps its reference and
the tokens it will expand to. A message is written as

    <|turn|>role NEWLINE content <|end|> NEWLINE

and its place in the formatted conversation follows from the lengths of the
messages before it, so a conversation is never held whole: it stays one row per
message, in order. The loss mask covers the content of the roles to be learned.

Escaping puts a backslash after every `<`, `[` and backslash of a text, so that
no control string, of this or another template, survives inside a text, and
reading takes it out again.

Defined cases: null text and null parts are empty, a null role is empty, a null
conversation or turn is a key like any other (first in order). Messages of one
turn are ordered by role, then content; repeated rows are kept. Parts of an
unknown type become placeholders of that type without expanded tokens. Very long
texts are formatted one by one and stay in one row. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
LEARNED = ("assistant",)

PIECE = (
    "conv_id bigint, seq bigint, formatted string, start bigint, loss_start bigint, loss_end bigint, "
    "attachments array<struct<kind:string,ref:string,tokens:bigint,position:bigint>>"
)

_ESCAPE = re.compile(r"[<\[\\]")
_ESCAPED = re.compile(r"([<\[\\])\\|\\n")
_MESSAGE = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """Undoes escape(); a lone backslash before an n, which only header() writes, is a newline."""
    return _ESCAPED.sub(lambda m: m[1] or "\n", text)


class Attachment(NamedTuple):
    kind: str
    ref: str
    tokens: int
    position: int


class Flattener:
    """Visits the parts of one message; `content` and `attachments` hold what it has seen."""

    def __init__(self, patch: int = 28, per_second: float = 25.0, per_page: int = 512):
        self.patch, self.per_second, self.per_page = patch, per_second, per_page
        self.content: list[str] = []
        self.length = 0
        self.attachments: list[Attachment] = []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(kind, part)

    def visit_text(self, kind: str, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, kind: str, part: dict) -> None:
        across = -(-int(part.get("width") or 0) // self.patch)
        down = -(-int(part.get("height") or 0) // self.patch)
        self._place(kind, part, across * down)

    def visit_audio(self, kind: str, part: dict) -> None:
        self._place(kind, part, int(-(-float(part.get("seconds") or 0) * self.per_second // 1)))

    def visit_document(self, kind: str, part: dict) -> None:
        self._place(kind, part, int(part.get("pages") or 0) * self.per_page)

    def visit_other(self, kind: str, part: dict) -> None:
        self._place(kind, part, 0)

    def _place(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append(Attachment(kind, part.get("ref") or "", tokens, self.length))
        self._add(f"<|{escape(kind)}:{len(self.attachments) - 1}|>")

    def _add(self, piece: str) -> None:
        self.content.append(piece)
        self.length += len(piece)


def flatten(parts: list[dict]) -> tuple[str, list[Attachment]]:
    visitor = Flattener()
    for part in parts:
        visitor.visit(part or {})
    return "".join(visitor.content), visitor.attachments


def header(role: str) -> str:
    return TURN + escape(role).replace("\n", "\\n") + "\n"


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every message in formatted text."""
    return [(unescape(role), unescape(content)) for role, content in _MESSAGE.findall(formatted)]


def text_part(text: Column) -> Column:
    """A plain text as the only part of its message."""
    none = {n: F.lit(None).cast(t) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    fields = {"type": F.lit("text"), "text": F.coalesce(text, F.lit("")), **none}
    return F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """Rows of a conversation side by side and in order, without gathering them in memory."""
    return df.repartition("conv_id", "null_id").sortWithinPartitions("conv_id", "null_id", *order)


def key_columns() -> list[Column]:
    """conv_id without nulls, which would turn it into a float on the way to pandas, and whether it was one."""
    return [F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("null_id")]


def format_messages(messages: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """messages(conv_id, turn, role, parts) -> one row per message in PIECE's columns.

    A part has type, text, ref, width, height, seconds and pages; those it does not need may be null.

    `formatted` of a conversation's rows by seq, joined, is the formatted
    conversation; start, loss_start and loss_end are code points in it.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, seq, at = object(), 0, 0
        for frame in frames:
            out = []
            for conv_id, null, role, parts in zip(frame["conv_id"], frame["null_id"], frame["role"], frame["parts"]):
                key = None if null else int(conv_id)
                if key != conv:
                    conv, seq, at = key, 0, 0
                content, attachments = flatten(json.loads(parts))
                head = header(role)
                begin = at + len(head)
                piece = f"{head}{content}{END}\n"
                masked = role in learned
                out.append((
                    key, seq, piece, at, begin if masked else None, begin + len(content) if masked else None,
                    [a._replace(position=begin + a.position)._asdict() for a in attachments],
                ))
                seq, at = seq + 1, at + len(piece)
            frame = pd.DataFrame(out, columns=["conv_id", "seq", "formatted", "start", "loss_start", "loss_end", "attachments"])
            yield frame.astype({"conv_id": "Int64", "loss_start": "Int64", "loss_end": "Int64"})

    rows = messages.select(
        *key_columns(), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.to_json("parts"), F.lit("[]")).alias("parts"),
    )
    return in_order(rows, "turn", "role", "parts").mapInPandas(write, PIECE)


def digests(pieces: DataFrame) -> DataFrame:
    """What reading the formatted conversations and their loss mask gives back, one row per conversation."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = object(), None

        def row():
            return (conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["length"])

        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for frame in frames:
            done = []
            for conv_id, null, formatted, begin, end in zip(*(frame[c] for c in ("conv_id", "null_id", "formatted", "begin", "end"))):
                key = None if null else int(conv_id)
                if key != conv:
                    if state:
                        done.append(row())
                    conv, state = key, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "length": 0}
                for role, text in read_back(formatted):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                masked = unescape(formatted[begin:end])
                state["chars"] += len(masked)
                state["loss"].update(masked.encode())
                state["length"] += len(formatted)
            if done:
                yield pd.DataFrame(done, columns=columns).astype({"conv_id": "Int64"})
        if state:
            yield pd.DataFrame([row()], columns=columns).astype({"conv_id": "Int64"})

    span = [F.coalesce(F.col(c) - F.col("start"), F.lit(0)).alias(n) for c, n in (("loss_start", "begin"), ("loss_end", "end"))]
    rows = pieces.select(*key_columns(), "seq", "formatted", *span)
    return in_order(rows, "seq").select("conv_id", "null_id", "formatted", "begin", "end").mapInPandas(
        read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The given messages and conversation -1, whose texts are control strings of other templates."""
    spark = conversations.sparkSession
    probe = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def format_and_read(conversations: DataFrame) -> DataFrame:
    messages = with_probe(conversations).withColumn("parts", text_part(F.col("text"))).drop("text")
    return digests(format_messages(messages))
