"""Chat formatting with typed content parts.

A visitor walks the parts of every turn in order.  Text is escaped, an image, an
audio clip or a document becomes a numbered placeholder; the visitor records which
attachment stands where and how many tokens it expands to.

The template
    <s>[TURN:role]body[/TURN]...[TURN:role]body[/TURN]</s>
uses ``<`` and ``[`` for control strings only: inside roles and bodies a
backslash goes before every ``<``, ``[`` and backslash, which :func:`unescape` takes out.
A ``]`` ends the role, so one inside a role is escaped too.  References stand in the table
of attachments, not in the string.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<ordinal:int,turn:int,type:string,ref:string,tokens:long,at:long>"
SPAN = "struct<start:long,stop:long>"
FORMATTED = f"formatted string, loss_spans array<{SPAN}>, attachments array<{ATTACHMENT}>, expanded_tokens long, n_turns long"

BOS, EOS, TURN, BODY, END = "<s>", "</s>", "[TURN:", "]", "[/TURN]"
_SPECIAL, _ROLE_SPECIAL = re.compile(r"[\\<\[]"), re.compile(r"[\\<\[\]]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TOKEN = re.compile(r"\\.|<s>|</s>|\[TURN:|\[/TURN\]|<(?:image|audio|document):\d+>|\]", re.S)


def escape(text: str, special: re.Pattern = _SPECIAL) -> str:
    return special.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group(1), text)


class PartVisitor:
    """Flattens the typed parts of one conversation; tokens per unit are parameters."""

    def __init__(self, patch: int = 28, audio_rate: float = 12.5, page_tokens: int = 800):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.attachments: list[dict] = []
        self.pieces: list[str] = []
        self.length = 0
        self.turn = 0

    def write(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit(self, part: dict) -> None:
        """An unknown or null type counts as text, so nothing is lost."""
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.write(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or self.patch) / self.patch) * math.ceil((part.get("height") or self.patch) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 1) * self.page_tokens)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"ordinal": len(self.attachments), "turn": self.turn, "type": kind, "ref": part.get("ref"), "tokens": int(tokens), "at": self.length})
        self.write(f"<{kind}:{len(self.attachments) - 1}>")


def format_turns(turns: Iterator[tuple[str, list[dict]]], loss_roles=("assistant",), **tokens) -> dict:
    """Formats (role, parts) turns; the loss spans are code points of the bodies whose role is in ``loss_roles``."""
    visitor, spans = PartVisitor(**tokens), []
    visitor.write(BOS)
    for visitor.turn, (role, parts) in enumerate(turns):
        visitor.write(TURN + escape(role, _ROLE_SPECIAL) + BODY)
        start = visitor.length
        for part in parts:
            visitor.visit(part)
        if role in loss_roles:
            spans.append({"start": start, "stop": visitor.length})
        visitor.write(END)
    visitor.write(EOS)
    n = visitor.turn + 1 if len(visitor.pieces) > 2 else 0
    return {"formatted": "".join(visitor.pieces), "loss_spans": spans, "attachments": visitor.attachments, "expanded_tokens": sum(a["tokens"] for a in visitor.attachments), "n_turns": n}


def parse_formatted(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; placeholders stay in the text."""
    turns, role, start, at = [], None, 0, 0
    if not formatted.startswith(BOS) or not formatted.endswith(EOS):
        raise ValueError("not a formatted conversation")
    state = "between"
    for m in _TOKEN.finditer(formatted):
        token = m.group()
        if state == "between" and token == TURN:
            state, start = "role", m.end()
        elif state == "role" and token == BODY:
            role, state, at = unescape(formatted[start : m.start()]), "body", m.end()
        elif state == "body" and token == END:
            turns.append((role, unescape(formatted[at : m.start()])))
            state = "between"
        elif state == "body" and token in (BOS, EOS, TURN) or state == "role" and token != BODY and token[0] != "\\":
            raise ValueError(f"control string {token!r} inside a turn")
    if state != "between":
        raise ValueError("an unfinished turn")
    return turns


def read_back(formatted: str, loss_spans: list[dict]) -> dict:
    """What the formatted string and its loss mask say, for checks."""
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n = chars = 0
    for role, text in parse_formatted(formatted):
        turns.update(f"{role}\n{text}\n".encode())
        n += 1
    for span in loss_spans:
        text = unescape(formatted[span["start"] : span["stop"]])
        chars += len(text)
        loss.update(text.encode())
    return {"n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": len(formatted)}


def text_parts(text_col: str = "text"):
    """The content of a plain text column: one text part."""
    fields = [F.lit("text").alias("type"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    fields += [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(*fields))


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts=None, loss_roles=("assistant",), patch: int = 28, audio_rate: float = 12.5, page_tokens: int = 800) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, expanded_tokens, n_turns.

    ``parts`` is a column of an array of ``PART``; by default the column ``text`` as one text part.
    Rows stand in order of ``turn``, ties and repeated rows by role and content, a null turn
    first.  A null role or text is empty; null conversation ids form one conversation.  Other
    columns are not read; an empty table gives an empty result; a very long text is written
    whole.

    The rows of a partition are sorted and streamed, so a task holds one conversation's
    output at a time, however many rows the conversation has.
    """
    conv_type = turns.schema[conv_col].dataType.simpleString()
    shaped = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(parts if parts is not None else text_parts(), F.array().cast(f"array<{PART}>")).alias("parts"))

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)

        def emit(done):
            return pa.RecordBatch.from_pylist(done, schema=out_schema)

        done, size, stream = [], 0, rows()
        row = next(stream, None)
        while row is not None:
            conv = row[0]

            def own():
                nonlocal row
                while row is not None and row[0] == conv:
                    yield row[1], row[2]
                    row = next(stream, None)

            done.append({"conv_id": conv} | format_turns(own(), loss_roles, patch=patch, audio_rate=audio_rate, page_tokens=page_tokens))
            size += len(done[-1]["formatted"])
            if size > 1 << 22 or len(done) >= 2000:
                yield emit(done)
                done, size = [], 0
        if done:
            yield emit(done)

    schema = f"conv_id {conv_type}, {FORMATTED}"
    out_schema = to_arrow_schema(T.StructType.fromDDL(schema))
    return shaped.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.to_json("parts")).mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what :func:`read_back` finds in the output."""
    conv_type = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    own = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            rows = [{"conv_id": r["conv_id"]} | read_back(r["formatted"], r["loss_spans"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=own)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)
