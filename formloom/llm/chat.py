"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them into one string, with a
placeholder for each attachment, in order, and records what each placeholder refers to and how many tokens it stands
for once expanded. Turns are marked as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts every ``<|`` gets a
backslash between its two characters, after any backslashes already there; taking one away again restores the text.

Turns are formatted row by row. Only the digests of a conversation need its turns in order: they are read back from
the formatted turns as a stream over partitions dealt by conversation and sorted by turn, one batch in memory at a
time, however long a conversation is.

Nulls: a null text counts as empty, a null role as an empty role, a null conversation id as a conversation of its own;
null turns come first. Ties in turn are ordered by role and text. Repeated rows count each. Empty tables give empty
results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: One part of a turn's content; the fields that its kind does not use are null.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<ordinal:int,kind:string,ref:string,at:int,tokens:int>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _role_back(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


@dataclass
class Flatten:
    """Visits the parts of one turn in order."""

    patch: int = 28  # pixels of a side of the image patch that one token stands for
    audio_rate: float = 12.5  # tokens a second
    page_tokens: int = 512  # tokens a page
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_unknown)(part)

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"ordinal": len(self.attachments), "kind": kind, "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self._add(f"<|{kind}|>")

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, max(1, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch)))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, (part.get("pages") or 0) * self.page_tokens))

    def visit_unknown(self, part: dict) -> None:
        """A part of an unknown kind is shown by its text."""
        self.visit_text(part)


def format_turn(role: str | None, parts: list[dict] | None, learn: frozenset[str]) -> dict:
    """One formatted turn with its loss span (code points, without the closing mark) and its attachments."""
    flat = Flatten()
    for part in parts or []:
        flat.visit(part or {})
    head = f"{START}{_role(role or '')}\n"
    text = "".join(flat.out)
    for a in flat.attachments:
        a["at"] += len(head)
    loss = (len(head), len(head) + len(text)) if (role or "") in learn else (0, 0)
    return {"formatted": f"{head}{text}{END}\n", "loss_start": loss[0], "loss_end": loss[1], "attachments": flat.attachments}


def format_turns(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, role and parts of `turns`, formatted: conv_id, turn, formatted, loss_start, loss_end, attachments."""
    roles = frozenset(learn)
    schema = f"conv_id long, turn long, formatted string, loss_start int, loss_end int, attachments array<{ATTACHMENT}>"
    kinds = pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int32())])

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                b = whole.slice(lo, 1000)
                rows = [format_turn(r, p, roles) for r, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                column = lambda name, kind: pa.array([x[name] for x in rows], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), column("formatted", pa.string()), column("loss_start", pa.int32()), column("loss_end", pa.int32()), column("attachments", pa.list_(kinds))],
                    ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments"],
                )

    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("parts").cast(f"array<{PART}>")]
    return turns.select(*columns).mapInArrow(formatted, schema)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.S)


class _Digest:
    """What is read back of one conversation so far."""

    def __init__(self, name: int | None):
        self.name, self.turns, self.loss_chars, self.chars, self.attached, self.tokens = name, 0, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int, attachments: list[dict]) -> None:
        role, text = _TURN.fullmatch(formatted).groups()
        self.turns += 1
        self.chars += len(formatted)
        self.all.update(f"{_role_back(role)}\n{unescape(text)}\n".encode())
        learned = unescape(formatted[start:end])
        self.loss_chars += len(learned)
        self.loss.update(learned.encode())
        self.attached += len(attachments)
        self.tokens += sum(a["tokens"] for a in attachments)

    def row(self) -> tuple:
        return (self.name, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attached, self.tokens)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted turns alone."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for name, *turn in zip(*[b.column(k).to_pylist() for k in range(5)]):
                if now is None or name != now.name:
                    if now:
                        rows.append(now.row())
                    now = _Digest(name)
                now.add(*turn)
            if len(rows) > 1000:
                yield packed(rows)
                rows = []
        if now:
            rows.append(now.row())
        if rows:
            yield packed(rows)

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end", "attachments").mapInArrow(digests, schema)


def text_parts(turns: DataFrame) -> DataFrame:
    """A table with one text a turn as turns of one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))
