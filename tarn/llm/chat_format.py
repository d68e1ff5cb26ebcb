"""Chat formatting with typed content parts.

A visitor flattens the parts of each turn in order: text is escaped and written, an image, an
audio clip or a document becomes a placeholder, and its reference and expanded token count are
recorded. The template marks turns; control strings inside texts are escaped, and ``read_back``
restores the turns and what lies under the loss mask from the formatted string alone.

Scale: turns meet by conversation in one shuffle, sorted, and are formatted as they stream by. A long
conversation is several rows, chunks of about ``CHUNK_CHARS``, so that a task never holds more of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import importable, slices

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

#: The template's own marks, and marks of other public templates.
CONTROL_STRINGS = (
    TURN, BODY, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<unk>", "<pad>",
)
_CONTROL = re.compile("(?=" + "|".join(re.escape(x) for x in sorted(CONTROL_STRINGS, key=len, reverse=True)) + ")(.)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.DOTALL)
_PLACEHOLDER = re.compile("|".join(re.escape(x) for x in PLACEHOLDERS.values()))

PART = "struct<type:string,text:string,uri:string,width:int,height:int,duration_ms:long,pages:int>"
#: Characters of a conversation after which a new row begins, at the next turn.
CHUNK_CHARS = 1_000_000
FORMATTED = (
    "conv_id long, chunk int, formatted string, loss_spans array<struct<start:long,stop:long>>, "
    "attachments array<struct<turn_index:int,kind:string,uri:string,position:long,n_tokens:long>>, attachment_tokens long, skipped_parts long"
)


def escape(text: str) -> str:
    """The text without control strings: a backslash after the first character of each, and backslashes doubled."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The text that was escaped."""
    return _ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class Expansion:
    """How many tokens an attachment takes."""

    patch_pixels: int = 28
    audio_tokens_per_second: int = 25
    tokens_per_page: int = 512


@dataclass
class PartVisitor:
    """Writes a conversation: its string, what the loss covers, and its attachments."""

    expansion: Expansion = Expansion()
    trained_roles: frozenset[str] = frozenset({"assistant"})
    pieces: list[str] = field(default_factory=list)
    length: int = 0
    loss_spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[int, str, str | None, int, int]] = field(default_factory=list)
    turns: int = 0
    skipped: int = 0
    trained: bool = False

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)

    def turn(self, role: str | None, parts: list[dict] | None) -> None:
        role = role or ""
        self.trained = role in self.trained_roles
        self.write(f"{TURN}{escape(role)}{BODY}")
        for part in parts or ():
            visit = getattr(self, f"visit_{part['type']}", None) if part and part["type"] in ("text", *PLACEHOLDERS) else None
            (visit or self.visit_unknown)(part)
        self.write(END)
        self.turns += 1

    def visit_text(self, part: dict) -> None:
        start = self.length
        self.write(escape(part["text"] or ""))
        if self.trained and self.length > start:
            self.loss_spans.append((start, self.length))

    def visit_image(self, part: dict) -> None:
        patches = [-(-max(part.get(k) or 0, 1) // self.expansion.patch_pixels) for k in ("width", "height")]
        self.attach(part, patches[0] * patches[1])

    def visit_audio(self, part: dict) -> None:
        self.attach(part, max(1, -(-(part.get("duration_ms") or 0) * self.expansion.audio_tokens_per_second // 1000)))

    def visit_document(self, part: dict) -> None:
        self.attach(part, max(part.get("pages") or 0, 1) * self.expansion.tokens_per_page)

    def visit_unknown(self, part: dict | None) -> None:
        self.skipped += 1

    def attach(self, part: dict, n_tokens: int) -> None:
        kind = part["type"]
        self.attachments.append((self.turns, kind, part.get("uri"), self.length, n_tokens))
        self.write(PLACEHOLDERS[kind])

    def chunk(self) -> tuple:
        """What was written since the last chunk: as in ``FORMATTED`` from ``formatted`` on."""
        spans = [{"start": a, "stop": b} for a, b in self.loss_spans]
        attached = [dict(zip(("turn_index", "kind", "uri", "position", "n_tokens"), x)) for x in self.attachments]
        out = "".join(self.pieces), spans, attached, sum(x[4] for x in self.attachments), self.skipped
        self.pieces, self.loss_spans, self.attachments, self.skipped = [], [], [], 0
        return out


def text_parts(text: str = "text") -> Column:
    """A single text part from a column of texts."""
    kinds = [x.split(":") for x in PART[len("struct<") : -1].split(",")]
    values = {"type": F.lit("text"), "text": F.col(text)}
    return F.array(F.struct(*(values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds)))


def format_conversations(turns: DataFrame, expansion: Expansion = Expansion(), chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """A row for each conversation, or for each chunk of a long one: see ``FORMATTED``.

    A conversation's string is that of its chunks (from 0) in a row; positions count code points from
    its start. ``turns``: conv_id, turn, role, and parts (an array of ``PART``) or else text. Turns are in
    the order of turn, role and parts (nulls first), so ties and repeated rows have a defined order
    and all are kept. A null text is an empty one, a null role an empty one, null parts are none. A part
    that is null, or whose type is null or unknown, writes nothing and is counted in skipped_parts. A
    null conv_id is a conversation like any other. An empty table gives no rows; other columns are unused.
    Chunks of a conversation follow one another in their partition.
    """
    parts = F.col("parts") if "parts" in turns.columns else text_parts()
    importable(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (
            pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])),
            pa.list_(pa.struct([("turn_index", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("position", pa.int64()), ("n_tokens", pa.int64())])), pa.int64(), pa.int64(),
        )
        names = ["conv_id", "chunk", "formatted", "loss_spans", "attachments", "attachment_tokens", "skipped_parts"]
        rows, held, began = [], 0, 0
        visitor, of, chunk = None, None, 0
        for batch in slices(batches):
            for conv_id, role, said in zip(*(c.to_pylist() for c in batch.columns)):
                if visitor and (conv_id != of or visitor.length - began >= chunk_chars):
                    rows.append((of, chunk, *visitor.chunk()))
                    held += visitor.length - began
                    chunk, began = chunk + 1, visitor.length
                    if len(rows) >= 512 or held >= chunk_chars:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if visitor is None or conv_id != of:
                    visitor, of, chunk, began = PartVisitor(expansion), conv_id, 0, 0
                visitor.turn(role, said)
        if visitor:
            rows.append((of, chunk, *visitor.chunk()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    said = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", parts.alias("parts"))
    said = said.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    return said.select("conv_id", "role", "parts").mapInArrow(run, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted string, without attachments' placeholders."""
    return [(unescape(role), unescape(_PLACEHOLDER.sub("", body))) for role, body in _TURN.findall(formatted)]


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """What a reader finds in the formatted strings: turns, and the text under the loss mask.

    ``in_order``: the rows come straight from ``format_conversations``, so that chunks need no sorting.
    """
    importable(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        rows, of, seen = [], None, None
        for batch in slices(batches, 64):
            for conv_id, chunk, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk == 0:
                    if seen:
                        rows.append((of, *seen.found()))
                    of, seen = conv_id, _Reader()
                seen.read(text, [(x["start"], x["stop"]) for x in spans])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((of, *seen.found()), kinds)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    chunks = formatted.select("conv_id", "chunk", "formatted", "loss_spans")
    if not in_order:
        chunks = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return chunks.mapInArrow(run, schema)


class _Reader:
    """Reads a conversation chunk by chunk."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, text: str, spans: list[tuple[int, int]]) -> None:
        for role, body in parse(text):
            self.turns += 1
            self.said.update(f"{role}\n{body}\n".encode())
        for start, stop in spans:
            own = unescape(text[start - self.chars : stop - self.chars])
            self.loss_chars += len(own)
            self.loss.update(own.encode())
        self.chars += len(text)

    def found(self) -> tuple[int, str, int, str, int]:
        return self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
