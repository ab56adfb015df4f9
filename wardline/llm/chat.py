"""Chat formatting with typed content parts.

A turn is a list of parts: text, image, audio or document. A visitor flattens it into one segment of the formatted
conversation: texts with their control characters escaped, and for each attachment a placeholder, a reference and
the tokens it will expand to. A conversation is its segments in order; its loss mask is the spans of assistant texts.

Segments are made turn by turn without a shuffle. Reading back streams the segments of a conversation in order and
holds one of them at a time, so a conversation of any length needs no more memory than its longest turn.

Template: ``<|turn|>`` role newline content ``<|end|>`` newline. In roles and texts ``&``, ``<`` and ``[`` are written
as the references below, so no control string of this or another template survives in them, and reading is exact.

Defined cases: a null text is an empty text part; a null role is an empty role; turns order by turn, then role, then
text, with nulls first, and rows that tie or repeat are all kept; a null conv_id is a conversation of its own; an
unknown part type raises; extra columns are ignored; no rows give no conversations.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.storage import small_batches, spread, staged

TURN, END = "<|turn|>", "<|end|>\n"
#: In this order; & first, so that it is undone last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
LEARNED_ROLE = "assistant"
#: Tokens that an attachment expands to: an image by patches of PATCH pixels, audio by second, a document by page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 640

MEASURES = ("width", "height", "seconds", "pages")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
_SEGMENT = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*)" + re.escape(END), re.S)
_LEARNED = "array<struct<start:int,end:int>>"
_ATTACHED = "array<struct<kind:string,ref:string,at:int,tokens:long,width:int,height:int,seconds:double,pages:int>>"
SEGMENTS = f"conv_id long, turn long, segment string, loss {_LEARNED}, attachments {_ATTACHED}, n_attachment_tokens long"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, n_attachment_tokens long"


def escaped(text: str) -> str:
    for plain, written in ESCAPES:
        text = text.replace(plain, written)
    return text


def unescaped(text: str) -> str:
    for plain, written in reversed(ESCAPES):
        text = text.replace(written, plain)
    return text


class Flattener:
    """The visitor of one turn's parts."""

    def __init__(self, role: str | None):
        self.role = role or ""
        # a line feed ends the role, so one inside it is written as a reference too
        self.out = [TURN, escaped(self.role).replace("\n", "&#10;"), "\n"]
        self.at = sum(map(len, self.out))
        self.loss: list[dict] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("type")
        if kind not in ("text", "image", "audio", "document"):
            raise ValueError(f"unknown part type {kind!r}")
        getattr(self, f"visit_{kind}")(part)

    def _put(self, written: str) -> int:
        self.out.append(written)
        self.at += len(written)
        return self.at - len(written)

    def visit_text(self, part: dict) -> None:
        written = escaped(part.get("text") or "")
        start = self._put(written)
        if self.role == LEARNED_ROLE and written:
            self.loss.append({"start": start, "end": self.at})

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        at = self._put(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": at, "tokens": tokens} | {k: part.get(k) for k in MEASURES})

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)

    def segment(self) -> str:
        return "".join([*self.out, END])


def _split(segment: str) -> tuple[str, str]:
    """Role and written content of a segment."""
    found = _SEGMENT.fullmatch(segment)
    if not found:
        raise ValueError("not a formatted turn")
    return unescaped(found[1].replace("&#10;", "\n")), found[2]


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a segment; placeholders are left out of the text."""
    role, content = _split(segment)
    return role, unescaped(_PLACEHOLDER.sub("", content))


def read_parts(segment: str, attachments: list[dict]) -> tuple[str, list[dict]]:
    """Role and parts of a segment, attachments with their references and measures. Text parts that stood next to each
    other come back as one, empty ones not at all."""
    role, content = _split(segment)
    parts: list[dict] = []
    at = 0
    for m in [*_PLACEHOLDER.finditer(content), None]:
        if text := content[at : m.start() if m else None]:
            parts.append({"type": "text", "text": unescaped(text)})
        if m:
            held = attachments[int(m[2])]
            parts.append({"type": held["kind"], "ref": held["ref"]} | {k: held[k] for k in MEASURES})
            at = m.end()
    return role, parts


def _list_of(**fields):
    return pa.list_(pa.struct(list(fields.items())))


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learned = _list_of(start=pa.int32(), end=pa.int32())
    attached = _list_of(kind=pa.string(), ref=pa.string(), at=pa.int32(), tokens=pa.int64(), width=pa.int32(), height=pa.int32(), seconds=pa.float64(), pages=pa.int32())
    for batch in batches:
        made = []
        for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            v = Flattener(role)
            for part in parts or []:
                v.visit(part)
            made.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array([v.segment() for v in made], pa.string()), pa.array([v.loss for v in made], learned), pa.array([v.attachments for v in made], attached), pa.array([sum(a["tokens"] for a in v.attachments) for v in made], pa.int64())], names=["conv_id", "turn", "segment", "loss", "attachments", "n_attachment_tokens"])


def format_turns(turns: DataFrame) -> DataFrame:
    """A segment for each row of (conv_id, turn, role, parts); or with ``text`` in place of parts."""
    small_batches(turns.sparkSession)
    if "parts" not in turns.columns:
        text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
        turns = turns.select("conv_id", "turn", "role", F.array(text).alias("parts"))
    rows = turns.select("conv_id", "turn", "role", F.col("parts").cast(f"array<{PART}>").alias("parts"))
    return rows.mapInArrow(_formatted, SEGMENTS)


class _Conversation:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, 0
        self.attachments = self.tokens = 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, spans: list[dict], attachments: list[dict], tokens: int) -> None:
        role, text = read_segment(segment)
        self.turns, self.chars = self.turns + 1, self.chars + len(segment)
        self.attachments, self.tokens = self.attachments + len(attachments or []), self.tokens + tokens
        self.all.update(f"{role}\n{text}\n".encode())
        for s in spans or []:
            part = unescaped(segment[s["start"] : s["end"]])
            self.loss += len(part)
            self.learned.update(part.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars, self.attachments, self.tokens


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.string() if "sha256" in n else pa.int64() for n in names]

    def batch_of(done: list[_Conversation]):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*(x.row() for x in done), strict=True), types, strict=True)], names=names)

    now: _Conversation | None = None
    for batch in batches:
        done: list[_Conversation] = []
        for conv_id, *rest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "attachments", "n_attachment_tokens")), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now)
                now = _Conversation(conv_id)
            now.add(*rest)
        if done:
            yield batch_of(done)
    if now is not None:
        yield batch_of([now])


def read_back(segments: DataFrame) -> DataFrame:
    """A row for each conversation, from its formatted segments alone."""
    small_batches(segments.sparkSession)
    def plain(written: Column) -> Column:  # as ``unescaped``
        for p, w in reversed(ESCAPES):
            written = F.replace(written, F.lit(w), F.lit(p))
        return written

    # ties order by role and text as they were: the sort's columns are made behind the shuffle
    dealt = segments.repartition(spread(segments.sparkSession), "conv_id")
    line = F.instr("segment", "\n")
    role = plain(F.replace(F.substr("segment", F.lit(len(TURN) + 1), line - len(TURN) - 1), F.lit("&#10;"), F.lit("\n")))
    text = plain(F.substr("segment", line + 1, F.char_length("segment") - line - len(END)))
    ordered = dealt.withColumns({"__role": role, "__text": text}).sortWithinPartitions("conv_id", "turn", "__role", "__text").select(*segments.columns)
    return ordered.mapInArrow(_read, READ)


def round_trip(conversations: DataFrame) -> DataFrame:
    return read_back(staged(format_turns(conversations), "chat"))
