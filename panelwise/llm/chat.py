"""Chat conversations as one marked-up text, from turns of typed content parts.

A turn is a role and a list of parts. A visitor flattens the parts in order: text
stays text, with control strings escaped; an image, audio or document part
becomes a placeholder with a running number, and its reference and the tokens it
expands to are recorded. The output has one segment a turn, in order, so a
conversation of any length is written and read back piece by piece; the segments
of a conversation put together are its formatted text. The loss mask covers the
text of assistant turns.

Escaping puts a backslash into every `<|`, and one more where there are some
already, so no text can hold a control string and unescaping takes exactly that
backslash out again.

Null text counts as empty, null roles as the empty role, a null conversation id
is a conversation. Turns are ordered by turn, null first, then role and text, so
ties and repeated rows come out alike on every run. A length of a recording that is
no finite positive number counts as 0. A part of an unknown type ends the job with
its name: leaving it out would change the conversation. Extra columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import bounded, col

# Control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"

TILE, TILE_TOKENS, IMAGE_TOKENS = 512, 170, 85
AUDIO_TOKENS_A_SECOND = 25
PAGE_TOKENS = 600

PARTS = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
SEGMENTS = (
    "conv_id bigint, turn bigint, role string, ord bigint, segment string, loss_start int, loss_end int, "
    "attachments array<struct<place: int, type: string, ref: string, tokens: bigint>>"
)
_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_IN_ROLE = {"\\": "\\\\", "\n": "\\n"}


def escape(text: str) -> str:
    return _OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(re.sub(r"[\\\n]", lambda m: _IN_ROLE[m.group()], role))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m.group(1) == "n" else "\\", unescape(role))


@dataclass
class Flattener:
    """Visitor over the parts of a turn: collects the text and the attachments."""

    pieces: list[tuple[str, bool]] = field(default_factory=list)  # and whether it is text
    attachments: list[dict] = field(default_factory=list)

    def body(self) -> str:
        """All pieces in order; text is escaped where it stands next to text, so none can form a control string."""
        runs = groupby(self.pieces, key=lambda p: p[1])
        return "".join(escape("".join(x for x, _ in run)) if text else "".join(x for x, _ in run) for text, run in runs)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append((part.get("text") or "", True))

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or TILE) / TILE) * math.ceil((part.get("height") or TILE) / TILE)
        self._attach("image", part, IMAGE_TOKENS + TILE_TOKENS * tiles)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0
        self._attach("audio", part, math.ceil(seconds * AUDIO_TOKENS_A_SECOND) if 0 < seconds < math.inf else 0)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, PAGE_TOKENS * (part.get("pages") or 1))

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"no such part: {part.get('type')!r}")

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.pieces.append((f"<|{kind}:{len(self.attachments)}|>", False))
        self.attachments.append({"place": len(self.attachments), "type": kind, "ref": part.get("ref"), "tokens": tokens})


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, int, int, list[dict]]:
    """Segment of a turn, the stretch of it under the loss mask (empty if none), and its attachments."""
    flat = Flattener()
    for part in parts or []:
        flat.visit(part)
    head, body = f"{START}{escape_role(role or '')}\n", flat.body()
    masked = len(body) if role == LOSS_ROLE else 0
    return f"{head}{body}{END}\n", len(head), len(head) + masked, flat.attachments


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn, unescaped; placeholders stay as they are."""
    if not segment.startswith(START) or not segment.endswith(END + "\n"):
        raise ValueError("not a formatted turn")
    role, body = segment[len(START) : -len(END) - 1].split("\n", 1)
    return unescape_role(role), unescape(body)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [format_turn(*x) for x in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist())]
        segments, starts, ends, attachments = zip(*made) if made else ((), (), (), ())
        found = pa.array(attachments, pa.list_(pa.struct([("place", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))
        columns = [batch.column(c) for c in ("conv_id", "turn", "role", "ord")]
        columns += [pa.array(segments, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), found]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "ord", "segment", "loss_start", "loss_end", "attachments"])


def text_parts(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as turns of one text part."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    part = F.struct(F.lit("text").alias("type"), F.coalesce(col("text"), F.lit("")).alias("text"), *empty)
    return turns.select(
        col("conv_id").cast("bigint").alias("conv_id"), col("turn").cast("bigint").alias("turn"), col("role").cast("string").alias("role"),
        F.array(part).alias("parts"), F.xxhash64(col("text")).alias("ord"),
    )


def format_turns(turns: DataFrame) -> DataFrame:
    """One segment a turn. `turns` has conv_id, turn, role, parts, and ord to break ties."""
    return bounded(turns).select("conv_id", "turn", "role", "parts", "ord").mapInArrow(_format, SEGMENTS)


def in_order(segments: DataFrame) -> DataFrame:
    """Segments with the turns of a conversation in one partition, in order."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ord", "segment")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations that arrive in order; holds sums, never a conversation."""
    none = object()
    at, state = none, None
    done: list[tuple] = []

    def finish() -> None:
        if at is not none:
            turns, masked, n, loss, size = state
            done.append((at, n, turns.hexdigest(), loss, masked.hexdigest(), size))

    def out() -> pa.RecordBatch:
        types = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=_DIGEST_NAMES)

    for batch in batches:
        for conv, segment, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))):
            if conv != at:
                finish()
                at, state = conv, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
            role, text = read_turn(segment)
            state[0].update(f"{role}\n{text}\n".encode())
            masked = unescape(segment[a:b])
            state[1].update(masked.encode())
            state[2] += 1
            state[3] += len(masked)
            state[4] += len(segment)
        if done:
            yield out()
            done = []
    finish()
    if done:
        yield out()


_DIGEST_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from its segments: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = in_order(bounded(segments)).select("conv_id", "segment", "loss_start", "loss_end")
    return rows.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def conversation(segments: DataFrame, conv_id: int) -> str:
    """Formatted text of one conversation."""
    rows = segments.where(F.col("conv_id") == conv_id).orderBy("turn", "role", "ord", "segment").select("segment")
    return "".join(r.segment for r in rows.toLocalIterator())
