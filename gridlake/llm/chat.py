"""Chat formatting with typed content parts, reversible escapes and a loss mask.

A turn's content is a text or a list of parts.  A visitor flattens the parts in order: text is
escaped, an image, audio or document part becomes a numbered placeholder, and its reference and
the number of tokens it will expand to are recorded.  Control strings of the template never
occur inside a flattened text, so a formatted conversation can be read back exactly.

Conversations are streamed turn by turn through sorted partitions: a conversation of any length
takes the memory of one turn.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template: ``<s>[ROLE] role [INST] text [/INST]</s>`` and a line end per turn.
OPEN, NAME, START, STOP, CLOSE = "<s>", "[ROLE]", "[INST]", "[/INST]", "</s>"
CONTROL = (OPEN, CLOSE, NAME, START, STOP, "<part:")
KINDS = ("text", "image", "audio", "document")

_RAW = re.compile("|".join(map(re.escape, CONTROL)))
_PLACEHOLDER = re.compile(r"<part:(\d+):(image|audio|document)>")


def escape(text: str) -> str:
    """No control string occurs in the result; ``unescape`` gives the text back."""
    return _RAW.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class PartVisitor:
    """Flattens typed parts; one instance per conversation numbers its attachments.

    ``patch``, ``seconds_rate`` and ``page_tokens`` give the tokens of an image of known size,
    of a second of audio and of a page of a document.
    """

    def __init__(self, patch: int = 28, seconds_rate: int = 25, page_tokens: int = 512):
        self.patch, self.seconds_rate, self.page_tokens, self.count = patch, seconds_rate, page_tokens, 0

    def flatten(self, parts: list[dict]) -> tuple[str, list[dict]]:
        text, attached = [], []
        for part in parts:
            kind = part.get("type", "text")
            if kind not in KINDS:
                raise ValueError(f"unknown part type {kind!r}")
            shown, record = getattr(self, f"visit_{kind}")(part)
            text.append(shown)
            if record is not None:
                attached.append(record)
        return "".join(text), attached

    def visit_text(self, part: dict) -> tuple[str, None]:
        return escape(part.get("text") or ""), None

    def visit_image(self, part: dict) -> tuple[str, dict]:
        across = -(-int(part.get("width") or 0) // self.patch)
        down = -(-int(part.get("height") or 0) // self.patch)
        return self._place("image", part, max(1, across * down))

    def visit_audio(self, part: dict) -> tuple[str, dict]:
        return self._place("audio", part, max(1, -int(-float(part.get("seconds") or 0) * self.seconds_rate // 1)))

    def visit_document(self, part: dict) -> tuple[str, dict]:
        return self._place("document", part, max(1, int(part.get("pages") or 1)) * self.page_tokens)

    def _place(self, kind: str, part: dict, tokens: int) -> tuple[str, dict]:
        number, self.count = self.count, self.count + 1
        return f"<part:{number}:{kind}>", {"number": number, "kind": kind, "ref": part.get("ref") or "", "tokens": tokens}


def parts_of(content: str | None, typed: bool) -> list[dict]:
    """A plain text is one text part; typed content is a JSON list of parts or strings."""
    if not typed or not content:
        return [{"type": "text", "text": content or ""}]
    return [{"type": "text", "text": p} if isinstance(p, str) else p for p in json.loads(content)]


ATTACHMENTS = "attachments array<struct<number: int, kind: string, ref: string, tokens: long>>"
_ATTACHMENTS = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def format_turns(
    turns: DataFrame, learned_role: str = "assistant", typed: bool = False, id_column: str = "conv_id",
    turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
) -> DataFrame:
    """Formatted turns: conv_id, place, piece, loss_from, loss_to, attachments.

    The pieces of a conversation, by place, joined without anything between are its formatted
    text; ``loss_from`` and ``loss_to`` are code point offsets in it, equal where nothing is
    learned.  Turns go by their number (null first), ties by role and text, repeated rows stay.
    Null roles and texts count as empty.  Rows without a conversation id are one conversation.
    Partitions come sorted by conversation and place.
    """
    rows = turns.select(
        F.col(id_column).cast("long").alias("conv_id"), F.col(turn_column).alias("turn"),
        F.coalesce(role_column, F.lit("")).alias("role"), F.coalesce(text_column, F.lit("")).alias("text"),
    )
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def write(batches):
        current, place, at, visitor = object(), 0, 0, None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != current:
                    current, place, at, visitor = conv, 0, 0, PartVisitor()
                shown, attached = visitor.flatten(parts_of(text, typed))
                head = f"{OPEN}{NAME}{escape(role)}{START}"
                piece = f"{head}{shown}{STOP}{CLOSE}\n"
                low = at + len(head)
                out.append((conv, place, piece, low, low + len(shown) if role == learned_role else low, attached))
                place, at = place + 1, at + len(piece)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), _ATTACHMENTS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)],
                names=["conv_id", "place", "piece", "loss_from", "loss_to", "attachments"],
            )

    schema = f"conv_id long, place long, piece string, loss_from long, loss_to long, {ATTACHMENTS}"
    return rows.mapInArrow(write, schema)


class Reader:
    """Reads a formatted conversation from pieces that may be cut anywhere."""

    def __init__(self):
        self.buffer, self.at, self.ranges = "", 0, []
        self.turns, self.loss_chars = 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()
        self.waiting: list[tuple[str, str, int, int]] = []

    def feed(self, piece: str, low: int, high: int) -> None:
        self.buffer += piece
        if high > low:
            self.ranges.append((low, high))
        while (end := self.buffer.find(CLOSE + "\n")) >= 0:
            self._turn(self.buffer[:end])
            self.buffer, self.at = self.buffer[end + len(CLOSE) + 1:], self.at + end + len(CLOSE) + 1

    def _turn(self, turn: str) -> None:
        start = turn.index(START)
        if not turn.startswith(OPEN + NAME) or not turn.endswith(STOP):
            raise ValueError("not a formatted turn")
        role = unescape(turn[len(OPEN) + len(NAME):start])
        body_from, body_to = start + len(START), len(turn) - len(STOP)
        text = unescape(turn[body_from:body_to])
        self.turns += 1
        self.turns_sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        # what the mask marks, which lies inside this turn
        while self.ranges and self.ranges[0][1] <= self.at + len(turn):
            low, high = self.ranges.pop(0)
            learned = unescape(turn[low - self.at:high - self.at])
            self.loss_chars += len(learned)
            self.loss_sha.update(learned.encode("utf-8", "surrogatepass"))

    def finish(self) -> tuple[int, str, int, str, int]:
        if self.buffer or self.ranges:
            raise ValueError("a formatted conversation is cut short")
        return self.turns, self.turns_sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.at


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the formatted pieces alone.

    ``formatted`` comes from ``format_turns`` (sorted by conversation within partitions).
    """

    def digest(batches):
        from gridlake.llm.chat import Reader

        current, reader, started = None, Reader(), False
        for batch in batches:
            out = []
            columns = [batch[c].to_pylist() for c in ("conv_id", "piece", "loss_from", "loss_to")]
            for conv, piece, low, high in zip(*columns):
                if started and conv != current:
                    out.append((current, *reader.finish()))
                    reader = Reader()
                current, started = conv, True
                reader.feed(piece, low, high)
            if out:
                yield _digests(out)
        if started:
            yield _digests([(current, *reader.finish())])

    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    columns = formatted.select("conv_id", "piece", "loss_from", "loss_to")
    return columns.mapInArrow(digest, schema)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def conversations_text(formatted: DataFrame) -> DataFrame:
    """One row per conversation with its whole text, for conversations that fit in a row."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "piece")))
    pieces: Column = F.transform(ordered, lambda p: p["piece"])
    return formatted.groupBy("conv_id").agg(F.array_join(pieces, "").alias("text"))
