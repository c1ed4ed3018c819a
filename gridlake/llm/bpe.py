"""Byte-pair encoding and decoding as streaming transducers with constant memory.

A token starts at most as many symbols before the end of what is known as the longest token
of the merge list is long: that length is the *lookahead*.  Whatever follows, the encoding of
the whole run passes through one of the token boundaries inside that last stretch, and up to
such a boundary it equals the encoding of the prefix.  So the encoder keeps, for each prefix of
a run, its last token; tokens that the paths from all boundaries of the stretch share are
stable and leave at once.  A token may follow another exactly if encoding the two together
gives the two.

Texts pass in windows.  Every run goes through the transducer; words and runs of at most
``LONGEST`` characters are remembered in bounded caches, longer ones are not kept.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.session import bounded_batches

# White space of Unicode, and how the vocabulary's library cuts words.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|\\p{{L}}+|\\p{{N}}|[^{_SPACE}\\p{{L}}\\p{{N}}]+")
_GAP = regex.compile(f"[{_SPACE}]+")
_SEPARATORS = regex.compile("[\\x1c-\\x1f]")
WORD_END = "</w>"

LONGEST = 64
WINDOW = 4096
CACHED_WORDS = 400_000
PAIRS = 1 << 18

_loaded: dict = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    others = (b for b in range(256) if b not in letters)
    letters.update((b, chr(256 + i)) for i, b in enumerate(others))
    return [letters[b] for b in range(256)]


class Cache(dict):
    """Values by key, made when first asked for, kept for short keys; ``trim`` bounds their number."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > CACHED_WORDS:  # frequent words came first
            for late in list(self)[CACHED_WORDS // 2:]:
                del self[late]


class MergeList:
    """Vocabulary and ranked merges of a tokenizer file, with what follows from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("expected a lower-casing BPE vocabulary with word ends")
        self.ids: dict[str, int] = dict(model["vocab"])
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.letters = byte_letters()
        self.decoder = spec.get("decoder")
        #: symbols of each token, and the sufficient lookahead: the longest token
        self.symbols = {t: self._symbols(t) for t in self.ids}
        self.lookahead = max(map(len, self.symbols.values()))
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*self.ids.items(), *self.added.items()]:
            self.tokens[i] = token
        self._follows: dict = {}

    @staticmethod
    def _symbols(token: str) -> list[str]:
        body = token.removesuffix(WORD_END)
        if not body:
            return [token]
        last = WORD_END if len(body) < len(token) else ""
        return [*body[:-1], body[-1] + last]

    def merge(self, symbols: list[str]) -> list[str]:
        """Lowest rank first, leftmost among equals, until no pair is in the list."""
        parts, rank, never = list(symbols), self.rank.get, 1 << 60
        ranks = [rank(pair, never) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            left = ranks.index(best)
            parts[left] += parts.pop(left + 1)
            del ranks[left]
            if left < len(ranks):
                ranks[left] = rank((parts[left], parts[left + 1]), never)
            if left:
                ranks[left - 1] = rank((parts[left - 1], parts[left]), never)
        return parts

    def may_follow(self, before: str | None, token: str) -> bool:
        known = self._follows.get((before, token))
        if known is None:
            if len(self._follows) > PAIRS:
                self._follows.clear()
            pair = [token] if before is None else [before, token]
            known = self.merge([s for t in pair for s in self.symbols[t]]) == pair
            self._follows[before, token] = known
        return known


class RunEncoder:
    """Encodes one run of symbols given bit by bit; emits tokens once they are stable."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.base = 0                  # symbols before this boundary have left
        self.before: str | None = None  # the last token that left
        self.tail: list[str] = []      # symbols since the base
        self.last: list[str] = []      # last token of each prefix since the base

    def feed(self, symbols: Iterable[str]) -> Iterator[str]:
        for i, symbol in enumerate(symbols):
            self.tail.append(symbol)
            self._extend()
            if i % 64 == 63:
                yield from self._stable(self.merges.lookahead)
        yield from self._stable(self.merges.lookahead)

    def finish(self) -> Iterator[str]:
        yield from self._stable(1)

    def _extend(self) -> None:
        n = len(self.tail)
        text = ""
        for start in range(n - 1, max(-1, n - 1 - self.merges.lookahead), -1):
            text = self.tail[start] + text
            before = self.last[start - 1] if start else self.before
            if text in self.merges.ids and self.merges.may_follow(before, text):
                self.last.append(text)
                return
        raise ValueError(f"no token ends the run at {self.base + n}")

    def _stable(self, stretch: int) -> Iterator[str]:
        n = len(self.tail)
        ends = set(range(max(0, n - stretch + 1), n + 1)) if stretch > 1 else {n}
        while len(ends) > 1:
            end = max(ends)
            ends.discard(end)
            ends.add(end - len(self.merges.symbols[self.last[end - 1]]))
        settled = at = ends.pop()
        out = []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.merges.symbols[out[-1]])
        if settled:
            self.before = out[0]
            self.base += settled
            self.tail, self.last = self.tail[settled:], self.last[settled:]
            yield from reversed(out)


class Encoder:
    """Text to ids; ``stream`` takes a text in pieces and holds a bounded part of it."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.added = regex.compile("|".join(map(regex.escape, merges.added))) if merges.added else None
        self.words, self.runs = Cache(self._word), Cache(self._run)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # one character at a time where the case of a letter would depend on its neighbours
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def _spelled(self, piece: str, final: bool = True) -> list[str]:
        letters = self.merges.letters
        symbols = list(piece) if piece.isascii() and piece.isalpha() else [letters[b] for b in piece.encode("utf-8")]
        if final:
            symbols[-1] += WORD_END
        return symbols

    def _run(self, piece: str) -> tuple[int, ...]:
        coder = RunEncoder(self.merges)
        return tuple(map(self.merges.ids.__getitem__, chain(coder.feed(self._spelled(piece)), coder.finish())))

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a text without ordinary white space around it."""
        ids = ()
        for piece in _PIECES.findall(self.normal(word)):
            ids += self.runs[piece]
        return ids

    def _plain(self, text: str) -> Iterator[list[int]]:
        words = _GAP.split(text) if _SEPARATORS.search(text) else text.split()
        for at in range(0, len(words), WINDOW):
            yield list(chain.from_iterable(map(self.words.__getitem__, words[at:at + WINDOW])))
            self.words.trim()
            self.runs.trim()

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of the whole text, a stretch of words at a time, streamed in windows."""
        return self.blocks(text[at:at + WINDOW] for at in range(0, len(text), WINDOW))

    def _window(self, text: str) -> Iterator[list[int]]:
        """Ids of a text that is held; added tokens are found in the raw text."""
        if self.added is None or not self.added.search(text):
            yield from self._plain(text)
            return
        at = 0
        for found in self.added.finditer(text):
            yield from self._plain(text[at:found.start()])
            yield [self.merges.added[found.group()]]
            at = found.end()
        yield from self._plain(text[at:])

    def stream(self, parts: Iterable[str]) -> Iterator[int]:
        """Ids of a text that arrives in parts, one by one."""
        return chain.from_iterable(self.blocks(parts))

    def blocks(self, parts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text that arrives in parts, with a part and ``WINDOW`` characters held at most.

        What follows the last white space waits, and of a longer stretch without any, its
        last run of one kind of character, which a ``RunEncoder`` takes over.  An added token
        or a contraction is awaited before its first character is given up, and a letter until
        all of its marks are there.
        """
        held, open_run = "", None
        margin = max([4, *map(len, self.merges.added)])
        for part in parts:
            held += part
            while len(held) > WINDOW:
                cut = WINDOW - margin
                if open_run is None:
                    gaps = [m.end() for m in _GAP.finditer(held, 0, cut)]
                    if gaps:
                        yield from self._window(held[:gaps[-1]])
                        held = held[gaps[-1]:]
                        continue
                    open_run = _LongStretch(self)
                ids, used, over = open_run.take(held, cut)
                yield ids
                held = held[used:]
                if over:
                    open_run = None
                elif not used:
                    break
        if open_run is not None:
            ids, used, _ = open_run.take(held, len(held), True)
            yield ids + open_run.close()
            held = held[used:]
        yield from self._window(held)


@functools.cache
def _joining() -> frozenset[str]:
    """Characters that are no marks but may compose with the one before, as Hangul vowels do."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x80, 0x20000))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
    jamo = map(chr, chain(range(0x1161, 0x1176), range(0x11A8, 0x11C3)))
    return frozenset(c for c in chain(seconds, jamo) if not unicodedata.combining(c))


class _LongStretch:
    """A stretch of text without white space that is longer than the window."""

    def __init__(self, owner: Encoder):
        self.owner, self.run, self.kind, self.waiting = owner, None, None, ""

    @staticmethod
    def _kind(char: str) -> str:
        return "L" if regex.match(r"\p{L}", char) else "N" if regex.match(r"\p{N}", char) else "S"

    def take(self, text: str, limit: int, final: bool = False) -> tuple[list[int], int, bool]:
        """Ids that became stable, characters used, whether white space ended the stretch.

        ``final`` says that no more text follows.
        """
        out, at = [], 0
        while at < limit:
            if _GAP.match(text, at):
                out.extend(self.close())
                return out, at, True
            special = self.owner.added.match(text, at) if self.owner.added else None
            if special:
                out.extend(self.close())
                out.append(self.owner.merges.added[special.group()])
                at = special.end()
                continue
            # a letter with its combining marks is normalised together
            end = at + 1
            while end < len(text) and not text[end].isascii() and (unicodedata.combining(text[end]) or text[end] in _joining()):
                end += 1
            if end == len(text) and not final:
                break
            char = self.owner.normal(text[at:end])
            if char == "'" and self.kind != "S":
                mark = _PIECES.match(self.owner.normal(text[at:at + 3]))
                if mark and len(mark.group()) > 1 and mark.group()[1].isalpha():
                    out.extend(self.close())
                    out.extend(self.owner.runs[mark.group()])
                    at += len(mark.group())
                    continue
            for c in char:
                kind = self._kind(c)
                if kind != self.kind or kind == "N":
                    out.extend(self.close())
                    self.run, self.kind = RunEncoder(self.owner.merges), kind
                # the last character of a run carries the word end, so one always waits
                if len(self.waiting) >= LONGEST:
                    out.extend(self._ids(self.run.feed(self.owner._spelled(self.waiting, False))))
                    self.waiting = ""
                self.waiting += c
            at = end
        return out, at, False

    def _ids(self, tokens) -> list[int]:
        return [self.owner.merges.ids[t] for t in tokens]

    def close(self) -> list[int]:
        if self.run is None:
            return []
        tokens = [*self.run.feed(self.owner._spelled(self.waiting)), *self.run.finish()]
        self.run, self.kind, self.waiting = None, None, ""
        return self._ids(tokens)


class Decoder:
    """Ids to text piece by piece.

    ``tokens`` gives the library's text where the vocabulary names no decoder: token strings
    with one space between.  ``text`` turns letters back into bytes and bytes into characters;
    bytes of a character that is not complete yet wait, wrong ones become U+FFFD.
    """

    def __init__(self, merges: MergeList, form: str = "tokens"):
        if form not in ("tokens", "text"):
            raise ValueError(f"unknown form {form!r}")
        self.merges, self.form, self.started = merges, form, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        if form == "text":
            byte_of = {c: b for b, c in enumerate(merges.letters)}
            special = set(merges.added.values())
            self.raw = [
                t.encode() if i in special else
                bytes(byte_of[c] for c in t.removesuffix(WORD_END)) + b" " * t.endswith(WORD_END)
                for i, t in enumerate(merges.tokens)
            ]

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.form == "text":
            return self.utf8.decode(b"".join(map(self.raw.__getitem__, ids)))
        joined = " ".join(map(self.merges.tokens.__getitem__, ids))
        joined, self.started = " " + joined if self.started else joined, True
        return joined

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


def tools(path: str) -> tuple[MergeList, Encoder]:
    """Merge list and encoder, once per process and file."""
    if path not in _loaded:
        merges = MergeList(path)
        _loaded[path] = merges, Encoder(merges)
    return _loaded[path]


def encode_ids(docs: DataFrame, path: str, text_column: str = "text", name: str = "ids") -> DataFrame:
    """Adds the ids of each whole text; null texts count as empty."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<int>")
    def ids_of(texts):
        from gridlake.llm import bpe

        _, coder = bpe.tools(path)
        return texts.map(lambda t: [i for ids in coder.encode(t or "") for i in ids])

    return docs.withColumn(name, ids_of(F.coalesce(F.col(text_column), F.lit(""))))


def decode_ids(docs: DataFrame, path: str, column: str = "ids", name: str = "text", form: str = "text") -> DataFrame:
    """Adds the text of an id array; null arrays give an empty text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text_of(arrays):
        from gridlake.llm import bpe

        merges, _ = bpe.tools(path)

        def text(ids):
            state = bpe.Decoder(merges, form)
            return "" if ids is None else state.feed([int(i) for i in ids]) + state.finish()

        return arrays.map(text)

    return docs.withColumn(name, text_of(F.col(column)))


def round_trip(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", block: int = 1 << 15,
) -> DataFrame:
    """Per row: id, n_tokens and digests of the ids and of the library's decoded text.

    Ids and decoded text pass in blocks and are not held whole.  Null texts count as empty;
    the id column keeps its type, equal and null ids stay rows of their own.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def digest(batches):
        # imported in the task, so that its caches live as long as the worker
        from gridlake.llm import bpe

        merges, coder = bpe.tools(path)
        decimal = [str(i) for i in range(len(merges.tokens))]
        for batch in batches:
            counts, id_hex, text_hex = [], [], []
            for text in batch["text"].to_pylist():
                ids_sha, text_sha, n, held = hashlib.sha256(), hashlib.sha256(), 0, []
                state = bpe.Decoder(merges)

                def pour():
                    ids_sha.update(((" " if n else "") + " ".join(map(decimal.__getitem__, held))).encode())
                    text_sha.update(state.feed(held).encode())

                for ids in coder.encode(text):
                    held += ids
                    if len(held) >= block:
                        pour()
                        n, held = n + len(held), []
                if held:
                    pour()
                    n += len(held)
                text_sha.update(state.finish().encode())
                counts.append(n)
                id_hex.append(ids_sha.hexdigest())
                text_hex.append(text_sha.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(id_hex), pa.array(text_hex)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
