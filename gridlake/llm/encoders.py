"""Whole-text token ids from the tokenizers library, with a bounded cache of words.

A byte-level vocabulary cuts a text before a space whenever a word follows it, so a word
with its leading space has the same ids wherever it stands.  Each distinct word goes to the
library once; texts in which a space could belong to a longer run of white space go to it
whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

from gridlake.llm.bpe import byte_letters

# Every character that some regular-expression engine takes for white space.
_WHITE = "\\t-\\r \\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_JOINED_SPACE = re.compile(f"(?<=[{_WHITE}]) (?=[{_WHITE}]|\\Z)")
_RARE_WHITE = re.compile("[" + _WHITE.replace("\\t-\\r ", "\\x0b-\\r") + "]")
# A word with or without its space, closing marks, and perhaps the start of the next line.
_SIMPLE = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*)(?:(\n)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*))?")
CACHED_WORDS = 1_200_000

_loaded: dict = {}


def joined_space(text: str) -> bool:
    """Whether a space may belong to a longer run of white space."""
    if "  " in text or "\n " in text or "\t " in text or _RARE_WHITE.search(text):
        return _JOINED_SPACE.search(text) is not None
    return False


class _Words(dict):
    """Ids by word; an unknown word is learned when it is asked for."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.learn(word)
        return ids


class ByteLevelEncoder:
    """``encode(text)`` gives the library's ids of the whole text as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        cut = spec.get("pre_tokenizer") or {}
        self.by_word = (
            spec.get("normalizer") is None and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        )
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.letters = {b: letter for b, letter in enumerate(byte_letters())}
        self.words = _Words(self.learn)
        self.words[""] = b""

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word or "\0" in text or (self.added and self.added.search(text)) or joined_space(text):
            return self.whole(text)
        # a cut before each space, so that words keep theirs
        out = b"".join(map(self.words.__getitem__, text.replace(" ", "\0 ").split("\0")))
        if len(self.words) > CACHED_WORDS:  # frequent words came first
            for late in list(self.words)[CACHED_WORDS // 2:]:
                del self.words[late]
        return out

    def learn(self, word: str) -> bytes:
        """Ids of a new word, piece by piece where the cut is plain; a piece is a word too."""
        if word.isascii() and word[0] == " " and word[1:].isalpha():
            return self.piece("Ġ" + word[1:])
        simple = _SIMPLE.fullmatch(word)
        if simple is None:
            return self.whole(word)
        pieces = [piece for piece in simple.groups() if piece]
        if len(pieces) > 1:
            return b"".join([self.words[piece] for piece in pieces])
        return self.piece(word.encode().decode("latin-1").translate(self.letters))

    def piece(self, spelled: str) -> bytes:
        """Ids of one piece, spelled with a letter for each byte."""
        ids = array("I", [t.id for t in self.library.model.tokenize(spelled)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def encoder(path: str) -> ByteLevelEncoder:
    """One encoder per process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = ByteLevelEncoder(path)
    return _loaded[path]
