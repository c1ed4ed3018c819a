"""Document statistics for quality rules: exact counts over whole texts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BLANK = b" \t\n\v\f\r"

LEAST_WORDS, REPEAT_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: what the model sees besides: shares of words or characters, so that length alone decides nothing
SHARES = ("symbols_per_word", "dup_lines", "repeat_words", "distinct_words", "word_length", "upper_words", "marked_words",
          "digit_chars", "line_words", "letters", "log_words")


def repeated_words(numbers: np.ndarray, window: int = 3) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    n = len(numbers)
    if n < window + 1:
        return 0
    distinct = int(numbers.max()) + 1
    # windows as pairs of (a window one word shorter, a word), renumbered so that keys stay small
    key = numbers.astype(np.int64)
    for i in range(1, window):
        key = np.unique(key[: n - i] * distinct + numbers[i:], return_inverse=True)[1].reshape(-1)
    often = np.bincount(key)[key] > 1
    if not often.any():
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(often)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: str | None) -> tuple:
    """The counts, then the shares, of a whole text; null is an empty text.

    Words are runs of characters other than ASCII white space.  ``n_dup_lines`` counts lines
    with a word that equal an earlier line.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(_SYMBOLS.findall(text)), 0, 0, *([0.0] * len(SHARES)))
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = len(_SYMBOLS.findall(text))
    lines = [line for line in raw.split(b"\n") if line.strip(_BLANK)]
    dup_lines = len(lines) - len(set(lines))
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    repeat = repeated_words(np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    marked = sum(map(raw.count, (b"!!", b"??", b"...", b"| ", b"=="))) / n
    digits = sum(map(raw.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9")))
    marks = digits + symbols + sum(map(raw.count, (b".", b",", b"!", b"?", b";", b":", b"-", b"_", b"(", b")", b"/", b"=")))
    return (
        n, chars, symbols, dup_lines, repeat,
        symbols / n, dup_lines / len(lines), repeat / n, len(number) / n, min(chars / n, 40.0), upper / n, min(marked, 4.0),
        digits / chars, min(n / len(lines), 400.0), 1 - marks / chars, float(np.log1p(n)),
    )


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, counts, shares) of every row; other columns are not read, repeated rows stay."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in SHARES)
    names = ["doc_id", *COUNTS, *SHARES]

    def count(batches):
        for batch in batches:
            columns = list(zip(*map(measure, batch["text"].to_pylist()))) or [[]] * (len(names) - 1)
            kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(SHARES)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(count, schema)


def base_rules(least_words: int = LEAST_WORDS, repeat_percent: int = REPEAT_PERCENT):
    """The fixed part of the rules: too few words, or too many in repeated windows."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
