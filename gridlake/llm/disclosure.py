"""Personal data in texts: patterns, and the terms that give them away.

Patterns find protected entities: addresses, IP numbers, cards, phone numbers.  A term discloses
an entity as far as it tells its information: over all words of the corpus,

    PMI(t; e) = log2(n(t, e) N / (n(t) n(e)))      IC(e) = log2(N / n(e))

where n(t, e) counts t among the ``WINDOW`` words on either side of e, n(e) all words there, n(t)
the occurrences of t, N all words.  PMI / IC is 1 for a term that occurs by that entity only.  In
texts that hold the entity, such terms are generalised from ``GENERALISE`` on and removed from
``REMOVE`` on, since they would name it after it is masked.  A term must be seen in ``CONTEXTS``
different contexts of the entity, so copies of one text prove nothing; texts without personal data
are left as they are.  Terms are runs of three letters or more, in lower case, outside of the
patterns' matches, compared by 64-bit hashes.

Texts are read twice: for the contexts, and for the counts and places of the terms that contexts
propose.  A bitmap of fixed size tells tasks which these are, so other words are never shuffled.

Null and empty texts have no spans.  Every row gives a row, repeated ids and null ids too; other
columns are not read; an empty table gives no rows.  Patterns take time in proportion to the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.bitmaps import bitmap, has
from gridlake.session import stage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
WINDOW, CONTEXTS = 8, 3
GENERALISE, REMOVE = 0.9, 0.97
CELLS = 1 << 23
#: distinct keys a task counts before it hands them on
ENTRIES = 1 << 18

# What the four kinds look like.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str):
    """Leftmost matches; a name ends at an @ and holds none, so each @ is looked at once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in order; kinds are places in ``KINDS``."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and _passes_luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _number(text: str) -> int:
    n = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def entity(text: str, span: tuple[int, int, int]) -> int:
    """A number for the protected value: letters in lower case, numbers by their digits."""
    start, kind, end = span
    value = text[start:end].lower() if kind < 2 else _NOT_DIGIT.sub("", text[start:end])
    return _number(f"{KINDS[kind]}:{value}")


def masked(text: str, spans) -> str:
    """The text with blanks in place of the spans: no term reaches into one."""
    parts, at = [], 0
    for start, _, end in spans:
        if end > at:
            parts += [text[at:start], " " * (end - max(at, start))] if start >= at else [" " * (end - at)]
            at = end
    return "".join([*parts, text[at:]])


def _one_by_one(column):
    for i in range(len(column)):
        yield column[i].as_py()


def contexts(docs: DataFrame, text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """(e, kind, t, context, n): the terms around each entity of each text, once per place."""

    def near(batches):
        counts: Counter = Counter()

        def leave():
            keys = list(zip(*counts)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip([*keys, list(counts.values())], [pa.int64(), pa.int32(), *[pa.int64()] * 3])],
                names=["e", "kind", "t", "context", "n"],
            )

        for batch in batches:
            for text in _one_by_one(batch["text"]):
                spans = base_spans(text) if text else []
                if not spans:
                    continue
                terms = [(m.start(), m.group().lower()) for m in _TERM.finditer(masked(text, spans))]
                starts = [s for s, _ in terms]
                around: dict = {}
                for span in spans:
                    places = around.setdefault((entity(text, span), span[1]), set())
                    at = bisect_left(starts, span[0])
                    places.update(range(max(0, at - window), min(len(terms), at + window)))
                for (e, kind), places in around.items():
                    words = [terms[i][1] for i in sorted(places)]
                    context = _number(" ".join(words))
                    counts.update((e, kind, _number(w), context) for w in words)
                if len(counts) > ENTRIES:
                    yield from leave()
                    counts.clear()
        yield from leave()

    rows = docs.select(F.col(text_column).alias("text"))
    return rows.mapInArrow(near, "e long, kind int, t long, context long, n long")


_FOUND = (
    "doc long, kinds array<int>, starts array<long>, ends array<long>, entities array<long>,"
    " terms array<long>, term_starts array<long>, term_ends array<long>, t long, n long, text string"
)


def _read(docs: DataFrame, id_column: str, text_column: str, proposed, keep_text: bool) -> DataFrame:
    """Rows of texts (spans, entities, places of proposed terms) and of counts (t, n); the count
    of all words has no t and no spans."""
    session = docs.sparkSession
    cells = session.sparkContext.broadcast(proposed)
    kinds = [pa.int64(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 6, pa.int64(), pa.int64(), pa.string()]
    names = [p.split()[0] for p in _FOUND.split(", ")]

    def find(batches):
        bits = cells.value if cells.value.any() else None
        counts, total = Counter(), 0

        def told(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 11, kinds)], names=names)

        def leave():
            rows = []
            for word, n in counts.items():
                t = _number(word)
                if bits is not None and has(bits, t % CELLS):
                    rows.append((*[None] * 8, t, n, None))
            counts.clear()
            return told(rows)

        for batch in batches:
            rows, size = [], 0
            for doc, text in zip(batch["doc"].to_pylist(), _one_by_one(batch["text"])):
                spans = base_spans(text) if text else []
                plain = masked(text, spans) if spans else text or ""
                words = _TERM.findall(plain)
                total += len(words)
                places = []
                if bits is not None:
                    counts.update(map(str.lower, words))
                    if spans:
                        for m in _TERM.finditer(plain):
                            t = _number(m.group().lower())
                            if has(bits, t % CELLS):
                                places.append((t, m.start(), m.end()))
                starts, of, ends = list(zip(*spans)) or ((), (), ())
                entities = list(dict.fromkeys(entity(text, s) for s in spans))
                rows.append((doc, of, starts, ends, entities, *(list(zip(*places)) or ((), (), ())), None, None, text if keep_text else None))
                size += len(text or "") if keep_text else 0
                if size > 1 << 24:
                    yield told(rows)
                    rows, size = [], 0
            yield told(rows)
            if len(counts) > ENTRIES:
                yield leave()
        yield leave()
        yield told([(*[None] * 9, total, None)])

    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    return rows.mapInArrow(find, _FOUND).withColumn("row", F.monotonically_increasing_id())


def disclosures(near: DataFrame, counts: DataFrame, total: int, least_share: float = GENERALISE, least_contexts: int = CONTEXTS) -> DataFrame:
    """(e, kind, t, share): how much of the information of an entity a term tells, where it is enough."""
    apart = near.groupBy("e", "kind", "t", "context").agg(F.sum("n").alias("n"))
    pairs = apart.groupBy("e", "kind", "t").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("both"))
    pairs = pairs.filter(F.col("contexts") >= least_contexts)
    whole = near.groupBy(F.col("e").alias("of")).agg(F.sum("n").alias("n_e"))
    known = pairs.join(whole, pairs["e"] == whole["of"]).join(counts.select("t", F.col("n").alias("n_t")), "t")
    of_all = F.lit(float(total))
    pmi = F.log2(F.col("both") * of_all / (F.col("n_t") * F.col("n_e").cast("double")))
    content = F.log2(of_all / F.col("n_e"))
    rows = known.withColumn("share", F.when(content > 0, pmi / content))
    return rows.filter(F.col("share") >= least_share).select("e", "kind", "t", "share")


def find_spans(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False, window: int = WINDOW,
    least_share: float = GENERALISE, least_contexts: int = CONTEXTS,
) -> DataFrame:
    """(doc, base, added, text) of every row: spans (start, kind, end) of the patterns, and of the
    terms that disclose one of them, with the share they tell and the kind of the entity."""
    near = stage(contexts(docs, text_column, window), "disclosure-contexts")
    often = near.select("e", "t", "context").distinct().groupBy("e", "t").count().filter(F.col("count") >= least_contexts)
    proposed = bitmap(often, F.col("t"), CELLS)
    read = stage(_read(docs, id_column, text_column, proposed, keep_text), "disclosure-rows")
    counts = read.filter("t IS NOT NULL").groupBy("t").agg(F.sum("n").alias("n"))
    total = read.filter("t IS NULL AND kinds IS NULL").agg(F.sum("n")).first()[0] or 0
    told = stage(disclosures(near, counts, total, least_share, least_contexts), "disclosures")
    texts = read.filter("kinds IS NOT NULL").select(
        "row", "doc", "text", "entities", "terms", "term_starts", "term_ends",
        F.arrays_zip(F.col("starts").alias("start"), F.col("kinds").alias("kind"), F.col("ends").alias("end")).alias("base"),
    )
    places = texts.filter(F.size("terms") > 0).select("row", "entities", F.explode(F.arrays_zip(
        F.col("terms").alias("t"), F.col("term_starts").alias("start"), F.col("term_ends").alias("end")
    )).alias("at")).select("row", "entities", "at.*")
    met = places.join(told, "t").filter(F.array_contains("entities", F.col("e")))
    best = met.groupBy("row", "start", "end").agg(F.max(F.struct("share", "kind")).alias("why"))
    added = best.groupBy(F.col("row").alias("of")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "why.share", "why.kind"))).alias("added")
    )
    out = texts.join(added, texts["row"] == added["of"], "left")
    none = F.array().cast("array<struct<start:long,end:long,share:double,kind:int>>")
    return out.select("doc", "base", F.coalesce("added", none).alias("added"), "text")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _of_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_digests(docs: DataFrame, **options) -> DataFrame:
    """Counts of the patterns, a digest of their spans, and all spans, per row."""
    found = find_spans(docs, **options)
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    terms = F.transform("added", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))
    count = [_of_kind("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        F.col("doc").alias("doc_id"), *count, F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat(base, terms))).alias("spans"),
    )


def rewrite(text: str, base, added, remove: float = REMOVE) -> str:
    """The text with entities named by kind, terms generalised to the kind they disclose, or removed."""
    spans = [(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in base]
    spans += [(s["start"], s["end"], "" if s["share"] >= remove else f"[of {KINDS[s['kind']]}]") for s in added]
    parts, at = [], 0
    for start, end, name in sorted(spans):
        if start >= at:
            parts += [text[at:start], name]
        at = max(at, end)  # of spans that overlap, the first gives the name and all are gone
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, remove: float = REMOVE, **options) -> DataFrame:
    """(doc_id, text) of every row, without what ``find_spans`` finds; null stays null."""
    found = find_spans(docs, keep_text=True, **options)

    def clean(batches):
        for batch in batches:
            texts = [
                None if text is None else rewrite(text, base, added, remove)
                for text, base, added in zip(*[_one_by_one(batch[c]) for c in ("text", "base", "added")])
            ]
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return found.mapInArrow(clean, "doc_id long, text string")
