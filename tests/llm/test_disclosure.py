"""Patterns against plain regular expressions, disclosing terms against plain counts."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from gridlake.llm import disclosure as D
from gridlake.llm.queries import QUERIES, table

SCHEMA = "doc_id long, text string, kinds string, row int, t double"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_spans(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def plain_terms(texts, window=D.WINDOW, least=D.GENERALISE, contexts=D.CONTEXTS):
    """For each text {(start, end)} of the terms that disclose an entity of that text."""
    found, both, of_entity, seen, of_term = [], Counter(), Counter(), {}, Counter()
    for text in texts:
        text = text or ""
        spans = plain_spans(text)
        hidden = list(text)
        for a, _, b in spans:
            hidden[a:b] = " " * (b - a)
        terms = [(m.start(), m.end(), m.group().lower()) for m in TERM.finditer("".join(hidden))]
        of_term.update(w for *_, w in terms)
        near = {}
        for a, kind, b in spans:
            value = text[a:b].lower() if kind < 2 else re.sub("[^0-9]", "", text[a:b])
            before = [i for i, t in enumerate(terms) if t[0] < a]
            behind = [i for i, t in enumerate(terms) if t[0] >= a]
            near.setdefault((kind, value), set()).update(before[-window:] + behind[:window])
        for e, places in near.items():
            words = [terms[i][2] for i in sorted(places)]
            both.update((e, w) for w in words)
            of_entity[e] += len(words)
            for w in words:
                seen.setdefault((e, w), set()).add(tuple(words))
        found.append((terms, set(near)))
    n = sum(of_term.values())
    telling = set()
    for (e, w), k in both.items():
        content = math.log2(n / of_entity[e])
        if len(seen[e, w]) >= contexts and content > 0 and math.log2(k * n / (of_term[w] * of_entity[e])) / content >= least:
            telling.add((e, w))
    return [{(a, b) for a, b, w in terms if any((e, w) in telling for e in entities)} for terms, entities in found]


def digests(texts):
    out = []
    for text, terms in zip(texts, plain_terms(texts)):
        base = plain_spans(text)
        names = (*D.KINDS, D.TERM)
        told = [",".join(f"{names[k]}:{a}:{b}" for a, k, b in s) for s in (base, sorted(base + [(a, 4, b) for a, b in terms]))]
        counts = [sum(k == i for _, k, _ in base) for i in range(4)]
        out.append((*counts, hashlib.sha256(told[0].encode()).hexdigest(), told[1]))
    return out


def run(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "clash", 1, 0.5) for i, t in enumerate(texts)]
    return D.span_digests(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()


def test_patterns_equal_plain_expressions():
    rnd = random.Random(7)
    pieces = ["a", "b.c", "@", "x@y.z", ".", "-", "+", "1", "22", "4111 1111 1111 1111", "255", "256", "1.2.3.4", "0000255.1.1.1",
              " ", "(", "+49 30 901820", "4041894974608795", "ü", "é@ö.de", "\n", "%", "..", "@@", "--", "999", "79927398713", "0"]
    for _ in range(6000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25)))
        assert D.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "a@", "+1 ", "+", "a.", "1-", "@a", "(", "+1((((", "@a."])
def test_time_in_proportion_to_the_text(unit):
    """A megabyte of any of these takes a moment; plain expressions need its square for some."""
    text = unit * (1_000_000 // len(unit))
    D.base_spans(text)
    assert D.base_spans(unit * 50) == plain_spans(unit * 50)


def people(seed=1):
    rnd = random.Random(seed)
    filler = ["river", "stone", "market", "window", "garden", "letter", "summer", "bread", "paper", "horse", "table", "music"]
    words = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    texts = [words(rnd.randint(0, 60)) for _ in range(120)]
    for i in range(6):
        texts.append(f"{words(5)} Archibald Featherstone writes from afe@mail.example.com {words(9)} Featherstone {words(i)}")
    texts.append(f"{words(20)} Featherstone {words(5)}")  # no entity: stays
    texts += [f"{words(4)} copied zanzibar one@copy.example.org {words(3)}"] * 5  # one context: proves nothing
    for i in range(4):
        texts.append(f"{words(3)} Quentin: +49 30 90182{i % 2}0, card 4111 1111 1111 1111 {words(4)} {words(i)}")
    return texts + [None, "", "   "]


def test_disclosing_terms(spark):
    texts = people()
    got = [tuple(r)[1:] for r in sorted(run(spark, texts), key=lambda r: r.doc_id)]
    assert got == digests(texts)
    by_text = dict(zip(texts, got))
    assert sum("term:" in r[-1] for r in got) >= 6
    for text, row in by_text.items():
        if text and "zanzibar" in text or text and not plain_spans(text):
            assert "term:" not in row[-1]


def test_sanitised_texts(spark):
    texts = people()
    df = spark.createDataFrame([(i, t, "clash", 1, 0.5) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.text for r in D.sanitise(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
        elif not plain_spans(t):
            assert got[i] == t
        else:
            assert not plain_spans(got[i]) and "Archibald" not in got[i]
    assert any("[EMAIL]" in t for t in got.values() if t) and any("zanzibar [EMAIL]" in t for t in got.values() if t)
    assert D.rewrite("Ann Lee x@y.z", [{"start": 8, "end": 13, "kind": 0}], [
        {"start": 0, "end": 3, "share": 0.99, "kind": 0}, {"start": 4, "end": 7, "share": 0.92, "kind": 0}
    ]) == " [of email] [EMAIL]"


def test_odd_rows(spark):
    long = "word " * 100_000 + "me@here.example.com " + "9" * 4_000 + " 1.2.3.4"
    texts = [None, "", "me@here.example.com", "me@here.example.com", long, "a" * 6_000]
    got = run(spark, texts, [None, None, 5, 5, 6, 7])
    assert sorted([tuple(r)[1:] for r in got]) == sorted(digests(texts))
    assert sorted([r.doc_id for r in got], key=repr) == sorted([None, None, 5, 5, 6, 7], key=repr)
    empty = spark.createDataFrame([], SCHEMA)
    assert D.span_digests(empty).count() == 0 and D.sanitise(empty).count() == 0


def test_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_disclosure"][0](spark, sf_dir).collect()}
    assert got == dict(zip([d for d, _ in docs], digests([t for _, t in docs])))
