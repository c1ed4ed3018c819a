"""Phrase mining against plain counting, and the trie, the cuts and the merge by themselves."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridlake.llm import collocations as C

SCHEMA = "text string, lang string, n string, id int, score double"


def brute(docs, least, longest, top, cover=100):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    cand = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    gone = set()
    for p, f in cand.items():
        for i in range(1, len(p)):
            for j in range(i + 2, len(p) + 1):
                part = (p[0], *p[i:j])
                if part != p and 100 * f >= cover * counts[part]:
                    gone.add(part)
    found = {}
    for p, a in cand.items():
        if p in gone:
            continue
        cuts = []
        for k in range(1, len(p) - 1):
            l, r = counts[p[:k + 1]], counts[(p[0], *p[k + 1:])]
            cuts.append((1000 * a * totals[p[0]] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        found.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted(
        (lang, i + 1, w.decode(), -a, l, r, totals[lang], -s)
        for lang, rows in found.items() for i, (s, a, w, l, r) in enumerate(sorted(rows)[:top])
    )


def mined(spark, docs, **options):
    df = spark.createDataFrame([(t, g, "clash", 1, 0.5) for t, g in docs], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in C.collocations(df, **options).collect())


def corpus(seed, n):
    rnd = random.Random(seed)
    words = ["a", "Bb", "cC", "ü", "Ü", "the", "\x85x", "\x0b", "d-e", "f"]
    out = []
    for _ in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", " ", ". ", "\n", ",", "\r\n", "\x1c"]) for _ in range(rnd.randint(0, 60)))
        out.append((text, rnd.choice(["en", "en", "de", None, "und", ""])))
    return out + [(None, "en"), (None, None), ("", "de")] + out[:5] * 3


@pytest.mark.parametrize("options", [
    {}, {"known": 3}, {"known": 0, "entries": 40}, {"top": 7}, {"longest": 3}, {"longest": 2, "cover": 60}, {"entries": 10},
    {"part_places": 50}, {"part_places": 7, "known": 5, "entries": 100},
])
def test_against_plain_counts(spark, options):
    docs = corpus(3, 150)
    plain = {"least": 6, "longest": options.get("longest", 5), "top": options.get("top", 2000), "cover": options.get("cover", 100)}
    assert mined(spark, docs, least=6, **options) == brute(docs, **plain)


def test_long_text_and_runs_of_one_word(spark):
    docs = [("again " * 30_000, "en"), ("x y, " * 20_000, "en"), ("x y z " * 200, None)]
    assert mined(spark, docs, least=100) == brute(docs, 100, 5, 2000)


def test_no_rows(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mined(spark, [(None, None), ("", "en"), (" \t .", "en")]) == []


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(9 * 10 ** 12, 10 ** 13, 9 * 10 ** 12 + 7, 3 * 10 ** 12)], "a long, n long, l long, r long")
    got = rows.select(C._score().alias("s")).first()["s"]
    assert got == 1000 * 9 * 10 ** 12 * 10 ** 13 // ((9 * 10 ** 12 + 7) * 3 * 10 ** 12)


@pytest.mark.parametrize("item", [4, 8])
def test_trie_bursts_and_spills_sorted_runs(item):
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 6, (4000, 5))
    rows[:, 0] = rng.integers(1, 4, 4000)
    trie, want, runs = C.HatTrie(5, item, burst=10, shallow=3), Counter(map(tuple, rows.tolist())), []
    for low in range(0, 4000, 500):
        part, counts = C.sorted_rows(rows[low:low + 500])
        assert part.tolist() == sorted(part.tolist())
        trie.add_rows(part, counts)
        if trie.entries > 800:
            runs += trie.spill(400)
            assert trie.entries <= 400
    assert any(isinstance(n, C.HatTrie.Branch) for n in trie.root.values())
    runs += trie.spill()
    assert trie.entries == 0 and not trie.root
    got = Counter()
    for part, counts in runs:
        assert part.tolist() == sorted(part.tolist())
        for row, n in zip(part.tolist(), counts.tolist()):
            got[tuple(row)] += n
    assert got == want


@pytest.mark.parametrize("split", [0, 10 ** 9])
def test_runs_of_a_partition_give_all_prefixes(split):
    """Whatever the runs and batches, the sums over all parts are the counts of all frequent phrases."""
    rng = np.random.default_rng(split % 7)
    rows = rng.integers(0, 3, (300, 4))
    rows[:, :2] += 1
    for k in (2, 3):
        rows[rows[:, k - 1] == 0, k:] = 0
    want = Counter()
    for row in rows.tolist():
        for k in range(2, 5):
            if row[k - 1]:
                want[tuple(row[:k])] += 1
    part = rows[:, 0] if not split else C.Partitions._hash(rows.T) % 5
    runs = [(int(p), C.pack_run(*C.sorted_rows(rows[low:low + 40][part[low:low + 40] == p])))
            for low in range(0, 300, 40) for p in np.unique(part[low:low + 40])]
    runs.sort(key=lambda r: r[0])
    batches = [pa.table({"part": [p for p, _ in runs[i:i + 3]], "run": [r for _, r in runs[i:i + 3]]}).to_batches()[0] for i in range(0, len(runs), 3)]
    got = Counter()
    for out in C._merge(4, 9 if not split else 1, split)(batches):
        for ids, n in zip(out["ids"].to_pylist(), out["n"].to_pylist()):
            got[tuple(ids)] += n
    assert {p: n for p, n in got.items() if n >= 9} == {p: n for p, n in want.items() if n >= 9}


def test_partitions_keep_prefixes_together():
    rng = np.random.default_rng(3)
    counts = sorted(rng.integers(1, 60, 40).tolist(), reverse=True)
    deal = C.Partitions([500, 130, *counts], 100)
    rows = rng.integers(1, 43, (3000, 5))
    part = deal.of(rows, False)
    assert part.min() >= 0 and part.max() < deal.many and len(set(part[rows[:, 0] == 1].tolist())) == 5
    for row, p in zip(rows[:200], part):
        assert (deal.first[row[0]] <= p < deal.first[row[0]] + max(1, deal.times[row[0]])) and (p < deal.split) == (row[0] <= 2)
    assert (part[rows[:, 0] > 2] >= deal.split).all()
    far = deal.of(rows | C._HASHED, True)
    assert far.max() < 0
    assert C.Partitions([]).many == 1


@pytest.mark.parametrize("high", [5, 1 << 31, 1 << 62])
def test_packed_runs(high):
    rng = np.random.default_rng(high % 11)
    rows, counts = C.sorted_rows(rng.integers(0, high, (500, 5)))
    counts = counts * rng.choice([1, 300, 1 << 33 if high > 5 else 2], len(counts))
    back, n = C.unpack_run(C.pack_run(rows, counts), 5)
    assert (back == rows).all() and (n == counts).all()


def test_split_words_share_only_phrases_of_split_words():
    """What occurs once leaves a part only if every word of it is split, and nothing else lies in two parts."""
    rng = np.random.default_rng(8)
    deal = C.Partitions([900, 800, 90, *[20] * 60], 100)
    rows = rng.choice([1, 2, 3, *range(4, 64)], (6000, 5), p=[0.3, 0.3, 0.1, *[0.3 / 60] * 60])
    rows[:, 2:][np.logical_or.accumulate(rng.random((6000, 3)) < 0.1, axis=1)] = 0
    part = deal.of(rows, False)
    assert deal.hot().tolist() == [1, 2] and len(set(part[part < deal.split].tolist())) == deal.split
    want, got, rare = Counter(), Counter(), 0
    for row in rows.tolist():
        want.update(tuple(row[:k]) for k in range(2, 6) if row[k - 1])
    runs = [(int(p), C.pack_run(*C.sorted_rows(rows[part == p]))) for p in np.unique(part)]
    batch = pa.table({"part": [p for p, _ in runs], "run": [r for _, r in runs]}).to_batches()
    for out in C._merge(5, 4, deal.split, deal.hot())(batch):
        for ids, n in zip(out["ids"].to_pylist(), out["n"].to_pylist()):
            got[tuple(ids)] += n
            rare += n < 4
            assert n >= 4 or set(ids) <= {1, 2} and len(ids) <= C.SHARED
    assert {p: n for p, n in got.items() if n >= 4} == {p: n for p, n in want.items() if n >= 4}
    assert rare < 4 * deal.split * (2 + 4)
