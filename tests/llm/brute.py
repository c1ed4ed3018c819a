"""Plain versions of the operators, one row at a time, to hold the Spark jobs against."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from fractions import Fraction

import numpy as np

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def token_files(docs):
    """{doc_id: (start, n_tokens, crc32)} with end id 0."""
    coder, start, out = tokenizer("byte_bpe_50k.json"), 0, {}
    for doc_id, text in sorted(docs):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        out[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    return out


def round_trip(text):
    coder = tokenizer("word_bpe_49k.json")
    ids = coder.encode(text or "", add_special_tokens=False).ids
    decoded = coder.decode(ids, skip_special_tokens=False)
    return (
        len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest(),
    )


def article(page):
    """The text between article tags of the test pages, whose only blocks are h1 and p."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    inner = re.sub(r"</?b>", "", inner).replace("<br>", " ")
    found = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in found if b)


def shingles(text, n):
    words = BLANK.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < n else frozenset(zip(*(words[i:] for i in range(n))))


def components(docs, n, share):
    """{doc_id: (n_shingles, component_id)} from all pairs that share a shingle."""
    share = Fraction(share)
    sets = {d: shingles(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    pairs = {(a, b) for h in holders.values() for i, b in enumerate(h) for a in h[:i]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if both >= share * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def statistics(text):
    text = text or ""
    words = BLANK.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else None
    if often is None:
        from collections import Counter

        often = {w for w, c in Counter(windows).items() if c > 1}
    marked = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def nearest(vectors, every, k):
    """{query id: [(vec_id, score)]} by all cosines in double precision."""
    fine = {}
    for i, v in vectors:
        if v is not None and all(x is not None for x in v):
            a = np.array(v, dtype=float)
            if np.isfinite(a).all() and a.any():
                fine[i] = a
    ids = np.array(sorted(fine))
    rows = np.array([fine[i] for i in ids])
    norm = np.sqrt((rows * rows).sum(axis=1))
    out = {}
    for q in ids[ids % every == 0].tolist():
        a = fine[q]
        score = (rows * a).sum(axis=1) / (np.sqrt((a * a).sum()) * norm)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out
