"""The Merkle manifest against a plain tree, and on odd tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gridlake.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, _pos string, leaf int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, fan):
    """(root, paths): the siblings of every node, level by level."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, members = [], []
        for low in range(0, len(nodes), fan):
            run = nodes[low:low + fan]
            for j in range(len(run)):
                for i in under[low + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            above.append(sha(*run))
            members.append([i for u in under[low:low + fan] for i in u])
        nodes, under = above, members
    return nodes[0], paths


def brute(rows, fan):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    groups = {}
    for d, source, lang, n, text in rows:
        lowered = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        tampered = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        leaf = plain_leaf(d, source, lang, n, text)
        groups.setdefault(lang, []).append((d, leaf, plain_leaf(d, source, lang, n, lowered) if tampered else leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = climb([r[1] for r in groups[g]], fan)
    root, tops = climb([trees[g][0] for g in order], fan)
    out = []
    for g, top in zip(order, tops):
        subroot, paths = trees[g]
        for (d, leaf, now), path in zip(groups[g], paths):
            whole = path + top
            for left, right in whole:
                now = sha(left, now, right)
            out.append((d, leaf, subroot, root, sha(*[x + y for x, y in whole]), now, now == root))
    return sorted(out, key=repr)


def check(spark, rows, fan=8, depth=merkle.DEPTH):
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    got = [tuple(r) for r in merkle.tamper_check(docs, fan, depth).collect()]
    assert sorted(got, key=repr) == brute(rows, fan)


@pytest.mark.parametrize("fan,depth", [(8, 1), (8, 2), (2, 3), (3, 1)])
def test_trees_of_every_size(spark, fan, depth):
    sizes = {"a": 1, "b": 2, "c": 8, "d": 9, "e": 17, "f": 64, "g": 65, "h": 130, "ü": 3, "Z": 5, None: 10}
    rows = [(i * 7 + k, f"s{i % 3}", lang, i, f"Text {i}") for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    check(spark, rows, fan, depth)


def test_odd_rows(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, clashing names."""
    long = "Long Word " * 60_000
    rows = [
        (1, None, None, None, None), (None, "s", "en", 3, "ABC"), (None, "s", "en", 3, "ABC"), (None, None, None, None, None),
        (5, "s", "en", 0, ""), (5, "s", "en", 0, ""), (5, "t", "en", 1, "x"), (6, "s", "", 2, "Ünï"), (7, "s", "de", 9, long),
        (-3, "s", "de", 9, "MINUS"),
    ]
    check(spark, rows)
    check(spark, [(12, "s", "en", 4, "Solo")])


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.tamper_check(docs).count() == 0


def test_one_changed_byte_shows_in_its_proof_only(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("g").alias("lang"), F.col("id").cast("string").alias("text"))
    kept = merkle.manifest(docs, ("doc_id", "text"), "lang", "doc_id").select("doc_id", "leaf", "root", "path")
    fake = F.when(F.col("doc_id") == 42, merkle.leaf(F.col("doc_id"), F.lit("other"))).otherwise(F.col("leaf"))
    wrong = kept.filter(merkle.fold(fake, F.col("path")) != F.col("root"))
    assert [r.doc_id for r in wrong.collect()] == [42]
