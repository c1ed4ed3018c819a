"""Registered corpus queries against brute force or their SQL, and the pipeline stage by stage."""

import math

import brute
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from gridlake.llm.queries import QUERIES, table


def rows(spark, sf_dir, name, *columns):
    return [tuple(r) for r in table(spark, sf_dir, name).select(*columns).collect()]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return rows(spark, sf_dir, "documents", "doc_id", "text")


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_sql(spark, sf_dir, name):
    run, sql = QUERIES[name]
    assert compare(spark, connect(sf_dir), run, sql, sf_dir) == ""


def test_token_files(spark, sf_dir, docs):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op1_token_files"][0](spark, sf_dir).collect()}
    assert got == brute.token_files(docs)


def test_round_trip(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_bpe"][0](spark, sf_dir).collect()}
    assert got == {d: brute.round_trip(t) for d, t in docs}


def test_page_text(spark, sf_dir):
    pages = rows(spark, sf_dir, "pages", "page_id", "url", "html")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in QUERIES["op3_html_text"][0](spark, sf_dir).collect()}
    assert got == {(i, u): (brute.article(h), len(brute.article(h))) for i, u, h in pages}


def test_nearest(spark, sf_dir):
    want = brute.nearest(rows(spark, sf_dir, "embeddings", "vec_id", "embedding"), 50, 5)
    got = {}
    for r in sorted(QUERIES["op4_nearest"][0](spark, sf_dir).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, found in got.items():
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        known = dict(want[q])
        assert all(math.isclose(s, known.get(i, s), rel_tol=1e-12) for i, s in found)


def test_token_counts(spark, sf_dir, docs):
    coder = brute.tokenizer("byte_bpe_50k.json")
    sizes = sorted(len(coder.encode(t or "", add_special_tokens=False).ids) for _, t in docs)
    got = {r.n_tokens: r for r in QUERIES["op5_token_counts"][0](spark, sf_dir).collect()}
    assert set(got) == set(sizes)
    for limit, r in got.items():
        over = sum(s > limit for s in sizes)
        assert (r.n_docs, r.docs_over) == (sizes.count(limit), over)
        assert r.fit_tokens == sum(s for s in sizes if s <= limit)
        assert r.kept_tokens == sum(min(s, limit) for s in sizes)
        assert math.isclose(r.share, 1 - over / len(sizes))


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    truth = dict(rows(spark, sf_dir, "labels", "doc_id", "toxic"))
    got = QUERIES["op6_toxicity"][0](spark, sf_dir).filter("held_out").collect()
    known = [(r.score, r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth]
    assert all(0 <= s <= 1 and p == (s >= 0.3) for s, p, _ in known)
    caught = sum(p for _, p, t in known if t) / sum(t for *_, t in known)
    wrong = sum(p for _, p, t in known if not t) / sum(not t for *_, t in known)
    assert caught >= 0.85 and wrong <= 0.02


def test_quality_counts_and_verdict(spark, sf_dir, docs):
    truth = dict(rows(spark, sf_dir, "labels", "doc_id", "quality"))
    got = {r.doc_id: r for r in QUERIES["op8_quality_rules"][0](spark, sf_dir).collect()}
    assert set(got) == {d for d, _ in docs}
    for d, t in docs:
        r = got[d]
        counts = brute.statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)
    judged = [(r.kept, truth[d]) for d, r in got.items() if d in truth and not r.base_failed]
    assert sum(k == bool(t) for k, t in judged) >= 0.95 * len(judged)


def test_pipeline_stages(spark, sf_dir, folder):
    given = table(spark, sf_dir, "documents")
    columns, docs = given.columns, given
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        kept[name] = docs
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    # quality: what the fixed rules reject is gone, good labelled documents stay
    texts = dict(rows(spark, sf_dir, "documents", "doc_id", "text"))
    for d, t in texts.items():
        n, _, _, _, repeat = brute.statistics(t)
        if n < 50 or 100 * repeat > 50 * n:
            assert d not in ids["quality rules"]
    # copies: the smallest id of every component
    passed = [(d, texts[d]) for d in sorted(ids["toxicity"])]
    assert ids["near duplicates"] == {c for _, c in brute.components(passed, 5, "4/5").values()}
    assert ids["source mix"] <= ids["near duplicates"]
    final = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in kept["encode"].collect()}
    assert final == {d: brute.round_trip(texts[d]) for d in ids["source mix"]}
    assert corpus_pipeline.run(spark, sf_dir).agg(F.count("*")).first()[0] == len(final)
