"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import unicodedata

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.llm import annindex, bitpack, bpe, chat, html, lengths, ngramjoin, quality, raking, toxicity
from gridlake.llm.queries import tokenizer

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, sampled int"
LONG = " ".join(f"word{i % 977} and thing{i % 89}" for i in range(60_000))


def documents(spark, *texts):
    return spark.createDataFrame(
        [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 0, 1.0, "x", 1) for i, t in enumerate(texts)], SCHEMA
    )


@pytest.fixture(scope="module")
def odd(spark):
    rows = documents(spark, None, "", "  \n\t ", "one two", "One  two", LONG, "a\u0085b <|endoftext|> c", "Ümlaut Σίσυφος ΟΔΟΣ 日本語")
    return rows.unionByName(rows.filter("doc_id = 3")).unionByName(rows.withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (5, 0, 1), (None, 1, None), (99, None, 1)], "doc_id long, quality int, toxic int")


def test_packed_files(spark, odd, folder):
    manifest = bitpack.write_tokens(odd, folder, tokenizer(BYTES), end_id=0)
    got = [tuple(r)[:4] for r in bitpack.read_tokens(manifest).collect()]
    coder = brute.tokenizer(BYTES)
    sizes = sorted(len(coder.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert sorted(g[2] for g in got) == sizes
    at = 0
    for _, start, n, _ in sorted(got, key=lambda g: g[1]):
        assert start == at
        at += n
    ids = [g[0] for g in sorted(got, key=lambda g: g[1])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert bitpack.packed_corpus(odd.limit(0), tokenizer(BYTES)).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17, 32])
def test_bits_and_random_access(bits, folder):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4") for n in (0, 1, 70_000, 3, 0, 140_000)]
    with open(f"{folder}/x.bin", "wb") as sink:
        writer = bitpack.PackedWriter(sink, bits)
        for i, ids in enumerate(docs):
            writer.add(i or None, ids)
        writer.close()
    from gridlake.sources.files import open_input

    with open_input(f"{folder}/x.bin") as source:
        reader = bitpack.PackedReader(source)
        flat = np.concatenate(docs)
        back = list(reader.documents())
        assert [d for d, *_ in back] == [None, 1, 2, 3, 4, 5]
        assert all((a == b).all() for (_, _, a), b in zip(back, docs))
        for low, high in ((0, 1), (65_535, 65_538), (69_999, 200_000), (5, 5)):
            assert (reader.read(low, high) == flat[low:high]).all()
    with pytest.raises(ValueError):
        bitpack.PackedWriter(open(f"{folder}/y.bin", "wb"), 4).add(1, np.array([16], "<u4"))


def test_streaming_encoder_equals_library():
    merges, coder = bpe.tools(tokenizer(WORDS))
    library = brute.tokenizer(WORDS)
    rnd = random.Random(5)
    alphabet = "abcdefghinorst  \n\t'sdm0129.,!<|é́ΣσİßÅ日本\x1c\x85\xa0😀-_​"
    for k in range(600):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80)))
        if k % 9 == 0:
            text = text[:20] + "<|endoftext|>" + text[20:]
        want = library.encode(text, add_special_tokens=False).ids
        assert [i for ids in coder.encode(text) for i in ids] == want
        state = bpe.Decoder(merges)
        cut = rnd.randint(0, len(want))
        assert state.feed(want[:cut]) + state.feed(want[cut:]) + state.finish() == library.decode(want, skip_special_tokens=False)
    for k in range(12):  # runs far longer than the window, in parts
        text = "".join(rnd.choice("aeinrsthing" if k % 2 else "ab") for _ in range(9000))
        text = text[:300] + "'ll" + text[300:] + "é" * 80 + "12!!!" + " end"
        want = library.encode(text, add_special_tokens=False).ids
        assert [i for ids in coder.encode(text) for i in ids] == want
        assert list(coder.stream(text[i:i + 700] for i in range(0, len(text), 700))) == want


def test_registered_encoder_streams(spark, monkeypatch):
    merges, coder = bpe.tools(tokenizer(WORDS))
    whole = []  # symbols merged at once: two tokens at most, as all other merging is the transducer's
    merge = bpe.MergeList.merge
    monkeypatch.setattr(bpe.MergeList, "merge", lambda self, symbols: whole.append(len(symbols)) or merge(self, symbols))
    rnd = random.Random(11)
    monkeypatch.setattr(coder, "words", bpe.Cache(coder._word))
    monkeypatch.setattr(coder, "runs", bpe.Cache(coder._run))
    letters = "aeinrsthABCxyz0189+/=,.'é日本ΣßÅ"
    hangul = unicodedata.normalize("NFD", "".join(chr(rnd.randrange(0xAC00, 0xD7A4)) for _ in range(2500)))
    texts = [
        " ".join("".join(rnd.choice(letters) for _ in range(rnd.choice([3, 90, 600, 5000]))) for _ in range(40)),
        "".join(rnd.choice(letters) for _ in range(9000)), hangul, "e" + "\u0301\u0323" * 3000 + "x" * 5000,
        "x" * 4090 + "<|endoftext|>" + "y'll" * 1200, "ordinary words, unremarkable sentences " * 400 + "incomprehensibilities" * 5,
    ]
    library = brute.tokenizer(WORDS)
    for text in texts:
        assert [i for ids in coder.encode(text) for i in ids] == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*coder.words, *coder.runs])) <= 64
    assert max(whole) <= 2 * merges.lookahead and len(whole) > 0


def test_round_trip_rows(spark, odd):
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd, tokenizer(WORDS)).collect())
    assert got == sorted(brute.round_trip(r.text) for r in odd.collect())
    assert bpe.round_trip(odd.limit(0), tokenizer(WORDS)).count() == 0
    plain = documents(spark, "hello big world", "Größe 7").select("doc_id", "text")
    back = bpe.decode_ids(bpe.encode_ids(plain, tokenizer(WORDS)), tokenizer(WORDS), name="again").orderBy("doc_id").collect()
    assert [r.again for r in back] == ["hello big world ", "größe 7 "]


def test_pages(spark):
    pages = spark.createDataFrame([
        (1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>unclosed <b", "x"),
        (4, "u", "<body><header><a href=/>Home</a></header><div class='cookie-notice'><p>" + "we use cookies " * 30 + "</p></div>"
         "<nav><ul><li><a>x</a></ul></nav><main><article><h1>A &amp; B</h1><p>First <a href=q>link</a>\n text<br>next</p>"
         "<aside><p>" + "related " * 40 + "</p></aside><p>Short.</p><script>var a='<p>x</p>'</script>"
         "<section class=comments><p>reader says</p></section></article></main><footer>&copy;</footer>", "x"),
    ], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract_text(pages).collect()}
    want = "A & B\nFirst link text next\nShort."
    assert got[1] == got[2] == ("", 0) and got[4] == (want, len(want))
    assert html.extract_text(pages.limit(0)).count() == 0
    assert html.extract_text(pages.unionAll(pages)).count() == 8


_TITLE = "Seven boats in the old harbour"
_FIRST, _SECOND = (" ".join(f"{w} the boat {i} lay still in the harbour," for i in range(6)) for w in ("First", "Later"))
_MENU = "<ul><li><a href=/>Home</a><li><a href=/n>Latest news</a><li><a href=/s>Sport</a><li><a href=/w>Weather</a></ul>"
_TEXT = f"{_TITLE}\n{_FIRST}\n{_SECOND}"
_BODY = f"<h1>{_TITLE}</h1><p>{_FIRST}</p><p>{_SECOND}</p>"


@pytest.mark.parametrize("page", [
    f"<html><head><meta charset=utf-8><title>no</title><style>p{{}}</style><body><article>{_BODY}</article></body></html>",
    f"<head>\n<link rel=x>\n<script>no()</script>\n<article>{_BODY}</article>",
    f"<head><title>no</title><noscript>no</noscript><template><p>no</p></template><h1>{_TITLE}</h1><p>{_FIRST}<p>{_SECOND}",
])
def test_page_without_end_of_head(page):
    assert html.main_text(page) == _TEXT


def test_text_ends_the_head():
    assert html.main_text(f"<head><title>no</title> {_FIRST} <b>and</b> more<p>{_SECOND}") == f"{_FIRST} and more\n{_SECOND}"
    assert html.main_text(f"<head><title>no</title><b>{_FIRST}</b><p>{_SECOND}") == f"{_FIRST}\n{_SECOND}"


_CARD = "<article><h3><a href=/c>Other harbour stories this week</a></h3><p><a href=/c>Read on</a></p></article>"


@pytest.mark.parametrize("page", [
    f"<body><div>{_MENU}</div><div>{_BODY}</div>{_CARD}</body>",
    f"<body>{_BODY}<article class=comment><p>A reader thinks that these boats were never seven at all.</p></article></body>",
    f"<body>{_BODY}<aside><article><p>{_FIRST}</p></article></aside></body>",
    f"<main>{_MENU}<article>{_BODY}</article><div><a href=/a>All of our boats at half price</a></div>{_MENU}</main>",
    f"<article>{_BODY}<article class='comment odd'><p>{_FIRST}</p></article></article>",
    f"<main>{_BODY}</main><section><article class=comment><p>{_SECOND}</p></article></section>",
    f"<body>{_MENU}{_BODY}</body>",
])
def test_words_and_links_decide_in_and_out_of_main(page):
    assert html.main_text(page) == _TEXT


@pytest.mark.parametrize("page", [
    f"<body><div class='with-sidebar'>{_BODY}<div class=sidebar><p>{_FIRST}</p></div></div></body>",
    f"<body id='search-page'><div id='search-page'><article>{_BODY}</article></div></body>",
    f"<div class='layout no-comments'><div><h1>{_TITLE}</h1></div><p>{_FIRST}</p><p>{_SECOND}</p></div>",
    f"<div class='social'><article class='banner'>{_BODY}</article></div><footer>{_FIRST}</footer>",
    f"<div class='widget'><div>{_BODY}</div><div class='share'>Tell all of your friends about this story of ours</div></div>",
    f"<div class='toolbar'><main>{_BODY}</main></div><div class='cookie-notice'><p>{_FIRST * 9}</p></div>",
    f"<article class='post category-social'>{_BODY}</article><div id=comments><div class=comment><p>{_FIRST}</p></div></div>",
    f"<main>{_BODY}</main><section id=comments><p>{_FIRST * 9}</p><article><p>{_SECOND * 9}</p></article></section>",
])
def test_marks_of_a_layout(page):
    assert html.main_text(page) == _TEXT


def test_vectors(spark):
    rng = np.random.default_rng(3)
    hot = [1.0, 2.0, 0.5, -1.0]
    vectors = [(i, hot if i % 3 == 0 else rng.normal(size=4).tolist(), "x") for i in range(400)]
    vectors += [(400, None, "x"), (401, [0.0] * 4, "x"), (402, [1.0, None, 1.0, 1.0], "x"), (403, [float("nan"), 1.0, 1.0, 1.0], "x"),
                (404, [1.0, 2.0], "x"), (450, [0.0] * 4, "x")]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string")
    want = brute.nearest([v[:2] for v in vectors if v[0] != 404], 50, 5)
    got = {}
    for r in sorted(annindex.nearest(table).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want)
    for q in want:  # ties by the smaller id, the query itself left out
        if q % 3 == 0:
            assert got[q] == [i for i in range(0, 400, 3) if i != q][:5]
    few = annindex.nearest(table.filter("vec_id IN (0, 3, 401)")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 3)]
    assert annindex.nearest(table.limit(0)).count() == 0


def test_lengths(spark, odd):
    histogram = lengths.length_histogram(odd, tokenizer(BYTES)).cache()
    sizes = [len(brute.tokenizer(BYTES).encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect()]
    assert {r.n_tokens: r.n_docs for r in histogram.collect()} == {s: sizes.count(s) for s in sizes}
    for r in lengths.totals_at(histogram, [0, 2, 100, 10**7]).collect():
        assert (r.docs, r.all_tokens) == (len(sizes), sum(sizes))
        assert (r.kept_tokens, r.docs_cut) == (sum(min(s, r.context) for s in sizes), sum(s > r.context for s in sizes))
    found = {r.asked: r.n_tokens for r in lengths.length_quantiles(lengths.length_profile(histogram), [0.5, 1.0]).collect()}
    assert found == {0.5: sorted(sizes)[(len(sizes) + 1) // 2 - 1], 1.0: max(sizes)}
    assert lengths.length_profile(histogram.limit(0)).count() == 0


def test_models_on_odd_tables(spark, odd, labels):
    for given in (labels, labels.limit(0)):
        machine = toxicity.train(odd, given)
        scored = toxicity.score_documents(odd, machine).collect()
        assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
        assert toxicity.keep_civil(odd, machine).columns == odd.columns
        judged = quality.judge(odd, given).collect()
        assert len(judged) == odd.count() and not any(r.kept for r in judged if r.n_words < 50)
        assert quality.keep_good(odd, given).columns == odd.columns
    empty = odd.limit(0)
    assert toxicity.score_documents(empty, toxicity.train(empty, labels)).count() == 0
    assert quality.judge(empty, labels).count() == quality.keep_good(empty, labels).count() == 0


def test_machine_learns_pairs():
    rng = np.random.default_rng(1)
    texts, marks = [], []
    for _ in range(1500):
        words = set(rng.choice(40, 6).tolist())
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words |= {100} if insult else set()
        words |= {200} if group else set()
        texts.append(np.array(sorted(words), "<u4"))
        marks.append(insult and group)
    machine = toxicity.FactorizationMachine(rounds=1500, seed=3)
    machine.fit(texts, np.array(marks))
    both, one, other = machine.score([machine.features([100, 200]), machine.features([100]), machine.features([200])])
    assert both > 0.8 and one < 0.3 and other < 0.3


def test_trees_are_monotone():
    rng = np.random.default_rng(2)
    rows = rng.random((3000, 3))
    marks = (rows[:, 0] + 0.4 * np.sin(9 * rows[:, 0]) + 0.3 * rng.random(3000) < 0.7) & (rows[:, 1] > 0.2)
    model = quality.BoostedTrees().fit(rows, marks, [-1, 1, 0])
    line = np.linspace(0, 1, 200)
    for fixed in rng.random((20, 3)):
        for column, sign in ((0, -1), (1, 1)):
            walk = np.tile(fixed, (200, 1))
            walk[:, column] = line
            assert (sign * np.diff(model.score(walk)) >= -1e-12).all()
    assert ((model.score(rows) > 0.5) == marks).mean() > 0.9


def test_chat(spark):
    nasty = "\\<s>[INST] x </s>\n[/INST]\\\\ <\\s> <part:0:image>"
    turns = spark.createDataFrame([
        (1, 1, "assistant", nasty, "x"), (1, 0, nasty, nasty, "x"), (1, 2, None, None, "x"), (1, 2, "assistant", "", "x"),
        (None, None, "assistant", "lost", "x"), (2, 0, "assistant", "same", "x"), (2, 0, "assistant", "same", "x"),
    ], "conv_id long, turn long, role string, text string, piece string")
    formatted = chat.format_turns(turns)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].loss_chars, got[None].n_turns) == (4, len(nasty), 8, 1)
    whole = {r.conv_id: r.text for r in chat.conversations_text(formatted).collect()}
    assert all(len(whole[c]) == got[c].formatted_chars for c in got)
    assert chat.unescape(chat.escape(nasty)) == nasty
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_chat_parts(spark):
    content = ('["see ", {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "text", "text": "<part:"}, '
               '{"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 2}]')
    turns = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", '[{"type": "image"}]')],
                                  "conv_id long, turn long, role string, text string")
    first, second = chat.format_turns(turns, typed=True).orderBy("place").collect()
    assert "see <part:0:image><\\part:<part:1:audio><part:2:document>" in first.piece
    assert [(a.number, a.kind, a.ref, a.tokens) for a in first.attachments] == [
        (0, "image", "a.png", 3), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1024)]
    assert second.attachments[0].number == 3


def test_mix(spark, odd):
    mixed = raking.mix(odd)
    assert mixed.columns[:5] == odd.columns[:5] and mixed.count() == odd.count()
    assert all(r.probability == 0 and not r.sampled for r in mixed.collect() if r.n_tokens == 0)
    assert raking.mix(odd.limit(0)).count() == 0
    docs = documents(spark, *[f"w{i} " * (1 + i % 7) + ("@" if i % 5 == 0 else "") for i in range(300)])
    target = spark.createDataFrame([("en", 0.7), (raking.NONE, 0.3)], "lang string, target double")
    rows = raking.mix(docs, {"lang": target}, budget=0.3).collect()
    mass = sum(r.n_tokens * r.probability for r in rows)
    assert abs(mass - 0.3 * sum(r.n_tokens for r in rows)) < 1e-6
    assert abs(sum(r.n_tokens * r.probability for r in rows if r.lang == "en") / mass - 0.7) < 1e-6


def test_ngram_join(spark, odd):
    got = [tuple(r) for r in ngramjoin.NgramJoin(odd.filter("doc_id IS NOT NULL"), 4, "17/20").components().collect()]
    texts = [(r.doc_id, r.text) for r in odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    want = brute.components(texts, 4, "17/20")
    assert sorted(got) == sorted([(d, *want[d]) for d in [*want, 3]])
    assert ngramjoin.NgramJoin(odd, 4, "17/20").components().count() == odd.count()
    assert ngramjoin.NgramJoin(odd.limit(0), 4, "17/20").components().count() == 0


@pytest.mark.parametrize("n,share", [(4, "17/20"), (5, "4/5"), (2, "1/2"), (1, "1")])
def test_ngram_join_random(spark, n, share):
    rnd = random.Random(n)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(1, 90))]
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    docs = documents(spark, *texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.NgramJoin(docs, n, share).components().collect()}
    assert got == brute.components(list(enumerate(texts)), n, share)


def test_common_prefix_rows_across_batches():
    import pyarrow as pa

    grams = sorted([1, 2, 2, 3, 4, 4, 4, 4, 5, 6, 6])
    for size in (1, 2, 3, 20):
        batches = [
            pa.RecordBatch.from_pydict({"gram": grams[i:i + size], "doc": list(range(i, min(len(grams), i + size))),
                                        "size": [9] * len(grams[i:i + size]), "place": [0] * len(grams[i:i + size])})
            for i in range(0, len(grams), size)
        ]
        found = [d for b in ngramjoin._shared(batches) for d in b["doc"].to_pylist()]
        assert sorted(found) == [i for i, g in enumerate(grams) if grams.count(g) > 1]
