"""Near copies leave one row, whatever their ids; no pair is verified twice; trainers are bounded by rows."""

import random

import brute
from pyspark.sql import functions as F

from gridlake.llm import ngramjoin, quality, toxicity

SCHEMA = "doc_id long, text string, _row string, c long"


def test_copies_with_equal_ids_and_without_ids(spark):
    text, other = "one two three four five six seven", "quite another text with other words in it"
    rows = [(1, text), (1, text), (2, text), (None, text), (3, other), (None, other + " and so on"), (4, None), (None, ""), (None, ""), (5, "short")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    got = ngramjoin.keep_one(docs, 5, "4/5")
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert kept == sorted([(1, text), (3, other), (None, other + " and so on"), (4, None), (None, ""), (None, ""), (5, "short")], key=repr)
    assert ngramjoin.keep_one(docs.limit(0), 5, "4/5").count() == 0


def test_chains_and_stars_of_near_copies(spark, monkeypatch):
    """A chain whose ends are not alike, a large group of near copies, and who is verified."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    base = [rng.choice(words) for _ in range(60)]
    for _ in range(25):
        base = list(base)
        base[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(base))
    centre = [rng.choice(words) for _ in range(80)]
    for _ in range(40):
        near = list(centre)
        for _ in range(rng.choice([0, 1, 2])):
            near[rng.randrange(80)] = rng.choice(words)
        texts.append(" ".join(near))
    texts += [" ".join(rng.choice(words) for _ in range(50)) for _ in range(20)]
    docs = [(i, t) for i, t in enumerate(texts)]
    seen = []
    whole = ngramjoin.NgramJoin._verify

    def spy(self, pairs):
        seen.extend((r["a"], r["b"]) for r in pairs.collect())
        return whole(self, pairs)

    monkeypatch.setattr(ngramjoin.NgramJoin, "_verify", spy)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.NgramJoin(df, 4, "7/10").components().collect()}
    assert got == brute.components(docs, 4, "7/10")
    assert len(seen) == len(set(seen)) and all(a < b for a, b in seen)


def test_trainers_take_one_row_of_an_id(spark):
    docs = spark.range(600).select(
        (F.col("id") % 2).alias("doc_id"), F.concat(F.lit("some words here "), F.col("id").cast("string")).alias("text")
    )
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    taken = []
    fit = toxicity.FactorizationMachine.fit
    grow = quality.BoostedTrees.fit

    def spy(self, rows, *more):
        taken.append(len(rows))
        return (fit if isinstance(self, toxicity.FactorizationMachine) else grow)(self, rows, *more)

    toxicity.FactorizationMachine.fit = quality.BoostedTrees.fit = spy
    try:
        toxicity.train(docs, labels)
        quality.keep_good(docs, labels)
    finally:
        toxicity.FactorizationMachine.fit, quality.BoostedTrees.fit = fit, grow
    assert len(taken) == 2 and max(taken) <= 2


def test_chance_phrases_make_no_pairs(spark, monkeypatch):
    """Texts that share a phrase by chance leave the join before pairs are made; links are those of all pairs."""
    rng = random.Random(11)
    common = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(4)) for _ in range(40)]
    texts = []
    for i in range(120):
        own = [f"d{i}x{k}" for k in range(60)]
        for _ in range(3):
            own[(at := rng.randrange(50)):at] = rng.choice(common).split()
        texts.append(" ".join(own))
    for i in range(0, 30, 3):
        words = texts[i].split()
        words[rng.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
    # any order gives right links; all n-grams are as rare as each other, as in corpora that outgrow the sketch
    monkeypatch.setattr(ngramjoin, "_slot", lambda g: g.astype("int64") * 0)
    met = []
    whole = ngramjoin.NgramJoin.postings

    def spy(self, heads):
        lists = whole(self, heads)
        met.append(lists.select("doc").distinct().count())
        return lists

    monkeypatch.setattr(ngramjoin.NgramJoin, "postings", spy)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.NgramJoin(df, 4, "17/20").components().collect()}
    assert got == brute.components(list(enumerate(texts)), 4, "17/20")
    assert len(set(c for _, c in got.values())) == 120 and met == [20]


def test_texts_with_more_of_their_own_are_not_compared(spark, monkeypatch):
    """Variants of a text that are like no other leave before all pairs of components; links are those of all pairs."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(30):
        own = list(base)
        for k, at in enumerate(rng.sample(range(4, 196), 14)):
            own[at] = f"d{i}x{k}"
        texts.append(" ".join(own))
    for text in texts[:4]:
        words = text.split()
        words[rng.randrange(200)] = "edit"
        texts.append(" ".join(words))
    # all n-grams are as rare as each other: prefixes do not tell what is a text's own
    monkeypatch.setattr(ngramjoin, "_slot", lambda g: g.astype("int64") * 0)
    met = []
    whole = ngramjoin.NgramJoin._rest

    def spy(self, mixed, parts, tested):
        met.extend(r.doc for r in mixed.select("doc").distinct().collect())
        return whole(self, mixed, parts, tested)

    monkeypatch.setattr(ngramjoin.NgramJoin, "_rest", spy)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.NgramJoin(df, 4, "17/20").components().collect()}
    assert got == brute.components(list(enumerate(texts)), 4, "17/20")
    assert len(set(c for _, c in got.values())) == 30 and len(set(met)) <= 8


def test_variants_that_differ_in_few_words_make_no_pairs(spark, monkeypatch):
    """Variants of a text, mostly made of it but too far from each other, meet by their own n-grams first: no pairs are left."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(40):
        own = list(base)
        for k, at in enumerate(rng.sample(range(4, 196, 5), 6)):
            own[at] = f"d{i}x{k}"
        texts.append(" ".join(own))
    for text in texts[:4]:
        words = text.split()
        words[rng.randrange(200)] = "edit"
        texts.append(" ".join(words))
    monkeypatch.setattr(ngramjoin, "_slot", lambda g: g.astype("int64") * 0)
    met = []
    whole = ngramjoin.NgramJoin._rest

    def spy(self, mixed, parts, tested):
        met.extend(r.doc for r in mixed.select("doc").distinct().collect())
        return whole(self, mixed, parts, tested)

    monkeypatch.setattr(ngramjoin.NgramJoin, "_rest", spy)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.NgramJoin(df, 4, "17/20").components().collect()}
    assert got == brute.components(list(enumerate(texts)), 4, "17/20")
    assert len(set(c for _, c in got.values())) == 40 and len(set(met)) <= 8


def test_pairs_that_are_left_give_all_links(spark, monkeypatch):
    """Without earlier links, what is left after the sieves and the new order still has all of them;
    repeated rows and ids with several texts too."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 70))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    star = ngramjoin.NgramJoin._star

    def none(self, lists, parts):
        links, tested = star(self, lists, parts)
        return links.limit(0), tested.limit(0)

    monkeypatch.setattr(ngramjoin.NgramJoin, "_star", none)
    monkeypatch.setattr(ngramjoin, "ROUNDS", 0)
    rows = list(enumerate(texts))
    for n, share in ((3, "4/5"), (2, "1/2"), (1, "17/20")):
        df = spark.createDataFrame([*rows, *rows[::4]], "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.NgramJoin(df, n, share).components().collect()}
        assert got == brute.components(rows, n, share)
    # an id of two texts links by either of them
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    near = [" ".join([*t[:50], "x", *t[51:]]) for t in (a, b)]
    df = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b)), (2, near[0]), (3, near[1])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngramjoin.NgramJoin(df, 3, "4/5").components().collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_asked_holds_for_all_pairs_of_sizes():
    for share in ("17/20", "4/5", "1/2", "1/3", "1", "99/100"):
        share = ngramjoin.Fraction(share)
        sizes = ngramjoin.np.arange(1, 400)
        got = ngramjoin.asked(sizes, share)
        assert (got >= 1).all() and (got <= ngramjoin.ceil_share(sizes, share)).all() and (got[1:] >= got[:-1]).all()


def test_training_gives_memory_back(spark, monkeypatch):
    """The driver keeps the machine, not what it was trained on."""
    given = []
    monkeypatch.setattr(toxicity, "give_back", lambda: given.append(1))
    docs = spark.createDataFrame([(i, f"some words {i % 2}") for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    assert len(toxicity.train(docs, labels).score([[], []])) == 2
    assert given == [1]
