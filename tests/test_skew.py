"""Chunked forms of ordered operators give what plain windows give, hot groups included."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridlake.operators import joins, windows
from gridlake.operators.rowindex import ROW, densify, running_offsets, scan_index, sort_index


@pytest.fixture(scope="module")
def points(spark):
    """A third of the rows under one key; ties and nulls in the order and value columns."""
    rng = random.Random(7)
    rows = []
    for i in range(300):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        rows.append((key, rng.randrange(25), i, None if rng.random() < 0.3 else rng.randrange(100)))
    return spark.createDataFrame(rows, "k string, t int, i int, v int").cache()


def same(a, b):
    names = sorted(a.columns)
    assert sorted(b.columns) == names
    got, want = (Counter(tuple(r) for r in df.select(names).collect()) for df in (a, b))
    assert got == want


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def test_ranking(points):
    args = (points, ["k"], ["t", "i"], ["t"])
    plain = windows.ranking(*args, tiles=7)
    cut = windows.ranking(*args, tiles=7, max_group=10, chunk_rows=37)
    same(rounded(plain, "percent_rank", "cume_dist"), rounded(cut, "percent_rank", "cume_dist"))


def test_neighbours(points):
    steps = {"before": -1, "after2": 2}
    args = (points, ["k"], ["t", "i"], "v", steps)
    same(windows.neighbours(*args), windows.neighbours(*args, max_group=10, chunk_rows=37))


def test_carry_last(points):
    args = (points, ["k"], ["t", "i"], "v", "known")
    same(windows.carry_last(*args), windows.carry_last(*args, max_group=10, chunk_rows=11))


def test_running_sums(points):
    args = (points, ["k"], ["t", "i"], {"total": F.coalesce("v", F.lit(0)), "n": F.lit(1)})
    same(windows.running_sums(*args), windows.running_sums(*args, max_group=10, chunk_rows=11))


@pytest.mark.parametrize("before, after", [(3, 0), (0, 4), (5, 5)])
def test_rows_frame(points, before, after):
    aggregates = {"s": lambda w: F.sum("v").over(w), "n": lambda w: F.count(F.lit(1)).over(w)}
    args = (points, ["k"], ["t", "i"], before, after, aggregates)
    same(windows.rows_frame(*args), windows.rows_frame(*args, max_group=10, chunk_rows=5))


def test_groups_frame(points):
    args = (points, ["k"], ["t"], 2, 1, "v")
    same(windows.groups_frame(*args), windows.groups_frame(*args, max_group=2, chunk_rows=6))


def test_range_frame(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else "cold", rng.randrange(5000), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, sec int, v int").withColumn(
        "ts", F.expr("TIMESTAMP_NTZ'1969-12-31 23:30:00' + make_dt_interval(0, 0, 0, sec)")
    )
    got = windows.range_frame(df, ["k"], "ts", 60, {"s": lambda w: F.sum("v").over(w)})
    want = {i: sum(v for kk, t, v in rows if kk == k and sec - 60 <= t <= sec) for k, sec, i in rows}
    assert {r["v"]: r["s"] for r in got.collect()} == want


@pytest.mark.parametrize("limits", [{}, {"max_group": 5, "chunk_rows": 13}])
def test_asof_join(spark, limits):
    rng = random.Random(5)
    left = [("hot" if i % 3 == 0 else f"k{i % 5}", rng.randrange(200), i) for i in range(150)]
    right = [("hot" if i % 3 == 0 else f"k{i % 7}", rng.randrange(200), i) for i in range(90)]
    a = spark.createDataFrame(left, "k string, t int, i int")
    b = spark.createDataFrame(right, "k string, rt int, j int")
    got = joins.asof_join(a, b, ["k"], "t", "rt", ["rt", "j"], **limits)
    for row in got.collect():
        fits = [(t, j) for k, t, j in right if k == row["k"] and t <= row["t"]]
        assert (row["rt"], row["j"]) == (max(fits) if fits else (None, None))
    assert got.count() == 150


def test_containing_interval(spark):
    intervals = [("a", 10 * n, 10 * n + 6, n) for n in range(20)]
    points = [("a", t) for t in range(205)] + [("b", 3)]
    got = joins.containing_interval(
        spark.createDataFrame(points, "k string, t int"),
        spark.createDataFrame(intervals, "k string, lo int, hi int, n int"),
        ["k"], "t", "lo", "hi", ["n"], max_group=4, chunk_rows=9,
    )
    assert sorted((r["t"], r["n"]) for r in got.collect()) == [(t, t // 10) for t in range(200) if t % 10 < 6]


@pytest.mark.parametrize("limits", [{}, {"max_group": 4, "chunk_rows": 9}])
@pytest.mark.parametrize("kind", ["int", "bigint", "double", "timestamp", "timestamp_ntz", "date", "decimal(12,3)", "string"])
def test_overlapping_intervals(spark, kind, limits):
    rng = random.Random(3)
    intervals = [("a", 0, 10, -1), ("a", 1, 3, -2), ("a", 1, 3, -2), (None, 0, 99, -3), ("a", None, 9, -4), ("a", 9, 2, -5)]
    for n in range(60):
        low = rng.randrange(-50, 4000)
        intervals.append((rng.choice("ab"), low, low + rng.choice([0, 1, 2, 15, 16, 17, 300, 5000]), n))
    points = [("a", 5, 0), (None, 5, 1), ("a", None, 2)] + [(rng.choice("aaab"), rng.randrange(-60, 4200), i) for i in range(3, 200)]

    def typed(rows, names, *columns):
        shift = {"string": "lpad(cast({0} + 100 as string), 5, '0')", "date": "date_add(date'2020-01-01', {0})",
                 "timestamp": "timestamp_seconds({0} * 60)",
                 "timestamp_ntz": "cast(timestamp_seconds({0} * 60) as timestamp_ntz)"}.get(kind, f"cast({{0}} as {kind})")
        return spark.createDataFrame(rows, names).withColumns({c: F.expr(shift.format(c)) for c in columns})

    got = joins.containing_interval(
        typed(points, "k string, t int, i int", "t"), typed(intervals, "k string, lo int, hi int, n int", "lo", "hi"),
        ["k"], "t", "lo", "hi", ["n"], **limits,
    )
    assert got.columns == ["k", "t", "i", "lo", "hi", "n"]
    want = Counter(
        (i, n) for k, t, i in points for key, low, high, n in intervals
        if k == key and None not in (k, t, low) and low <= t < high
    )
    assert want[0, -1] == 1 and Counter((r["i"], r["n"]) for r in got.collect()) == want


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_merge_over_hot_keys_of_either_side(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(9)] + [("a", 9), (None, 10), ("l", 11)], "k string, i int")
    right = spark.createDataFrame([("hot", j) for j in range(8)] + [("a", 8), (None, 9), ("r", 10)], "k string, j int")
    got = joins.merge(left, right, "k", how, max_group=3).select("k", "i", "j")
    want = left.join(right, "k", how).select("k", "i", "j")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("limits", [{}, {"max_group": 3, "chunk_rows": 4}])
def test_pairs_of_overlapping_intervals(spark, limits):
    rng = random.Random(8)
    sides = []
    for side in range(2):
        rows = [("a", 0, 10, -1), ("a", 10, 20, -2), ("a", 5, 5, -3), (None, 0, 9, -4), ("a", None, 9, -5), ("a", 0, 10, -1), ("a", 9, 3, -6)]
        for n in range(70):
            low = rng.randrange(0, 300)
            rows.append((rng.choice("aab"), low, low + rng.choice([0, 1, 2, 40, 500]), n))
        sides.append(rows)
    left = spark.createDataFrame(sides[0], "k string, s int, e int, i int")
    right = spark.createDataFrame(sides[1], "k string, rs int, re int, j int")
    got = joins.overlapping_intervals(left, right, ["k"], ("s", "e"), ("rs", "re"), **limits)
    assert got.columns == ["k", "s", "e", "i", "rs", "re", "j"]
    want = Counter(
        (i, j) for k, s, e, i in sides[0] for key, rs, re, j in sides[1]
        if k is not None and k == key and None not in (s, rs) and s < e and rs < re and s < re and rs < e
    )
    assert want[-1, -1] == 4 and Counter((r["i"], r["j"]) for r in got.collect()) == want


def test_intervals_refuse_what_has_no_order(spark):
    one = spark.createDataFrame([("a", 1, 2)], "k string, lo int, hi int")
    for points, names in ((spark.createDataFrame([("a", "x")], "k string, t string"), ("lo", "hi")),
                          (spark.createDataFrame([("a", 1)], "k string, lo int"), ("lo", "hi"))):
        at = points.columns[1]
        with pytest.raises((TypeError, ValueError)):
            joins.containing_interval(points, one, ["k"], at, *names, [])
    with pytest.raises(ValueError):
        joins.overlapping_intervals(one, one, ["k"], ("lo", "hi"), ("lo", "hi"))
    mixed = joins.containing_interval(spark.createDataFrame([("a", 1.5)], "k string, t double"), one, ["k"], "t", "lo", "hi", [])
    assert [tuple(r) for r in mixed.collect()] == [("a", 1.5, 1, 2)]


def test_range_aggregate(spark):
    rng = random.Random(11)
    probes = [(i, rng.randrange(50)) for i in range(60)]
    points = [(rng.randrange(50), rng.randrange(9)) for _ in range(140)]
    got = joins.range_aggregate(
        spark.createDataFrame(probes, "i int, at int"), spark.createDataFrame(points, "p int, w int"),
        "at", "p", F.col("w"), chunk_rows=17,
    )
    want = {i: (sum(p <= at for p, _ in points), sum(w for p, w in points if p <= at)) for i, at in probes}
    assert {r["i"]: (r["n_matches"], r["sum_matches"]) for r in got.collect()} == want


def test_sort_index_counts_hot_values(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"), "id")
    got = sort_index(df, [F.col("v"), F.col("id")]).orderBy(ROW).collect()
    want = sorted((0 if i % 3 == 0 else i, i) for i in range(5000))
    assert [(r["v"], r["id"]) for r in got] == want and [r[ROW] for r in got] == list(range(5000))


def test_chunk_sizes_match_the_stream(spark):
    from gridlake.frame import Frame
    from gridlake.streaming import chunks

    df = spark.range(1000).select(F.col("id").alias(ROW), F.col("id").alias("v"))
    frame = Frame(df, dense=True).filter("v % 3 == 0")
    sizes = {r["chunk"]: r["n_rows"] for r in chunks.chunk_sizes(frame, 100).collect()}
    assert sizes == {0: 100, 1: 100, 2: 100, 3: 34}
    assert list(sizes.values()) == [b.num_rows for b in frame.get_stream(100)]
    placed = chunks.with_chunk(frame, 100).groupBy("chunk").count().collect()
    assert {r["chunk"]: r["count"] for r in placed} == sizes


def test_densify_blocks(spark):
    df = spark.range(3000).where("id % 7 IN (1, 2)").select(F.col("id").alias(ROW), F.col("id").alias("v"))
    got = densify(df, block_rows=64).orderBy(ROW).collect()
    assert [r[ROW] for r in got] == list(range(len(got)))
    assert [r["v"] for r in got] == [i for i in range(3000) if i % 7 in (1, 2)]


def test_running_offsets_over_many_blocks(spark):
    sizes = spark.range(500).select(F.col("id").alias("b"), (F.col("id") % 4).alias("n"))
    got = {r["b"]: r["_offset"] for r in running_offsets(sizes, "b", "n", fan=16).collect()}
    assert got == {b: sum(i % 4 for i in range(b)) for b in range(500)}


def test_scan_index_over_files(spark, folder):
    for part in range(3):
        spark.range(part * 100, part * 100 + 70 + part).coalesce(1).write.parquet(f"{folder}/t/p{part}")
    df = spark.read.parquet(*[f"{folder}/t/p{i}" for i in range(3)])
    got = [tuple(r) for r in scan_index(df).orderBy(ROW).collect()]
    want = [i for p in range(3) for i in range(p * 100, p * 100 + 70 + p)]
    assert got == [(v, n) for n, v in enumerate(want)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_merge_over_hot_key(spark, how):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(60)], "k string, a int")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3), (None, 4)], "k string, b int")
    same(joins.merge(left, right, "k", how), joins.merge(left, right, "k", how, max_group=3))


def test_row_numbers(points):
    args = (points, ["k"], ["t", "i"])
    same(windows.row_numbers(*args), windows.row_numbers(*args, max_group=10, chunk_rows=37))


def test_null_keys_match_nothing(spark):
    a = spark.createDataFrame([(None, 5, 1), ("a", None, 2), ("a", 5, 3)], "k string, t int, i int")
    b = spark.createDataFrame([(None, 1, 7), ("a", None, 8), ("a", 4, 9)], "k string, rt int, j int")
    for limits in ({}, {"max_group": 1, "chunk_rows": 2}):
        got = joins.asof_join(a, b, ["k"], "t", "rt", ["j"], **limits).collect()
        assert {r["i"]: r["j"] for r in got} == {1: None, 2: None, 3: 9}
    probes = spark.createDataFrame([(1, 3), (2, None)], "i int, at int")
    points = spark.createDataFrame([(None, 10), (2, 20), (4, 40)], "p int, w int")
    got = joins.range_aggregate(probes, points, "at", "p", F.col("w")).collect()
    assert {r["i"]: (r["n_matches"], r["sum_matches"]) for r in got} == {1: (1, 20.0), 2: (0, 0.0)}
