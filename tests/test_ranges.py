"""Aggregates over long and dense frames, known neighbours and exact quantiles, against plain windows."""

import datetime
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlake.operators import quantiles, ranges, windows
from gridlake.operators.rowindex import ROW

ALL = {
    "n": ("count", None), "known": ("count", "v"), "total": ("sum", "v"), "mean": ("avg", "v"), "low": ("min", "v"), "high": ("max", "v"),
    "whole": ("sum", "i"), "first": ("min", "i"), "last": ("max", "i"),
}


def near(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    return x == y and type(x) is type(y)


def same(a, b, *key):
    rows = [sorted((tuple(r) for r in d.select(*key, *ALL).collect()), key=lambda r: repr(r[:len(key)])) for d in (a, b)]
    assert len(rows[0]) == len(rows[1])
    for x, y in zip(*rows):
        assert all(map(near, x, y)), (x, y)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(11)
    rows = []
    for i in range(700):
        key = None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 4}"
        value = None if i % 6 == 0 else float("nan") if i % 97 == 0 else rng.uniform(-5, 5)
        at = None if i % 41 == 0 else datetime.datetime(1969, 12, 31, 23, 50) + datetime.timedelta(microseconds=rng.choice([0, 1, 10 ** 6]) * rng.randrange(900))
        rows.append((key, at, i, value))
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, i long, v double").cache()


@pytest.mark.parametrize("bits", [1, 2, 3, 5, 14])
def test_ranges_of_positions(spark, bits):
    """Every range of a small table: both ends, single places, empty and null ranges."""
    rng = random.Random(bits)
    n = 37
    rows = [(i, i * 3 - 40, None if i % 5 == 0 else rng.uniform(-1, 1), *sorted((rng.randrange(n), rng.randrange(n)))) for i in range(n)]
    rows[3] = (*rows[3][:3], 9, 4)
    rows[4] = (*rows[4][:3], None, 4)
    rows[5], rows[6] = (*rows[5][:3], 0, n - 1), (*rows[6][:3], 15, 16)
    df = spark.createDataFrame(rows, f"{ROW} long, i long, v double, lo long, hi long")
    got = {r[ROW]: r for r in ranges.range_totals(df, ALL, "lo", "hi", bits).collect()}
    assert set(got) == set(range(n))
    for at, _, _, lo, hi in rows:
        inside = rows[lo:hi + 1] if lo is not None and lo <= hi else []
        values = [v for _, _, v, *_ in inside if v is not None]
        r = got[at]
        assert (r["n"], r["known"]) == (len(inside), len(values))
        assert near(r["total"], float(math.fsum(values)) if values else None) and near(r["mean"], math.fsum(values) / len(values) if values else None)
        assert (r["low"], r["high"]) == ((min(values), max(values)) if values else (None, None))
        whole = [i for _, i, *_ in inside]
        assert (r["whole"], r["first"], r["last"]) == ((sum(whole), min(whole), max(whole)) if whole else (None, None, None))


@pytest.mark.parametrize("before,after", [(120, 0), (0, 300), (90, 90), (5000, 5000), (10, -4)])
def test_rows_frames_of_many_chunks(points, before, after):
    w = Window.partitionBy("k").orderBy("i").rowsBetween(-before, after)
    plain = points.withColumns({n: ranges.over(spec, w) for n, spec in ALL.items()}) 
    framed = windows.rows_frame(points.select("k", "i", "v", "ts"), ["k"], ["i"], before, after, ALL, max_group=5, chunk_rows=4)
    same(framed, plain, "k", "i")


def test_functions_of_a_window_need_a_short_frame(points):
    with pytest.raises(ValueError):
        windows.rows_frame(points, ["k"], ["i"], 100, 0, {"s": lambda w: F.sum("v").over(w)}, max_group=5, chunk_rows=9)


@pytest.mark.parametrize("seconds", [1, 60, 10_000])
def test_dense_range_frames(points, seconds):
    w = Window.partitionBy("k").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    plain = points.withColumns({n: ranges.over(spec, w) for n, spec in ALL.items()})
    rows = points.select("k", "ts", "i", "v")
    same(windows.dense_range_frame(rows, ["k"], "ts", seconds, ALL, bits=3, chunk_rows=50).select("k", "i", *ALL), plain, "k", "i")
    same(windows.range_frame(rows, ["k"], "ts", seconds, ALL, max_bucket=2).select("k", "i", *ALL), plain, "k", "i")
    same(windows.range_frame(rows, ["k"], "ts", seconds, ALL).select("k", "i", *ALL), plain, "k", "i")


def test_all_rows_in_one_second_spread_over_tasks(spark):
    """Half a million rows of one key within a second: no task gets more than a chunk of them."""
    df = spark.range(500_000).select(
        F.lit("one").alias("k"), (F.col("id") % 7).alias("i"), (F.col("id") % 11).cast("double").alias("v"), "id",
        F.timestamp_micros(F.lit(1_000_000_000) + F.col("id")).cast("timestamp_ntz").alias("ts"),
    )
    got = windows.range_frame(df, ["k"], "ts", 1, {"n": ("count", None), "whole": ("sum", "i"), "high": ("max", "v")})
    rows = {r["id"]: (r["n"], r["whole"], r["high"]) for r in got.filter("id % 99991 = 5 OR id < 3").collect()}
    for at, found in rows.items():
        assert found == (at + 1, sum(i % 7 for i in range(at + 1)), float(max(i % 11 for i in range(min(at + 1, 11)))))


@pytest.mark.parametrize("limits", [{}, {"max_group": 5, "chunk_rows": 7}])
def test_known_neighbours(points, limits):
    gaps = points.select("k", "i", F.when((F.col("i") < 80) | (F.col("i") > 600) & (F.col("i") % 9 == 0), F.col("i")).alias("v"))
    got = windows.known_neighbours(gaps, ["k"], ["i"], "v", {"b": -1, "b3": -3, "a": 1, "a2": 2}, **limits).collect()
    rows = sorted((tuple(r) for r in gaps.collect()), key=lambda r: r[1])
    assert len(got) == len(rows)
    for r in got:
        before = [v for k, i, v in rows if k == r["k"] and i < r["i"] and v is not None]
        behind = [v for k, i, v in rows if k == r["k"] and i > r["i"] and v is not None]
        pick = lambda x, n: x[n] if -len(x) <= n < len(x) else None
        assert (r["b"], r["b3"], r["a"], r["a2"]) == (pick(before, -1), pick(before, -3), pick(behind, 0), pick(behind, 1))


POINTS = {"q0": 0.0, "q25": 0.25, "mid": 0.5, "q99": 0.99, "q100": 1.0}


@pytest.mark.parametrize("kind", ["double", "float", "long", "int", "decimal(12,3)"])
def test_quantiles_equal_sorted_values(spark, kind):
    rng = random.Random(2)
    whole = kind in ("long", "int")
    values = [rng.choice([0, -1, 7, 7, 10 ** 8, -(10 ** 8), rng.randrange(-1000, 1000)]) / (1 if whole else 8) for _ in range(400)]
    values += [5e8, -5e8] if kind == "int" else [2.0 ** 62, -(2.0 ** 62)] if kind == "long" else [0.0, -0.0]
    rows = [(None if i % 9 == 0 else f"g{i % 3}", None if i % 13 == 0 else float(v)) for i, v in enumerate(values)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").select("g", F.col("v").cast(kind).alias("v"))
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, ["g"], "v", POINTS).collect()}
    groups = {}
    for g, v in df.collect():
        if v is not None:
            groups.setdefault(g, []).append(v if whole else float(v))
    assert set(got) == set(groups)
    for g, known in groups.items():
        known.sort()
        for name, q in POINTS.items():
            at = q * (len(known) - 1)
            low, share = int(at), at - int(at)
            want = float(known[low]) * (1 - share) + (float(known[min(low + 1, len(known) - 1)]) * share if share else 0.0)
            assert math.isclose(got[g][name], want, rel_tol=1e-12, abs_tol=1e-12)


def test_quantiles_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v,) for v in (nan, inf, -inf, 1e-320, -1e-320, None)], "v double")
    r = quantiles.exact_quantiles(df, [], "v", {"q0": 0.0, "q25": 0.25, "mid": 0.5, "q75": 0.75, "q100": 1.0}).first()
    assert (r["q0"], r["q25"], r["mid"], r["q75"]) == (-inf, -1e-320, 1e-320, inf) and math.isnan(r["q100"])
    assert quantiles.exact_quantiles(df.limit(0), ["v"], "v", {"mid": 0.5}).count() == 0
    with pytest.raises(TypeError):
        quantiles.exact_quantiles(df.select(F.lit("x").alias("v")), [], "v", {"mid": 0.5})


def test_quantiles_of_one_large_group_spread(spark):
    df = spark.range(300_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 300_007).cast("double").alias("v"))
    r = quantiles.exact_quantiles(df, ["g"], "v", {"mid": 0.5, "q9": 0.9}).first()
    known = sorted(i * 7919 % 300_007 for i in range(300_000))
    assert math.isclose(r["mid"], (known[149_999] + known[150_000]) / 2) and math.isclose(r["q9"], known[269_999] + 0.1 * (known[270_000] - known[269_999]), rel_tol=1e-9)
