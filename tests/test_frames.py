"""Frames of partial results in chunks and buckets, against plain windows; and what is not done for them."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlake.operators import ranges, windows
from test_ranges import ALL, same


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        key = None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 4}"
        value = None if i % 6 == 0 else float("nan") if i % 97 == 0 else rng.uniform(-5, 5)
        at = None if i % 41 == 0 else datetime.datetime(1969, 12, 31, 23, 50) + datetime.timedelta(microseconds=rng.choice([0, 1, 10 ** 6]) * rng.randrange(900))
        rows.append((key, at, i, value, f"text {i}"))
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, i long, v double, note string").cache()


def by_time(points, seconds):
    w = Window.partitionBy("k").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return points.withColumns({n: ranges.over(spec, w) for n, spec in ALL.items()})


@pytest.mark.parametrize("cuts", [1, 2, 64])
@pytest.mark.parametrize("seconds", [1, 60, 10_000])
def test_bucketed_range_frames(points, seconds, cuts):
    rows = points.select("k", "ts", "i", "v")
    got = windows._bucketed_range_frame(rows, ["k"], "ts", seconds, ALL, cuts)
    assert got.columns == [*rows.columns, *ALL]
    same(got.select("k", "i", *ALL), by_time(points, seconds), "k", "i")


def test_range_frames_choose_narrow_buckets(points, monkeypatch):
    chosen = []
    real = windows._bucketed_range_frame
    monkeypatch.setattr(windows, "_bucketed_range_frame", lambda *a: chosen.append(a[-1]) or real(*a))
    monkeypatch.setattr(windows, "CHUNK_ROWS", 500)
    monkeypatch.setattr(windows, "THIN_ROWS", 0)
    got = windows.range_frame(points.select("k", "ts", "i", "v"), ["k"], "ts", 600, ALL, max_bucket=2)
    same(got.select("k", "i", *ALL), by_time(points, 600), "k", "i")
    assert chosen
    # columns of any width stay out of Python
    got = windows.range_frame(points, ["k"], "ts", 600, ALL, max_bucket=2)
    same(got.select("k", "i", *ALL), by_time(points, 600), "k", "i")
    assert len(chosen) == 1 and got.columns == [*points.columns, *ALL]


def test_dense_times_are_not_added_up_row_by_row(spark):
    """20,000 rows of one key within a frame: 200 million additions in a plain window."""
    df = spark.range(20_000).select(
        F.lit("one").alias("k"), (F.col("id") % 7).alias("i"), "id",
        F.timestamp_micros(F.lit(1_000_000_000) + F.col("id") * 100).cast("timestamp_ntz").alias("ts"),
    )
    got = windows.range_frame(df, ["k"], "ts", 3600, {"n": ("count", None), "whole": ("sum", "i")})
    assert "Window [" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["n"], r["whole"]) for r in got.filter("id IN (0, 9, 19999)").sort("id").collect()] == [
        (at + 1, sum(i % 7 for i in range(at + 1))) for at in (0, 9, 19_999)
    ]


@pytest.mark.parametrize("before,after", [(120, 0), (0, 130), (90, 90), (30, -4), (-2, 40)])
@pytest.mark.parametrize("wide", [False, True])
def test_long_rows_frames_stay_in_their_chunk(points, monkeypatch, before, after, wide):
    """One shuffle of the rows by chunk, no questions about positions."""
    monkeypatch.setattr(windows, "LONG_FRAME", 20)
    monkeypatch.setattr(ranges, "range_totals", None)
    w = Window.partitionBy("k").orderBy("i").rowsBetween(-before, after)
    plain = points.withColumns({n: ranges.over(spec, w) for n, spec in ALL.items()})
    rows = points if wide else points.select("k", "i", "v", "ts")
    framed = windows.rows_frame(rows, ["k"], ["i"], before, after, ALL, chunk_rows=131)
    assert framed.columns == [*rows.columns, *ALL]
    same(framed, plain, "k", "i")


def test_sums_beyond_64_bits_raise(spark):
    big = 1 << 62
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([big, -big, big, 5, big])], "k int, i long, v long")
    ordered = ranges._between(ranges._leaf(_column(df), "sum"), *_ends([(0, 2), (1, 4), (3, 3)]), "sum", True)
    assert ranges._stored(ordered, True).to_pylist() == [big, big + 5, 5]
    over = ranges._between(ranges._leaf(_column(df), "sum"), *_ends([(2, 4)]), "sum", True)
    with pytest.raises(OverflowError):
        ranges._stored(over, True)


def _column(df):
    import pyarrow as pa

    return pa.chunked_array([pa.array([r["v"] for r in df.sort("i").collect()], pa.int64())])


def _ends(pairs):
    import numpy as np

    return [np.array(x, dtype=np.int64) for x in zip(*pairs)]
