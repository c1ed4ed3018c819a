"""Samples of a fixed size, and the latest rows of a lateral join."""

import random

import pytest
from pyspark.sql import functions as F

from gridlake.operators import joins, sampling


@pytest.mark.parametrize("k", [0, 1, 5, 40, 2000])
def test_exact_sizes_whatever_the_partitioning(spark, k):
    df = spark.range(3000).select("id", F.when(F.col("id") % 9 == 0, None).when(F.col("id") < 2000, "hot").otherwise((F.col("id") % 3).cast("string")).alias("s"))
    sizes = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    taken = []
    for rows in (df.repartition(7), df.coalesce(1)):
        got = sampling.sample_rows(rows, k, ["id"], ["s"])
        assert got.columns == ["id", "s"]
        taken.append({r["id"] for r in got.collect()})
        found = {r["s"]: r["count"] for r in got.groupBy("s").count().collect()}
        assert found == {s: min(k, n) for s, n in sizes.items() if k}
    assert taken[0] == taken[1]
    assert sampling.sample_rows(df, k, ["id"]).count() == min(k, 3000)


def test_seeds_and_repeated_rows(spark):
    df = spark.range(500).select((F.col("id") % 100).alias("id"))
    a, b = ({r["id"] for r in sampling.sample_rows(df.distinct(), 30, ["id"], seed=s).collect()} for s in "xy")
    assert len(a) == len(b) == 30 and a != b
    assert sampling.sample_rows(df, 12, ["id"]).count() == 12
    assert sampling.sample_rows(df.limit(0), 12, ["id"]).count() == 0
    assert 80 < sampling.sample_share(spark.range(1000), 0.1, ["id"]).count() < 120


@pytest.mark.parametrize("n", [1, 3])
def test_lateral_latest(spark, n):
    rng = random.Random(n)
    outer = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(50)]), i) for i in range(150)]
    inner = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *range(60)]), i) for i in range(200)]
    got = joins.lateral_latest(
        spark.createDataFrame(outer, "k string, t int, i int"), spark.createDataFrame(inner, "k string, u int, j int"),
        ["k"], "t", "u", "j", n, ["u", "j"], chunk_rows=11,
    )
    want = []
    for k, t, i in outer:
        fits = sorted(((u, j) for key, u, j in inner if None not in (k, t, u) and key == k and u <= t), reverse=True)[:n]
        want += [(k, t, i, nth + 1, u, j) for nth, (u, j) in enumerate(fits)]
    assert got.columns == ["k", "t", "i", "nth", "u", "j"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
