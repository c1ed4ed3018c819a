"""Null keys and times, results without a row order, inferred types and many Arrow files."""

import pytest
from pyspark.sql import functions as F

from gridlake.frame import Frame
from gridlake.operators import windows as W
from gridlake.sources.tables import read_arrow


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(i, [None, "a", "b"][i % 3], None if i % 4 == 0 else float(i), i // 5 if i % 7 else None) for i in range(90)]
    return spark.createDataFrame(rows, "i long, k string, v double, t long").repartition(3)


@pytest.mark.parametrize("call", [
    lambda d, m: W.ranking(d, ["k"], ["t", "i"], ["t"], max_group=m, chunk_rows=8),
    lambda d, m: W.row_numbers(d, ["k"], ["i"], max_group=m, chunk_rows=8),
    lambda d, m: W.carry_last(d, ["k"], ["i"], "v", "w", max_group=m, chunk_rows=8),
    lambda d, m: W.running_sums(d, ["k"], ["i"], {"s": F.col("v")}, max_group=m, chunk_rows=8),
    lambda d, m: W.groups_frame(d, ["k"], ["t"], 1, 1, "v", max_group=m, chunk_rows=8),
    lambda d, m: W.neighbours(d, ["k"], ["i"], "v", {"p": -1, "n": 2}, max_group=m, chunk_rows=8),
])
def test_cut_and_plain_windows_agree(gaps, call):
    plain, cut = call(gaps, None), call(gaps, 0)
    assert plain.count() == cut.count() == 90
    columns = [c for c in plain.columns if c != "ntile"]
    near = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in plain.select(*columns).dtypes]
    assert sorted(map(str, plain.select(*near).collect())) == sorted(map(str, cut.select(*near).collect()))


def test_edges_and_times_of_null_groups(spark, gaps):
    found = {r.k: r.nth_value for r in W.edge_values(gaps, ["k"], ["i"], "v").collect()}
    assert found == {None: 3.0, "a": None, "b": 5.0}
    timed = gaps.withColumn("ts", F.when(F.col("i") % 5 != 0, F.timestamp_seconds("i")).cast("timestamp_ntz"))
    framed = W.range_frame(timed, ["k"], "ts", 6, {"n": lambda w: F.count(F.lit(1)).over(w)})
    assert framed.count() == 90
    assert {r.n for r in framed.filter("ts IS NULL AND k = 'a'").collect()} == {6}


def test_results_without_order_print_and_slice(spark):
    frame = Frame(spark.createDataFrame([(i, i % 3) for i in range(30)], "i long, g long"))
    grouped = frame.sql("SELECT g, count(*) AS n FROM dataframe GROUP BY g")
    assert "[3 rows x 2 columns]" in str(grouped)
    assert grouped.slice(1).data.count() == 2
    assert "[3 rows x 2 columns]" in str(frame.group_by("g").aggregate(n=("i", "sum")))


def test_inferred_type_is_held(spark):
    frame = Frame(spark.range(1000).toDF("i"))
    with pytest.raises(Exception, match="pass return_type"):
        frame.map("i", lambda v: v if v < 500 else v + 0.5).data.agg(F.sum("i")).collect()


def test_many_arrow_files_keep_their_order(spark, folder):
    for name in ("x", "y"):
        Frame(spark.range(200).toDF("i").repartitionByRange(20, "i").withColumn("_row", F.col("i"))).write(f"{folder}/{name}.arrow")
    both = read_arrow(spark, f"{folder}/x.arrow").concat(read_arrow(spark, f"{folder}/y.arrow"))
    assert both.column("i") == [*range(200), *range(200)]


def test_profile_counts_nested_values(spark):
    frame = spark.createDataFrame([([1.0, 2.0], ("ab", 3)), (None, None)], "a array<double>, s struct<t: string, n: int>")
    from gridlake.operators.profile import frame_profile

    assert frame_profile(frame).first()["total_bytes"] == 16 + 2 + 4
