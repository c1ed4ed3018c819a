"""Slices open the files that hold their rows, and give the rows that a full scan gives."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridlake.operators import profile
from gridlake.operators.rowindex import ROW
from gridlake.sources import tables

SIZES = [3, 0, 7, 1, 20, 5, 5, 9, 0, 4] * 10  # 540 rows


@pytest.fixture(scope="module")
def parquet(tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts") / "data with blank"
    folder.mkdir()
    at = 0
    for i, n in enumerate(SIZES):
        pq.write_table(pa.table({"v": list(range(at, at + n)), "w": [f"x{k % 7}" for k in range(at, at + n)]},
                                schema=pa.schema([("v", pa.int64()), ("w", pa.string())])), str(folder / f"part-{i:05d}.parquet"))
        at += n
    return str(folder)


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    folder = tmp_path_factory.mktemp("lines")
    at = 0
    for i, n in enumerate(SIZES[:30]):
        with open(folder / f"part-{i:05d}.csv", "w") as sink:
            sink.write("v,w\n" + "".join(f"{k},{'' if k % 5 == 0 else f'y{k}'}\n" for k in range(at, at + n)))
        at += n
    return str(folder)


def values(frame):
    return [r["v"] for r in frame.df.orderBy(ROW).select("v", ROW).collect()]


def opened(frame):
    return sorted(os.path.basename(f) for f in frame.df.inputFiles())


def test_limit_lists_one_file_of_a_thousand(spark, tmp_path):
    for i in range(1000):
        pq.write_table(pa.table({"v": list(range(20 * i, 20 * i + 20))}), str(tmp_path / f"{i:04d}.parquet"))
    frame = tables.read_parquet(spark, str(tmp_path))
    first = frame.limit(10)
    assert opened(first) == ["0000.parquet"] and values(first) == list(range(10))
    plan = first.df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "InMemoryFileIndex(1 paths)" in plan or "0000.parquet]" in plan
    assert frame.row(4567) == {"v": 4567}
    assert len(frame.scan.counts) < 520  # no footers past the ones that lead there


@pytest.mark.parametrize("offset,length", [(0, 2), (0, 11), (3, 7), (10, 1), (35, 6), (100, 200), (538, 10), (540, 5), (700, 3), (0, 540), (0, 0), (12, 0)])
def test_slices_equal_a_full_scan(spark, parquet, offset, length):
    frame = tables.read_parquet(spark, parquet)
    part = frame.slice(offset, length)
    assert values(part) == list(range(540))[offset:offset + length]
    assert [r[ROW] for r in part.df.select(ROW).orderBy(ROW).collect()] == list(range(len(values(part))))
    if length and length < 200:
        assert len(opened(part)) <= 10
    rest = frame.slice(offset)
    assert values(rest) == list(range(offset, 540))


def test_steps_are_kept(spark, parquet):
    frame = tables.read_parquet(spark, parquet)
    part = frame.astype({"v": "string"}).drop("w").slice(8, 4)
    assert [tuple(r) for r in part.ordered.collect()] == [(str(i),) for i in range(8, 12)]
    assert len(opened(part)) <= 3
    assert frame.select("w").row(30) == {"w": "x2"}
    # a window over all rows is not computed over some
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    totals = frame.assign(n=F.count(F.lit(1)).over(Window.partitionBy())).slice(0, 2)
    assert [r["n"] for r in totals.ordered.collect()] == [540, 540]


def test_filtered_limit_opens_leading_files(spark, parquet):
    frame = tables.read_parquet(spark, parquet)
    part = frame.filter("v % 10 == 3").select("v").slice(1, 2)
    assert [r["v"] for r in part.ordered.collect()] == [13, 23] and len(opened(part)) <= 16
    rare = frame.filter("v == 539").limit(1)
    assert [r["v"] for r in rare.ordered.collect()] == [539]


@pytest.mark.parametrize("offset,length", [(0, 1), (0, 4), (2, 20), (60, 30), (150, 40), (161, 5)])
def test_text_scans(spark, csv, offset, length):
    frame = tables.read_csv(spark, csv, "v BIGINT, w STRING")
    want = [(k, "" if k % 5 == 0 else f"y{k}") for k in range(162)]
    assert [tuple(r) for r in frame.slice(offset, length).ordered.collect()] == want[offset:offset + length]
    assert [tuple(r) for r in frame.slice(offset).ordered.collect()] == want[offset:]
    if offset + length < 20:
        assert len(opened(frame.slice(offset, length))) <= 5


def test_one_large_text_file_is_read_at_its_start(spark, tmp_path):
    path = tmp_path / "one.csv"
    with open(path, "w") as sink:
        sink.write("v,w\n" + "".join(f"{k},z\n" for k in range(200_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        frame = tables.read_csv(spark, str(path), "v BIGINT, w STRING")
        assert values(frame.limit(5)) == [0, 1, 2, 3, 4]
        assert values(frame.slice(9990, 10)) == list(range(9990, 10_000))
        assert values(frame.slice(150_000, 3)) == [150_000, 150_001, 150_002]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_preview_opens_both_ends(spark, parquet):
    frame = tables.read_parquet(spark, parquet)
    rows = profile.preview_rows(frame, 2, 3)
    assert sorted((r[ROW], r["v"], r["_total"]) for r in rows.collect()) == [(i, i, 540) for i in (0, 1, 537, 538, 539)]
    assert len(rows.inputFiles()) <= 4
    assert sorted(r["v"] for r in profile.preview_rows(frame.slice(0, 4), 3, 3).collect()) == [0, 1, 2, 3]
    assert "[540 rows x 2 columns]" in str(frame)


def test_partitioned_folder_keeps_its_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.range(40).withColumn("g", F.col("id") % 4).repartition(4, "g").sortWithinPartitions("id").write.partitionBy("g").parquet(str(tmp_path / "t"))
    frame = tables.read_parquet(spark, str(tmp_path / "t"))
    whole = [tuple(r) for r in frame.ordered.collect()]
    assert [tuple(r) for r in frame.slice(12, 15).ordered.collect()] == whole[12:27]
    assert frame.slice(12, 3).column_names == ["id", "g"]
