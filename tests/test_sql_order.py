"""The order of an SQL text holds in every way to look at its result."""

import pytest
from pyspark.sql import functions as F

from gridlake.frame import Frame
from gridlake.operators.rowindex import ROW


@pytest.fixture()
def numbers(spark):
    df = spark.range(0, 300, 1, 6).select("id", (F.col("id") % 7).alias("m"), F.when(F.col("id") % 10 > 0, F.col("id")).alias("v"), F.col("id").alias(ROW))
    return Frame(df, dense=True)


ORDERS = [
    ("SELECT id, m, v FROM dataframe WHERE id <= 90 ORDER BY id DESC", lambda r: -r[0]),
    ("SELECT id, m, v FROM dataframe WHERE id <= 90 ORDER BY v DESC NULLS FIRST, id", lambda r: (r[2] is not None, -(r[2] or 0), r[0])),
    ("WITH t AS (SELECT * FROM dataframe WHERE id <= 90) SELECT id, m, v FROM t ORDER BY m, id DESC", lambda r: (r[1], -r[0])),
]


@pytest.mark.parametrize("text,key", ORDERS)
def test_all_views_agree(numbers, text, key):
    want = sorted(((i, i % 7, i if i % 10 else None) for i in range(91)), key=key)
    found = numbers.sql(text)
    assert [tuple(r) for r in found.ordered.collect()] == want
    assert found.column("id") == [r[0] for r in want]
    assert [found.row(i)["id"] for i in (0, 5, 90)] == [want[i][0] for i in (0, 5, 90)]
    assert [tuple(r) for r in found.slice(5, 3).ordered.collect()] == want[5:8]
    assert [tuple(r) for r in found.slice(80).ordered.collect()] == want[80:]
    assert [tuple(r) for r in found.limit(4).ordered.collect()] == want[:4]
    assert found.select("id").column("id") == [r[0] for r in want]
    lines = str(found).splitlines()
    assert [int(x.split()[1]) for x in lines[1:6]] == [r[0] for r in want[:5]]
    assert [int(x.split()[1]) for x in lines[7:12]] == [r[0] for r in want[-5:]]


def test_limit_and_offset_keep_the_order(numbers):
    found = numbers.sql("SELECT id FROM dataframe ORDER BY id DESC LIMIT 20 OFFSET 10")
    assert found.column("id") == list(range(289, 269, -1)) and found.row(0) == {"id": 289}


def test_ties_have_one_place(numbers):
    found = numbers.sql("SELECT m, id FROM dataframe ORDER BY m")
    rows = [tuple(r) for r in found.ordered.collect()]
    assert [r[0] for r in rows] == sorted(i % 7 for i in range(300))
    assert [tuple(r) for r in found.slice(17, 40).ordered.collect()] == rows[17:57] and found.row(100)["id"] == rows[100][1]


def test_results_without_order_are_sorted_by_value(numbers):
    found = numbers.sql("SELECT m, count(*) AS n FROM (SELECT * FROM dataframe ORDER BY id) GROUP BY m")
    assert found.indexed().column("m") == list(range(7))


def test_the_users_own_view_stays(spark, numbers):
    spark.range(3).createOrReplaceTempView("dataframe")
    try:
        first = numbers.sql("SELECT count(*) AS n FROM dataframe")
        assert first.row(0) == {"n": 300} and spark.table("dataframe").count() == 3
        assert first.sql("SELECT n + 1 AS n FROM dataframe").row(0) == {"n": 301}
    finally:
        spark.catalog.dropTempView("dataframe")
    numbers.sql("SELECT 1 AS x FROM dataframe")
    assert not any(t.name == "dataframe" for t in spark.catalog.listTables())


def test_column_sets(numbers):
    assert numbers.has_columns("v", "id") and numbers.has_columns() and not numbers.has_columns("id", "w") and not numbers.has_columns(ROW)
