"""Null, NaN and order rules, and the filter language against pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlake.frame import Frame
from gridlake.functions.expressions import predicate
from gridlake.operators.rowindex import ROW

DDL = f"{ROW} bigint, x double, s string, n bigint, flag boolean"
ROWS = [
    (0, 1.0, "b", 4, True), (1, float("nan"), "a", -3, None), (2, None, None, 0, False), (3, 3.0, "c", 7, True),
]


@pytest.fixture(scope="module")
def frame(spark):
    return Frame(spark.createDataFrame(ROWS, DDL), dense=True)


def ids(frame):
    return [r[0] for r in frame.df.select(ROW).orderBy(ROW).collect()]


@pytest.mark.parametrize("text, kept", [
    ("x != 3", [0, 1, 2]), ("x == 3", [3]), ("~(x == 3)", [0, 1, 2]), ("x.notnull()", [0, 3]), ("x.isna()", [1, 2]),
    ("x > 0", [0, 3]), ("x <= 1", [0]), ("s != 'a'", [0, 2, 3]), ("s.isin(['a', 'c'])", [1, 3]),
    ("s.str.contains('[ab]')", [0, 1]), ("s.str.len() == 1", [0, 1, 3]), ("n // 2 == -2", [1]), ("n % 4 == 1", [1]),
    ("n / 0 > 10", [0, 3]), ("x.between(1, 3)", [0, 3]), ("flag", [0, 3]), ("(x > 0) & ~flag", []),
    ("n ** 2 >= 9", [0, 1, 3]), ("-n > 0", [1]), ("2 < n", [0, 3]), ("n - 1 == x", []), ("n % -4 == -1", [3]),
    ("7 // n == 1", [0, 3]), ("flag == True", [0, 3]), ("(n > 0) ^ (x > 2)", [0]), ("n.abs() == 3", [1]),
])
def test_filter_rules(frame, text, kept):
    assert ids(frame.filter(text)) == kept


@pytest.mark.parametrize("text", ["x > 0 and n > 0", "not x", "0 < x < 5", "x > 1 or flag"])
def test_ambiguous_truth(frame, text):
    with pytest.raises(ValueError, match="truth value"):
        frame.filter(text)


@pytest.mark.parametrize("text", [
    "__import__('os')", "x.__class__", "open('f')", "[c for c in s]", "(lambda: x)()", "x.column", "s.str.encode()",
    "x if flag else n", "x[0] > 1",
])
def test_refused_expressions(frame, text):
    with pytest.raises(ValueError):
        frame.filter(text)


def test_unknown_column(frame):
    with pytest.raises(NameError):
        frame.filter("y > 1")
    with pytest.raises(KeyError):
        frame.select("y")


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    rows=st.lists(
        st.tuples(
            st.one_of(st.none(), st.just(float("nan")), st.floats(-9, 9)),
            st.integers(-20, 20), st.sampled_from(["red", "green", "blue", None]),
        ), min_size=1, max_size=15),
    text=st.sampled_from([
        "(a > 1) | (b <= -2)", "a != 0", "~(a >= b)", "b % 3 == 1", "b // 4 < 0", "a * 2 - b < 5", "a / b > 1",
        "c.isin(['red', 'blue']) & (b > 0)", "c != 'red'", "a.between(-2, 4)", "a.isnull() | (b ** 2 < 10)",
        "~c.isnull() & ~(a < 0)",
    ]),
)
def test_filter_matches_pandas(spark, rows, text):
    pdf = pd.DataFrame({"a": pd.Series([r[0] for r in rows], dtype="float64"),
                        "b": pd.Series([r[1] for r in rows], dtype="int64"),
                        "c": pd.Series([r[2] for r in rows], dtype=object)})
    with np.errstate(all="ignore"):
        mask = eval(text, {}, {c: pdf[c] for c in pdf})
    expected = [i for i, keep in enumerate(mask) if keep]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i bigint, a double, b bigint, c string")
    got = sorted(r[0] for r in df.where(predicate(df, text)).select("i").collect())
    assert got == expected


def test_aggregates_with_gaps(frame):
    assert math.isnan(frame.sum("x")) and math.isnan(frame.mean("x"))
    assert (frame.min("x"), frame.max("x")) == (1.0, 3.0)
    assert frame.sum("flag") == 2
    assert (frame.count("x"), frame.nunique("s")) == (2, 3)
    only_nan = frame.filter("n == -3")
    assert math.isnan(only_nan.max("x")) and math.isnan(only_nan.min("x"))
    empty = frame.filter("n > 100")
    assert empty.sum("x") is None and empty.mean("n") is None and empty.min("s") is None


def test_sort_order(frame):
    assert [r[0] for r in frame.sort("x").ordered.select("n").collect()] == [4, 7, -3, 0]
    assert [r[0] for r in frame.sort("x", "descending").ordered.select("n").collect()] == [7, 4, -3, 0]
    assert [r[0] for r in frame.sort("s", "anything else").ordered.select("s").collect()] == ["c", "b", "a", None]


def test_sort_is_stable(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(30)], f"{ROW} bigint, a int, b int")
    got = Frame(df, dense=True).sort("a").sort("b").indexed().df.orderBy(ROW).collect()
    assert [(r["b"], r["a"]) for r in got] == sorted((i % 2, i % 3) for i in range(30))


def test_slices(spark):
    df = spark.range(1000).select(F.col("id").alias(ROW), (F.col("id") * 2).alias("v"))
    f = Frame(df, dense=True)
    assert [r[0] for r in f.slice(2, 3).ordered.collect()] == [4, 6, 8]
    assert f.slice(999, 10).num_rows == 1 and f.slice(2000, 5).num_rows == 0 and f.slice(990).num_rows == 10
    assert f.limit(5000).num_rows == 1000
    with pytest.raises(IndexError):
        f.slice(-1, 2)
    odd = f.filter("v % 4 == 2")
    assert [r[0] for r in odd.slice(1, 2).ordered.collect()] == [6, 10]
    assert odd.indexed().df.agg(F.min(ROW), F.max(ROW), F.count_distinct(ROW)).first()[:] == (0, 499, 500)
    assert sum(b.num_rows for b in odd.get_stream(64)) == 500
    assert [b.num_rows for b in odd.get_stream(200)] == [200, 200, 100]


def test_access_and_preview(frame):
    assert frame[0]["s"] == "b" and frame["n"] == [4, -3, 0, 7]
    assert frame.shape == (4, 4) and len(frame) == 4 and frame.column_names == ["x", "s", "n", "flag"]
    text = frame.to_string(head_rows=1, tail_rows=1, first_cols=1, last_cols=1)
    assert text.endswith("[4 rows x 4 columns]") and "..." in text and " s" not in text.splitlines()[0]
    with pytest.raises(TypeError):
        frame[1.5]
    with pytest.raises(IndexError):
        frame[10]


def test_verbs(spark, frame):
    assert frame.map("n", lambda v: v + 1).column_names == ["x", "s", "flag", "n"]
    assert frame.map("n", lambda v: v + 1)["n"] == [5, -2, 1, 8]
    assert frame.map("s", lambda v: v is None, "gap", "boolean")["gap"] == [False, False, True, False]
    assert frame.fillna({"x": 0.5})["x"] == [1.0, 0.5, 0.5, 3.0]
    assert frame.dropna(["x"]).num_rows == 2
    assert frame.astype({"s": "int"}, errors="coerce")["s"] == [None] * 4
    assert frame.groupby("flag").aggregate({"n": "sum"}).num_rows == 3
    assert frame.concat(frame.select("n")).num_rows == 8
    assert frame.concat(frame.select("n"))["n"] == [4, -3, 0, 7] * 2
    with pytest.raises(ValueError):
        frame.select("n", "n")
    with pytest.raises(ValueError):
        frame.groupby("flag").aggregate(a=("n", "nothing"))
    nested = frame.sql("SELECT count(*) AS c FROM dataframe WHERE n > 0").sql("SELECT c * 2 AS d FROM dataframe")
    assert nested.data.first()[0] == 4
    kept = frame.collect()
    assert kept.filter("n > 0").num_rows == 2
    joined = frame.append_column("back", frame.sort("n").select("n"))
    assert joined["back"] == [-3, 0, 4, 7]
