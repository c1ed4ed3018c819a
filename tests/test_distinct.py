"""Exact and approximate distinct counts side by side."""

import re

from gridlake.plans.aggregation import sql_approx_distinct


def test_approximate_counts_keep_no_sketch_per_value(spark, folder):
    rows = [("A", 1), ("A", 1), ("A", 2), ("A", None), (None, 7), ("N", None)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    got = sql_approx_distinct(spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"l_partkey[^\]]*\], functions=\[[^\n]*approx_count_distinct", plan)
    assert {(r["l_returnflag"], r["exact"], r["near"]) for r in got.collect()} == {("A", 2, True), (None, 1, True), ("N", 0, True)}
