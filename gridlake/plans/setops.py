"""Row concatenation and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import reshape
from gridlake.operators.rowindex import ROW
from gridlake.plans.inputs import frame, gap_frame, table


def concat_frames(spark, sf_dir):
    """Two frames with different columns, with the position of each row in the result."""
    first = frame(spark, sf_dir, "benchmark").assign(origin=F.lit("benchmark"))
    pages = frame(spark, sf_dir, "pages").select("page_id", "url").assign(origin=F.lit("pages"))
    both = first.concat(pages).indexed()
    return both.df.withColumnRenamed(ROW, "row_no")


def _keys(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return customers, suppliers


def set_union(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.union(b).distinct()


def set_union_all(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.unionAll(b)


def set_intersect(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return reshape.intersect_rows(a, b)


def set_intersect_all(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.intersectAll(b)


def set_except(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return reshape.subtract_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), orders)


def set_except_all(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.exceptAll(b)


def pivot_wide(spark, sf_dir):
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    orders = frame(spark, sf_dir, "orders")
    wide = orders.pivot(["o_orderstatus"], "o_orderpriority", "o_totalprice", priorities, "sum").data
    return wide.select("o_orderstatus", *[F.round(f"`{p}`", 2).alias(f"p{p[0]}") for p in priorities])


def melt_long(spark, sf_dir):
    line = frame(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    return line.melt(["l_orderkey"], ["l_quantity", "l_discount", "l_tax"], "measure", "amount").data


def fillna(spark, sf_dir):
    return gap_frame(spark, sf_dir).fillna({"value": -1.0, "note": "none"}).select("event_id", "value", "note").data


def dropna(spark, sf_dir):
    return gap_frame(spark, sf_dir).dropna(["value", "note"]).select("event_id", "value", "note").data


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"

QUERIES = {
    "concat_frames": (concat_frames, """SELECT item_id, text, 'benchmark' AS origin, NULL::BIGINT AS page_id,
      NULL::VARCHAR AS url, row_number() OVER (ORDER BY item_id) - 1 AS row_no FROM benchmark
      UNION ALL SELECT NULL, NULL, 'pages', page_id, url,
      row_number() OVER (ORDER BY page_id) - 1 + (SELECT count(*) FROM benchmark) FROM pages"""),
    "set_union": (set_union, f"{_A} UNION {_B}"),
    "set_union_all": (set_union_all, f"{_A} UNION ALL {_B}"),
    "set_intersect": (set_intersect, f"{_A} INTERSECT {_B}"),
    "set_intersect_all": (set_intersect_all, f"{_A} INTERSECT ALL {_B}"),
    "set_except": (set_except, "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders"),
    "set_except_all": (set_except_all, f"{_A} EXCEPT ALL {_B}"),
    "pivot_wide": (pivot_wide, "SELECT o_orderstatus, " + ", ".join(
        f"round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '{p}'), 2) AS p{p[0]}"
        for p in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    ) + " FROM orders GROUP BY 1"),
    "melt_long": (melt_long, """SELECT l_orderkey, unnest(['l_quantity', 'l_discount', 'l_tax']) AS measure,
      unnest([l_quantity, l_discount, l_tax]) AS amount FROM lineitem"""),
    "fillna": (fillna, """SELECT event_id, CASE WHEN event_id % 10 IN (0, 1) THEN -1.0 ELSE value END::DOUBLE AS value,
      CASE WHEN event_id % 8 = 0 THEN 'none' ELSE event_type END AS note FROM events"""),
    "dropna": (dropna, """SELECT event_id, value, event_type AS note FROM events
      WHERE event_id % 10 > 1 AND event_id % 8 <> 0"""),
}
