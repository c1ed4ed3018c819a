"""Sort, limit, slice, top-k and row positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators.rowindex import ROW, sort_index
from gridlake.plans.inputs import GAPS_SQL, frame, gap_frame, table


def limit_rows(spark, sf_dir):
    return frame(spark, sf_dir, "events").filter("value > 25").limit(500).select("event_id", "value").data


def slice_rows(spark, sf_dir):
    return frame(spark, sf_dir, "events").filter("value > 25").slice(100, 300).select("event_id", "value").data


def slice_tail(spark, sf_dir):
    return frame(spark, sf_dir, "events").slice(50).select("event_id", "value").data


def sort_rank(spark, sf_dir):
    """Positions under a descending sort with nulls last and NaN just before them."""
    ordered = gap_frame(spark, sf_dir).sort("value", "descending").indexed()
    return ordered.df.select("event_id", F.col(ROW).alias("position"))


def sort_ascending(spark, sf_dir):
    ordered = gap_frame(spark, sf_dir).sort("note").sort("value").indexed()
    return ordered.df.select("event_id", F.col(ROW).alias("position"))


def top_k(spark, sf_dir):
    orders = frame(spark, sf_dir, "orders")
    return orders.sort("o_totalprice", "descending").limit(100).select("o_orderkey", "o_totalprice").data


def row_index(spark, sf_dir):
    line = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    numbered = sort_index(line, [F.col("o_orderdate"), F.col("o_orderkey")])
    return numbered.select("o_orderkey", F.col(ROW).alias("position"))


def sql_order_multi(spark, sf_dir):
    events = gap_frame(spark, sf_dir)
    return events.sql(
        "SELECT event_id, note, value FROM dataframe "
        "ORDER BY note ASC NULLS FIRST, user_id DESC, event_id LIMIT 200 OFFSET 50"
    ).data


QUERIES = {
    "limit_rows": (limit_rows, "SELECT event_id, value FROM events WHERE value > 25 ORDER BY event_id LIMIT 500"),
    "slice_rows": (slice_rows, "SELECT event_id, value FROM events WHERE value > 25 ORDER BY event_id LIMIT 300 OFFSET 100"),
    "slice_tail": (slice_tail, "SELECT event_id, value FROM events WHERE event_id >= 50"),
    "sort_rank": (sort_rank, f"""SELECT event_id, row_number() OVER (ORDER BY value IS NULL, isnan(value),
      value DESC, event_id) - 1 AS position FROM {GAPS_SQL}"""),
    "sort_ascending": (sort_ascending, f"""SELECT event_id, row_number() OVER (ORDER BY value IS NULL, isnan(value),
      value, note NULLS LAST, event_id) - 1 AS position FROM {GAPS_SQL}"""),
    "top_k": (top_k, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"),
    "row_index": (row_index, """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position
      FROM orders"""),
    "sql_order_multi": (sql_order_multi, f"""SELECT event_id, note, value FROM {GAPS_SQL}
      ORDER BY note ASC NULLS FIRST, user_id DESC, event_id LIMIT 200 OFFSET 50"""),
}
