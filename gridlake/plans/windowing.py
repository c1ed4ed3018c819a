"""Window functions and time buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import windows
from gridlake.plans.inputs import GAPS_SQL, frame, gap_frame, table


def win_ranking(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    ranked = windows.ranking(part, ["p_brand"], ["p_size", "p_partkey"], ["p_size"], tiles=4)
    whole = ["row_number", "rank", "dense_rank", "ntile"]
    return ranked.withColumns({c: F.col(c).cast("bigint") for c in whole}).withColumns(
        {c: F.round(c, 8) for c in ("percent_rank", "cume_dist")}
    )


def win_offset(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    return windows.neighbours(
        turns, ["conv_id"], ["turn"], "size", {"before": -1, "after": 1, "after2": 2}
    )


def win_edges(spark, sf_dir):
    events = gap_frame(spark, sf_dir).data.select("user_id", "event_id", "note")
    return windows.edge_values(events, ["user_id"], ["event_id"], "note", nth=3)


def win_ignore_nulls(spark, sf_dir):
    events = gap_frame(spark, sf_dir).data.select("user_id", "event_id", "note")
    return windows.carry_last(events, ["user_id"], ["event_id"], "note", "last_note")


def win_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    framed = windows.rows_frame(events, ["user_id"], ["ts", "event_id"], 3, 1, {
        "moving_sum": ("sum", "value"), "moving_max": ("max", "value"),
    })
    return framed.drop("ts").withColumn("moving_sum", F.round("moving_sum", 2))


def win_rows_long(spark, sf_dir):
    """Frames over most of a table: the 3000 line items before each in order of price."""
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    framed = windows.rows_frame(line, ["l_returnflag"], ["l_extendedprice", "l_orderkey", "l_linenumber"], 3000, 0, {
        "n": ("count", None), "quantity": ("sum", "l_quantity"), "least": ("min", "l_quantity"), "lowest": ("min", "l_extendedprice"),
    })
    return framed.select("l_orderkey", "l_linenumber", "n", F.round("quantity", 2).alias("quantity"), "least", "lowest")


def win_range_dense(spark, sf_dir):
    """Frames that hold a third of the table, whatever the density of times."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp_ntz").alias("at"), "o_totalprice")
    framed = windows.dense_range_frame(orders, ["o_orderstatus"], "at", 700 * 86400, {
        "n": ("count", None), "total": ("sum", "o_totalprice"), "least": ("min", "o_totalprice"), "most": ("max", "o_totalprice"),
    })
    return framed.select("o_orderkey", "n", F.round("total", 2).alias("total"), "least", "most")


def win_known_neighbours(spark, sf_dir):
    events = gap_frame(spark, sf_dir).data.select("user_id", "event_id", "note")
    return windows.known_neighbours(
        events, ["user_id"], ["event_id"], "note", {"last_note": -1, "second_last": -2, "next_note": 1}
    )


def win_running(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    summed = windows.running_sums(events, ["user_id"], ["event_id"], {"running": F.col("value")})
    return summed.withColumn("running", F.round("running", 2))


def win_range(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    framed = windows.range_frame(events, ["event_type"], "ts", 6 * 3600, {
        "recent_sum": ("sum", "value"), "recent_n": ("count", None),
    })
    return framed.drop("ts").withColumn("recent_sum", F.round("recent_sum", 2))


def win_groups(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    framed = windows.groups_frame(part, ["p_brand"], ["p_size"], 1, 1, "p_retailprice")
    return framed.select("p_partkey", F.round("groups_sum", 2).alias("groups_sum"), "groups_count")


def win_qualify(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    top = windows.top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return top.withColumn("rn", F.col("rn").cast("bigint"))


def sql_time_bucket(spark, sf_dir):
    return frame(spark, sf_dir, "events").sql("""
      SELECT window.start AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total
      FROM dataframe GROUP BY window(ts, '6 hours'), event_type""").data


QUERIES = {
    "win_rows_long": (win_rows_long, """SELECT l_orderkey, l_linenumber, count(*) OVER w AS n,
      round(sum(l_quantity) OVER w, 2) AS quantity, min(l_quantity) OVER w AS least, min(l_extendedprice) OVER w AS lowest
      FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber
        ROWS BETWEEN 3000 PRECEDING AND CURRENT ROW)"""),
    "win_range_dense": (win_range_dense, """SELECT o_orderkey, count(*) OVER w AS n, round(sum(o_totalprice) OVER w, 2) AS total,
      min(o_totalprice) OVER w AS least, max(o_totalprice) OVER w AS most
      FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate::TIMESTAMP
        RANGE BETWEEN INTERVAL 700 DAYS PRECEDING AND CURRENT ROW)"""),
    "win_known_neighbours": (win_known_neighbours, f"""SELECT user_id, event_id, note,
      lag(note IGNORE NULLS) OVER w AS last_note, lag(note, 2 IGNORE NULLS) OVER w AS second_last,
      lead(note IGNORE NULLS) OVER w AS next_note
      FROM {GAPS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""),
    "win_ranking": (win_ranking, """SELECT p_partkey, p_brand, p_size,
      row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS row_number,
      rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rank,
      dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dense_rank,
      round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS percent_rank,
      round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS cume_dist,
      ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS ntile FROM part"""),
    "win_offset": (win_offset, """SELECT conv_id, turn, role, length(text)::INTEGER AS size,
      lag(length(text)::INTEGER) OVER w AS before, lead(length(text)::INTEGER) OVER w AS after,
      lead(length(text)::INTEGER, 2) OVER w AS after2
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""),
    "win_edges": (win_edges, f"""SELECT DISTINCT user_id, first_value(note) OVER w AS first_value,
      last_value(note) OVER w AS last_value, last_value(note IGNORE NULLS) OVER w AS last_known,
      nth_value(note, 3) OVER w AS nth_value FROM {GAPS_SQL}
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""),
    "win_ignore_nulls": (win_ignore_nulls, f"""SELECT user_id, event_id, note,
      last_value(note IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_note FROM {GAPS_SQL}"""),
    "win_rows": (win_rows, """SELECT user_id, event_id, value, round(sum(value) OVER w, 2) AS moving_sum,
      max(value) OVER w AS moving_max FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)"""),
    "win_running": (win_running, """SELECT user_id, event_id, value,
      round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS running FROM events"""),
    "win_range": (win_range, """SELECT event_type, event_id, value, round(sum(value) OVER w, 2) AS recent_sum,
      count(*) OVER w AS recent_n FROM events
      WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)"""),
    "win_groups": (win_groups, """SELECT p_partkey, round(sum(p_retailprice) OVER w, 2) AS groups_sum,
      count(*) OVER w AS groups_count FROM part
      WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""),
    "win_qualify": (win_qualify, """SELECT o_custkey, o_orderkey, o_totalprice,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
      FROM orders QUALIFY rn <= 3"""),
    "sql_time_bucket": (sql_time_bucket, """SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket,
      event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"""),
}
