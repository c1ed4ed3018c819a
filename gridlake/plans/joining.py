"""Joins: frame verbs, SQL joins, as-of, interval and range aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.frame import Frame
from gridlake.operators import joins, reports, windows
from gridlake.plans.inputs import BENCH_RUNS_SQL, bench_runs, frame, table


def _orders(spark, sf_dir):
    return frame(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _customers(spark, sf_dir):
    """Customers by key; every third key is moved out of the orders' range."""
    customers = frame(spark, sf_dir, "customer").select("c_custkey", "c_name")
    shifted = F.when(F.col("c_custkey") % 3 == 0, -F.col("c_custkey") - 1).otherwise(F.col("c_custkey"))
    return customers.assign(o_custkey=shifted).select("o_custkey", "c_name")


_CUSTOMERS_SQL = """(SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey - 1 ELSE c_custkey END AS o_custkey,
  c_name FROM customer)"""


def _merge(how: str):
    def query(spark, sf_dir):
        return _orders(spark, sf_dir).merge(_customers(spark, sf_dir), "o_custkey", how).data

    return query


def _merge_sql(how: str) -> str:
    return f"""SELECT coalesce(o.o_custkey, c.o_custkey) AS o_custkey, o_orderkey, o_totalprice, c_name
      FROM orders o {how} JOIN {_CUSTOMERS_SQL} c ON o.o_custkey = c.o_custkey"""


def join_semi(spark, sf_dir):
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return joins.merge(customers, dear.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "semi")


def join_anti(spark, sf_dir):
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return joins.merge(customers, dear.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "anti")


def join_self(spark, sf_dir):
    """Each order with the customer's next one; the join keys are unique, so no key is hot."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    numbered = windows.row_numbers(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "k").drop("o_orderdate")
    return Frame(numbered).sql("""
      SELECT a.o_orderkey, b.o_orderkey AS next_order, round(b.o_totalprice - a.o_totalprice, 2) AS change
      FROM dataframe a JOIN dataframe b ON a.o_custkey = b.o_custkey AND b.k = a.k + 1""").data


def join_theta(spark, sf_dir):
    """Per supplier: number and value of the parts that cost no more than its balance."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    parts = table(spark, sf_dir, "part").select("p_retailprice")
    found = joins.range_aggregate(suppliers, parts, "s_acctbal", "p_retailprice", F.col("p_retailprice"))
    return found.select(
        "s_suppkey", F.col("n_matches").cast("bigint").alias("n_parts"), F.round("sum_matches", 2).alias("value")
    )


def join_asof(spark, sf_dir):
    """Each purchase with the user's latest view at or before it."""
    events = table(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    views = events.where("event_type = 'view'").select(
        "user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"), F.col("value").alias("view_value")
    )
    return joins.asof_join(purchases, views, ["user_id"], "ts", "view_ts", ["view_ts", "view_id", "view_value"])


def sql_lateral_limit(spark, sf_dir):
    """Each purchase with the user's three latest views at or before it."""
    events = table(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    views = events.where("event_type = 'view'").select(
        "user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"), F.col("value").alias("view_value")
    )
    return joins.lateral_latest(purchases, views, ["user_id"], "ts", "view_ts", "view_id", 3, ["view_id", "view_ts", "view_value"])


def join_overlap(spark, sf_dir):
    """Three hours from each sign-up of a user that overlap the two hours around a purchase."""
    events = table(spark, sf_dir, "events")
    sessions = events.where("event_type = 'signup'").select(
        "user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("opened"), F.expr("ts + INTERVAL '3' HOUR").alias("closed")
    )
    around = events.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.expr("ts - INTERVAL '2' HOUR").alias("from_ts"),
        F.expr("ts + INTERVAL '2' HOUR").alias("to_ts"),
    )
    return joins.overlapping_intervals(sessions, around, ["user_id"], ("opened", "closed"), ("from_ts", "to_ts"))


def join_interval(spark, sf_dir):
    """Events inside the three hours after each of the user's sign-ups."""
    events = table(spark, sf_dir, "events")
    signups = events.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    episodes = signups.select(
        "user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("starts"), F.expr("ts + INTERVAL '3' HOUR").alias("ends"),
    )
    others = events.where("event_type <> 'signup'").select("user_id", "event_id", "ts")
    return joins.containing_interval(others, episodes, ["user_id"], "ts", "starts", "ends", ["signup_id"])


def sql_lateral(spark, sf_dir):
    return frame(spark, sf_dir, "lineitem").sql("""
      SELECT l_orderkey, l_partkey, l_suppkey, net, net * (1 + l_tax) AS gross
      FROM dataframe, LATERAL (SELECT l_extendedprice * (1 - l_discount) AS net)""").data


def sql_corr_subquery(spark, sf_dir):
    return frame(spark, sf_dir, "orders").sql("""
      SELECT o_orderkey, o_custkey, o_totalprice FROM dataframe o
      WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM dataframe i WHERE i.o_custkey = o.o_custkey)""").data


def bench_compare(spark, sf_dir):
    runs = reports.rollup_runs(bench_runs(spark, sf_dir), "dataset_name", "protocol")
    first, second = (runs.where(F.col("protocol") == p).drop("protocol") for p in ("F", "O"))
    ratios = reports.compare_protocols(first, second)
    return ratios.select("dataset_name", *[F.round(c, 6).alias(c) for c in ratios.columns[1:]])


QUERIES = {
    "sql_lateral_limit": (sql_lateral_limit, """SELECT p.user_id, p.event_id, p.ts, v.nth, v.view_id, v.view_ts, v.view_value
      FROM (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase') p, LATERAL (
        SELECT row_number() OVER (ORDER BY e.ts DESC, e.event_id DESC) AS nth, e.event_id AS view_id, e.ts AS view_ts, e.value AS view_value
        FROM events e WHERE e.event_type = 'view' AND e.user_id = p.user_id AND e.ts <= p.ts
        ORDER BY e.ts DESC, e.event_id DESC LIMIT 3) v"""),
    "join_overlap": (join_overlap, """SELECT s.user_id, s.event_id AS signup_id, s.ts AS opened, s.ts + INTERVAL 3 HOUR AS closed,
      p.event_id AS purchase_id, p.ts - INTERVAL 2 HOUR AS from_ts, p.ts + INTERVAL 2 HOUR AS to_ts
      FROM events s JOIN events p ON p.user_id = s.user_id AND s.ts < p.ts + INTERVAL 2 HOUR AND p.ts - INTERVAL 2 HOUR < s.ts + INTERVAL 3 HOUR
      WHERE s.event_type = 'signup' AND p.event_type = 'purchase'"""),
    "join_inner": (_merge("inner"), _merge_sql("INNER")),
    "join_left": (_merge("left"), _merge_sql("LEFT")),
    "join_right": (_merge("right"), _merge_sql("RIGHT")),
    "join_full": (_merge("full"), _merge_sql("FULL")),
    "join_semi": (join_semi, """SELECT c_custkey, c_name FROM customer
      WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"""),
    "join_anti": (join_anti, """SELECT c_custkey, c_name FROM customer
      WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"""),
    "join_self": (join_self, """WITH numbered AS (SELECT o_orderkey, o_custkey, o_totalprice,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
      SELECT a.o_orderkey, b.o_orderkey AS next_order, round(b.o_totalprice - a.o_totalprice, 2) AS change
      FROM numbered a JOIN numbered b ON a.o_custkey = b.o_custkey AND b.k = a.k + 1"""),
    "join_theta": (join_theta, """SELECT s_suppkey, count(p_partkey) AS n_parts,
      round(coalesce(sum(p_retailprice), 0), 2) AS value
      FROM supplier LEFT JOIN part ON p_retailprice <= s_acctbal GROUP BY s_suppkey"""),
    "join_asof": (join_asof, """SELECT p.user_id, p.event_id, p.ts, v.ts AS view_ts, v.event_id AS view_id,
      v.value AS view_value
      FROM (SELECT * FROM events WHERE event_type = 'purchase') p
      ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
      ON p.user_id = v.user_id AND p.ts >= v.ts"""),
    "join_interval": (join_interval, """SELECT e.user_id, e.event_id, e.ts, starts, ends, signup_id
      FROM (SELECT user_id, event_id, ts FROM events WHERE event_type <> 'signup') e
      JOIN (SELECT user_id, event_id AS signup_id, ts AS starts, ts + INTERVAL 3 HOUR AS ends
        FROM events WHERE event_type = 'signup') s
      ON e.user_id = s.user_id AND e.ts >= starts AND e.ts < ends"""),
    "sql_lateral": (sql_lateral, """SELECT l_orderkey, l_partkey, l_suppkey,
      l_extendedprice * (1 - l_discount) AS net,
      l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem"""),
    "sql_corr_subquery": (sql_corr_subquery, """SELECT o_orderkey, o_custkey, o_totalprice FROM orders o
      WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)"""),
    "bench_compare": (bench_compare, f"""WITH r AS (SELECT dataset_name, protocol, avg(connect_time) AS c,
        avg(total_time) AS t, avg(throughput_mbps) AS m FROM {BENCH_RUNS_SQL} GROUP BY 1, 2)
      SELECT a.dataset_name, round(b.c / a.c, 6) AS connect_ratio, round(b.t / a.t, 6) AS total_ratio,
        round(a.m / b.m, 6) AS throughput_ratio
      FROM (SELECT * FROM r WHERE protocol = 'F') a LEFT JOIN (SELECT * FROM r WHERE protocol = 'O') b
      ON a.dataset_name = b.dataset_name"""),
}
