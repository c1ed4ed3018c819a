"""Aggregates: frame verbs, roll-ups and SQL grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import nulls
from gridlake.operators import quantiles, reports
from gridlake.plans.inputs import BENCH_RUNS_SQL, GAPS_SQL, bench_runs, frame, gap_frame, table


def _one(pick, name, digits=None):
    def query(spark, sf_dir):
        line = frame(spark, sf_dir, "lineitem").filter("l_quantity > 10")
        value = pick(line.df, "l_extendedprice")
        return line.df.agg((F.round(value, digits) if digits else value).alias(name))

    return query


def agg_gaps(spark, sf_dir):
    """The four aggregates over a column with nulls and NaN, per event type."""
    df = gap_frame(spark, sf_dir).df
    rules = {"sum": nulls.total, "mean": nulls.average, "min": nulls.smallest, "max": nulls.largest}
    return df.groupBy("event_type").agg(
        *[rule(df, "value").alias(name) for name, rule in rules.items()],
        nulls.total(df, "flag").alias("n_flags"),
    )


def agg_stats(spark, sf_dir):
    events = gap_frame(spark, sf_dir)
    return events.groupby("event_type").aggregate(
        n=("value", "count"), std=("value", "std"), var=("value", "var")
    ).data.select("event_type", "n", F.round("std", 6).alias("std"), F.round("var", 4).alias("var"))


def group_agg(spark, sf_dir):
    line = frame(spark, sf_dir, "lineitem")
    grouped = line.groupby("l_returnflag", "l_linestatus").aggregate(
        sum_qty=("l_quantity", "sum"), avg_price=("l_extendedprice", "mean"),
        min_ship=("l_shipdate", "min"), max_tax=("l_tax", "max"), n=("l_orderkey", "count"),
        n_parts=("l_partkey", "nunique"),
    )
    return grouped.assign(avg_price=F.round("avg_price", 3)).data


def uniques(spark, sf_dir):
    return frame(spark, sf_dir, "part").unique("p_brand")


def nunique(spark, sf_dir):
    df = gap_frame(spark, sf_dir).df
    return df.agg(
        F.count_distinct("note").alias("n_notes"), F.count_distinct("user_id").alias("n_users"),
        F.count_distinct(F.when(~F.isnan("value"), F.col("value"))).alias("n_values"),
    )


def bench_rollup(spark, sf_dir):
    rolled = reports.rollup_runs(bench_runs(spark, sf_dir), "dataset_name", "protocol")
    return rolled.select(
        "dataset_name", "protocol", "count", "min_total_time", "max_total_time",
        *[F.round(f"avg_{m}", 5).alias(f"avg_{m}") for m in reports.MEASURES],
    )


_AVERAGES = ", ".join(f"round(avg({m}), 5) AS avg_{m}" for m in reports.MEASURES)


def sql_group_having(spark, sf_dir):
    return frame(spark, sf_dir, "orders").sql("""
      SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS n_status,
             round(sum(o_totalprice), 2) AS total
      FROM dataframe GROUP BY o_custkey HAVING count(*) >= 12""").data


def sql_agg_filter(spark, sf_dir):
    return frame(spark, sf_dir, "lineitem").sql("""
      SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
             round(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 2) AS discounted_qty
      FROM dataframe GROUP BY l_linestatus""").data


def _grouping(clause: str):
    def query(spark, sf_dir):
        return frame(spark, sf_dir, "lineitem").sql(f"""
          SELECT l_returnflag, l_linestatus, year(l_shipdate) AS ship_year,
                 grouping_id(l_returnflag, l_linestatus, year(l_shipdate)) AS level,
                 count(*) AS n, round(sum(l_quantity), 2) AS qty
          FROM dataframe GROUP BY {clause}""").data.withColumns({
            "ship_year": F.col("ship_year").cast("bigint"), "level": F.col("level").cast("bigint")})

    return query


def _grouping_sql(clause: str) -> str:
    return f"""SELECT l_returnflag, l_linestatus, year(l_shipdate) AS ship_year,
      grouping_id(l_returnflag, l_linestatus, year(l_shipdate)) AS level,
      count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY {clause}"""


_KEYS = "l_returnflag, l_linestatus, year(l_shipdate)"
_SETS = "GROUPING SETS ((l_returnflag, l_linestatus), (year(l_shipdate)), (l_returnflag), ())"


def sql_quantiles(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    points = {"q10": 0.1, "median": 0.5, "q90": 0.9}
    found = quantiles.exact_quantiles(line, ["l_returnflag"], "l_extendedprice", points)
    return found.select("l_returnflag", *[F.round(p, 4).alias(p) for p in points])


def sql_mode_skew(spark, sf_dir):
    """Most frequent size (smallest of equals) and skewness of price per brand."""
    part = table(spark, sf_dir, "part")
    counted = part.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    modes = counted.groupBy("p_brand").agg(F.max_by("p_size", F.struct("n", -F.col("p_size"))).alias("mode_size"))
    shape = part.groupBy("p_brand").agg(F.round(F.skewness("p_retailprice"), 6).alias("price_skew"))
    return modes.join(shape, "p_brand")


def sql_approx_distinct(spark, sf_dir):
    """Approximate distinct counts held against the exact ones (within ten percent)."""
    # next to a distinct aggregate Spark would keep a whole sketch for every value; copies do not change a sketch
    pairs = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey").distinct()
    both = pairs.groupBy("l_returnflag").agg(
        F.count("l_partkey").alias("exact"), F.approx_count_distinct("l_partkey", 0.02).alias("approx")
    )
    near = F.abs(F.col("approx") - F.col("exact")) <= F.col("exact") * 0.1
    return both.select("l_returnflag", "exact", near.alias("near"))


def sql_collect(spark, sf_dir):
    """Lists per order: an order has few lines, so each list is short."""
    return frame(spark, sf_dir, "lineitem").sql("""
      SELECT l_orderkey, listagg(CAST(l_partkey AS STRING), ',') WITHIN GROUP (ORDER BY l_partkey) AS parts,
             array_join(array_sort(collect_list(CAST(l_suppkey AS STRING))), ',') AS suppliers
      FROM dataframe GROUP BY l_orderkey""").data


def sql_argmax(spark, sf_dir):
    return frame(spark, sf_dir, "orders").sql("""
      SELECT o_orderpriority, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS dearest,
             min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS cheapest
      FROM dataframe GROUP BY o_orderpriority""").data


_LINE = "FROM lineitem WHERE l_quantity > 10"

QUERIES = {
    "agg_sum": (_one(nulls.total, "result", 2), f"SELECT round(sum(l_extendedprice), 2) AS result {_LINE}"),
    "agg_mean": (_one(nulls.average, "result", 4), f"SELECT round(avg(l_extendedprice), 4) AS result {_LINE}"),
    "agg_min": (_one(nulls.smallest, "result"), f"SELECT min(l_extendedprice) AS result {_LINE}"),
    "agg_max": (_one(nulls.largest, "result"), f"SELECT max(l_extendedprice) AS result {_LINE}"),
    "agg_gaps": (agg_gaps, f"""SELECT event_type, sum(value) AS sum, avg(value) AS mean,
      min(value) FILTER (WHERE NOT isnan(value)) AS min, max(value) FILTER (WHERE NOT isnan(value)) AS max,
      count(*) FILTER (WHERE flag) AS n_flags FROM {GAPS_SQL} GROUP BY event_type"""),
    "agg_stats": (agg_stats, f"""SELECT event_type, count(*) AS n, round(stddev_samp(value), 6) AS std,
      round(var_samp(value), 4) AS var FROM {GAPS_SQL} WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type"""),
    "group_agg": (group_agg, """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
      round(avg(l_extendedprice), 3) AS avg_price, min(l_shipdate) AS min_ship, max(l_tax) AS max_tax,
      count(l_orderkey) AS n, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1, 2"""),
    "uniques": (uniques, "SELECT DISTINCT p_brand FROM part"),
    "nunique": (nunique, f"""SELECT count(DISTINCT note) AS n_notes, count(DISTINCT user_id) AS n_users,
      count(DISTINCT value) FILTER (WHERE NOT isnan(value)) AS n_values FROM {GAPS_SQL}"""),
    "bench_rollup": (bench_rollup, f"""SELECT dataset_name, protocol, count(*) AS "count", {_AVERAGES},
      min(total_time) AS min_total_time, max(total_time) AS max_total_time FROM {BENCH_RUNS_SQL} GROUP BY 1, 2"""),
    "sql_group_having": (sql_group_having, """SELECT o_custkey, count(*) AS n,
      count(DISTINCT o_orderstatus) AS n_status, round(sum(o_totalprice), 2) AS total
      FROM orders GROUP BY o_custkey HAVING count(*) >= 12"""),
    "sql_agg_filter": (sql_agg_filter, """SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
      round(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 2) AS discounted_qty FROM lineitem GROUP BY 1"""),
    "sql_rollup": (_grouping(f"ROLLUP ({_KEYS})"), _grouping_sql(f"ROLLUP ({_KEYS})")),
    "sql_cube": (_grouping(f"CUBE ({_KEYS})"), _grouping_sql(f"CUBE ({_KEYS})")),
    "sql_grouping_sets": (_grouping(_SETS), _grouping_sql(_SETS)),
    "sql_quantiles": (sql_quantiles, """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS q10,
      round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90
      FROM lineitem GROUP BY 1"""),
    "sql_mode_skew": (sql_mode_skew, """SELECT m.p_brand, mode_size, price_skew FROM (
        SELECT p_brand, p_size AS mode_size FROM (SELECT p_brand, p_size, row_number() OVER (
          PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS rn FROM part GROUP BY 1, 2) WHERE rn = 1) m
      JOIN (SELECT p_brand, round(
          (sum(power(p_retailprice - mu, 3)) / count(*)) / power(sum(power(p_retailprice - mu, 2)) / count(*), 1.5), 6
        ) AS price_skew FROM (SELECT *, avg(p_retailprice) OVER (PARTITION BY p_brand) AS mu FROM part)
        GROUP BY p_brand) s ON m.p_brand = s.p_brand"""),
    "sql_approx_distinct": (sql_approx_distinct, """SELECT l_returnflag, count(DISTINCT l_partkey) AS exact,
      TRUE AS near FROM lineitem GROUP BY 1"""),
    "sql_collect": (sql_collect, """SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts,
      string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS suppliers FROM lineitem GROUP BY 1"""),
    "sql_argmax": (sql_argmax, """SELECT o_orderpriority,
      max_by(o_orderkey, (o_totalprice, o_orderkey)) AS dearest,
      min_by(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY 1"""),
}
