"""The SQL action over the current frame."""

from __future__ import annotations

from gridlake.operators import sampling
from gridlake.plans.inputs import frame, table


def sql_action(spark, sf_dir):
    """A chain of verbs with SQL in the middle."""
    events = frame(spark, sf_dir, "events").filter("value > 5").select("event_id", "user_id", "event_type", "value")
    grouped = events.sql("""
      SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS total FROM dataframe
      GROUP BY user_id, event_type ORDER BY user_id DESC""")
    return grouped.filter("(n > 3) & (event_type != 'error')").data


def sql_cte(spark, sf_dir):
    return frame(spark, sf_dir, "orders").sql("""
      WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM dataframe GROUP BY o_custkey),
           level AS (SELECT avg(total) AS mean FROM spend)
      SELECT o_custkey, n, round(total, 2) AS total FROM spend WHERE total > (SELECT mean FROM level)""").data


def sql_recursive(spark, sf_dir):
    """Depth of every part in the binary tree ``parent = key div 2``."""
    # a level per bit of the largest key; the row limit is for runaway recursions
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return frame(spark, sf_dir, "part").sql("""
      WITH RECURSIVE tree AS (
        SELECT p_partkey, 0 AS depth FROM dataframe WHERE p_partkey = 1
        UNION ALL
        SELECT c.p_partkey, t.depth + 1 FROM tree t
        JOIN dataframe c ON c.p_partkey div 2 = t.p_partkey AND c.p_partkey > 1)
      SELECT p_partkey, depth FROM tree""").data


def sql_exists(spark, sf_dir):
    return frame(spark, sf_dir, "lineitem").sql("""
      SELECT l_orderkey, count(*) AS n FROM dataframe a
      WHERE l_orderkey IN (SELECT DISTINCT b.l_orderkey FROM dataframe b WHERE b.l_quantity > 45)
        AND NOT EXISTS (SELECT DISTINCT c.l_orderkey FROM dataframe c
          WHERE c.l_returnflag = 'R' AND c.l_orderkey = a.l_orderkey)
      GROUP BY l_orderkey""").data


def sample_strata(spark, sf_dir):
    """Twenty orders of each status, by a hash of their key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sampling.sample_rows(orders, 20, ["o_orderkey"], ["o_orderstatus"])


def sample_fixed(spark, sf_dir):
    """Exactly 1500 line items of the table."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return sampling.sample_rows(line, 1500, ["l_orderkey", "l_linenumber"])


def sql_hash_sample(spark, sf_dir):
    """A repeatable tenth of the rows, chosen by a digest of the key."""
    return frame(spark, sf_dir, "events").sql("""
      SELECT event_id, value FROM dataframe
      WHERE substring(md5(CAST(event_id AS STRING)), 1, 2) < '1a'""").data


def sql_file_functions(spark, sf_dir):
    """A file read inside the SQL text, joined to the frame."""
    return frame(spark, sf_dir, "customer").sql(f"""
      SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance
      FROM dataframe JOIN parquet.`{sf_dir}/nation.parquet` ON c_nationkey = n_nationkey GROUP BY n_name""").data


QUERIES = {
    "sample_strata": (sample_strata, """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('sample|=' || o_orderkey), o_orderkey) <= 20"""),
    "sample_fixed": (sample_fixed, """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
      ORDER BY md5('sample|=' || l_orderkey || '|=' || l_linenumber), l_orderkey, l_linenumber LIMIT 1500"""),
    "sql_action": (sql_action, """SELECT * FROM (SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS total
      FROM events WHERE value > 5 GROUP BY user_id, event_type) WHERE n > 3 AND event_type <> 'error'"""),
    "sql_cte": (sql_cte, """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n
        FROM orders GROUP BY o_custkey), level AS (SELECT avg(total) AS mean FROM spend)
      SELECT o_custkey, n, round(total, 2) AS total FROM spend WHERE total > (SELECT mean FROM level)"""),
    "sql_recursive": (sql_recursive, """WITH RECURSIVE tree AS (
        SELECT p_partkey, 0 AS depth FROM part WHERE p_partkey = 1
        UNION ALL SELECT c.p_partkey, t.depth + 1 FROM tree t
        JOIN part c ON c.p_partkey // 2 = t.p_partkey AND c.p_partkey > 1)
      SELECT p_partkey, depth FROM tree"""),
    "sql_exists": (sql_exists, """SELECT l_orderkey, count(*) AS n FROM lineitem a
      WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_quantity > 45)
        AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY l_orderkey"""),
    "sql_hash_sample": (sql_hash_sample, """SELECT event_id, value FROM events
      WHERE substring(md5(event_id::VARCHAR), 1, 2) < '1a'"""),
    "sql_file_functions": (sql_file_functions, """SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""),
}
