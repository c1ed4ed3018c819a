"""Compare registered queries with their SQL on the same Parquet tables.

Run as a script: ``python tests/oracle.py [sf_dir] [query ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
    "binary": "BLOB", "smallint": "SMALLINT", "tinyint": "TINYINT",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def compare(spark, con, run, sql: str | None, sf_dir: str) -> str:
    """An empty text if both agree on columns, types and rows; else what differs."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(plain(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    if sql is None:
        return "" if got else "no rows"
    con.execute(sql)
    described = [(d[0], str(d[1])) for d in con.description]
    if sorted(n for n, _ in described) != names:
        return f"columns {names} != {sorted(n for n, _ in described)}"
    ours = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    problems = [f"{n}: {ours[n]} != {k}" for n, k in described if ours[n] != k]
    at = {n: i for i, (n, _) in enumerate(described)}
    want = [tuple(plain(r[at[n]]) for n in names) for r in con.fetchall()]
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    extra, lost = Counter(got) - Counter(want), Counter(want) - Counter(got)
    if extra or lost:
        problems.append(f"{sum(extra.values())} rows differ, ours {list(extra)[:2]} theirs {list(lost)[:2]}")
    return "; ".join(problems)


def main() -> int:
    from gridlake.plans import registered
    from gridlake.session import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                          "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, (run, sql) in registered().items():
        if chosen and name not in chosen:
            continue
        began = time.time()
        try:
            problem = compare(spark, con, run, sql, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.2f}s {problem[:900]}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
