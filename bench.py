"""Time registered queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8),
``BENCH_QUERIES`` (comma-separated names, or ``all``), ``BENCH_RUNS`` (default 3).
Each query runs once to warm up; the median of the timed runs is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "scan_csv", "scan_parquet", "scan_netcdf", "count_rows", "chunk_sizes", "filter_expr", "filter_str",
    "select_cols", "sort_rank", "top_k", "slice_rows", "row_index", "agg_mean", "group_agg", "bench_rollup",
    "sql_cube", "sql_quantiles", "join_inner", "join_full", "join_theta", "join_asof", "join_interval",
    "win_ranking", "win_rows", "win_range", "win_qualify", "set_except_all", "pivot_wide", "melt_long",
    "sql_action", "map_udf", "apply_vectorized", "cat_user_files", "cat_permission", "meta_validate",
    "array_flatten", "array_pad", "raster_bands", "array_rebuild", "roundtrip_diff",
]


def main() -> None:
    from gridlake.plans import registered
    from gridlake.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    known = registered()
    names = os.environ.get("BENCH_QUERIES", "")
    names = list(known) if names == "all" else names.split(",") if names else HEADLINE
    spark = session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, warm = {}, {}
    for name in names:
        run, _ = known[name]
        timed = []
        for i in range(runs + 1):
            began = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            timed.append(time.perf_counter() - began)
        warm[name] = round(timed[0], 3)
        seconds[name] = round(statistics.median(timed[1:] or timed), 3)
        print(f"{name} {warm[name]} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_median_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "runs": runs, "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
