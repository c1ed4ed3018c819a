"""Registered queries, one module per group of operators.

Each module has a ``QUERIES`` dict: name -> (callable(spark, sf_dir), reference SQL or
None where SQL cannot express the work).
"""

from gridlake.plans import (
    aggregation, catalogue, filters, grids, joining, ordering, projection, scalars, scans, setops,
    sqltext, udfs, windowing,
)

MODULES = [
    scans, projection, filters, ordering, aggregation, joining, windowing, setops, scalars, sqltext,
    udfs, catalogue, grids,
]


def registered() -> dict:
    merged = {}
    for module in MODULES:
        for name, entry in module.QUERIES.items():
            if name in merged:
                raise ValueError(f"query registered twice: {name}")
            merged[name] = entry
    return merged
