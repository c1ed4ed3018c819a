"""Filters by expression text and by mask, with missing values in every column."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions.expressions import predicate
from gridlake.plans.inputs import GAPS_SQL, gap_frame


def _filter(expression: str):
    def query(spark, sf_dir):
        return gap_frame(spark, sf_dir).filter(expression).select("event_id", "value", "note").data

    return query


def _sql(condition: str) -> str:
    # NaN never passes a comparison except <>, which every missing value passes
    return f"SELECT event_id, value, note FROM {GAPS_SQL} WHERE {condition}"


def filter_mask(spark, sf_dir):
    """A mask of the same length, then a boolean column."""
    mask = gap_frame(spark, sf_dir).assign(keep=F.col("event_id") % 3 == 0).select("keep")
    masked = gap_frame(spark, sf_dir).filter(mask)
    return masked.filter(F.col("value") < 60).select("event_id", "value", "note").data


def filter_cmp(spark, sf_dir):
    """How many rows each comparison keeps, missing values included."""
    events = gap_frame(spark, sf_dir)
    tests = {
        "eq": "note == 'click'", "ne": "note != 'click'", "lt": "value < 40", "le": "value <= 40",
        "gt": "value > 40", "ge": "value >= 40", "ne_num": "value != 40", "not_gt": "~(value > 40)",
    }
    counted = events.data.agg(*[F.count_if(predicate(events.data, t)).alias(n) for n, t in tests.items()])
    return counted


_KNOWN = "(value IS NOT NULL AND NOT isnan(value))"

QUERIES = {
    "filter_expr": (
        _filter("((value < 20) | (note == 'purchase')) & (user_id != 0)"),
        _sql(f"(({_KNOWN} AND value < 20) OR coalesce(note = 'purchase', false)) AND user_id <> 0"),
    ),
    "filter_cmp": (filter_cmp, f"""SELECT count(*) FILTER (WHERE note = 'click') AS eq,
      count(*) FILTER (WHERE note IS DISTINCT FROM 'click') AS ne,
      count(*) FILTER (WHERE {_KNOWN} AND value < 40) AS lt, count(*) FILTER (WHERE {_KNOWN} AND value <= 40) AS le,
      count(*) FILTER (WHERE {_KNOWN} AND value > 40) AS gt, count(*) FILTER (WHERE {_KNOWN} AND value >= 40) AS ge,
      count(*) FILTER (WHERE NOT ({_KNOWN} AND value = 40)) AS ne_num,
      count(*) FILTER (WHERE NOT ({_KNOWN} AND value > 40)) AS not_gt FROM {GAPS_SQL}"""),
    "filter_bool": (
        _filter("~((value > 30) & flag) | (note == 'view')"),
        _sql(f"NOT ({_KNOWN} AND value > 30 AND coalesce(flag, false)) OR coalesce(note = 'view', false)"),
    ),
    "filter_isin": (
        _filter("note.isin(['click', 'view']) & ~user_id.isin([1, 2, 3])"),
        _sql("coalesce(note IN ('click', 'view'), false) AND user_id NOT IN (1, 2, 3)"),
    ),
    "filter_null": (
        _filter("value.notnull() & note.isnull() | value.isna() & note.notna()"),
        _sql(f"({_KNOWN} AND note IS NULL) OR (NOT {_KNOWN} AND note IS NOT NULL)"),
    ),
    "filter_arith": (
        _filter("(value * 2 - 10 >= user_id // 7) & ((0 - event_id) % 7 < 3) & (value / 4 + 1 < 25) & (user_id ** 2 > 9)"),
        _sql(f"""{_KNOWN} AND value * 2 - 10 >= user_id // 7 AND ((-event_id % 7) + 7) % 7 < 3
          AND value / 4 + 1 < 25 AND user_id * user_id > 9"""),
    ),
    "filter_str": (
        _filter("note.str.contains('^(cl|vi)') & (note.str.len() < 6) | note.str.upper().str.startswith('PUR') "
                "| (event_type.str.endswith('or') & value.between(10, 50))"),
        _sql(f"""coalesce(regexp_matches(note, '^(cl|vi)') AND length(note) < 6, false)
          OR coalesce(starts_with(upper(note), 'PUR'), false)
          OR (event_type LIKE '%or' AND {_KNOWN} AND value BETWEEN 10 AND 50)"""),
    ),
    "filter_mask": (filter_mask, _sql(f"{_KNOWN} AND value < 60 AND event_id % 3 = 0")),
}
