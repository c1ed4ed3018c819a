"""Python functions over columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.plans.inputs import frame, gap_frame


def map_udf(spark, sf_dir):
    """A per-value function as a new column; it sees None for null."""
    events = gap_frame(spark, sf_dir)
    mapped = events.map("note", lambda v: "?" if v is None else v[::-1].upper(), "shout", return_type="string")
    return mapped.select("event_id", "shout").data


def map_replace(spark, sf_dir):
    """Without a new name the column is replaced; the type is found from the first rows."""
    events = frame(spark, sf_dir, "events").select("event_id", "user_id")
    return events.map("user_id", lambda v: v * 10 + 1).data


def apply_vectorized(spark, sf_dir):
    events = frame(spark, sf_dir, "events")
    scaled = events.apply("value", lambda s: (s - 50) / 25, "double", "scaled")
    return scaled.data.select("event_id", F.round("scaled", 6).alias("scaled"))


QUERIES = {
    "map_udf": (map_udf, """SELECT event_id, CASE WHEN event_id % 8 = 0 THEN '?'
      ELSE upper(reverse(event_type)) END AS shout FROM events"""),
    "map_replace": (map_replace, "SELECT event_id, user_id * 10 + 1 AS user_id FROM events"),
    "apply_vectorized": (apply_vectorized, "SELECT event_id, round((value - 50) / 25, 6) AS scaled FROM events"),
}
