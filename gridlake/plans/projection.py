"""Projection, row access and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import profile
from gridlake.operators.rowindex import ROW
from gridlake.plans.inputs import frame


def select_cols(spark, sf_dir):
    return frame(spark, sf_dir, "events").select("value", "event_id", "event_type").data


def column_values(spark, sf_dir):
    values = frame(spark, sf_dir, "events").select("value").indexed()
    return values.df.select(F.col(ROW).alias("row_no"), "value")


def row_at(spark, sf_dir):
    return frame(spark, sf_dir, "events").sort("value", "descending").slice(7, 1).data


def append_col(spark, sf_dir):
    """A computed column, then a column of another frame with the same row order."""
    events = frame(spark, sf_dir, "events").append_column("double_value", F.col("value") * 2)
    other = frame(spark, sf_dir, "events").select("user_id")
    return events.append_column("owner", other).select("event_id", "double_value", "owner").data


def flatten_struct(spark, sf_dir):
    events = frame(spark, sf_dir, "events")
    packed = events.assign(s=F.when(F.col("event_id") % 9 != 0, F.struct("user_id", "event_type")))
    return packed.select("event_id", "s").flatten().data


def drop_cols(spark, sf_dir):
    return frame(spark, sf_dir, "events").drop("props", "ts").data


def assign_col(spark, sf_dir):
    events = frame(spark, sf_dir, "events").assign(
        value_sq=F.round(F.col("value") * F.col("value"), 4), is_high=F.col("value") > 100
    )
    return events.select("event_id", "value_sq", "is_high").data


def cast_cols(spark, sf_dir):
    events = frame(spark, sf_dir, "events")
    typed = events.astype({"event_id": "int", "user_id": "string"}).astype({"event_type": "double"}, errors="coerce")
    return typed.select("event_id", "user_id", "event_type").data


def frame_profile(spark, sf_dir):
    return profile.frame_profile(frame(spark, sf_dir, "events").filter("value > 20").data)


QUERIES = {
    "select_cols": (select_cols, "SELECT value, event_id, event_type FROM events"),
    "column_values": (column_values, "SELECT event_id AS row_no, value FROM events"),
    "row_at": (row_at, "SELECT * FROM events ORDER BY value DESC, event_id LIMIT 1 OFFSET 7"),
    "append_col": (append_col, "SELECT event_id, value * 2 AS double_value, user_id AS owner FROM events"),
    "flatten_struct": (flatten_struct, """SELECT event_id,
      CASE WHEN event_id % 9 <> 0 THEN user_id END AS "s.user_id",
      CASE WHEN event_id % 9 <> 0 THEN event_type END AS "s.event_type" FROM events"""),
    "drop_cols": (drop_cols, "SELECT event_id, user_id, event_type, value FROM events"),
    "assign_col": (assign_col, "SELECT event_id, round(value * value, 4) AS value_sq, value > 100 AS is_high FROM events"),
    "cast_cols": (cast_cols, """SELECT event_id::INTEGER AS event_id, user_id::VARCHAR AS user_id,
      TRY_CAST(event_type AS DOUBLE) AS event_type FROM events"""),
    "frame_profile": (frame_profile, """SELECT count(*) AS num_rows, 6::BIGINT AS num_cols,
      (count(*) * 32 + sum(octet_length(encode(event_type))) + sum(octet_length(encode(props))))::BIGINT AS total_bytes
      FROM events WHERE value > 20"""),
}
