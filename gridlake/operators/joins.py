"""Joins Spark has no operator for: as-of, containing interval, range aggregates.

As-of joins and range aggregates order both sides together instead of pairing rows, so
their cost does not depend on how many pairs would match; interval joins meet in buckets
of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from gridlake.operators import windows
from gridlake.session import stage


def merge(left, right, on: str | list[str], how: str = "inner", max_group=None) -> DataFrame:
    """Equi-join on shared columns: inner, left, right, full, semi or anti.

    Spark splits a hot key of either side in inner joins, of the left side in left joins.  So
    semi and anti joins see distinct right keys; a left join over a huge key group of the right
    side is an inner join plus the left rows without a partner, and a right or full join over
    one of the left side an inner or left join plus the right rows without one.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how in ("semi", "anti", "left_semi", "left_anti"):
        return left.join(right.select(*keys).distinct(), keys, how)
    biggest = windows.MAX_GROUP_ROWS if max_group is None else max_group
    if how == "left" and windows.largest_group(right, keys) > biggest:
        matched = left.join(right, keys, "inner")
        alone = left.join(right.select(*keys).distinct(), keys, "left_anti")
        return matched.unionByName(alone, allowMissingColumns=True)
    if how not in ("right", "full") or windows.largest_group(left, keys) <= biggest:
        return left.join(right, keys, how)
    matched = left.join(right, keys, "inner" if how == "right" else "left")
    alone = right.join(left.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def asof_join(left, right, keys, left_on, right_on, values, max_group=None, chunk_rows=windows.CHUNK_ROWS):
    """Each left row with the ``values`` of the latest right row at or before it.

    ``values`` become null where no right row precedes; a right row at the same time
    matches, and among right rows of one time the one with the largest ``values``.
    """
    at = F.col(left_on).alias("_at")
    payload = left.select(
        *keys, at, F.lit(1).alias("_side"), F.monotonically_increasing_id().alias("_tie"),
        F.struct(*[F.col(c) for c in left.columns if c not in keys]).alias("_left"),
        F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_right"),
    )
    # null keys and null times match nothing
    lookup = right.dropna(subset=[*keys, right_on]).select(
        *keys, F.col(right_on).alias("_at"), F.lit(0).alias("_side"),
        F.monotonically_increasing_id().alias("_tie"),
        F.lit(None).cast(payload.schema["_left"].dataType).alias("_left"),
        F.struct(*values).alias("_right"),
    )
    both = payload.unionByName(lookup)
    # equal times: right rows first, the largest values last; _tie only lets ties spread
    order = ["_at", "_side", "_right", "_tie"]
    matched = windows.carry_last(both, keys, order, "_right", "_match", max_group, chunk_rows)
    rows = matched.where(F.col("_side") == 1)
    return rows.select(*keys, "_left.*", *[F.col(f"_match.{v}").alias(v) for v in values])


def lateral_latest(outer, inner, keys, outer_on, inner_on, tie, n, values, max_group=None,
                   chunk_rows=windows.CHUNK_ROWS) -> DataFrame:
    """For each outer row the ``n`` latest inner rows of its key at or before it, the latest first.

    The correlated ``LATERAL (... WHERE inner_on <= outer_on ORDER BY inner_on DESC, tie DESC LIMIT n)``
    without pairs: both sides are put in one order, each outer row counts the inner ones before it,
    and asks for the last ``n`` of these numbers.  Adds ``nth`` (1 is the latest) and ``values``.  Outer
    rows without any, and null keys or times, give no row; ``tie`` tells inner rows of one time apart.
    """
    clash = ({c.lower() for c in outer.columns} | {"nth"}) & {c.lower() for c in values}
    if clash:
        raise ValueError(f"outer and inner rows both have {', '.join(sorted(clash))}; rename one side")
    left = outer.dropna(subset=[*keys, outer_on]).select(
        *keys, F.col(outer_on).alias("_at"), F.lit(1).alias("_side"), F.monotonically_increasing_id().alias("_tie"),
        F.struct(*[F.col(f"`{c}`") for c in outer.columns if c not in keys]).alias("_outer"),
    )
    right = inner.dropna(subset=[*keys, inner_on]).select(
        *keys, F.col(inner_on).alias("_at"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"),
        F.struct(*[F.col(f"`{c}`") for c in values]).alias("_inner"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    counted = windows.running_sums(
        both, [], [*keys, "_at", "_side", "_tie"], {"_seen": F.when(F.col("_side") == 0, 1).otherwise(0).cast("long")}, chunk_rows=chunk_rows
    )
    counted = stage(counted, "lateral")
    numbered = counted.where("_side = 0").select(*[F.col(k).alias(f"_same_{k}") for k in keys], F.col("_seen").alias("_no"), "_inner")
    asked = counted.where("_side = 1").select(
        *keys, "_outer", "_seen", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("nth")
    ).withColumn("_no", F.col("_seen") - F.col("nth") + 1)
    met = asked.join(numbered, "_no")
    for k in keys:
        met = met.where(F.col(k) == F.col(f"_same_{k}"))
    return met.select(*keys, "_outer.*", F.col("nth").cast("bigint").alias("nth"), "_inner.*")


def _place(column: str, kind) -> Column:
    """Whole numbers that never fall where the values rise."""
    value, name = F.col(column), kind.typeName()
    if name == "timestamp":
        number = F.unix_micros(value)
    elif name == "timestamp_ntz":
        number = F.unix_micros(value.cast("timestamp"))
    elif name == "date":
        number = F.unix_date(value).cast("long")
    elif name in ("byte", "short", "integer", "long"):
        number = value.cast("long")
    elif name in ("float", "double", "decimal"):
        scaled = value.cast("double") * F.lit(float(1 << 20))
        inner = F.least(F.greatest(scaled, F.lit(-2.0 ** 61)), F.lit(2.0 ** 61))
        number = F.when(F.isnan(scaled), F.lit(1 << 61)).otherwise(F.floor(inner)).cast("long")
    elif name == "string":  # the first seven bytes
        head = F.substring(F.hex(F.encode(value, "UTF-8")), 1, 14)
        number = F.conv(F.rpad(head, 14, "0"), 16, 10).cast("long")
    else:
        raise TypeError(f"interval bounds need an order by numbers, {column} is {name}")
    return F.least(F.greatest(number, F.lit(-(1 << 61))), F.lit(1 << 61))


def containing_interval(points, intervals, keys, at, start, end, values, max_group=None,
                        chunk_rows=windows.CHUNK_ROWS) -> DataFrame:
    """Points joined to every interval ``[start, end)`` of their key that contains them.

    Intervals may overlap and repeat; each gives a row of its own.  An interval has a level,
    the hexadecimal digits of its length, and lies in few buckets as wide as its level; a point
    looks into one bucket of each level there is, then the exact bounds decide.  Buckets with
    more than ``max_group`` points or intervals are split on that side into parts of ``chunk_rows``
    rows at least, and the other side's rows are repeated per part.  Bounds are numbers, times or
    texts of one type; a column that both sides have is refused.
    """
    biggest = windows.MAX_GROUP_ROWS if max_group is None else max_group
    kinds = {c: df.schema[c].dataType for df, c in ((points, at), (intervals, start), (intervals, end))}
    if len({k.typeName() for k in kinds.values()}) > 1:
        whole = {"byte", "short", "integer", "long"}
        if not all(isinstance(k, NumericType) for k in kinds.values()):
            raise TypeError("points and interval bounds need one type, got " + ", ".join(sorted({k.typeName() for k in kinds.values()})))
        if not all(k.typeName() in whole for k in kinds.values()):  # they share the scale of doubles
            kinds = dict.fromkeys(kinds, DoubleType())
    clash = {c.lower() for c in points.columns} & {c.lower() for c in (start, end, *values)}
    if clash:
        raise ValueError(f"points and intervals both have {', '.join(sorted(clash))}; rename one side")
    spans = intervals.dropna(subset=[*keys, start, end]).where(F.col(start) < F.col(end)).select(
        *keys, F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate([start, end, *values])]).alias("_right"),
        _place(start, kinds[start]).alias("_from"), _place(end, kinds[end]).alias("_to"),
    )
    # 15 digits at most: a longer interval covers a few more buckets
    digits = F.least(F.lit(15), F.length(F.hex(F.col("_to") - F.col("_from"))))
    spans = spans.withColumn("_level", digits).select(
        *keys, "_right", "_level",
        F.explode(F.expr("sequence(shiftright(_from, 4 * _level), shiftright(_to, 4 * _level))")).alias("_bucket"),
    )
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())  # 15 at most
    rest = [c for c in points.columns if c not in keys]
    looks = points.dropna(subset=[*keys, at]).select(
        *keys, F.struct(*rest).alias("_left"), _place(at, kinds[at]).alias("_place"),
        F.monotonically_increasing_id().alias("_tie"),
        F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("_level"),
    ).withColumn("_bucket", F.expr("shiftright(_place, 4 * _level)"))
    group = [*keys, "_level", "_bucket"]
    looks, spans, group = _split(looks, spans, group, F.col("_tie"), biggest, chunk_rows, "_part")
    spans, looks, group = _split(spans, looks, group, F.xxhash64("_right"), biggest, chunk_rows, "_other_part")
    met = looks.join(spans, group)
    inside = (F.col(f"_left.{at}") >= F.col("_right.c0")) & (F.col(f"_left.{at}") < F.col("_right.c1"))
    return met.where(inside).select(
        *keys, "_left.*", *[F.col(f"_right.c{i}").alias(c) for i, c in enumerate([start, end, *values])]
    )


def _split(many, few, group, salt: Column, biggest: int, chunk_rows: int, name: str):
    """Groups of more than ``biggest`` rows of ``many`` in parts, those of ``few`` repeated per part."""
    if windows.largest_group(many, group) <= biggest:
        return many, few, group
    parts = F.ceil(F.col("count") / F.lit(max(biggest, chunk_rows))).cast("long")
    hot = many.groupBy(*group).count().where(F.col("count") > biggest).select(*group, parts.alias("_parts"))
    many = many.join(hot, group, "left").withColumn(name, F.pmod(salt, F.coalesce("_parts", F.lit(1)))).drop("_parts")
    repeated = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))
    few = few.join(hot, group, "left").withColumn(name, repeated).drop("_parts")
    return many, few, [*group, name]


def overlapping_intervals(left, right, keys, left_on: tuple[str, str], right_on: tuple[str, str], max_group=None,
                          chunk_rows=windows.CHUNK_ROWS) -> DataFrame:
    """Pairs of rows of one key whose intervals ``[start, end)`` share a point.

    The later start of a pair lies in the other interval, so pairs are found by ``containing_interval``
    from either side: right starts in left intervals, left starts behind the right ones.  Each pair
    comes once, repeated rows repeat it; null keys, null bounds and empty intervals match nothing.
    """
    (ls, le), (rs, re) = left_on, right_on
    clash = {c.lower() for c in left.columns if c not in keys} & {c.lower() for c in right.columns if c not in keys}
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}; rename one side")

    def known(df, start, end, row):
        df = df.dropna(subset=[*keys, start, end]).where(F.col(start) < F.col(end))
        return df.select(*keys, F.col(start).alias(f"{row}_from"), F.col(end).alias(f"{row}_to"),
                         F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys]).alias(row))

    a, b = known(left, ls, le, "_a"), known(right, rs, re, "_b")
    later = containing_interval(b.drop("_b_to"), a, keys, "_b_from", "_a_from", "_a_to", ["_a"], max_group, chunk_rows)
    earlier = containing_interval(a.drop("_a_to"), b, keys, "_a_from", "_b_from", "_b_to", ["_b"], max_group, chunk_rows)
    kept = [*keys, "_a", "_b"]
    pairs = later.select(*kept).unionByName(earlier.where(F.col("_a_from") > F.col("_b_from")).select(*kept))
    return pairs.select(*keys, "_a.*", "_b.*")


def range_aggregate(probes, points, probe_on: str, point_on: str, value: Column,
                    chunk_rows=windows.CHUNK_ROWS) -> DataFrame:
    """For each probe row: count and sum over all points with ``point_on <= probe_on``.

    The inequality join folded into its aggregate: both sides are put in one order
    and added up from chunk to chunk, so no pair is ever formed.
    """
    left = probes.select(
        F.col(probe_on).alias("_at"), F.lit(1).alias("_side"),
        F.monotonically_increasing_id().alias("_tie"),
        F.struct(*probes.columns).alias("_left"), F.lit(None).cast("double").alias("_value"),
    )
    # a null point is below no probe
    right = points.where(F.col(point_on).isNotNull()).select(
        F.col(point_on).alias("_at"), F.lit(0).alias("_side"),
        F.monotonically_increasing_id().alias("_tie"),
        F.lit(None).cast(left.schema["_left"].dataType).alias("_left"),
        value.cast("double").alias("_value"),
    )
    both = left.unionByName(right)
    summed = windows.running_sums(both, [], ["_at", "_side", "_tie"], {
        "n_matches": F.when(F.col("_side") == 0, 1).otherwise(0),
        "sum_matches": F.coalesce(F.col("_value"), F.lit(0.0)),
    }, chunk_rows=chunk_rows)
    return summed.where(F.col("_side") == 1).select("_left.*", "n_matches", "sum_matches")
