"""Ordered computations per group that stay whole when one group is huge.

Every operator measures its largest group first (one pruned, map-side combined
count).  While that fits ``max_group`` rows, a plain window by group is cheapest.
Beyond it the rows are numbered in (group, order) sequence and cut into chunks of
consecutive rows, so one group spreads over many tasks; chunk summaries (one row per
chunk and group) carry the state from chunk to chunk.

``order`` lists column names, the last of which must make the order unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.text import epoch_micros
from gridlake.operators import ranges
from gridlake.operators.rowindex import ROW, densify, sort_index
from gridlake.session import stage

MAX_GROUP_ROWS = 4_000_000
CHUNK_ROWS = 250_000
LONG_FRAME = 2_000  # rows that Spark may add up anew for each row
DENSE_ROWS = 2_000  # rows in a time bucket of a RANGE frame, four frames wide, for the same reason
MOST_CUTS = 64  # buckets to a RANGE frame; a power of two divides the microseconds of a second
THIN_ROWS = 50  # rows a bucket on average that are worth a call of Python


def largest_group(df: DataFrame, keys: list[str]) -> int:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _plain(df: DataFrame, keys: list[str], max_group: int | None) -> bool:
    return largest_group(df, keys) <= (MAX_GROUP_ROWS if max_group is None else max_group)


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null, as windows and groups have it; keys come once."""
    other = right.select(*[F.col(f"`{c}`").alias(f"_meet_{c}" if c in keys else c) for c in right.columns])
    same = F.lit(True)
    for c in keys:
        same = same & left[c].eqNullSafe(other[f"_meet_{c}"])
    return left.join(other, same, how).drop(*[f"_meet_{c}" for c in keys])


def number_chunks(df: DataFrame, keys: list[str], order: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows with their position in (keys, order) sequence and the chunk they fall into."""
    indexed = sort_index(df, [F.col(c).asc() for c in [*keys, *order]])
    return indexed.withColumn("_chunk", F.floor(F.col(ROW) / chunk_rows))


def _group_spans(indexed: DataFrame, keys: list[str]) -> DataFrame:
    return indexed.groupBy(*keys).agg(F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("_n"))


def ranking(df, keys, order, peers, tiles=4, max_group=None, chunk_rows=CHUNK_ROWS) -> DataFrame:
    """row_number, rank, dense_rank, percent_rank, cume_dist and ntile per group.

    ``order`` is unique and fixes row_number and ntile; ``peers``, its leading part,
    decides which rows tie for the other ranks.
    """
    if _plain(df, keys, max_group):
        by_row = Window.partitionBy(*keys).orderBy(*order)
        by_peer = Window.partitionBy(*keys).orderBy(*peers)
        return df.withColumns({
            "row_number": F.row_number().over(by_row),
            "rank": F.rank().over(by_peer),
            "dense_rank": F.dense_rank().over(by_peer),
            "percent_rank": F.percent_rank().over(by_peer),
            "cume_dist": F.cume_dist().over(by_peer),
            "ntile": F.ntile(tiles).over(by_row),
        })
    indexed = number_chunks(df, keys, order, chunk_rows)
    tied = indexed.groupBy(*keys, *peers).agg(
        F.min(ROW).alias("_peer"), F.max(ROW).alias("_peer_last")
    )
    tied = densify(tied.withColumn("_peer_no", F.col("_peer")), "_peer_no")
    spans = _meet(_group_spans(indexed, keys), tied.groupBy(*keys).agg(F.min("_peer_no").alias("_first_peer")), keys)
    marked = _meet(_meet(indexed, tied, [*keys, *peers]), spans, keys)
    position = F.col(ROW) - F.col("_first")
    n = F.col("_n")
    wide, large = F.expr(f"_n div {tiles}"), F.expr(f"_n % {tiles}")
    # the first ``large`` tiles hold one row more
    in_large = large * (wide + 1)
    tile = F.when(position < in_large, F.floor(position / (wide + 1))).otherwise(
        large + F.floor((position - in_large) / F.greatest(wide, F.lit(1)))
    )
    rank = F.col("_peer") - F.col("_first") + 1
    return marked.select(
        *df.columns,
        (position + 1).cast("int").alias("row_number"),
        rank.cast("int").alias("rank"),
        (F.col("_peer_no") - F.col("_first_peer") + 1).cast("int").alias("dense_rank"),
        F.when(n > 1, (rank - 1) / (n - 1)).otherwise(F.lit(0.0)).alias("percent_rank"),
        ((F.col("_peer_last") - F.col("_first") + 1) / n).alias("cume_dist"),
        (tile + 1).cast("int").alias("ntile"),
    )


def row_numbers(df, keys, order, name="row_number", max_group=None, chunk_rows=CHUNK_ROWS) -> DataFrame:
    """The 1-based position of each row in its group."""
    if _plain(df, keys, max_group):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    indexed = number_chunks(df, keys, order, chunk_rows)
    first = indexed.groupBy(*keys).agg(F.min(ROW).alias("_first"))
    numbered = _meet(indexed, first, keys)
    return numbered.select(*df.columns, (F.col(ROW) - F.col("_first") + 1).alias(name))


def neighbours(df, keys, order, column, steps: dict[str, int], max_group=None, chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Values of ``column`` a given number of rows away in the group (negative: before)."""
    if _plain(df, keys, max_group):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: F.lead(column, k).over(w) for name, k in steps.items()})
    out = number_chunks(df, keys, order, chunk_rows)
    source = out.select(ROW, *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(column).alias("_v"))
    for name, k in steps.items():
        moved = source.select(
            (F.col(ROW) - k).alias(ROW), F.col("_v").alias(name),
            *[F.col(f"_k_{c}").alias(f"_same_{c}") for c in keys],
        )
        out = out.join(moved, ROW, "left")
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_same_{c}"))
        out = out.withColumn(name, F.when(same, F.col(name))).drop(*[f"_same_{c}" for c in keys])
    return out.drop(ROW, "_chunk")


def known_neighbours(df, keys, order, column, steps: dict[str, int], max_group=None, chunk_rows=CHUNK_ROWS) -> DataFrame:
    """The k-th known value of ``column`` before (negative) or behind each row of the group: lag and
    lead that ignore nulls.

    Cut groups number their known values; each row then asks for a number, so a run of nulls may be
    longer than any chunk.
    """
    if not all(steps.values()):
        raise ValueError("a neighbour is at least one known value away")
    if _plain(df, keys, max_group):
        w = Window.partitionBy(*keys).orderBy(*order)
        wanted = {n: f"{'lead' if k > 0 else 'lag'}(`{column}`, {abs(k)}) IGNORE NULLS" for n, k in steps.items()}
        return df.withColumns({n: F.expr(text).over(w) for n, text in wanted.items()})
    # the number of known values up to each row, in the order of all groups
    known = F.col(f"`{column}`").isNotNull()
    counted = running_sums(df, [], [*keys, *order], {"_known": F.when(known, 1).otherwise(0).cast("long")}, chunk_rows=chunk_rows)
    counted = stage(counted, "known-values")
    values = counted.where(known).select(
        (F.col("_known") - 1).alias("_no"), F.col(f"`{column}`").alias("_value"), *[F.col(k).alias(f"_same_{k}") for k in keys]
    )
    out = counted.withColumn("_behind", F.col("_known") - F.when(known, 1).otherwise(0))
    for name, k in steps.items():
        asked = F.col("_known") + (k - 1) if k > 0 else F.col("_behind") + k
        found = out.withColumn("_ask", asked).join(values, F.col("_ask") == F.col("_no"), "left")
        same = ranges.same_all([(F.col(c), F.col(f"_same_{c}")) for c in keys]) & F.col("_no").isNotNull()
        out = found.withColumn(name, F.when(same, F.col("_value"))).drop("_ask", "_no", "_value", *[f"_same_{c}" for c in keys])
    return out.select(*df.columns, *steps)


def edge_values(df, keys, order, column, nth: int = 2) -> DataFrame:
    """Per group: first, last and n-th value of ``column`` and its last non-null value.

    Plain aggregates, combined on the map side, so group size does not matter; the n-th
    row is found with a row-number limit that Spark applies before the shuffle.
    """
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    edges = df.groupBy(*keys).agg(
        F.min_by(column, at).alias("first_value"),
        F.max_by(column, at).alias("last_value"),
        F.max_by(column, F.when(F.col(column).isNotNull(), at)).alias("last_known"),
    )
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.select(*keys, *order, F.col(column).alias("_nth")).withColumn("_rn", F.row_number().over(w))
    picked = numbered.where(F.col("_rn") <= nth).where(F.col("_rn") == nth)
    return _meet(edges, picked.select(*keys, F.col("_nth").alias("nth_value")), keys, "left")


def carry_last(df, keys, order, column, name, max_group=None, chunk_rows=CHUNK_ROWS) -> DataFrame:
    """The last non-null value of ``column`` at or before each row of the group."""
    if _plain(df, keys, max_group):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(column, ignorenulls=True).over(w))
    chunked = number_chunks(df, keys, order, chunk_rows)
    ends = chunked.groupBy(*keys, "_chunk").agg(
        F.max_by(column, F.when(F.col(column).isNotNull(), F.col(ROW))).alias("_end")
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_chunk", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy("_chunk", *keys).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    out = chunked.withColumn(name, F.last(column, ignorenulls=True).over(inside))
    out = _meet(out, carried, ["_chunk", *keys], "left")
    return out.select(*df.columns, F.coalesce(name, "_carry").alias(name))


def running_sums(df, keys, order, sums: dict[str, Column], max_group=None, chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Running sums from the first row of the group up to each row.

    ``keys`` may be empty for one sequence over the whole table; that always takes the
    chunked way.
    """
    if keys and _plain(df, keys, max_group):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    chunked = number_chunks(df.withColumns(sums), keys, order, chunk_rows)
    parts = chunked.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_p_{c}") for c in sums])
    # one row per chunk: the window below is over chunk summaries, not rows
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(*keys, "_chunk", *[
        F.sum(f"_p_{c}").over(before).alias(f"_b_{c}") for c in sums
    ])
    inside = Window.partitionBy("_chunk", *keys).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    out = chunked.withColumns({f"_s_{c}": F.sum(c).over(inside) for c in sums})
    out = _meet(out, bases, ["_chunk", *keys])
    # null as long as no value has come, as in a window
    return out.select(*df.columns, *[
        F.coalesce(F.col(f"_b_{c}") + F.col(f"_s_{c}"), f"_b_{c}", f"_s_{c}").alias(c) for c in sums
    ])


def _function(spec):
    return spec if callable(spec) else lambda w: ranges.over(spec, w)


def rows_frame(df, keys, order, before: int, after: int, aggregates: dict, max_group=None,
               chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Aggregates over the ``before`` rows before and ``after`` rows behind each row.

    ``aggregates`` maps names to (function, column), function being count, sum, avg, min or max, for
    instance ``{"avg3": ("avg", "value")}``, or to functions of a window.  Cut groups copy the rows
    next to a chunk border into the neighbouring chunk, so that every frame is complete in its chunk;
    functions of a window have that way alone.  Spark adds up every frame anew, so frames longer than
    ``LONG_FRAME`` rows are joined from partial results instead: in their chunk, or over several
    chunks if they do not fit into one.
    """
    named = not any(map(callable, aggregates.values()))
    if named and LONG_FRAME < before + after + 1 and max(before, after) <= chunk_rows:
        return _chunked_rows_frame(df, keys, order, before, after, aggregates, chunk_rows)
    if named and before + after + 1 > min(LONG_FRAME, chunk_rows):
        indexed = number_chunks(df, keys, order, chunk_rows).drop("_chunk")
        spans = _group_spans(indexed, keys)
        framed = _meet(indexed, spans, keys).withColumns({
            "_lo": F.greatest("_first", F.col(ROW) - before),
            "_hi": F.least(F.col("_first") + F.col("_n") - 1, F.col(ROW) + after),
        })
        return ranges.range_totals(framed, aggregates, "_lo", "_hi").select(*df.columns, *aggregates)
    functions = {name: _function(spec) for name, spec in aggregates.items()}
    if _plain(df, keys, max_group):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, after)
        return df.withColumns({name: f(w) for name, f in functions.items()})
    if chunk_rows < max(before, after):
        raise ValueError("functions of a window need a frame that fits into one chunk; name the aggregates instead")
    spread = _spread(number_chunks(df, keys, order, chunk_rows), before, after, chunk_rows)
    w = Window.partitionBy("_home", *keys).orderBy(ROW).rowsBetween(-before, after)
    out = spread.withColumns({name: f(w) for name, f in functions.items()})
    return out.where(F.col("_home") == F.col("_chunk")).select(*df.columns, *aggregates)


def _spread(chunked: DataFrame, before: int, after: int, chunk_rows: int) -> DataFrame:
    """Rows with each chunk (``_home``) that needs them."""
    place = F.col(ROW) % chunk_rows
    homes = F.array_compact(F.array(
        F.col("_chunk"),
        F.when(place >= chunk_rows - before, F.col("_chunk") + 1),
        F.when(place < after, F.col("_chunk") - 1),
    ))
    return chunked.withColumn("_home", F.explode(homes))


def _light(df: DataFrame, keys: list[str]) -> list[str]:
    """The columns that Python tasks may hold a chunk of: keys, and values of a fixed width."""
    return [c for c in df.columns if c in keys or ranges.fixed_width(df.schema[c].dataType)]


def _chunked_rows_frame(df, keys, order, before, after, aggregates, chunk_rows) -> DataFrame:
    """``rows_frame`` by partial results inside chunks.  Wide columns are joined by position."""
    parts = ranges.Parts(df, aggregates)
    light = _light(df, keys)
    chunked = number_chunks(df, keys, order, chunk_rows)
    spread = _spread(chunked.select(ROW, "_chunk", *light, *[c.alias(p) for p, c in parts.leaves.items()]), before, after, chunk_rows)
    w = Window.partitionBy("_home").orderBy(ROW)
    same = ranges.same_all([(F.col(f"`{c}`"), F.lag(f"`{c}`").over(w)) for c in keys])
    kept = light if len(light) == len(df.columns) else [ROW, *light]
    out = ranges.row_frames(spread.withColumn("_starts", ~same), parts, kept, before, after)
    if ROW in kept:
        heavy = [F.col(f"`{c}`") for c in df.columns if c not in light]
        out = out.join(chunked.select(ROW, *heavy).hint("merge"), ROW)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(name) for name, c in parts.results().items()])


def range_frame(df, keys, order: str, seconds: int, aggregates: dict, max_bucket=None) -> DataFrame:
    """Aggregates over the last ``seconds`` before each row, by a timestamp column.

    ``aggregates`` as for ``rows_frame``.  Groups are cut into time buckets four frames wide; rows
    within one frame of a bucket's end are copied to the next bucket.  One shuffle, a quarter more
    rows.  Spark adds up every frame anew, so where a bucket holds more than ``max_bucket`` rows,
    named aggregates are joined from partial results: of buckets as narrow as the times are dense,
    or of ranges of positions (``dense_range_frame``) where no bucket is narrow enough, or most
    buckets are nearly empty.
    """
    wide = 4 * seconds
    micros = epoch_micros(F.col(order))
    bucket = F.floor(micros / (wide * 1_000_000)).cast("bigint")
    marked = df.withColumn("_us", micros).withColumn("_bucket", bucket)
    if not any(map(callable, aggregates.values())):
        largest = largest_group(marked, [*keys, "_bucket"])
        if largest > (DENSE_ROWS if max_bucket is None else max_bucket):
            cuts = 1
            while cuts < MOST_CUTS and largest > 4 * cuts * CHUNK_ROWS // 2:
                cuts *= 2
            narrow = marked.withColumn("_bucket", ranges.time_bucket(F.col("_us"), seconds * 1_000_000 // cuts))
            sizes = narrow.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("n"))
            seen = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("buckets")).first()
            even = seen["most"] <= CHUNK_ROWS and seen["rows"] >= THIN_ROWS * seen["buckets"]
            if even and len(_light(df, keys)) == len(df.columns):
                return _bucketed_range_frame(df, keys, order, seconds, aggregates, cuts)
            return dense_range_frame(df, keys, order, seconds, aggregates)
    late = F.pmod(F.col("_us"), F.lit(wide * 1_000_000)) >= (wide - seconds) * 1_000_000
    homes = F.array_compact(F.array(F.col("_bucket"), F.when(late, F.col("_bucket") + 1)))
    # rows without a time are a bucket of their own
    homes = F.when(F.col("_bucket").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(homes)
    spread = marked.withColumn("_home", F.explode(homes))
    w = Window.partitionBy(*keys, "_home").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    out = spread.withColumns({name: _function(spec)(w) for name, spec in aggregates.items()})
    return out.where(F.col("_home").eqNullSafe(F.col("_bucket"))).select(*df.columns, *aggregates)


def _bucketed_range_frame(df, keys, order: str, seconds: int, aggregates: dict, cuts: int) -> DataFrame:
    """``range_frame`` by partial results of buckets, ``cuts`` to a frame."""
    parts = ranges.Parts(df, aggregates)
    timed = df.withColumn("_us", epoch_micros(F.col(order))).withColumns(parts.leaves)
    out = ranges.time_frames(timed.where("_us IS NOT NULL"), parts, keys, df.columns, seconds * 1_000_000, cuts)
    # rows without a time are the frame of each other
    none = timed.where("_us IS NULL")
    totals = none.groupBy(*keys).agg(*parts.merged())
    out = out.unionByName(_meet(none.select(*[F.col(f"`{c}`") for c in df.columns]), totals, keys).select(*out.columns))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(name) for name, c in parts.results().items()])


def dense_range_frame(df, keys, order: str, seconds: int, aggregates: dict, bits: int = ranges.BITS,
                      chunk_rows=CHUNK_ROWS) -> DataFrame:
    """``range_frame`` for any number of rows in a frame.

    Rows of one key and time share their frame, so they are added up first.  Frame ends are found by
    putting the times and the times a frame earlier into one order and counting; the frames, now
    ranges of positions, are joined from two partial results each.
    """
    parts = ranges.Parts(df, aggregates)
    timed = df.withColumn("_us", epoch_micros(F.col(order)))
    group = [*keys, "_us"]
    ties = stage(timed.select(*group, *[c.alias(p) for p, c in parts.leaves.items()]).groupBy(*group).agg(*parts.merged()), "ties")
    both = ties.withColumns({"_at": F.col("_us"), "_kind": F.lit(1)}).unionByName(
        ties.select(*group, (F.col("_us") - seconds * 1_000_000).alias("_at"), F.lit(0).alias("_kind")), allowMissingColumns=True
    )
    counted = running_sums(both, [], [*keys, "_at", "_kind"], {"_seen": F.col("_kind").cast("long")}, chunk_rows=chunk_rows)
    counted = stage(counted, "frame-ends")
    starts = counted.where("_kind = 0").select(*group, F.col("_seen").alias("_lo"))
    placed = counted.where("_kind = 1").select(*group, *parts.kinds, (F.col("_seen") - 1).alias(ROW))
    framed = stage(_meet(placed, starts, group).withColumn("_hi", F.col(ROW)), "frames")
    totals = ranges.range_parts(framed, parts, "_lo", "_hi", bits).select(
        *group, *[c.alias(name) for name, c in parts.results().items()]
    )
    return _meet(timed, totals, group).select(*df.columns, *aggregates)


def groups_frame(df, keys, peers, before: int, after: int, column: str, max_group=None,
                 chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Sum and count over whole peer groups around each row's own (a GROUPS frame).

    Rows that tie on ``peers`` are added up first; frames then run over the much smaller
    table of ties.
    """
    ties = df.groupBy(*keys, *peers).agg(
        F.sum(column).alias("_sum"), F.count(column).alias("_count")
    )
    framed = rows_frame(ties, keys, peers, before, after, {
        "groups_sum": ("sum", "_sum"), "groups_count": ("sum", "_count"),
    }, max_group, chunk_rows)
    return _meet(df, framed.drop("_sum", "_count"), [*keys, *peers])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps only ``n`` per task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
