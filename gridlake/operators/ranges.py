"""Aggregates over ranges of row positions, of any length, from two partial results each.

Positions are leaves of a binary tree.  The ends ``lo < hi`` of a range part at one level of it, at
the middle of a block; the answer is what lies from ``lo`` up to that middle joined with what lies
from the middle on to ``hi`` (a disjoint sparse table).  So every range asks two questions
``(position, level, side)``, sums need no subtraction, and equal questions are asked once.

Positions are cut into chunks of ``2 ** bits``.  A task answers the questions of one chunk from its
rows; levels above a chunk go on as questions about whole chunks, which are a table ``2 ** bits``
times smaller, and so on.  No task sees more than one chunk and its questions, however long the
ranges and however many rows share a group or a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.operators.rowindex import ROW
from gridlake.session import stage

BITS = 14
_LARGEST, _SMALLEST = (1 << 63) - 1, -(1 << 63)


class Parts:
    """What has to be added up for some aggregates ``{name: (function, column)}``.

    Functions are count, sum, avg, min and max over whole numbers, floats and decimals (as doubles);
    ``("count", None)`` counts rows.  Nulls are skipped; NaN counts as the largest number.
    """

    def __init__(self, df: DataFrame, aggregates: dict[str, tuple[str, str | None]]):
        self.aggregates = aggregates
        self.kinds: dict[str, tuple[str, bool]] = {}  # column name: (operation, whole numbers)
        self.leaves: dict[str, Column] = {}
        self.place: dict[tuple, str] = {}
        for function, column in aggregates.values():
            if function not in ("count", "sum", "avg", "min", "max"):
                raise ValueError(f"no such aggregate over a range: {function}")
            whole = True
            if column is not None:
                kind = df.schema[column].dataType
                whole = isinstance(kind, T.IntegralType)
                if function != "count" and not isinstance(kind, T.NumericType):
                    raise TypeError(f"{function} over a range needs numbers, {column} is {kind.simpleString()}")
            self._need("count", column, True)
            if function != "count":
                self._need("sum" if function == "avg" else function, column, whole)

    def _need(self, operation: str, column: str | None, whole: bool) -> None:
        if (operation, column) in self.place:
            return
        name = f"_p{len(self.kinds)}"
        self.place[operation, column] = name
        self.kinds[name] = (operation, whole)
        if operation == "count":
            self.leaves[name] = F.lit(1).cast("long") if column is None else F.when(F.col(f"`{column}`").isNotNull(), 1).otherwise(0).cast("long")
            return
        nothing = {"sum": 0, "min": _LARGEST, "max": _SMALLEST} if whole else {"sum": 0.0, "min": float("nan"), "max": float("-inf")}
        value = F.col(f"`{column}`").cast("long" if whole else "double")
        self.leaves[name] = F.coalesce(value, F.lit(nothing[operation]))

    def merged(self) -> list[Column]:
        """The parts of a group of rows that have parts."""
        merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
        return [merge[operation](name).alias(name) for name, (operation, _) in self.kinds.items()]

    def both(self, left: str, right: str) -> dict[str, Column]:
        """Two sets of parts, named by a prefix, as one; either may be missing."""
        out = {}
        for name, (operation, _) in self.kinds.items():
            a, b = F.col(f"{left}{name}"), F.col(f"{right}{name}")
            one = {"count": a + b, "sum": a + b, "min": F.least(a, b), "max": F.greatest(a, b)}[operation]
            out[name] = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(one)
        return out

    def results(self) -> dict[str, Column]:
        out = {}
        for name, (function, column) in self.aggregates.items():
            n = F.coalesce(self.place["count", column], F.lit(0).cast("long"))
            if function == "count":
                out[name] = n
            elif function == "avg":
                out[name] = F.when(n > 0, F.col(self.place["sum", column]).cast("double") / n)
            else:
                out[name] = F.when(n > 0, F.col(self.place[function, column]))
        return out


def _solver(kinds: dict[str, tuple[str, bool]], bits: int):
    """The function that answers the questions of one chunk from its rows."""
    size = 1 << bits
    steps = {"count": np.add, "sum": np.add, "min": np.fmin, "max": np.maximum}

    def solve(rows: pa.Table, asked: pa.Table) -> pa.Table:
        at = rows["pos"].to_numpy() & (size - 1)
        want, level, side = (asked[c].to_numpy() for c in ("pos", "level", "side"))
        inside = want & (size - 1)
        out = asked.select(["pos", "level", "side"])
        for name, (operation, whole) in kinds.items():
            if whole:
                nothing, dtype = {"min": _LARGEST, "max": _SMALLEST}.get(operation, 0), np.int64
            else:
                nothing, dtype = {"min": np.nan, "max": -np.inf}.get(operation, 0.0), np.float64
            leaf = np.full(size, nothing, dtype)
            leaf[at] = rows[name].to_numpy()
            found = leaf[inside]
            for k in np.unique(level[level >= 0]):
                # from each place up to the middle of its block, and from the middle on
                runs = leaf.reshape(-1, 1 << min(int(k), bits))
                ahead = steps[operation].accumulate(runs[:, ::-1], axis=1)[:, ::-1].reshape(-1)
                behind = steps[operation].accumulate(runs, axis=1).reshape(-1)
                here = level == k
                found[here] = np.where(side[here] == 0, ahead[inside[here]], behind[inside[here]])
            out = out.append_column(name, pa.array(found))
        return out

    return solve


def _answers(leaves: DataFrame, asked: DataFrame, n: int, parts: Parts, bits: int) -> DataFrame:
    """``asked`` (pos, level, side), each once, with the parts from ``pos`` to the middle; level -1
    asks for the position alone.  ``leaves`` are (pos, parts) at 0 to n - 1."""
    names = list(parts.kinds)
    schema = "pos long, level int, side int, " + ", ".join(f"{p} {'long' if whole else 'double'}" for p, (_, whole) in parts.kinds.items())
    chunk = F.shiftright("pos", bits)
    rows = leaves.select("pos", *names).withColumn("chunk", chunk)
    found = rows.groupBy("chunk").cogroup(asked.withColumn("chunk", chunk).groupBy("chunk")).applyInArrow(
        _solver(parts.kinds, bits), schema
    )
    if n <= 1 << bits:
        return found
    found = stage(found, "range-answers")
    totals = stage(rows.groupBy(F.col("chunk").alias("pos")).agg(*parts.merged()), "range-chunks")
    # the chunks between this one and the middle
    near = F.shiftright("pos", bits)
    next_ = F.when(F.col("side") == 0, near + 1).otherwise(near - 1)
    above = found.filter(F.col("level") >= bits).select("pos", "level", "side", near.alias("near"), next_.alias("next"))
    above = above.withColumn("high", (F.col("level") - bits).cast("int"))
    above = above.filter(F.expr("shiftright(near, high) = shiftright(next, high)"))
    further = above.select(F.col("next").alias("pos"), F.col("high").alias("level"), "side").distinct()
    rest = _answers(totals, further, -(-n >> bits), parts, bits)
    rest = rest.select(F.col("pos").alias("next"), F.col("level").alias("high"), "side", *[F.col(p).alias(f"r{p}") for p in names])
    rest = above.join(rest, ["next", "high", "side"]).select("pos", "level", "side", *[f"r{p}" for p in names])
    joined = found.select("pos", "level", "side", *[F.col(p).alias(f"l{p}") for p in names]).join(rest, ["pos", "level", "side"], "left")
    return joined.select("pos", "level", "side", *[c.alias(p) for p, c in parts.both("l", "r").items()])


def range_parts(rows: DataFrame, parts: Parts, lo: str, hi: str, bits: int = BITS) -> DataFrame:
    """``rows``, which have positions 0, 1, 2 ... and parts, with the parts of the rows from position
    ``lo`` to ``hi`` (null where that is no row) in place of their own.  ``rows`` should be staged: they
    are read several times."""
    names = list(parts.kinds)
    n = rows.count()
    leaves = rows.select(F.col(ROW).alias("pos"), *names)
    # the highest bit in which the ends differ
    apart = F.col(lo).bitwiseXOR(F.col(hi))
    level = F.when(apart == 0, -1).otherwise(F.length(F.bin(apart)) - 1).cast("int")
    ranges = rows.drop(*names).withColumn("_level", F.when(F.col(lo) <= F.col(hi), level))
    ends = [F.struct(F.col(lo).alias("pos"), F.lit(0).alias("side")), F.struct(F.col(hi).alias("pos"), F.lit(1).alias("side"))]
    questions = F.when(F.col("_level") < 0, F.array(ends[0])).otherwise(F.array(*ends))
    asked = ranges.filter("_level IS NOT NULL").select("_level", F.explode(questions).alias("q"))
    asked = asked.select("q.pos", F.col("_level").alias("level"), "q.side").distinct()
    found = stage(_answers(leaves, asked, n, parts, bits), "range-answers")
    out = ranges
    for end, side, prefix in ((lo, 0, "l"), (hi, 1, "r")):
        told = found.filter(F.col("side") == side).select(
            F.col("pos").alias("_at"), F.col("level").alias("_of"), *[F.col(p).alias(f"{prefix}{p}") for p in names]
        )
        out = out.join(told, (F.col(end) == told["_at"]) & (F.col("_level") == told["_of"]), "left").drop("_at", "_of")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in names]
    return out.select(*kept, *[c.alias(p) for p, c in parts.both("l", "r").items()])


def range_totals(
    df: DataFrame, aggregates: dict[str, tuple[str, str | None]], lo: str, hi: str, bits: int = BITS,
) -> DataFrame:
    """``df``, with positions 0, 1, 2 ..., plus aggregates over the rows at positions ``lo`` to ``hi``."""
    parts = Parts(df, aggregates)
    rows = stage(df.withColumns(parts.leaves), "range-rows")
    out = range_parts(rows, parts, lo, hi, bits)
    kept = [F.col(f"`{c}`") for c in df.columns]
    return out.select(*kept, *[c.alias(name) for name, c in parts.results().items()])


_STEPS = {"count": np.add, "sum": np.add, "min": np.fmin, "max": np.maximum}


def _nothing(operation: str, whole: bool):
    if whole:
        return np.int64({"min": _LARGEST, "max": _SMALLEST}.get(operation, 0))
    return np.float64({"min": np.nan, "max": -np.inf}.get(operation, 0.0))


def _leaf(column: pa.ChunkedArray, operation: str) -> np.ndarray:
    """Parts as numbers; as Python's whole numbers where 64 bits might not hold a sum."""
    leaf = column.to_numpy()
    if operation == "sum" and leaf.dtype == np.int64 and np.abs(leaf.astype(np.float64)).sum() >= 2.0 ** 62:
        return leaf.astype(object)
    return leaf


def _stored(found: np.ndarray, whole: bool) -> pa.Array:
    """Raises where a sum is beyond 64 bits."""
    return pa.array(found.astype(np.int64 if whole else np.float64))


def _between(leaf: np.ndarray, lo: np.ndarray, hi: np.ndarray, operation: str, whole: bool) -> np.ndarray:
    """``leaf`` from place ``lo`` to ``hi`` for each pair of them; nothing where ``hi < lo``."""
    out = np.full(len(lo), _nothing(operation, whole), leaf.dtype)
    some = lo <= hi
    if whole and operation in ("count", "sum"):
        before = np.concatenate([[0], np.cumsum(leaf)])
        out[some] = before[hi[some] + 1] - before[lo[some]]
        return out
    # as positions above: halves that meet at the middle of a block, level by level
    level = np.where(some, np.frexp((lo ^ hi).astype(np.float64))[1] - 1, -2)
    out[level == -1] = leaf[lo[level == -1]]
    top = int(level.max(initial=-1))
    size = 1 << max((len(leaf) - 1).bit_length(), top + 1)
    padded = np.concatenate([leaf, np.full(size - len(leaf), _nothing(operation, whole))])
    step = _STEPS[operation]
    for k in range(top + 1):
        here = np.flatnonzero(level == k)
        if len(here):
            runs = padded.reshape(-1, 1 << k)
            ahead = step.accumulate(runs[:, ::-1], axis=1)[:, ::-1].reshape(-1)
            behind = step.accumulate(runs, axis=1).reshape(-1)
            out[here] = step(ahead[lo[here]], behind[hi[here]])
    return out


def _with_parts(schema: T.StructType, parts: Parts) -> T.StructType:
    out = T.StructType([*schema.fields])
    for p, (_, whole) in parts.kinds.items():
        out = out.add(p, T.LongType() if whole else T.DoubleType())
    return out


def row_frames(homes: DataFrame, parts: Parts, kept: list[str], before: int, after: int) -> DataFrame:
    """Frames of ``before`` to ``after`` rows around each row, where a chunk has all rows it needs.

    ``homes`` has positions, parts, ``_home`` (the chunk that gets the row, its own one or, near a
    border, the next), ``_chunk`` (its own one) and ``_starts``, true on the first row of a group.
    Returns ``kept`` and the parts of the frame, once for each row.
    """
    kinds = parts.kinds
    names = [*dict.fromkeys([ROW, "_starts", "_own", *kept, *kinds])]

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows[ROW].to_numpy(), kind="stable")))
        at = np.arange(rows.num_rows)
        starts = rows["_starts"].to_numpy().astype(bool)
        starts[0] = True
        first = np.maximum.accumulate(np.where(starts, at, 0))
        ends = np.append(starts[1:], True)
        last = np.minimum.accumulate(np.where(ends, at, rows.num_rows)[::-1])[::-1]
        own = rows["_own"].to_numpy().astype(bool)
        lo, hi = np.maximum(first, at - before)[own], np.minimum(last, at + after)[own]
        out = rows.select(kept).filter(pa.array(own))
        for name, (operation, whole) in kinds.items():
            found = _between(_leaf(rows[name], operation), lo, hi, operation, whole)
            out = out.append_column(name, _stored(found, whole))
        return out

    rows = homes.withColumn("_own", F.col("_home") == F.col("_chunk")).select("_home", *names)
    schema = _with_parts(homes.select(*kept).schema, parts)
    return rows.groupBy("_home").applyInArrow(solve, schema)


def time_frames(timed: DataFrame, parts: Parts, keys: list[str], kept: list[str], micros: int, cuts: int) -> DataFrame:
    """Frames of the last ``micros`` before each row and the rows of its own time.

    ``timed`` has times ``_us`` (not null), which are cut into buckets, ``cuts`` to a frame, and parts.
    A row goes to its own bucket and to the one in which frames leave it behind, so a task holds one
    bucket of one key and the rows one frame earlier; of the buckets between, the parts are enough.
    Returns ``kept`` and the parts of the frame.
    """
    kinds = parts.kinds
    width = micros // cuts
    if width * cuts != micros:
        raise ValueError("a frame is a whole number of buckets")
    placed = timed.withColumn("_bucket", time_bucket(F.col("_us"), width))
    inner = {c: f"_c{i}" for i, c in enumerate(kept)}  # given columns may be called like ours
    given = [F.col(f"`{c}`").alias(n) for c, n in inner.items()]
    group = [F.col(f"`{k}`").alias(f"_g{i}") for i, k in enumerate(keys)]
    by = [*[f"_g{i}" for i in range(len(keys))], "_home"]
    rows = placed.select(*group, *given, "_us", *kinds, F.col("_bucket").alias("_home"))
    role = F.explode(F.array(F.lit(0), F.lit(1))).alias("_role")
    rows = rows.select("*", role).withColumns({n: F.when(F.col("_role") == 0, F.col(n)) for n in inner.values()})
    rows = rows.withColumn("_home", F.col("_home") + F.col("_role") * cuts)
    if cuts > 1:
        sums = placed.groupBy(*group, F.col("_bucket").alias("_home")).agg(*parts.merged())
        # every bucket that may need them: those with rows
        w = Window.partitionBy(*by[:-1]).orderBy("_home").rangeBetween(-(cuts - 1), -1)
        merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
        middle = sums.withColumns({p: merge[operation](p).over(w) for p, (operation, _) in kinds.items()})
        middle = middle.filter(F.col(next(iter(kinds))).isNotNull()).withColumn("_role", F.lit(2))
        rows = rows.unionByName(middle, allowMissingColumns=True)

    def solve(rows: pa.Table) -> pa.Table:
        role, us = rows["_role"].to_numpy(), rows["_us"].fill_null(0).to_numpy()
        own, gone, between = (np.flatnonzero(role == r) for r in range(3))
        own, gone = own[np.argsort(us[own], kind="stable")], gone[np.argsort(us[gone], kind="stable")]
        out = rows.select(list(inner.values())).take(pa.array(own))
        since = np.searchsorted(us[gone], us[own] - micros, "left")
        until = np.searchsorted(us[own], us[own], "right") - 1
        for name, (operation, whole) in kinds.items():
            step, leaf = _STEPS[operation], _leaf(rows[name], operation)
            ahead = np.append(step.accumulate(leaf[gone][::-1])[::-1], _nothing(operation, whole))
            found = ahead[since]
            for i in between:
                found = step(found, leaf[i])
            found = step(found, step.accumulate(leaf[own])[until]) if len(own) else found
            out = out.append_column(name, _stored(found, whole))
        return out

    schema = _with_parts(rows.select(*inner.values()).schema, parts)
    done = rows.groupBy(*by).applyInArrow(solve, schema)
    return done.select(*[F.col(n).alias(c) for c, n in inner.items()], *kinds)


def time_bucket(us: Column, width: int) -> Column:
    """The number of the bucket, in whole numbers."""
    return F.call_function("div", us - F.pmod(us, F.lit(width)), F.lit(width))


def fixed_width(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def over(spec: tuple[str, str | None], window) -> Column:
    """The same aggregate as a window function."""
    function, column = spec
    value = F.lit(1) if column is None else F.col(f"`{column}`")
    return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[function](value).over(window)


def same_all(pairs: list[tuple[Column, Column]]) -> Column:
    """All pairs equal, null to null."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs], F.lit(True))
