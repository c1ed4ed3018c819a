"""Files of a scan in row order, so that positions are looked up before files are read.

Rows of a scan are numbered file by file.  ``ScanFiles`` learns the row counts of as many leading
files as a question needs (Parquet tells them in its footers, text has to be read), a doubling
number of files per job, and opens only the files that hold the wanted positions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.operators.rowindex import ROW

#: rows that a text scan may hand to the driver to find out what its first lines are
HEAD_ROWS = 10_000
#: files that are read one by one for that
HEAD_FILES = 16
#: a search for matching rows gives up on narrowing after this share of the files
SEARCH_SHARE = 0.25


def _name(path: str) -> str:
    """One spelling: a local file has one slash or three after its scheme."""
    scheme, colon, rest = path.partition(":")
    return unquote(f"{scheme}:/{rest.lstrip('/')}" if colon else path)


class ScanFiles:
    """The files of one scan.

    ``read`` opens the given paths, or all for None, as a plain scan; ``number`` adds the row
    positions among the files that were opened, ``finish`` the form in which columns are shown.
    ``lines`` marks a text scan: its files have no row counts of their own, its first rows are found
    by reading just those.
    """

    def __init__(
        self, read: Callable[[list[str] | None], DataFrame], number: Callable[[DataFrame], DataFrame],
        finish: Callable[[DataFrame], DataFrame] = lambda df: df, lines: bool = False,
    ):
        self.read, self.finish, self.lines = read, finish, lines
        self.number = lambda df: finish(number(df))
        self._files: list[str] | None = None
        self.counts: list[int] = []

    @property
    def files(self) -> list[str]:
        if self._files is None:
            self._files = sorted(self.read(None).inputFiles())
        return self._files

    def _open(self, low: int, high: int) -> DataFrame:
        return self.read([unquote(f) for f in self.files[low:high]])

    def _learn(self, rows: int) -> None:
        """Row counts of leading files until they hold ``rows`` rows."""
        step = max(1, len(self.counts))
        while len(self.counts) < len(self.files) and sum(self.counts) < rows:
            low, high = len(self.counts), min(len(self.counts) + step, len(self.files))
            found = self._open(low, high).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"))
            known = {_name(r["f"]): r["n"] for r in found.collect()}  # one row per file, as the listing
            self.counts += [known.get(_name(f), 0) for f in self.files[low:high]]
            step *= 2

    def covering(self, offset: int, length: int | None) -> DataFrame | None:
        """A numbered scan of the files that hold positions ``offset`` and on, or None if that is all."""
        if len(self.files) < 2:
            return None
        if length is None and not offset:
            return None
        self._learn(offset + 1 if length is None else offset + length)
        ends = list(accumulate(self.counts))
        low = next((i for i, end in enumerate(ends) if end > offset), len(ends))
        high = len(self.files)
        if length is not None:
            high = 1 + next((i for i, end in enumerate(ends) if end >= offset + length), high - 1)
        if low >= len(self.files):
            low = len(self.files) - 1  # past the end: one file shows that
        if (low, high) == (0, len(self.files)):
            return None
        base = sum(self.counts[:low])
        return self.number(self._open(low, max(high, low + 1))).withColumn(ROW, F.col(ROW) + base)

    def head(self, rows: int) -> DataFrame | None:
        """The first rows of a text scan, from its first lines: files in order, each read until it
        has given enough.  Rows of one file arrive split by split, so the first ones come first."""
        if not self.lines or rows > HEAD_ROWS:
            return None
        scan, parts, base = self.read(None), [], 0
        for i in range(min(len(self.files), HEAD_FILES)):
            part = self._open(i, i + 1).limit(rows - base).toArrow()
            parts.append(part.append_column(ROW, pa.array(range(base, base + part.num_rows), pa.int64())))
            base += part.num_rows
            if base == rows or i + 1 == len(self.files):
                first = pa.concat_tables(parts).combine_chunks()
                return self.finish(scan.sparkSession.createDataFrame(first, T.StructType([*scan.schema.fields, T.StructField(ROW, T.LongType())])))
        return None  # many small files: they are numbered in one job

    def leading(self, steps: Sequence[Callable[[DataFrame], DataFrame]], rows: int) -> DataFrame | None:
        """A numbered scan of the leading files in which ``steps`` keep ``rows`` rows, or None."""
        high = 1
        while high <= SEARCH_SHARE * len(self.files):
            found = self.number(self._open(0, high))
            for step in steps:
                found = step(found)
            if found.limit(rows).count() >= rows:
                return self.number(self._open(0, high))
            high *= 4
        return None
