"""Results are whole or an error: byte ranges, inferred types."""

import pytest

from gridlake.frame import Frame
from gridlake.sources import blobs


def test_short_and_missing_files_fail(spark, tmp_path):
    path = tmp_path / "a.bin"
    path.write_bytes(b"0123456789")
    whole = spark.createDataFrame([(str(path), 10)], "path string, size long")
    assert [bytes(r["bytes"]) for r in blobs.load_chunks(whole, chunk_bytes=4).orderBy("chunk_no").collect()] == [b"0123", b"4567", b"89"]
    for name, size in ((str(path), 100), (str(tmp_path / "none.bin"), 5)):
        with pytest.raises(Exception, match="expected"):
            blobs.load_chunks(spark.createDataFrame([(name, size)], "path string, size long")).collect()


@pytest.mark.parametrize("late", ["fraction", "text"])
def test_values_that_do_not_fit_raise(spark, late):
    def func(value):
        return [value if value < 150 else value + 0.5 if late == "fraction" else str(value)]

    frame = Frame(spark.range(300), order=[])
    with pytest.raises(Exception, match="does not fit"):
        frame.map("id", func, "y").data.collect()


def test_lists_that_fit_pass(spark):
    frame = Frame(spark.range(300), order=[])
    got = {r["id"]: r["y"] for r in frame.map("id", lambda v: [v, None] if v % 2 else [], "y").data.collect()}
    assert got == {i: [i, None] if i % 2 else [] for i in range(300)}
