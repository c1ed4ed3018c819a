"""Files: CSV rules, Arrow and JSON copies, blobs, NetCDF and TIFF layouts."""

import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlake import open_frame
from gridlake.operators import arrays, profile
from gridlake.sources import blobs, files, netcdf, registry, tables, tiff
from gridlake.streaming import chunks


def test_csv_cells(spark, folder):
    with open(f"{folder}/t.csv", "w") as f:
        f.write('a,g,v\n,x,NaN\n2,,1.5\n3,"say ""hi"", you",\n')
    frame = open_frame(spark, f"{folder}/t.csv")
    assert [tuple(r) for r in frame.ordered.collect()] == [
        (None, "x", None), (2, "", 1.5), (3, 'say "hi", you', None)]
    assert frame.schema["a"].dataType.simpleString() == "bigint"
    assert registry.count_path(spark, f"{folder}/t.csv") == 3
    summary = {r["column"]: r for r in registry.sample_path(spark, f"{folder}/t.csv").collect()}
    assert summary["a"]["values"] == [None, "2", "3"] and summary["v"]["total_count"] == 3


def test_csv_order_over_splits(spark, folder):
    with open(f"{folder}/big.csv", "w") as f:
        f.write("i\n" + "\n".join(str(i) for i in range(20000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        frame = tables.read_csv(spark, f"{folder}/big.csv", "i BIGINT")
        assert frame.df.rdd.getNumPartitions() > 4
        assert frame.df.where("i <> _row").count() == 0 and frame.num_rows == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("suffix", [".csv", ".arrow", ".json", ".parquet"])
def test_copies(spark, sf_dir, folder, suffix):
    source = tables.read_parquet(spark, f"{sf_dir}/events.parquet").sort("value")
    path = f"{folder}/copy{suffix}"
    source.write(path)
    if suffix == ".json":
        copy = tables.read_json(spark, path, source.schema)
    elif suffix == ".csv":
        copy = tables.read_csv(spark, path, source.schema)
    else:
        copy = open_frame(spark, path)
    assert copy.column("event_id") == source.column("event_id")
    diff = profile.roundtrip_diff(source.data, copy.data, ["event_id"], ["ts", "user_id", "event_type", "value", "props"])
    assert [tuple(r) for r in diff.collect()] == [("equal", 1000)]


def test_unknown_formats(spark, folder):
    with pytest.raises(ValueError):
        open_frame(spark, f"{folder}/x.xml")
    frame = tables.read_parquet(spark, "/root/testdata/sf0.001/nation.parquet")
    with pytest.raises(ValueError):
        frame.write(f"{folder}/x.unknown")
    with pytest.raises(NotImplementedError):
        frame.write(f"{folder}/x", format="hdf5")


def test_blobs(spark, folder):
    import os

    os.makedirs(f"{folder}/d/sub")
    contents = {"d/a.bin": b"x" * 1000, "d/sub/b.TXT": b"hello", "d/empty": b"", "d/.DS_Store": b"no"}
    for name, data in contents.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    frame = open_frame(spark, f"{folder}/d")
    assert frame.column_names == files.DIRECTORY_COLUMNS
    rows = {r["name"]: r for r in frame.collect_blob().data.collect()}
    assert {n: bytes(r["blob"]) for n, r in rows.items()} == {
        "a.bin": b"x" * 1000, "b.TXT": b"hello", "empty": b""}
    assert rows["b.TXT"]["suffix"] == "txt" and rows["a.bin"]["size"] == 1000
    assert frame.sort("name").row(0)["blob"] == b""
    missing = spark.createDataFrame([("/nowhere/x", None)], "path string, blob binary")
    assert blobs.load_blobs(missing).first()["blob"] is None
    parts = blobs.load_chunks(frame.data, chunk_bytes=300).where("path LIKE '%a.bin'").orderBy("chunk_no").collect()
    assert [(r["chunk_offset"], r["chunk_length"]) for r in parts] == [(0, 300), (300, 300), (600, 300), (900, 100)]
    assert b"".join(bytes(r["bytes"]) for r in parts) == contents["d/a.bin"]
    assert registry.count_path(spark, f"{folder}/d") is None
    listed = files.folder_listing(spark, folder).select("dataset", "relative_path").collect()
    assert sorted(tuple(r) for r in listed) == [("d", "/d/a.bin"), ("d", "/d/empty"), ("d", "/d/sub/b.TXT")]


def test_chunk_plan_edges(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 10), ("d", 11)], "p string, size bigint")
    got = chunks.chunk_plan(df, chunk_bytes=10).select("p", "chunk_no", "chunk_offset", "chunk_length")
    assert sorted(tuple(r) for r in got.collect()) == [("b", 0, 0, 1), ("c", 0, 0, 10), ("d", 0, 0, 10), ("d", 1, 10, 1)]


# -- NetCDF ----------------------------------------------------------------------
def name(text):
    raw = text.encode()
    return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def classic_file(path, dims, variables, records=None, version=1):
    """A classic file written field by field: ``variables`` are (name, dim ids, attrs, code, array)."""
    codes = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
    is_record = [bool(ids) and dims[ids[0]][1] == 0 for _, ids, *_ in variables]
    raw = [np.asarray(a).astype(codes[c]) for *_, c, a in variables]

    def pad(b):
        return b + b"\0" * (-len(b) % 4)

    def header(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">I", records if records is not None else 0)
        out += struct.pack(">II", 10, len(dims)) + b"".join(name(n) + struct.pack(">I", s) for n, s in dims)
        out += struct.pack(">II", 12, 1) + name("title") + struct.pack(">II", 2, 4) + b"test"
        out += struct.pack(">II", 11, len(variables))
        for (n, ids, attrs, code, _), begin in zip(variables, begins):
            out += name(n) + struct.pack(">I", len(ids)) + b"".join(struct.pack(">I", i) for i in ids)
            out += struct.pack(">II", 12, len(attrs)) if attrs else struct.pack(">II", 0, 0)
            for a, (kind, value) in attrs.items():
                body = value.encode() if kind == 2 else struct.pack(codes[kind].replace("i2", "h").replace("f4", "f"), value)
                out += name(a) + struct.pack(">II", kind, len(body) if kind == 2 else 1) + pad(body)
            out += struct.pack(">II", code, 0) + (struct.pack(">I", begin) if version == 1 else struct.pack(">q", begin))
        return out

    at = len(header([0] * len(variables)))
    begins, fixed = [], b""
    for data, rec in zip(raw, is_record):
        begins.append(at + len(fixed) if not rec else 0)
        if not rec:
            fixed += pad(data.tobytes())
    at += len(fixed)
    lone = sum(is_record) == 1
    offset = 0
    for i, (data, rec) in enumerate(zip(raw, is_record)):
        if rec:
            begins[i] = at + offset
            part = data[:1].tobytes()
            offset += len(part if lone else pad(part))
    body = b""
    n = max((len(d) for d, rec in zip(raw, is_record) if rec), default=0)
    for r in range(n):
        for data, rec in zip(raw, is_record):
            if rec:
                part = data[r : r + 1].tobytes()
                body += part if lone else pad(part)
    with open(path, "wb") as f:
        f.write(header(begins) + fixed + body)


@pytest.fixture()
def arrays_file(folder):
    """Four variables of 1 to 4 dimensions with a fill value, after the array fixtures."""
    var1 = np.arange(12, dtype="f4").reshape(4, 3)
    var2 = np.arange(24, dtype="i2").reshape(2, 4, 3)
    var2[0, 0, 0] = -9999
    var3 = np.linspace(0, 1, 4)
    var4 = np.arange(5 * 2 * 4 * 3, dtype="i1").reshape(5, 2, 4, 3)
    dims = [("x", 4), ("y", 3), ("z", 2), ("t", 5)]
    variables = [
        ("var1", [0, 1], {"units": (2, "m")}, 5, var1),
        ("var2", [2, 0, 1], {"_FillValue": (3, -9999)}, 3, var2),
        ("var3", [0], {}, 6, var3), ("var4", [3, 2, 0, 1], {}, 1, var4), ("scalar", [], {}, 4, np.int32(7)),
    ]
    path = f"{folder}/grid.nc"
    classic_file(path, dims, variables)
    return path, {"var1": var1, "var2": var2, "var3": var3, "var4": var4}


def test_netcdf_header(spark, arrays_file):
    path, data = arrays_file
    meta = {r["var"]: r for r in netcdf.var_meta(spark, path).collect()}
    assert set(meta) == set(data)
    assert meta["var2"]["shape"] == [2, 4, 3] and meta["var2"]["dims"] == ["z", "x", "y"]
    assert meta["var2"]["fill"] == -9999 and meta["var1"]["attrs"] == {"units": "m"}
    assert meta["var4"]["dtype"] == "int8" and meta["var3"]["global_attrs"] == {"title": "test"}
    assert registry.count_path(spark, path) == 120


@pytest.mark.parametrize("range_bytes", [16, 1 << 20])
def test_netcdf_cells(spark, arrays_file, range_bytes):
    path, data = arrays_file
    cells = netcdf.read_cells(spark, path, range_bytes=range_bytes)
    for var, want in data.items():
        got = [r[0] for r in cells.where(F.col("var") == var).orderBy("pos").select("value").collect()]
        assert got == want.flatten().astype(float).tolist()


def test_netcdf_frame_and_sample(spark, arrays_file):
    path, data = arrays_file
    frame = open_frame(spark, path)
    assert frame.column_names == ["var1", "var2", "var3", "var4"] and frame.num_rows == 120
    assert frame.row(1)["var2"] == 1.0 and frame.row(30)["var1"] is None
    sample = netcdf.sample_frame(spark, path).ordered.collect()
    assert len(sample) == 20 and sample[0]["var2"] == -9999 and sample[19]["var2"] == 19
    assert math.isnan(sample[12]["var1"]) and sample[11]["var1"] == 11
    summary = {r["column"]: r for r in registry.sample_path(spark, path).collect()}
    assert summary["var3"]["values"][4] == "NaN" and summary["var3"]["total_count"] == 120


@pytest.mark.parametrize("version, records", [(1, 5), (2, 0xFFFFFFFF)])
def test_netcdf_records(spark, folder, version, records):
    """Interleaved record variables of uneven width, with a known or an open record count."""
    a = np.arange(15, dtype="i2").reshape(5, 3)
    b = np.arange(5, dtype="f8") / 2
    c = np.array([list(b"ab"), list(b"cd"), list(b"ef"), list(b"gh"), list(b"ij")], "u1").view("S1")
    dims = [("t", 0), ("w", 3), ("n", 2)]
    variables = [("a", [0, 1], {}, 3, a), ("b", [0], {}, 6, b), ("c", [0, 2], {}, 2, c)]
    classic_file(f"{folder}/r.nc", dims, variables, records, version)
    for range_bytes in (2, 4, 1 << 20):
        cells = netcdf.read_cells(spark, f"{folder}/r.nc", range_bytes=max(range_bytes, 8)).orderBy("var", "pos").collect()
        assert [r["value"] for r in cells if r["var"] == "a"] == a.flatten().tolist()
        assert [r["value"] for r in cells if r["var"] == "b"] == b.tolist()
        assert "".join(r["text"] for r in cells if r["var"] == "c") == "abcdefghij"


def test_netcdf_lone_record_variable_is_not_padded(spark, folder):
    a = np.arange(7, dtype="i1").reshape(7, 1)
    classic_file(f"{folder}/l.nc", [("t", 0), ("w", 1)], [("a", [0, 1], {}, 1, a)], 7)
    assert [r["value"] for r in netcdf.read_cells(spark, f"{folder}/l.nc").orderBy("pos").collect()] == list(range(7))


def test_netcdf_written_records(spark, folder):
    df = spark.createDataFrame(
        [(i, float(i) / 4 if i % 5 else None, [float(i)] * 6, i % 100) for i in range(50)],
        "id bigint, v double, g array<float>, s smallint")
    rows = netcdf.write_records(
        df, f"{folder}/out", shapes={"g": (2, 3)}, attrs={"v": {"units": "K"}}, global_attrs={"history": "made"})
    assert rows == 50
    meta = netcdf.var_meta(spark, f"{folder}/out").where("var = 'g'").collect()
    assert {tuple(m["shape"][1:]) for m in meta} == {(2, 3)} and sum(m["shape"][0] for m in meta) == 50
    cells = netcdf.read_cells(spark, f"{folder}/out")
    assert cells.where("var = 'id'").agg(F.sum("value")).first()[0] == sum(range(50))
    assert cells.where("var = 'v' AND isnan(value)").count() == 10
    assert cells.where("var = 'g'").count() == 300 and cells.where("var = 's'").count() == 50
    with pytest.raises(TypeError):
        netcdf.write_records(df.select(F.lit("x").alias("t")), f"{folder}/no")


def test_frame_written_as_netcdf(spark, folder):
    frame = tables.read_parquet(spark, "/root/testdata/sf0.001/supplier.parquet").select("s_suppkey", "s_acctbal")
    frame.write(f"{folder}/s.nc")
    cells = netcdf.read_cells(spark, f"{folder}/s.nc", ["s_acctbal"])
    assert cells.agg(F.round(F.sum("value"), 2)).first()[0] == round(frame.sum("s_acctbal"), 2)


def test_netcdf_folder_keeps_every_row(spark, folder):
    df = spark.range(0, 1000, 1, 4).select(F.col("id").cast("double").alias("v"))
    netcdf.write_records(df, f"{folder}/rows.nc")
    assert netcdf.var_meta(spark, f"{folder}/rows.nc").select("file").distinct().count() >= 4
    again = netcdf.open_cells(spark, f"{folder}/rows.nc")
    assert netcdf.count_rows(spark, f"{folder}/rows.nc").first()[0] == 1000
    assert [r["v"] for r in again.ordered.select("v").collect()] == [float(i) for i in range(1000)]


def test_tiff_folder_keeps_every_pixel(spark, folder):
    for i in range(3):
        tiff_file(f"{folder}/p{i}.tif", [np.full((2, 3), i, dtype="u1")])
    again = tiff.open_cells(spark, folder)
    assert tiff.count_rows(spark, folder).first()[0] == 18
    assert [r[0] for r in again.ordered.select("page1_band1").collect()] == [0.0] * 6 + [1.0] * 6 + [2.0] * 6


# -- TIFF ------------------------------------------------------------------------
def tiff_file(path, pages, order="<", planar=1, rows_per_strip=None):
    """Uncompressed pages, strips first and directory after them."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    links = [4]
    for page in pages:
        samples = 1 if page.ndim == 2 else (page.shape[2] if planar == 1 else page.shape[0])
        height, width = page.shape[:2] if page.ndim == 2 or planar == 1 else page.shape[1:]
        data = page.astype(page.dtype.newbyteorder(order))
        step = rows_per_strip or height
        planes = [data] if page.ndim == 2 or planar == 1 else list(data)
        offsets, sizes = [], []
        for plane in planes:
            for r in range(0, height, step):
                raw = plane[r : r + step].tobytes()
                offsets.append(len(out))
                sizes.append(len(raw))
                out += raw
        places = []
        for values in (offsets, sizes):
            places.append(len(out))
            out += struct.pack(order + "I" * len(values), *values)
        kind = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        entries = [
            (256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, page.dtype.itemsize * 8), (259, 3, 1, 1),
            (273, 4, len(offsets), offsets[0] if len(offsets) == 1 else places[0]), (277, 3, 1, samples),
            (278, 4, 1, step), (279, 4, len(sizes), sizes[0] if len(sizes) == 1 else places[1]),
            (284, 3, 1, planar), (339, 3, 1, kind),
        ]
        struct.pack_into(order + "I", out, links[-1], len(out))
        out += struct.pack(order + "H", len(entries))
        for tag, code, count, value in entries:
            packed = struct.pack(order + "HH", value, 0) if code == 3 else struct.pack(order + "I", value)
            out += struct.pack(order + "HHI", tag, code, count) + packed
        links.append(len(out))
        out += struct.pack(order + "I", 0)
    with open(path, "wb") as f:
        f.write(out)


def grid(cells, page, band):
    rows = cells.where((F.col("page") == page) & (F.col("band") == band)).orderBy("pos").select("value").collect()
    return [r[0] for r in rows]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("step", [None, 3])
def test_tiff_pages(spark, folder, order, step):
    pages = [np.arange(64, dtype="u1").reshape(8, 8), np.arange(48, dtype="f4").reshape(6, 8) / 8]
    tiff_file(f"{folder}/p.tif", pages, order, rows_per_strip=step)
    cells = tiff.read_cells(spark, f"{folder}/p.tif")
    assert grid(cells, 1, 1) == pages[0].flatten().tolist() and grid(cells, 2, 1) == pages[1].flatten().tolist()
    frame = open_frame(spark, f"{folder}/p.tif")
    assert frame.column_names == ["page1_band1", "page2_band1"] and frame.num_rows == 64
    assert frame.row(50)["page2_band1"] is None
    assert registry.count_path(spark, f"{folder}/p.tif") == 64


@pytest.mark.parametrize("planar", [1, 2])
def test_tiff_bands(spark, folder, planar):
    image = np.arange(8 * 8 * 3, dtype="u2").reshape((8, 8, 3) if planar == 1 else (3, 8, 8))
    tiff_file(f"{folder}/b.tiff", [image], planar=planar, rows_per_strip=5)
    cells = tiff.read_cells(spark, f"{folder}/b.tiff")
    for band in range(3):
        want = image[:, :, band] if planar == 1 else image[band]
        assert grid(cells, 1, band + 1) == want.flatten().tolist()
    sample = tiff.sample_frame(spark, f"{folder}/b.tiff")
    assert sample.column_names == ["page1_band1", "page1_band2", "page1_band3"] and sample.num_rows == 20
    want = (image[:, :, 1] if planar == 1 else image[1]).flatten()[:20].tolist()
    assert sample["page1_band2"] == want


def test_tiff_written_pages(spark, folder, monkeypatch):
    monkeypatch.setattr(tiff, "ROLL_BYTES", 1500)
    df = spark.createDataFrame([([float(i)] * 12,) for i in range(40)], "g array<float>").coalesce(2)
    assert tiff.write_pages(df, f"{folder}/t", 3, 4) == 40
    cells = tiff.read_cells(spark, f"{folder}/t")
    assert cells.count() == 480 and cells.agg(F.sum("value")).first()[0] == 12 * sum(range(40))
    assert cells.select("file").distinct().count() > 2


def test_unsupported_rasters(spark, folder):
    page = np.zeros((4, 4), "u1")
    tiff_file(f"{folder}/c.tif", [page])
    raw = bytearray(open(f"{folder}/c.tif", "rb").read())
    at = raw.index(struct.pack("<HHI", 259, 3, 1)) + 8
    raw[at] = 5
    open(f"{folder}/c.tif", "wb").write(raw)
    with pytest.raises(Exception, match="not supported"):
        tiff.read_cells(spark, f"{folder}/c.tif").count()


# -- arrays ----------------------------------------------------------------------
@pytest.mark.parametrize("shape, columns", [
    ((3, 8, 8), {(1, 1): 64, (1, 2): 64, (1, 3): 64}), ((8, 8), {(1, 1): 64}), ((8, 8, 3), {(1, 1): 64, (1, 2): 64, (1, 3): 64}),
    ((2, 2, 2, 2), {(1, 0): 8, (2, 0): 8}), ((5, 8, 8), {(p, 1): 64 for p in range(1, 6)}), ((7,), {(1, 0): 7}),
    ((2, 3, 6, 6), {(p, b): 36 for p in (1, 2) for b in (1, 2, 3)}),
])
def test_band_shapes(spark, shape, columns):
    data = np.arange(int(np.prod(shape)))
    raster = spark.createDataFrame([(list(shape), data.tolist())], "shape array<bigint>, data array<int>")
    planned = arrays.band_plan(raster).select("page_cells", "layout", "plane", F.posexplode("data").alias("pos", "value"))
    got = {}
    for r in arrays.split_bands(planned).orderBy("band_pos").collect():
        got.setdefault((r["page"], r["band"]), []).append(r["value"])
    assert {k: len(v) for k, v in got.items()} == columns
    image = data.reshape(shape)
    if shape == (8, 8, 3):
        assert got[(1, 2)] == image[:, :, 1].flatten().tolist()
    if shape == (3, 8, 8):
        assert got[(1, 3)] == image[2].flatten().tolist()
    if shape == (2, 3, 6, 6):
        assert got[(2, 2)] == image[1, 1].flatten().tolist()


def test_chunk_rows_rule(spark):
    shapes = [[1000, 720, 1440], [100], [10, 8, 8], [3000000, 2]]
    meta = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "i int, shape array<bigint>")
    plan = arrays.chunk_plan(meta).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum("row_count").alias("rows"))
    got = {r["i"]: (r["n"], r["rows"]) for r in plan.collect()}
    assert got == {0: (100, 1000), 1: (1, 100), 2: (1, 10), 3: (5, 3000000)}


def test_flatten_and_rebuild(spark):
    data = list(range(45))
    df = spark.createDataFrame([("a", data)], "var string, data array<int>")
    cells = arrays.flatten(df, "data", ["var"]).repartition(7)
    chunk = arrays.rebuild_chunks(cells, ["var"], 10).orderBy("chunk_no").collect()
    assert [v for c in chunk for v in c["values"]] == data and max(len(c["values"]) for c in chunk) == 10


def test_arrow_schema_is_kept(spark, folder):
    df = spark.createDataFrame([(1, "a", b"x", [1.5])], "i int, s string, b binary, l array<double>")
    from gridlake.sources.writers import write_arrow

    assert write_arrow(df, f"{folder}/a") == 1
    back = tables.read_arrow(spark, f"{folder}/a")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert isinstance(next(back.get_stream()), pa.RecordBatch)


def test_workspace(spark, folder):
    import os

    from gridlake import Workspace

    os.makedirs(f"{folder}/alpha/deep")
    os.makedirs(f"{folder}/beta")
    with open(f"{folder}/alpha/deep/t.csv", "w") as f:
        f.write("a,b\n1,x\n2,y\n")
    with open(f"{folder}/beta/raw.bin", "wb") as f:
        f.write(bytes(range(256)) * 5)
    space = Workspace(spark, folder)
    assert sorted(r[0] for r in space.list_datasets().collect()) == ["alpha", "beta"]
    assert [r[0] for r in space.list_dataframes("alpha").collect()] == [f"{folder}/alpha/deep/t.csv"]
    uri = "data://host:1/alpha/alpha/deep/t.csv"
    assert space.open(uri)["a"] == [1, 2] and space.count(uri) == 2
    assert {r["column"] for r in space.sample(uri).collect()} == {"a", "b"}
    parts = list(space.download(f"{folder}/beta/raw.bin", 300))
    assert [len(p) for p in parts] == [300, 300, 300, 300, 80] and b"".join(parts) == bytes(range(256)) * 5
    with pytest.raises(ValueError):
        space.resolve("data://host/alpha")
