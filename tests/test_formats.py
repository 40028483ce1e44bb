"""Files that other programs read: round trips, and what their specifications fix."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailgrid.formats import geopackage, shape, sheet, tiff
from trailgrid.functions import geo
from trailgrid.operators import ud
from trailgrid.sinks import files, tables
from trailgrid.sources import tables as sources
from trailgrid.sources import vector

LINE = "id string, when timestamp_ntz, long_name_of_km double, LONG_NAME_of_n int, line array<struct<x:double,y:double>>"


@pytest.mark.parametrize("size", [0, 1, 5, 3000, 200_000])
def test_lzw_round_trip(size):
    rng = np.random.default_rng(size)
    for data in (rng.integers(0, 256, size, np.uint8).tobytes(), rng.integers(0, 3, size, np.uint8).tobytes(), b"\0" * size):
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_of_the_specification():
    # the example of the TIFF 6.0 text: 7 7 7 8 8 7 7 6 6 gives codes 256 7 258 8 8 258 6 6 257
    codes = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    want = bytes(int(codes[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(codes), 8))
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == want


def test_geotiff_is_a_tiff():
    values = np.arange(70 * 40, dtype="<f4").reshape(70, 40)
    data = tiff.write(values, 100.0, 900.0, 2.0, 3.0, 32613, -9999.0)
    back, about = tiff.read(data)
    assert (back == values).all() and about == {"minx": 100.0, "maxy": 900.0, "px_w": 2.0, "px_h": 3.0, "srid": 32613, "nodata": -9999.0}
    assert data[:4] == b"II*\0" and b"-9999\0" in data
    assert tiff.read(tiff.write(np.ones((3, 2), "u1"), 0, 0, 1, 1, 4326))[1]["srid"] == 4326


def test_rasters_of_surfaces(spark, tmp_path):
    grid = ud.Grid(0.0, 0.0, 40.0, 30.0, 3, 4, 10.0, 32613)
    cells = spark.createDataFrame([("a/b", 0, 1, 0.5), ("a/b", 2, 3, 0.25), ("c", 1, 1, 0.0)], "seq_id string, row int, col int, density double")
    assert files.write_geotiffs(cells, grid, str(tmp_path / "t"), key="seq_id") == 2
    values, about = tiff.read((tmp_path / "t" / "a_b.tif").read_bytes())
    assert values[0, 1] == 0.5 and values[2, 3] == 0.25 and (values == -9999).sum() == 10 and about["srid"] == 32613
    files.write_geotiffs(cells, grid, str(tmp_path / "m"), kind="uint8", name="mask")
    assert tiff.read((tmp_path / "m" / "mask.tif").read_bytes())[0].sum() == 3
    files.write_geotiffs(cells, grid, str(tmp_path / "n"), kind="count", name="n")
    assert (tiff.read((tmp_path / "n" / "n.tif").read_bytes())[0] > 0).sum() == 2


def lines(spark):
    a = [{"x": 400000.0, "y": 4400000.0}, {"x": 401000.0, "y": 4400500.0}, {"x": 402000.0, "y": 4400000.0}]
    rows = [("é1", dt.datetime(2024, 1, 2, 3, 4), 1.5, 7, a), ("b", None, None, None, a[:2]), ("none", None, 2.0, 1, None)]
    return spark.createDataFrame(rows, LINE)


@pytest.mark.parametrize("ending", ["shp", "gpkg"])
def test_layers_of_lines(spark, tmp_path, ending):
    path = str(tmp_path / f"lines.{ending}")
    assert files.write_layer(lines(spark), path, 32613) == 3
    got = vector.read_lines(spark, path, ["id", "long_name_"]).orderBy("id", "seg_no").collect()
    assert [(r["id"], r["seg_no"], r["x1"], r["y2"]) for r in got] == [("b", 0, 400000.0, 4400500.0), ("é1", 0, 400000.0, 4400500.0), ("é1", 1, 401000.0, 4400000.0)]
    rows = {r["id"]: r for r in vector.read_attributes(spark, path, ["id", "when", "long_name_", "LONG_NAME1", "no"]).collect()}
    assert rows["é1"]["when"] == "2024-01-02 03:04" and float(rows["é1"]["long_name_"]) == 1.5 and float(rows["é1"]["LONG_NAME1"]) == 7 and rows["b"]["long_name_"] is None and rows["none"]["no"] is None


@pytest.mark.parametrize("ending", ["shp", "gpkg"])
def test_layers_of_points_become_degrees(spark, tmp_path, ending):
    df = spark.createDataFrame([("a", -105.5, 40.25), ("b", -107.9, 37.0)], "LoclAID string, lon double, lat double")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), F.lit(13))
    utm = df.select("LoclAID", F.struct(x.alias("x"), y.alias("y")).alias("point"))
    path = str(tmp_path / f"p.{ending}")
    files.write_layer(utm, path, 32613)
    got = {r["LoclAID"]: (r["Long"], r["Lat"]) for r in sources.read_fixes(spark, path, ["LoclAID"]).collect()}
    assert got["a"] == pytest.approx((-105.5, 40.25), abs=1e-9) and got["b"] == pytest.approx((-107.9, 37.0), abs=1e-9)
    files.write_layer(df.select("LoclAID", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("point")), path)
    assert {r["LoclAID"]: r["Long"] for r in vector.read_points(spark, path, ["LoclAID"]).collect()} == {"a": -105.5, "b": -107.9}


def test_shapefile_headers():
    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    main, index = shape.write_shapes(shape.POLYGON, [[square], []])
    assert struct.unpack_from(">i", main)[0] == 9994 and 2 * struct.unpack_from(">i", main, 24)[0] == len(main) and 2 * struct.unpack_from(">i", index, 24)[0] == len(index)
    assert struct.unpack_from("<4d", main, 36) == (0, 0, 2, 2) and list(shape.read_shapes(main)) == [(5, [square]), (0, [])]
    names, rows = shape.read_table(shape.write_table(["a", "b", "c"], [(True, 2, "x" * 300), (None, None, None)]))
    assert names == ["a", "b", "c"] and list(rows) == [("T", "2", "x" * 254), ("?", None, None)]


def test_geopackage_is_one():
    import sqlite3

    data = geopackage.write("l", shape.POLYGON, ["n"], [(1,)], [[[(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)]]], 32613)
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    assert con.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47 and con.execute("SELECT max_x FROM gpkg_contents").fetchone()[0] == 1.0
    names, rows, shapes, srid = geopackage.read(data)
    assert (names, rows, srid) == (["n"], [(1,)], 32613) and shapes == [(5, [[(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)]])]


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame([("a<b>&", 1, 2.5, True, None), ("c", None, None, False, dt.date(2024, 1, 2))], "s string, i int, f double, b boolean, d date")
    files.write_workbook({"one": df, "two": df.limit(0)}, str(tmp_path / "w.xlsx"))
    got = sheet.read((tmp_path / "w.xlsx").read_bytes())
    assert got["one"][0] == ["s", "i", "f", "b", "d"] and got["one"][1][:4] == ["a<b>&", 1, 2.5, True] and got["one"][2] == ["c", None, None, False, "2024-01-02"] and got["two"] == [["s", "i", "f", "b", "d"]]
    assert sheet._column(27) == "AB"


def test_summaries(spark, tmp_path):
    df = spark.range(2).select("id", F.create_map(F.lit("a"), F.col("id")).alias("m"))
    files.write_summaries({"herd": df}, str(tmp_path), "Herd")
    assert spark.read.option("header", True).csv(str(tmp_path / "herd")).count() == 2 and sheet.read((tmp_path / "Herd.xlsx").read_bytes())["herd"][1][0] == 0


def test_projects(spark, tmp_path):
    df = spark.range(3)
    tables.save_project(spark, str(tmp_path / "p"), {"fixes": df, "windows": df.limit(1)}, {"herd": "D1"})
    back, settings = tables.load_project(spark, str(tmp_path / "p"))
    assert {n: t.count() for n, t in back.items()} == {"fixes": 3, "windows": 1} and settings == {"herd": "D1"}


def test_export_tree(spark, tmp_path):
    cells = spark.createDataFrame([("Spring", f"s{i}", i, j, 0.1) for i in range(9) for j in range(3)], "season string, seq_id string, row int, col int, density double")
    tables.export_all({}, cells, cells.drop("density"), {"m": spark.range(2)}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "UDs")).count() == 27 and len(list((tmp_path / "UDs" / "season=Spring").glob("*.parquet"))) <= 4
    assert spark.read.parquet(str(tmp_path / "Footprints")).select("value").distinct().first()[0] == 1
