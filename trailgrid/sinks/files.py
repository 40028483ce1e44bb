"""Rasters, vector layers and workbooks in the formats that other programs read.

A file is made whole by one task: rasters have their grid's size, layers and
sheets a row a sequence or season.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..formats import geopackage, shape, sheet, tiff
from ..formats.files import put, write_files
from ..functions import text
from ..operators.grouped import map_groups
from ..operators.ud import Grid
from .tables import NODATA, flat_fields, write_csv

#: Rows of a sheet, which the format bounds.
SHEET_ROWS = 1_048_575


def geotiffs(surface: DataFrame, grid: Grid, value: str = "density", key: str | None = None, kind: str = "float32", name: str = "raster") -> DataFrame:
    """``name, content``: a GeoTIFF a key (or one): ``float32`` with nodata -9999, ``uint8`` mask, ``count`` without zeros."""
    dtype = np.dtype({"float32": "<f4", "uint8": "u1", "count": "<f4"}[kind])
    rows = surface.select((text.file_token(F.col(key)) if key else F.lit(name)).alias("name"), "row", "col", (F.lit(1.0) if kind == "uint8" else F.col(value).cast("double")).alias("v"))

    def one(stem: str, c: dict[str, np.ndarray]) -> dict:
        values = np.full((grid.nrows, grid.ncols), 0 if kind == "uint8" else NODATA, dtype)
        use = ~np.isnan(c["v"]) & ((c["v"] > 0) if kind == "count" else True)
        values[c["row"][use].astype(int), c["col"][use].astype(int)] = c["v"][use]
        data = tiff.write(values, grid.minx, grid.maxy, grid.px_w, grid.px_h, grid.srid, None if kind == "uint8" else NODATA)
        return {"name": [f"{stem}.tif"], "content": [data]}

    return map_groups(rows, "name", ["row", "col"], one, "name string, content binary")


def write_geotiffs(surface: DataFrame, grid: Grid, folder: str, value: str = "density", key: str | None = None, kind: str = "float32", name: str = "raster") -> int:
    """Write ``geotiffs`` to a shared folder; the number of files."""
    return write_files(geotiffs(surface, grid, value, key, kind, name), folder)


def write_layer(shapes: DataFrame, path: str, srid: int | None = 4326) -> int:
    """A .shp (with .shx, .dbf and .prj) or .gpkg layer of rows with a ``line``, ``ring`` or ``point`` (x, y); the number of features.

    Attribute names are cut to ten different ones, times become text, nested
    columns go.
    """
    geometry = next(c for c in ("line", "ring", "point") if c in shapes.columns)
    kind = {"line": shape.LINE, "ring": shape.POLYGON, "point": shape.POINT}[geometry]
    attributes = flat_fields(shapes, keep=(geometry,))
    names = [c for c in attributes.columns if c != geometry]
    rows = attributes.withColumnRenamed(geometry, "_g")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, parts = [], []
        for frame in frames:
            own = frame[names].astype(object).where(frame[names].notna(), None) if names else frame[[]]
            values += [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in own.itertuples(index=False, name=None)] if names else [()] * len(frame)
            for g in frame["_g"]:
                points = [] if g is None else [(g["x"], g["y"])] if kind == shape.POINT else [(p["x"], p["y"]) for p in g]
                if kind == shape.POLYGON and points and points[0] != points[-1]:
                    points.append(points[0])
                parts.append([points] if points else [])
        stem, _, ending = path.rpartition(".")
        if ending.lower() == "gpkg":
            layer = stem.rpartition("/")[2] or "layer"
            put(path, geopackage.write(layer, kind, names, values, parts, srid or -1))
        else:
            main, index = shape.write_shapes(kind, parts)
            for end, data in (("shp", main), ("shx", index), ("dbf", shape.write_table(names or ["id"], values if names else [(i,) for i in range(len(parts))])), ("prj", (shape.projection(srid) or "").encode())):
                if data:
                    put(f"{stem}.{end}", data)
        yield pd.DataFrame({"n": [len(parts)]})

    return rows.repartition(1).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """One .xlsx with a sheet a table; summaries, whose size the format bounds."""
    sheets = {}
    for name, df in tables.items():
        rows = df.limit(SHEET_ROWS + 1).collect()
        if len(rows) > SHEET_ROWS:
            raise ValueError(f"{name} has more rows than a sheet holds")
        plain = (int, float, bool, str, type(None))
        sheets[name] = df.columns, [tuple(v if isinstance(v, plain) else str(v) for v in r) for r in rows]
    put(path, sheet.write(sheets))


def write_summaries(tables: dict[str, DataFrame], folder: str, name: str = "summary") -> None:
    """Each table as one CSV, and all of them as the sheets of one workbook."""
    for table, df in tables.items():
        flat = df.select([F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(("array", "map", "struct")) else F.col(f"`{f.name}`") for f in df.schema.fields])
        write_csv(flat, f"{folder}/{table}")
    write_workbook(tables, f"{folder}/{name}.xlsx")
