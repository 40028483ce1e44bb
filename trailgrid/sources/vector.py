"""Shapefiles and GeoPackages: attributes alone, points with degrees, lines as segments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formats import geopackage, shape
from ..functions import geo


def _decoded(parts: dict[str, bytes]) -> tuple[list[str], list[tuple], list[tuple[int, list]], tuple[int, bool] | None]:
    """Names, rows as texts, shapes and UTM zone of one layer's files by ending."""
    if "gpkg" in parts:
        names, rows, shapes, srid = geopackage.read(parts["gpkg"])
        zone = (srid % 100, srid >= 32700) if 32601 <= srid <= 32760 else None
        return names, [tuple(None if v is None else str(v) for v in r) for r in rows], shapes, zone
    names, rows = shape.read_table(parts["dbf"])
    shapes = list(shape.read_shapes(parts["shp"])) if "shp" in parts else []
    rows = list(rows)
    return names, rows, shapes or [(0, [])] * len(rows), shape.zone_of(parts.get("prj", b"").decode("utf-8", "replace"))


def _layers(spark: SparkSession, path: str, endings: tuple[str, ...]) -> DataFrame:
    """``layer, ending, content`` of the files that make up the layers at ``path`` (a .shp or .gpkg file, or a folder)."""
    stem = path.rpartition(".")[0] if path.lower().endswith((".shp", ".gpkg")) else None
    files = spark.read.format("binaryFile").load(f"{stem}.*" if stem else path)
    name = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select(F.regexp_replace("path", r"\.[^./]+$", "").alias("layer"), name.alias("ending"), "content").where(name.isin(*endings))


def _read(spark: SparkSession, path: str, properties: list[str], geometry: bool) -> DataFrame:
    """A row a feature: properties as strings, and with ``geometry`` its kind, parts, and the UTM zone of its layer."""
    fields = ", ".join(f"`{p}` string" for p in properties)
    schema = f"{fields}, " * bool(properties) + "feature int" + ", kind int, parts array<array<struct<x:double,y:double>>>, zone int, south boolean" * geometry

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, rows, shapes, zone = _decoded(dict(zip(pdf["ending"], pdf["content"], strict=True)))
        at = {p: names.index(p) if p in names else None for p in properties}
        out = {p: [None if i is None else r[i] for r in rows] for p, i in at.items()} | {"feature": range(len(rows))}
        if geometry:
            out |= {"kind": [k for k, _ in shapes], "parts": [[[{"x": x, "y": y} for x, y in part] for part in parts] for _, parts in shapes], "zone": [zone[0] if zone else None] * len(rows), "south": [bool(zone and zone[1])] * len(rows)}
        return pd.DataFrame(out)

    endings = ("gpkg", "dbf", "shp", "prj") if geometry else ("gpkg", "dbf")
    return _layers(spark, path, endings).groupBy("layer").applyInPandas(one, schema)


def read_attributes(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """Properties alone; of a shapefile only the table is read, no geometry."""
    return _read(spark, path, properties, False).drop("feature")


def read_points(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """Point features: properties as strings, ``Long`` and ``Lat`` in degrees where no property gives them; UTM layers are turned into degrees."""
    rows = _read(spark, path, properties, True).where(F.col("kind") == shape.POINT)
    p = F.get(F.get("parts", F.lit(0)), F.lit(0))
    lon, lat = geo.from_utm(p["x"], p["y"], F.col("zone"), F.col("south"))
    place = {"Long": F.when(F.col("zone").isNull(), p["x"]).otherwise(lon), "Lat": F.when(F.col("zone").isNull(), p["y"]).otherwise(lat)}
    return rows.select(*properties, *[c.alias(n) for n, c in place.items() if n not in properties])


def read_lines(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """Line features as segments: properties, ``line_no, seg_no, x1, y1, x2, y2`` in the layer's own coordinates."""
    rows = _read(spark, path, properties, True).where(F.col("kind") == shape.LINE)
    parts = rows.select(*properties, F.col("feature").alias("line_no"), F.explode("parts").alias("p")).where("size(p) > 1")
    at = parts.withColumn("seg_no", F.explode(F.sequence(F.lit(0), F.size("p") - 2)))
    return at.select(*properties, "line_no", "seg_no", *[F.get("p", F.col("seg_no") + k)[c].alias(f"{c}{k + 1}") for k in (0, 1) for c in "xy"])


def is_layer(path: str) -> bool:
    return path.lower().endswith((".shp", ".gpkg"))
