"""GeoJSON features: whole collections and line-delimited files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _features(spark: SparkSession, path: str) -> DataFrame:
    """A column ``f`` with each feature's text."""
    lines = spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "doc")
    collection = F.from_json("doc", "features array<string>")["features"]
    one = F.filter(F.split("doc", "\n"), lambda x: F.trim(x) != "")
    return lines.select(F.explode(F.when(F.get_json_object("doc", "$.type") == "FeatureCollection", collection).otherwise(one)).alias("f"))


def read_points(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """Point features: the named properties as strings, ``Long`` and ``Lat`` from the geometry where no property gives them."""
    f = _features(spark, path).where(F.get_json_object("f", "$.geometry.type") == "Point")
    props = [F.get_json_object("f", f"$.properties.{p}").alias(p) for p in properties]
    place = [F.get_json_object("f", f"$.geometry.coordinates[{i}]").alias(c) for i, c in enumerate(("Long", "Lat")) if c not in properties]
    return f.select(*props, *place)


def read_attributes(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """Properties alone; geometry is not parsed."""
    return _features(spark, path).select(*[F.get_json_object("f", f"$.properties.{p}").alias(p) for p in properties])


def read_lines(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """Line features as segments: properties, ``line_no, seg_no, x1, y1, x2, y2``."""
    f = _features(spark, path).withColumn("line_no", F.monotonically_increasing_id())
    single = F.from_json(F.get_json_object("f", "$.geometry.coordinates"), "array<array<double>>")
    several = F.from_json(F.get_json_object("f", "$.geometry.coordinates"), "array<array<array<double>>>")
    kind = F.get_json_object("f", "$.geometry.type")
    parts = F.when(kind == "LineString", F.array(single)).when(kind == "MultiLineString", several)
    rows = f.select(*[F.get_json_object("f", f"$.properties.{p}").alias(p) for p in properties], "line_no", F.explode(parts).alias("p")).where("size(p) > 1")
    at = rows.withColumn("seg_no", F.explode(F.sequence(F.lit(0), F.size("p") - 2)))
    return at.select(*properties, "line_no", "seg_no", *[F.get(F.get("p", F.col("seg_no") + k), F.lit(i)).alias(f"{c}{k + 1}") for k in (0, 1) for i, c in enumerate("xy")])
