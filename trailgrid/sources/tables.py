"""Scans of tabular files as strings; types are given later by tolerant casts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import vector


def read_fixes(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV (all columns as strings, so one odd value spoils no column), Parquet, ORC, or a layer of points, by the path's ending.

    Of a layer (.shp, .gpkg) ``columns`` names the attributes; ``Long`` and
    ``Lat`` in degrees are added where they are missing.
    """
    if vector.is_layer(path):
        if columns is None:
            raise ValueError("name the attributes of a layer")
        return vector.read_points(spark, path, columns)
    if path.endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    elif path.endswith(".orc"):
        df = spark.read.orc(path)
    else:
        df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.select(*columns) if columns else df


def preview(df: DataFrame, page: int = 0, size: int = 25, order: str | None = None) -> DataFrame:
    """One page of rows; ordered pages of a table don't overlap."""
    return (df.orderBy(order) if order else df).offset(page * size).limit(size)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first path that exists, if any does."""
    return next((c for c in candidates if exists(spark, c)), None)


def read_roads(spark: SparkSession, path: str, category: str = "all") -> DataFrame:
    """Road segments of the known classes: all, ``roads`` or ``highways``; the filter is pushed to the scan."""
    from ..operators.enrich import HIGHWAYS, ROADS

    classes = {"roads": ROADS, "highways": HIGHWAYS}.get(category, (*ROADS, *HIGHWAYS))
    df = spark.read.parquet(path)
    return df.where(df["mtfcc"].isin(*classes))


def read_snow(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """``date, row, col, depth, swe`` of a table partitioned by date (yyyyMMdd); other days than asked for aren't read."""
    df = spark.read.parquet(path)
    df = df.withColumn("date", df["date"].cast("string"))
    for edge, keep in ((first, df["date"] >= first), (last, df["date"] <= last)):
        df = df.where(keep) if edge else df
    return df.select("date", "row", "col", "depth", "swe")


def read_model_outputs(spark: SparkSession, ud_path: str, metadata_path: str | None = None, footprint_path: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Stored UDs with their sequence's metadata by left join, and footprints if they are there."""
    uds = spark.read.parquet(ud_path)
    if metadata_path and exists(spark, metadata_path):
        meta = spark.read.option("header", True).csv(metadata_path)
        name = next((c for c in ("seq_id", "sequence", "seq_name") if c in meta.columns), None)
        if name:
            uds = uds.join(meta.withColumnRenamed(name, "seq_id").dropDuplicates(["seq_id"]), "seq_id", "left")
    return uds, spark.read.parquet(footprint_path) if footprint_path and exists(spark, footprint_path) else None
