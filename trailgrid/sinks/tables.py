"""Table sinks: rasters as sparse long tables, lines and points, flat CSV, manifests, text reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import movement, sequences

NODATA = -9999.0


def write_raster(surface: DataFrame, path: str, value: str = "density", partition: list[str] | None = None, kind: str = "float32") -> None:
    """Cells of one kind: ``float32`` (missing as no row), ``uint8`` mask, or ``count`` above 0."""
    typed = {"float32": F.col(value).cast("float"), "uint8": F.lit(1).cast("byte"), "count": F.col(value).cast("int")}[kind]
    rows = surface.where(F.col(value) > 0) if kind == "count" else surface
    keep = [*(partition or []), "row", "col"]
    writer = rows.select(*keep, typed.alias("value")).write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_grid(grid, spark, path: str) -> None:
    """A grid's box and shape as a table of one row."""
    spark.createDataFrame([{k: v for k, v in vars(grid).items() if v is not None}]).write.mode("overwrite").parquet(path)


def write_product(product: DataFrame, kind: str, path: str, value: str = "value", partition: list[str] | None = None) -> None:
    """Rasters by ``write_raster``, outlines by ``write_geojson``."""
    if kind == "vector":
        write_geojson(product, path)
    else:
        write_raster(product, path, value, partition, kind)


def geojson_features(shapes: DataFrame, properties: list[str]) -> DataFrame:
    """A column ``feature`` with one GeoJSON feature a row of rings (``ring``) or lines (``line``)."""
    name = "ring" if "ring" in shapes.columns else "line"
    xy = F.transform(name, lambda p: F.array(p["x"], p["y"]))
    coordinates = F.to_json(F.array(F.concat(xy, F.slice(xy, 1, 1)))) if name == "ring" else F.to_json(xy)
    kind = "Polygon" if name == "ring" else "LineString"
    props = F.to_json(F.struct(*properties)) if properties else F.lit("{}")
    return shapes.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(f',"geometry":{{"type":"{kind}","coordinates":'), coordinates, F.lit("}}")).alias("feature"))


def write_geojson(shapes: DataFrame, path: str) -> None:
    """Line-delimited GeoJSON features; every other column is a property."""
    geojson_features(shapes, [c for c in shapes.columns if c not in ("ring", "line")]).write.mode("overwrite").text(path)


def field_names(columns: list[str], most: int = 10) -> list[str]:
    """Names of ten characters at most, different whatever their case."""
    seen: set[str] = set()
    out = []
    for c in columns:
        base = c.replace(".", "_")[:most]
        name, k = base, 0
        while name.lower() in seen:
            k += 1
            name = base[: most - len(str(k))] + str(k)
        seen.add(name.lower())
        out.append(name)
    return out


def flat_fields(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """For attribute tables: short names, times as text, no nested or interval columns but those of ``keep``, as they are."""
    flat = [f for f in df.schema.fields if f.name not in keep and not re.match("array|map|struct|interval|binary", f.dataType.simpleString())]
    cols = [F.date_format(f"`{f.name}`", "yyyy-MM-dd HH:mm") if f.dataType.simpleString().startswith("timestamp") else F.col(f"`{f.name}`") for f in flat]
    return df.select(*[c.alias(n) for c, n in zip(cols, field_names([f.name for f in flat]), strict=True)], *keep)


def mig_lines(seq: DataFrame, key: str = "mig", start: tuple[int, int] = (2, 1)) -> DataFrame:
    """One line a sequence with its dates, number of fixes, three distances and the start of the biological year (``wrr_date``, MM-dd)."""
    lines = sequences.line_distances(seq, key, ("label", "bio_year", "animal_id")).join(sequences.max_pair(seq, key), key)
    shape = seq.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))
    return lines.join(shape, key).withColumn("wrr_date", F.lit(f"{start[0]:02d}-{start[1]:02d}"))


def mig_points(seq: DataFrame, fixes: DataFrame) -> DataFrame:
    """Sequence fixes with the processed fixes' other columns by animal and time."""
    own = [c for c in fixes.columns if c in ("animal_id", "timestamp") or c not in seq.columns]
    return seq.join(fixes.select(*own), ["animal_id", "timestamp"], "left")


def write_mig_outputs(seq: DataFrame, fixes: DataFrame, path: str) -> None:
    write_geojson(mig_lines(seq), f"{path}/lines")
    flat_fields(mig_points(seq, fixes)).write.mode("overwrite").parquet(f"{path}/points")


def write_flags_removed(fixes: DataFrame, path: str) -> bool:
    """Fixes without marks; nothing is written if there is none."""
    kept = movement.unflagged(fixes)
    if not kept.head(1):
        return False
    flat_fields(kept).write.mode("overwrite").parquet(path)
    return True


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file; for summary tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def flat_rows(df: DataFrame) -> DataFrame:
    """A nested row's leaves as ``section, key, value``."""
    from pyspark.sql import types as T

    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [F.struct(F.lit(f.name).alias("section"), F.lit(g.name).alias("key"), F.col(f"{f.name}.{g.name}").cast("string").alias("value")) for g in f.dataType.fields]
        elif isinstance(f.dataType, T.MapType):
            continue
        else:
            out.append(F.struct(F.lit("").alias("section"), F.lit(f.name).alias("key"), F.col(f.name).cast("string").alias("value")))
    flat = df.select(F.inline(F.array(*out)))
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType):
            flat = flat.unionByName(df.select(F.lit(f.name).alias("section"), F.explode(f.name)).select("section", F.col("key").cast("string").alias("key"), F.to_json(F.struct("value")).alias("value")))
    return flat


def text_report(summary: DataFrame, title: str = "Herd summary", about: dict | None = None, settings: dict | None = None) -> str:
    """A text of what is known of the herd, the season summary's rows, which are few, and the settings."""
    lines = [title, "=" * len(title)]
    if about:
        lines += ["", "Study", "-----"] + [f"  {k}: {v}" for k, v in about.items()]
    for row in summary.orderBy("season").collect():
        lines += ["", str(row["season"]), "-" * len(str(row["season"]))]
        for k, v in row.asDict().items():
            if k != "season":
                lines.append(f"  {k}: {'n/a' if v is None else f'{v:.2f}' if isinstance(v, float) else v}")
    if settings:
        lines += ["", "Settings", "--------"] + [f"  {k}: {v}" for k, v in settings.items()]
    return "\n".join(lines) + "\n"


def export_all(contours: dict[str, DataFrame], uds: DataFrame, footprints: DataFrame, metadata: dict[str, DataFrame], path: str) -> None:
    """The full tree: contours, metadata, and UDs and footprints by season."""
    for name, shapes in contours.items():
        write_geojson(shapes, f"{path}/contours/{name}")
    for name, df in metadata.items():
        write_csv(df, f"{path}/metadata/{name}")
    # a folder a season; a sequence's cells lie together in its files, which are as many as the shuffle's partitions
    for name, cells, kind in (("UDs", uds, "float32"), ("Footprints", footprints.withColumn("density", F.lit(1.0)), "uint8")):
        typed = F.lit(1).cast("byte") if kind == "uint8" else F.col("density").cast("float")
        rows = cells.select("season", "seq_id", "row", "col", typed.alias("value")).repartition("season", "seq_id").sortWithinPartitions("season", "seq_id", "row", "col")
        rows.write.mode("overwrite").partitionBy("season").parquet(f"{path}/{name}")


def manifest(spark, version: int, parameters: dict, parent: dict | None = None) -> DataFrame:
    """``version, key, value, parent_value, changed``: a run's parameters against its parent's."""
    def rows(p: dict | None) -> DataFrame:
        return spark.createDataFrame([(k, str(v)) for k, v in (p or {}).items()], "key string, value string")

    both = rows(parameters).join(rows(parent).withColumnRenamed("value", "parent_value"), "key", "full_outer")
    return both.select(F.lit(version).alias("version"), "key", "value", "parent_value", (~F.col("value").eqNullSafe(F.col("parent_value"))).alias("changed"))


def with_file_tokens(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, text.file_token(F.col(column)))


def save_project(spark, path: str, tables: dict[str, DataFrame], settings: dict) -> None:
    """A project's tables as Parquet, beside a sidecar with its settings."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    sidecar = json.dumps({"tables": sorted(tables), "settings": settings}, sort_keys=True)
    spark.createDataFrame([(sidecar,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_project")


def load_project(spark, path: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and settings of a saved project."""
    sidecar = json.loads(spark.read.text(f"{path}/_project").first()[0])
    return {name: spark.read.parquet(f"{path}/{name}") for name in sidecar["tables"]}, sidecar["settings"]
