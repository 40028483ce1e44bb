"""Joins with other sources: nearest in time, rasters, snow, roads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, temporal

# fixed values: road classes
ROADS, HIGHWAYS = ("S1400",), ("S1100", "S1200")
SNOW_ROWS, SNOW_COLS = 658, 903
#: The grid of the snow model: upper left corner and degrees per cell.
SNOW_WEST, SNOW_NORTH, SNOW_STEP = -109.5, 42.0, 1 / 120


def match_ids(gps: DataFrame, wld: DataFrame, gps_id: str = "animal_id", wld_id: str = "wld_serial", order: str | None = None, strict: bool = False) -> DataFrame:
    """``gps_id, wld_id``: for each id the first serial that equals it or holds it or is held by it.

    Both id lists are distinct and short strings; the equal ids join by key
    and only the rest are compared as parts of each other, trigram by trigram
    where both are three characters or longer.
    """
    g = gps.select(F.col(gps_id).cast("string").alias("g")).where("g is not null").distinct()
    s = wld.select(F.col(wld_id).cast("string").alias("w"), (F.col(order) if order else F.col(wld_id)).alias("o")).where("w is not null").groupBy("w").agg(F.min("o").alias("o"))
    if strict:
        return g.join(s, F.col("g") == F.col("w")).select("g", "w")

    def pieces(c: str) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(F.col(c), i, F.lit(3))))

    long_g, long_s = g.where(F.length("g") >= 3), s.where(F.length("w") >= 3)
    # the shorter id's first trigram must be among the longer one's
    held = long_g.select("g", F.explode(pieces("g")).alias("p")).join(long_s.select("w", "o", F.substring("w", 1, 3).alias("p")), "p").where(F.col("g").contains(F.col("w"))).select("g", "w", "o")
    holds = long_s.select("w", "o", F.explode(pieces("w")).alias("p")).join(long_g.select("g", F.substring("g", 1, 3).alias("p")), "p").where(F.col("w").contains(F.col("g"))).select("g", "w", "o")
    # ids of one or two characters: there are few different ones
    short = g.where(F.length("g") < 3).join(s, F.col("w").contains(F.col("g"))).select("g", "w", "o").union(s.where(F.length("w") < 3).join(g, F.col("g").contains(F.col("w"))).select("g", "w", "o"))
    both = held.union(holds).union(short)
    return both.groupBy("g").agg(F.min_by("w", F.struct("o", "w")).alias("w"))


def nearest_in_time(left: DataFrame, right: DataFrame, values: list[str], key: str = "animal_id", time: str = "timestamp", tolerance_s: int = 1800) -> DataFrame:
    """Each row of ``left`` with ``values`` of the row of ``right`` nearest in time, and ``diff_s``.

    Times are cut to seconds; a difference of ``tolerance_s`` still counts; of
    two as near the later wins.  The tables are merged and each row looks back
    and ahead in one window, so nothing is paired.
    """
    cols = left.columns
    second = F.date_trunc("second", F.col(time))
    row = F.struct(second.alias("t"), *[F.col(v) for v in values])
    empty = F.lit(None)
    l_rows = left.select(F.col(key).alias("_k"), second.alias("_t"), F.struct(*cols).alias("_l"), empty.alias("_r"))
    r_rows = right.groupBy(key, second.alias("_t")).agg(*[F.min_by(v, F.struct(*values)).alias(v) for v in values])
    r_rows = r_rows.select(F.col(key).alias("_k"), "_t", empty.alias("_l"), F.struct(F.col("_t").alias("t"), *values).alias("_r"))
    both = l_rows.unionByName(r_rows)
    # both frames grow by a row at a time, the second one from the latest time on
    upto = Window.unboundedPreceding, Window.currentRow
    back = F.last("_r", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_t").rangeBetween(*upto))
    ahead = F.last("_r", ignorenulls=True).over(Window.partitionBy("_k").orderBy(F.desc("_t")).rangeBetween(*upto))
    seen = both.withColumns({"_back": back, "_ahead": ahead}).where("_l is not null")
    db, da = temporal.seconds_between(F.col("_back.t"), F.col("_t")), temporal.seconds_between(F.col("_t"), F.col("_ahead.t"))
    best = F.when(F.col("_ahead").isNull() | (F.col("_back").isNotNull() & (db < da)), F.col("_back")).otherwise(F.col("_ahead"))
    diff = F.least(db, da)
    out = seen.select("_l.*", diff.alias("_d"), best.alias("_b"))
    near = F.col("_d") <= tolerance_s
    return out.select(*cols, *[F.when(near, F.col(f"_b.{v}")).alias(v) for v in values], F.when(near, F.col("_d")).alias("diff_s"))


def merge_wld(gps: DataFrame, wld: DataFrame, values: list[str], tolerance_s: int = 1800, utc_offset_hours: int = 0) -> DataFrame:
    """Values of the nearest record of the collar that belongs to each animal."""
    ids = match_ids(gps, wld)
    named = wld.withColumn("timestamp", F.expr(f"wld_timestamp + make_dt_interval(0, {utc_offset_hours})").cast("timestamp_ntz")).join(ids, F.col("wld_serial") == F.col("w")).withColumn("animal_id", F.col("g"))
    return nearest_in_time(gps, named.select("animal_id", "timestamp", *values), values, tolerance_s=tolerance_s)


def largest_tiles(files: DataFrame) -> DataFrame:
    """Of the tiles ``name, size_bytes`` the largest of each degree cell; names without a cell all stay."""
    cell = F.regexp_extract(F.lower("name"), r"(n\d+w\d+)", 1)
    w = Window.partitionBy("cell").orderBy(F.desc("size_bytes"), "name")
    ranked = files.withColumn("cell", cell).withColumn("_n", F.row_number().over(w))
    return ranked.where("cell = '' or _n = 1").drop("_n", "cell")


def sample_elevation(points: DataFrame, tiles: DataFrame, cells: DataFrame, lon: str = "lon", lat: str = "lat", nodata: float = -9999.0) -> DataFrame:
    """``elevation_m`` of each point: the first tile by name that holds it, its cell, NULL without data.

    ``tiles``: tile, west, south, east, north, nrows, ncols.  ``cells``: tile,
    row, col, v.  Points meet tiles by whole degree, cells by tile, row, column.
    """
    spans = tiles.select("*", F.explode(F.sequence(F.floor("west").cast("int"), F.floor("east").cast("int"))).alias("_dx")).select("*", F.explode(F.sequence(F.floor("south").cast("int"), F.floor("north").cast("int"))).alias("_dy"))
    keys = [c for c in points.columns]
    at = points.select("*", F.floor(lon).cast("int").alias("_px"), F.floor(lat).cast("int").alias("_py"))
    inside = (F.col("_px") == F.col("_dx")) & (F.col("_py") == F.col("_dy")) & F.col(lon).between(F.col("west"), F.col("east")) & F.col(lat).between(F.col("south"), F.col("north"))
    spots = at.select(F.col(lon).alias("_lon"), F.col(lat).alias("_lat"), "_px", "_py").distinct()
    hit = spots.join(spans, (F.col("_px") == F.col("_dx")) & (F.col("_py") == F.col("_dy")) & F.col("_lon").between(F.col("west"), F.col("east")) & F.col("_lat").between(F.col("south"), F.col("north")))
    row = F.least(F.col("nrows") - 1, F.floor((F.col("north") - F.col("_lat")) / (F.col("north") - F.col("south")) * F.col("nrows"))).cast("int")
    col = F.least(F.col("ncols") - 1, F.floor((F.col("_lon") - F.col("west")) / (F.col("east") - F.col("west")) * F.col("ncols"))).cast("int")
    first = hit.groupBy("_lon", "_lat").agg(F.min_by(F.struct("tile", row.alias("row"), col.alias("col")), "tile").alias("c")).select("_lon", "_lat", "c.*")
    value = first.join(cells, ["tile", "row", "col"], "left").select("_lon", "_lat", F.when((F.col("v") != nodata) & ~F.isnan("v"), F.col("v")).alias("elevation_m"))
    return points.join(value, (F.col(lon) == F.col("_lon")) & (F.col(lat) == F.col("_lat")), "left").select(*keys, "elevation_m")


def snow_cell(lon: Column, lat: Column) -> tuple[Column, Column]:
    row = F.greatest(F.lit(0), F.least(F.lit(SNOW_ROWS - 1), F.floor((SNOW_NORTH - lat) / SNOW_STEP))).cast("int")
    col = F.greatest(F.lit(0), F.least(F.lit(SNOW_COLS - 1), F.floor((lon - SNOW_WEST) / SNOW_STEP))).cast("int")
    return row, col


def sample_snow(points: DataFrame, snow: DataFrame, row: Column | None = None, col: Column | None = None, time: str = "timestamp") -> DataFrame:
    """``snow_depth_m, swe_m, snow_density_kgm3`` by day and cell; 0 where there is no snow record.

    ``snow``: date (yyyyMMdd), row, col, depth, swe.  Only days that occur on
    both sides are met, so a table partitioned by date is pruned.
    """
    r, c = (row, col) if row is not None else snow_cell(F.col("lon"), F.col("lat"))
    at = points.withColumns({"_date": F.date_format(time, "yyyyMMdd"), "_row": r, "_col": c})
    s = snow.select(F.col("date").alias("_date"), F.col("row").alias("_row"), F.col("col").alias("_col"), "depth", "swe")
    out = at.join(s, ["_date", "_row", "_col"], "left").withColumns({"snow_depth_m": F.coalesce("depth", F.lit(0.0)), "swe_m": F.coalesce("swe", F.lit(0.0))})
    out = out.withColumn("snow_density_kgm3", F.when(F.col("snow_depth_m") > 0.01, F.col("swe_m") / F.col("snow_depth_m") * 1000).otherwise(0.0))
    return out.select(*points.columns, "snow_depth_m", "swe_m", "snow_density_kgm3")


def _buckets(cell: float, x1: str, y1: str, x2: str, y2: str) -> Column:
    """Grid cells of a segment's bounding box, as an array of structs."""
    xs = F.sequence(F.floor(F.least(x1, x2) / cell).cast("long"), F.floor(F.greatest(x1, x2) / cell).cast("long"))
    ys = F.sequence(F.floor(F.least(y1, y2) / cell).cast("long"), F.floor(F.greatest(y1, y2) / cell).cast("long"))
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("i"), j.alias("j")))))


def split_long(segments: DataFrame, cell: float, most: int = 16) -> DataFrame:
    """Segments (x1, y1, x2, y2) cut so that none spans more than ``most`` cells a side."""
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / (cell * most))).cast("int")
    parts = segments.withColumn("_n", n).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def at(a: str, b: str, k: Column) -> Column:
        return F.when(k == 0, F.col(a)).when(k == F.col("_n"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n"))

    p = F.col("_p")
    new = {"x1": at("x1", "x2", p), "y1": at("y1", "y2", p), "x2": at("x1", "x2", p + 1), "y2": at("y1", "y2", p + 1)}
    return parts.withColumns(new).drop("_n", "_p")


def track_segments(fixes: DataFrame, key: str = "id_bio_year", x: str = "x", y: str = "y") -> DataFrame:
    w = Window.partitionBy(key).orderBy("timestamp")
    rows = fixes.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("key"), F.col(x).alias("x1"), F.col(y).alias("y1"), F.lead(x).over(w).alias("x2"), F.lead(y).over(w).alias("y2"))
    return rows.where("x2 is not null")


def road_crossings(fixes: DataFrame, roads: DataFrame, key: str = "id_bio_year", x: str = "x", y: str = "y", cell: float = 1000.0) -> DataFrame:
    """``key, crosses_road, crosses_highway`` of every key: does its track meet a road or highway.

    Both sides are dealt by grid cell, so a segment is tested only against
    roads in its cells; touching counts, a track of one fix crosses nothing.
    """
    track = split_long(track_segments(fixes, key, x, y), cell).select("key", *[F.col(c).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")], F.explode(_buckets(cell, "x1", "y1", "x2", "y2")).alias("b"))
    lines = split_long(roads.where(F.col("mtfcc").isin(*ROADS, *HIGHWAYS)), cell).select(F.col("mtfcc").isin(*HIGHWAYS).alias("hw"), "x1", "y1", "x2", "y2", F.explode(_buckets(cell, "x1", "y1", "x2", "y2")).alias("b"))
    meet = geo.segments_meet(tuple(F.col(f"t{c}") for c in ("x1", "y1", "x2", "y2")), tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    hits = track.join(lines, "b").where(meet).groupBy("key").agg(F.max(~F.col("hw")).alias("r"), F.max("hw").alias("h"))
    keys = fixes.select(F.col(key).alias("key")).distinct()
    return keys.join(hits, "key", "left").select(F.col("key").alias(key), F.coalesce("r", F.lit(False)).alias("crosses_road"), F.coalesce("h", F.lit(False)).alias("crosses_highway"))


def track_signature(fixes: DataFrame, key: str = "id_bio_year", x: str = "x", y: str = "y") -> DataFrame:
    """``key, n, signature`` of each track: it changes with any of its keys, times or places."""
    return fixes.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(key, F.col("timestamp").cast("string"), x, y)).alias("signature"))


def stale_crossings(stored: DataFrame, fixes: DataFrame, key: str = "id_bio_year") -> DataFrame:
    """Keys whose crossings must be worked out again: their track changed since ``stored`` (key, n, signature), is new, or is gone."""
    now = track_signature(fixes, key).select(key, F.col("n").alias("_n"), F.col("signature").alias("_s"))
    both = stored.select(key, "n", "signature").join(now, key, "full_outer")
    return both.where(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("signature").eqNullSafe(F.col("_s")))).select(key)
