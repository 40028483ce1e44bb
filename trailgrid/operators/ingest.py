"""From raw columns to standard fixes: naming, timestamps, coordinates, quality, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ProcessConfig
from ..functions import geo, temporal, text

# fixed values: names of the app download and the standard names they stand for
APP_COLUMNS = {
    "animalIdLocal": "LoclAID", "animalTrackerId": "TrakAID", "species": "Species", "projectName": "Project", "sex": "Sex", "captureAgeClass": "AgeClass", "mtReadable": "DT_MST",
    "speedCollar": "Cllr_Spd", "dop": "DOP", "numSats": "NumSats", "longitude": "Long", "latitude": "Lat", "utm_datum_and_zone": "UTM_D_Z", "utmZone": "UTM_Zn",
    "UTME": "UTME", "UTMN": "UTMN", "dau": "DAU", "captureGmu": "CptrGMU", "captureDau": "CptrDAU",
}
# fixed values: the columns that may name the herd and the project, the first with a value decides
HERD_COLUMNS = ("CaptureDAU", "captureDau", "CptrDAU", "DAU", "dau", "Project", "project_name")
PROJECT_COLUMNS = ("Project", "project_name", "ProjectName")


def app_names(columns: list[str]) -> dict[str, str]:
    """Old name -> new name if the columns look like an app download (three of its names)."""
    if sum(c in APP_COLUMNS for c in columns) < 3:
        return {}
    return {c: APP_COLUMNS[c] for c in columns if c in APP_COLUMNS and (APP_COLUMNS[c] == c or APP_COLUMNS[c] not in columns)}


def remap_columns(df: DataFrame) -> DataFrame:
    """Rename app-download columns; of equal names the first stays."""
    names, new = app_names(df.columns), []
    indexed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    for i, c in enumerate(df.columns):
        to = names.get(c, c)
        if to not in [n for _, n in new]:
            new.append((i, to))
    return indexed.select(*[F.col(f"c{i}").alias(n) for i, n in new])


def reconcile(name: str, before: list[str], after: list[str]) -> str:
    """A configured column's name after the renaming."""
    return name if name in after else app_names(before).get(name, APP_COLUMNS.get(name, name))


def find_timestamp(columns: list[str], wanted: str | tuple[str, ...]) -> list[str]:
    """Columns that make up the timestamp: the wanted ones, a usual name, or the first with ``date`` in it."""
    lower = {c.lower(): c for c in reversed(columns)}
    parts = [wanted] if isinstance(wanted, str) else list(wanted)
    if all(p.lower() in lower for p in parts):
        return [lower[p.lower()] for p in parts]
    # fixed values: usual names
    for name in ("fixdatetim", "datetime"):
        if name in lower:
            return [lower[name]]
    for c in columns:
        if "date" in c.lower() and "start" not in c.lower() and "end" not in c.lower():
            return [c]
    raise ValueError(f"no timestamp column among {columns}")


def with_timestamp(df: DataFrame, cfg: ProcessConfig) -> DataFrame:
    """Column ``timestamp`` (no time zone) from one column or several, joined by spaces."""
    parts = find_timestamp(df.columns, cfg.timestamp_col)
    if len(parts) == 1:
        return temporal.parse_flexibly(df, parts[0], cfg.timestamp_format)
    joined = df.withColumn("_ts", F.concat_ws(" ", *[F.col(p).cast("string") for p in parts]))
    return temporal.parse_flexibly(joined, "_ts", cfg.timestamp_format).drop("_ts")


def with_standard_names(df: DataFrame, cfg: ProcessConfig) -> DataFrame:
    """``animal_id, lon, lat, x, y, utm_zone`` from the configured names where they exist."""
    names = {cfg.animal_id_col: "animal_id", cfg.lon_col: "lon", cfg.lat_col: "lat", cfg.utme_col: "x", cfg.utmn_col: "y", cfg.utm_zone_col: "utm_zone"}
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def exact_quantile(df: DataFrame, column: str, share: float = 0.5) -> DataFrame:
    """One row ``q``: the quantile of a numeric column, interpolated between its two neighbours; NULL without values.

    An approximate sketch gives a narrow bracket around it; what lies below is
    counted, and only the bracket's different values are sorted in one task.
    """
    v = F.col("v")
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n = values.count()
    if not n:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("q"))
    slack = 2e-4 + 2 / n  # the sketch is off by 1e-4 of the rows at most, and counts ranks otherwise
    a, b = values.agg(F.percentile_approx("v", [max(0.0, share - slack), min(1.0, share + slack)], 10000)).first()[0]
    rank = share * (n - 1)
    k, part = int(rank), rank - int(rank)
    below = values.agg(F.count_if(v < a)).first()[0]
    near = values.where(v.between(a, b)).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + below
    ends = near.select("v", upto.alias("upto")).agg(F.min(F.when(F.col("upto") > k, v)).alias("x"), F.min(F.when(F.col("upto") > min(k + 1, n - 1), v)).alias("y"))
    return ends.select((F.col("x") + (F.col("y") - F.col("x")) * part).alias("q"))


def with_coordinates(df: DataFrame) -> DataFrame:
    """Numeric lon and lat; x and y as given if any is, else projected to the UTM zone of the median position."""
    df = df.withColumns({c: text.number(F.col(c)) for c in ("lon", "lat", "x", "y") if c in df.columns})
    if "x" in df.columns and "y" in df.columns and df.where("x is not null").head(1):
        return df
    middle = exact_quantile(df, "lon").withColumnRenamed("q", "lon").crossJoin(F.broadcast(exact_quantile(df, "lat").withColumnRenamed("q", "lat")))  # one row each
    zone = middle.select(geo.utm_zone(F.col("lon")).alias("utm_zone"), (F.col("lat") < 0).alias("_south"))  # one row
    df = df.drop("x", "y", "utm_zone").crossJoin(F.broadcast(zone))
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), F.col("utm_zone"), F.col("_south"))
    return df.withColumns({"x": x, "y": y}).drop("_south")


def good_position(projected: bool = False, lon: str = "lon", lat: str = "lat") -> Column:
    known = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    return known if projected else known & (F.col(lon) < 0)


def quality_filter(df: DataFrame, projected: bool = False, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows with both coordinates and, in degrees, a western longitude; poor DOP and few satellites stay to be flagged."""
    return df.where(good_position(projected, lon, lat))


def quality_report(df: DataFrame, cfg: ProcessConfig = ProcessConfig(), lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row of counts: rows, bad coordinates (a row without both counts twice), poor DOP, few satellites."""
    counts = {
        "n_rows": F.count(F.lit(1)), "n_null_lon": F.count_if(F.col(lon).isNull()), "n_null_lat": F.count_if(F.col(lat).isNull()),
        "n_positive_lon": F.lit(0).cast("long") if cfg.projected else F.count_if(F.col(lon) >= 0),
    }
    counts["n_bad"] = counts["n_null_lon"] + counts["n_null_lat"] + counts["n_positive_lon"]
    if cfg.dop_cutoff is not None and cfg.dop_col in df.columns:
        counts["n_poor_dop"] = F.count_if(text.number(F.col(cfg.dop_col)) > cfg.dop_cutoff)
    if cfg.sat_cutoff is not None and cfg.sat_col in df.columns:
        counts["n_few_sats"] = F.count_if(text.number(F.col(cfg.sat_col)) < cfg.sat_cutoff)
    return df.agg(*[c.alias(n) for n, c in counts.items()])


def validate(df: DataFrame, required: list[str], timestamp: str, lon: str = "lon", lat: str = "lat", projected: bool = False) -> DataFrame:
    """``check, passed, detail``: required columns, missing values, western longitudes, ranges, time spelling, 100 rows."""
    missing = [c for c in required if c not in df.columns]
    present = [c for c in required if c in df.columns]
    time = F.col(timestamp).cast("string") if timestamp in df.columns else F.lit(None).cast("string")
    position = lon in df.columns and lat in df.columns
    got = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(text.or_null(F.col(c)).isNull()).alias(f"null_{i}") for i, c in enumerate(present)],
        (F.count_if(F.col(lon) >= 0) if position and not projected else F.lit(0)).alias("east"),
        *[(f(F.col(c)) if position else F.lit(None)).alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k, c in (("lon", lon), ("lat", lat))],
        F.first(time, ignorenulls=True).rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{1,2}:\d{2}|^\d{1,2}/\d{1,2}/\d{2,4} \d{1,2}:\d{2}").alias("spelled"),
    )
    rows = [("required_columns", F.lit(not missing), F.lit(", ".join(missing)))]
    rows += [(f"no_missing_{c}", F.col(f"null_{i}") == 0, F.col(f"null_{i}").cast("string")) for i, c in enumerate(present)]
    rows += [
        ("western_longitudes", F.col("east") == 0, F.col("east").cast("string")),
        ("coordinates", F.col("min_lon").isNotNull(), F.format_string("%.4f %.4f %.4f %.4f", *[F.col(f"{n}_{k}").cast("double") for k in ("lon", "lat") for n in ("min", "max")])),
        ("timestamp_spelling", F.coalesce(F.col("spelled"), F.lit(False)), F.lit(timestamp)),
        ("at_least_100_rows", F.col("n") >= 100, F.col("n").cast("string")),
    ]
    return got.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("passed"), d.alias("detail")) for n, ok, d in rows])))


def drop_null_times(df: DataFrame) -> DataFrame:
    """Rows with a timestamp; an error if there are rows and none has one."""
    got = df.agg(F.count(F.lit(1)).alias("n"), F.count("timestamp").alias("t")).first()
    if got["n"] and not got["t"]:
        raise ValueError("no timestamp could be parsed")
    return df.where("timestamp is not null")


def deduplicate(df: DataFrame, order: str | None = None, keys: tuple[str, ...] = ("animal_id", "timestamp")) -> DataFrame:
    """One fix per animal and time: the first by ``order`` (else by all other columns)."""
    by = [F.col(order)] if order else [F.col(c) for c in df.columns if c not in keys and not df.schema[c].dataType.simpleString().startswith("map")]
    first = Window.partitionBy(*keys).orderBy(*(by or [F.lit(0)]))
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def with_keys(df: DataFrame, start: tuple[int, int] = (2, 1)) -> DataFrame:
    """``year, id_yr, bio_year, id_bio_year``; the strings derive from columns and are never parsed."""
    df = df.withColumns({"year": F.year("timestamp"), "bio_year": temporal.bio_year(F.col("timestamp"), start)})
    return df.withColumns({"id_yr": F.concat_ws("_", "animal_id", "year"), "id_bio_year": F.concat_ws("_", "animal_id", "bio_year")})


def herd_id(df: DataFrame, columns: tuple[str, ...] = HERD_COLUMNS, override: str | None = None) -> DataFrame:
    """One row ``herd_id``: sorted values of the first candidate column with any, joined by ``_``; else ``Herd``."""
    present = [c for c in columns if c in df.columns]
    sets = [F.array_join(F.array_sort(F.collect_set(text.or_null(F.col(c)))), "_") for c in present]
    best = F.coalesce(*([F.lit(override)] if override else []), *[F.nullif(s, F.lit("")) for s in sets], F.lit("Herd"))
    return df.agg(best.alias("herd_id"))


def project_name(df: DataFrame, order: str, columns: tuple[str, ...] = PROJECT_COLUMNS) -> DataFrame:
    """One row ``project``: the first value without white space and marks; else ``Project``."""
    present = [c for c in columns if c in df.columns]
    values = [F.min_by(text.or_null(F.col(c)), F.when(text.or_null(F.col(c)).isNotNull(), F.col(order))) for c in present]
    clean = [F.nullif(F.regexp_replace(F.regexp_replace(v, r"\s+", ""), r"[^\w\-]", ""), F.lit("")) for v in values]
    return df.agg(F.coalesce(*clean, F.lit("Project")).alias("project"))


def include_values(df: DataFrame, column: str, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose value (``(blank)`` if missing) is wanted, and the others with a reason."""
    value = text.blank_bucket(F.col(column))
    return df.where(value.isin(*wanted)), df.where(~value.isin(*wanted)).withColumn("reason", F.concat(F.lit(f"{column} = "), value))


def usual_value(df: DataFrame, column: str) -> DataFrame:
    """``animal_id, value``: each animal's most frequent value, the smallest of ties."""
    value = text.or_null(F.col(column))
    counts = df.select("animal_id", value.alias("value")).where("value is not null").groupBy("animal_id", "value").count()
    return counts.groupBy("animal_id").agg(F.min_by("value", F.struct(-F.col("count"), "value")).alias("value"))


def distinct_counts(df: DataFrame) -> DataFrame:
    """Animals, bursts and animal-years, as far as their columns exist."""
    named = {"animal_id": "n_animals", "burst_id": "n_bursts", "id_bio_year": "n_animal_years"}
    return df.agg(F.count(F.lit(1)).alias("n_fixes"), *[F.countDistinct(c).alias(n) for c, n in named.items() if c in df.columns])
