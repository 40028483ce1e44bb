"""Registered queries over the fix-shaped views, each with SQL that another engine can run.

Doubles are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, temporal, text
from ..operators import contours, detect, enrich, ingest, movement, population, report, sequences, ud
from . import fixtures
from .fixtures import BIO_YEAR, SQL, fixes, table
from .process import measure
from .store import stored
from ..config import ProcessConfig, model_config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CELL = 2000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {SQL.strip()}{sql}" if sql.lstrip().startswith(",") else f"WITH {SQL.strip()}\n{sql}"
        return f

    return add


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def keyed(spark: SparkSession, d: str) -> DataFrame:
    return ingest.with_keys(fixes(spark, d), BIO_YEAR)


def stepped(spark: SparkSession, d: str) -> DataFrame:
    return movement.with_steps(movement.with_burst(fixes(spark, d)))


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return movement.with_mortality(movement.with_problems(ingest.with_keys(stepped(spark, d), BIO_YEAR)))


def extracted(spark: SparkSession, d: str) -> DataFrame:
    return sequences.extract_sequences(flagged(spark, d), fixtures.windows(spark, d))


def points(spark: SparkSession, d: str) -> DataFrame:
    """The sequences' fixes, stored: a query's surfaces start from them, some several times."""
    return stored(extracted(spark, d).select(F.col("mig").alias("seq_id"), "animal_id", F.col("label").alias("season"), "bio_year", "timestamp", "x", "y"), "sequences")


def members(p: DataFrame) -> DataFrame:
    return p.select("seq_id", "animal_id", "season", "bio_year").distinct()


def use_cells(p: DataFrame) -> DataFrame:
    """A UD by counting: the share of a sequence's fixes in each 2 km cell."""
    c = p.select("seq_id", F.floor(F.col("y") / CELL).cast("int").alias("row"), F.floor(F.col("x") / CELL).cast("int").alias("col"))
    c = c.groupBy("seq_id", "row", "col").agg(F.count(F.lit(1)).cast("double").alias("density"))
    return c.withColumn("density", F.col("density") / F.sum("density").over(Window.partitionBy("seq_id")))


def used(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, d)
    return use_cells(p), members(p)


USE_SQL = """,
cnt AS (SELECT seq_id, CAST(floor(y / 2000) AS INTEGER) AS "row", CAST(floor(x / 2000) AS INTEGER) AS col, CAST(count(*) AS DOUBLE) AS n FROM pts GROUP BY ALL),
uc AS (SELECT seq_id, "row", col, n / sum(n) OVER (PARTITION BY seq_id) AS density FROM cnt),
mem AS (SELECT DISTINCT seq_id, animal_id, season, bio_year FROM pts),
nseq AS (SELECT animal_id, count(*) AS k FROM mem GROUP BY 1),
ind AS (SELECT animal_id, "row", col, sum(density) / any_value(k) AS density FROM uc JOIN mem USING (seq_id) JOIN nseq USING (animal_id) GROUP BY 1, 2, 3),
inds AS (SELECT animal_id, season, "row", col, sum(density) AS density FROM uc JOIN mem USING (seq_id) GROUP BY 1, 2, 3, 4),
inds2 AS (SELECT animal_id, season, "row", col, density / sum(density) OVER (PARTITION BY animal_id, season) AS density FROM inds),
herd AS (SELECT season, count(DISTINCT animal_id) AS h FROM inds2 GROUP BY 1),
surf AS (SELECT season, "row", col, count(DISTINCT animal_id) AS n, sum(density) / any_value(h) AS mean_ud FROM inds2 JOIN herd USING (season) GROUP BY 1, 2, 3)
"""

GRID_SQL = """,
g0 AS (SELECT min(x) - (max(x) - min(x)) * 0.3 AS minx, min(y) - (max(y) - min(y)) * 0.3 AS miny, max(x) + (max(x) - min(x)) * 0.3 AS maxx, max(y) + (max(y) - min(y)) * 0.3 AS maxy FROM pts),
grid AS (SELECT *, greatest(1, CAST(ceil((maxy - miny) / 2000) AS INTEGER)) AS nrows, greatest(1, CAST(ceil((maxx - minx) / 2000) AS INTEGER)) AS ncols FROM g0),
gg AS (SELECT *, (maxx - minx) / ncols AS pw, (maxy - miny) / nrows AS ph FROM grid),
bb AS (SELECT seq_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, count(*) AS n, sqrt((var_samp(x) + var_samp(y)) / 2) * pow(count(*), -1.0 / 6) AS h FROM pts GROUP BY 1),
bx AS (SELECT seq_id, n, h, minx, maxy, pw, ph,
  greatest(0, least(nrows - 1, floor((maxy - d - (d - c) * 0.3) / ph))) AS r0, greatest(0, least(nrows - 1, ceil((maxy - c + (d - c) * 0.3) / ph) - 1)) AS r1,
  greatest(0, least(ncols - 1, floor((a - (b - a) * 0.3 - minx) / pw))) AS c0, greatest(0, least(ncols - 1, ceil((b + (b - a) * 0.3 - minx) / pw) - 1)) AS c1 FROM bb, gg),
cl0 AS (SELECT *, unnest(range(CAST(r0 AS BIGINT), CAST(greatest(r0, r1) AS BIGINT) + 1)) AS "row" FROM bx),
cl1 AS (SELECT *, unnest(range(CAST(c0 AS BIGINT), CAST(greatest(c0, c1) AS BIGINT) + 1)) AS col FROM cl0),
cl AS (SELECT seq_id, n, h, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, minx + (col + 0.5) * pw AS gx, maxy - ("row" + 0.5) * ph AS gy FROM cl1)
"""


@query("""SELECT animal_id, count(*) AS n_fixes, count(DISTINCT burst_id) AS n_bursts, round(coalesce(sum(dist), 0) / 1000, 4) AS dist_km, round(median(dt) / 3600, 6) AS median_hours, round(avg(problem), 6) AS flagged_share
FROM problems GROUP BY animal_id""")
def animal_summary(spark, d):
    f = movement.with_problems(movement.with_steps(movement.with_burst(ingest.deduplicate(fixes(spark, d), "ord"))))
    return f.groupBy("animal_id").agg(F.count(F.lit(1)).alias("n_fixes"), F.countDistinct("burst_id").alias("n_bursts"), r(F.coalesce(F.sum("dist"), F.lit(0.0)) / 1000, 4).alias("dist_km"), r(F.median("dt") / 3600).alias("median_hours"), r(F.avg("problem")).alias("flagged_share"))


@query("""SELECT ord, animal_id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY animal_id, timestamp ORDER BY ord) AS n FROM fixes_dup) WHERE n = 1""")
def dedup_fixes(spark, d):
    return ingest.deduplicate(fixes(spark, d, duplicates=True), "ord").select("ord", "animal_id", "timestamp")


@query("""SELECT min(ord) AS ord, animal_id, timestamp FROM long_fixes GROUP BY animal_id, timestamp""")
def dedup_long(spark, d):
    return ingest.deduplicate(fixtures.long_fixes(spark, d), "ord").select("ord", "animal_id", "timestamp")


@query("SELECT ord, burst_id FROM bursts")
def burst_id(spark, d):
    return movement.with_burst(fixes(spark, d)).select("ord", "burst_id")


@query("SELECT ord, round(dist, 6) AS dist, round(dt, 3) AS dt, round(speed, 6) AS speed, round(abs_angle, 5) AS abs_angle, round(rel_angle, 5) AS rel_angle, round(fix_rate_hours, 6) AS fix_rate_hours FROM steps")
def movement_steps(spark, d):
    return stepped(spark, d).select("ord", r("dist"), r("dt", 3).alias("dt"), r("speed"), r("abs_angle", 5), r("rel_angle", 5), r("fix_rate_hours")).toDF("ord", "dist", "dt", "speed", "abs_angle", "rel_angle", "fix_rate_hours")


NSD_SQL = """, n0 AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY timestamp) AS n FROM fixes),
n1 AS (SELECT *, avg(CASE WHEN n <= 20 THEN x END) OVER (PARTITION BY {k}) AS rx, avg(CASE WHEN n <= 20 THEN y END) OVER (PARTITION BY {k}) AS ry FROM n0)
SELECT ord, round(((x - rx) * (x - rx) + (y - ry) * (y - ry)) / 1e6, 6) AS nsd, round(sqrt(((x - rx) * (x - rx) + (y - ry) * (y - ry)) / 1e6), 6) AS displacement FROM n1"""


def _nsd(spark, d, keys):
    f = movement.with_nsd(keyed(spark, d), keys, "g")
    return f.select("ord", r("nsd_g").alias("nsd"), r("displacement_g").alias("displacement"))


@query(NSD_SQL.format(k="animal_id"))
def nsd_first20(spark, d):
    return _nsd(spark, d, ["animal_id"])


@query(NSD_SQL.format(k="animal_id, bio_year"))
def nsd_bio_year(spark, d):
    return _nsd(spark, d, ["animal_id", "bio_year"])


@query(NSD_SQL.format(k="animal_id, year(timestamp)"))
def nsd_year(spark, d):
    return _nsd(spark, d, ["animal_id", "year"])


@query("SELECT ord, CAST(year(timestamp) AS INTEGER) AS year, CAST(bio_year AS INTEGER) AS bio_year, animal_id || '_' || year(timestamp) AS id_yr, animal_id || '_' || bio_year AS id_bio_year FROM fixes")
def bio_year_keys(spark, d):
    return keyed(spark, d).select("ord", "year", "bio_year", "id_yr", "id_bio_year")


@query("""SELECT ord, problem, concat_ws('; ', CASE WHEN speed > 10.8 / 3.6 THEN printf('speed = %.1f km/h (max 10.8)', speed * 3.6) END, CASE WHEN "DOP" > 10 THEN printf('DOP = %.1f (max 10)', CAST("DOP" AS DOUBLE)) END, CASE WHEN "NumSats" < 6 THEN printf('satellites = %d (min 6)', "NumSats") END) AS problem_reason FROM problems""")
def problem_flags(spark, d):
    return movement.with_problems(stepped(spark, d)).select("ord", "problem", "problem_reason")


@query("SELECT ord, mortality_flag FROM mort")
def mortality_window(spark, d):
    return movement.with_mortality(fixes(spark, d)).select("ord", "mortality_flag")


@query("""SELECT ord, max(mortality_flag) OVER (PARTITION BY animal_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS mortality_flag FROM mort JOIN fixes USING (ord)""")
def mortality_cascade(spark, d):
    return movement.cascade_mortality(movement.with_mortality(fixes(spark, d))).select("ord", "mortality_flag")


@query("""SELECT count(*) AS n_rows, count(*) FILTER (lon IS NULL) AS n_null_lon, count(*) FILTER (lat IS NULL) AS n_null_lat, count(*) FILTER (lon >= 0) AS n_positive_lon,
count(*) FILTER (lon IS NULL) + count(*) FILTER (lat IS NULL) + count(*) FILTER (lon >= 0) AS n_bad, count(*) FILTER ("DOP" > 10) AS n_poor_dop, count(*) FILTER ("NumSats" < 6) AS n_few_sats FROM fixes""")
def quality_report(spark, d):
    return ingest.quality_report(fixes(spark, d))


@query("SELECT ord FROM fixes WHERE lon < 0 AND lat IS NOT NULL")
def quality_filter(spark, d):
    return ingest.quality_filter(fixes(spark, d)).select("ord")


@query("""SELECT 'western_longitudes' AS "check", count(*) FILTER (lon >= 0) = 0 AS passed, CAST(count(*) FILTER (lon >= 0) AS VARCHAR) AS detail FROM fixes UNION ALL
SELECT 'coordinates', TRUE, printf('%.4f %.4f %.4f %.4f', min(lon), max(lon), min(lat), max(lat)) FROM fixes UNION ALL
SELECT 'required_columns', FALSE, 'Species' UNION ALL SELECT 'no_missing_animal_id', count(*) FILTER (animal_id = '') = 0, CAST(count(*) FILTER (animal_id = '') AS VARCHAR) FROM fixes UNION ALL
SELECT 'no_missing_AgeClass', count(*) FILTER ("AgeClass" = '') = 0, CAST(count(*) FILTER ("AgeClass" = '') AS VARCHAR) FROM fixes UNION ALL SELECT 'at_least_100_rows', count(*) >= 100, CAST(count(*) AS VARCHAR) FROM fixes UNION ALL SELECT 'timestamp_spelling', TRUE, 'timestamp'""")
def validation(spark, d):
    return ingest.validate(fixes(spark, d), ["animal_id", "AgeClass", "Species"], "timestamp")


@query("""SELECT string_agg(DISTINCT 'C' || CAST(user_id % 2 AS VARCHAR), '_' ORDER BY 'C' || CAST(user_id % 2 AS VARCHAR)) AS herd_id, 'ElkStudy7' AS project FROM fixes""")
def herd_id_project(spark, d):
    """CaptureDAU is blank, so CptrDAU decides before DAU; Project is blank, so project_name does."""
    f = fixes(spark, d).withColumns({"CaptureDAU": F.lit(" "), "CptrDAU": F.concat(F.lit("C"), (F.col("user_id") % 2).cast("string")), "Project": F.lit(""), "project_name": F.lit(" Elk Study (7)")})
    return ingest.herd_id(f).crossJoin(ingest.project_name(f, "timestamp"))


@query("SELECT string_agg(DISTINCT \"DAU\", '_' ORDER BY \"DAU\") AS herd_id, 'Project' AS project FROM fixes")
def herd_id_default(spark, d):
    f = fixes(spark, d)
    return ingest.herd_id(f).crossJoin(ingest.project_name(f, "timestamp"))


@query("SELECT id_bio_year, animal_id, CAST(bio_year AS INTEGER) AS bio_year, CAST(slot AS INTEGER) AS slot, label, \"start\", \"end\" FROM migtime")
def migtime_unpivot(spark, d):
    wide = sequences.to_wide(fixtures.windows(spark, d))
    return sequences.to_long(wide, {1: "Spring", 2: "Fall"})


@query("""SELECT id_bio_year, max(CASE WHEN slot = 1 THEN "start" END) AS mig1start, max(CASE WHEN slot = 1 THEN "end" END) AS mig1end, max(CASE WHEN slot = 2 THEN "start" END) AS mig2start, max(CASE WHEN slot = 2 THEN "end" END) AS mig2end FROM migtime GROUP BY 1""")
def migtime_pivot(spark, d):
    return sequences.to_wide(fixtures.windows(spark, d)).select("id_bio_year", "mig1start", "mig1end", "mig2start", "mig2end")


@query("SELECT DISTINCT animal_id || '_' || bio_year AS id_bio_year, animal_id, CAST(bio_year AS INTEGER) AS bio_year, CAST(bio_year AS VARCHAR) AS bio_year_full, FALSE AS auto_detected, FALSE AS reviewed FROM fixes")
def migtime_scaffold(spark, d):
    return sequences.migtime_scaffold(keyed(spark, d)).select("id_bio_year", "animal_id", "bio_year", "bio_year_full", "auto_detected", "reviewed")


@query("SELECT ord, mig, label FROM seqs")
def extract_sequences(spark, d):
    return extracted(spark, d).select("ord", "mig", "label")


@query("SELECT f.ord, w.label AS window_label FROM fixes f LEFT JOIN migtime w ON w.animal_id = f.animal_id AND w.bio_year = f.bio_year AND f.timestamp BETWEEN w.\"start\" AND w.\"end\"")
def window_labels(spark, d):
    return sequences.with_window_label(keyed(spark, d), fixtures.windows(spark, d)).select("ord", "window_label")


@query("""SELECT mig, min(timestamp) AS start_date, max(timestamp) AS end_date, CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6) AS BIGINT) AS days, round(coalesce(sum(step_km), 0), 3) AS distance_km FROM seqstep GROUP BY mig""")
def sequence_distance(spark, d):
    return sequences.sequence_distances(extracted(spark, d))


@query(""", hv AS (SELECT mig, radians(lag(lat) OVER w) AS p, radians(lat) AS q, radians(lon - lag(lon) OVER w) AS l FROM seqs WINDOW w AS (PARTITION BY mig ORDER BY timestamp)),
hk AS (SELECT mig, CASE WHEN p IS NULL OR l IS NULL THEN NULL ELSE 2 * 6371 * asin(least(1, sqrt(pow(sin((q - p) / 2), 2) + cos(p) * cos(q) * pow(sin(l / 2), 2)))) END AS km FROM hv)
SELECT mig, round(coalesce(sum(km), 0), 3) AS distance_km FROM hk GROUP BY mig""")
def haversine_distance(spark, d):
    return sequences.sequence_distances(extracted(spark, d), geographic=True).select("mig", "distance_km")


@query("SELECT mig, round(maxpair_km, 6) AS maxpair_km FROM maxpair")
def max_pair_distance(spark, d):
    return sequences.max_pair(extracted(spark, d)).select("mig", r("maxpair_km").alias("maxpair_km"))


@query("SELECT round(avg(maxpair_km), 5) AS mean_km, round(coalesce(stddev_samp(maxpair_km), 0), 5) AS sd_km, round(min(maxpair_km), 5) AS min_km, round(max(maxpair_km), 5) AS max_km FROM maxpair")
def max_pair_summary(spark, d):
    s = sequences.max_pair_summary(sequences.max_pair(extracted(spark, d)))
    return s.select(*[r(c, 5).alias(c) for c in s.columns])


@query("SELECT mig, season, CAST(bio_year AS INTEGER) AS bio_year, animal_id, start_date, end_date, round(days, 6) AS days, round(eucl_km, 6) AS eucl_km, round(cumu_km, 6) AS cumu_km, round(maxpair_km, 6) AS maxpair_km, round(cumu_miles, 6) AS cumu_miles, n_fixes FROM trips")
def trip_table(spark, d):
    t = sequences.trips(extracted(spark, d))
    return t.select("mig", "season", "bio_year", "animal_id", "start_date", "end_date", *[r(c).alias(c) for c in ("days", "eucl_km", "cumu_km", "maxpair_km", "cumu_miles")], "n_fixes")


@query("""SELECT season, metric, round(avg(km), 4) AS mean_km, round(coalesce(stddev_samp(km), 0), 4) AS sd_km, round(min(km), 4) AS min_km, round(max(km), 4) AS max_km, count(*) AS n_sequences
FROM (SELECT season, unnest(['eucl_km', 'cumu_km', 'maxpair_km']) AS metric, unnest([eucl_km, cumu_km, maxpair_km]) AS km FROM trips) GROUP BY season, metric""")
def season_distance_summary(spark, d):
    return report.distance_summary(sequences.trips(extracted(spark, d)))


@query("SELECT (SELECT count(DISTINCT animal_id) FROM fixes) AS num_ind, (SELECT CAST(min(year(timestamp)) AS INTEGER) FROM fixes) AS first_year, (SELECT CAST(max(year(timestamp)) AS INTEGER) FROM fixes) AS last_year, (SELECT count(DISTINCT animal_id) FROM trips) AS mig_ind")
def herd_counts(spark, d):
    return report.herd_counts(fixes(spark, d), sequences.trips(extracted(spark, d)))


@query("""SELECT count(*) FILTER (upper(s) IN ('M', 'MALE')) AS n_male, count(*) FILTER (upper(s) IN ('F', 'FEMALE')) AS n_female FROM (SELECT animal_id, arg_min("Sex", timestamp) FILTER ("Sex" IS NOT NULL) AS s FROM fixes GROUP BY 1)""")
def sex_counts(spark, d):
    return report.sex_counts(fixes(spark, d))


@query("SELECT CAST(bio_year AS INTEGER) AS bio_year, count(DISTINCT animal_id) AS n_collars FROM fixes GROUP BY 1")
def annual_collars(spark, d):
    return report.annual_collars(keyed(spark, d))


@query("SELECT round(max(fix_rate_hours), 6) AS max_hours, round(min(fix_rate_hours), 6) AS min_hours, round(median(fix_rate_hours), 6) AS median_hours FROM steps")
def fix_rate_stats(spark, d):
    s = report.fix_rate_stats(stepped(spark, d))
    return s.select(*[r(c).alias(c) for c in s.columns])


@query("""SELECT animal_id || '_' || bio_year AS id_bio_year, count(*) AS n, CAST(greatest(1, floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6)) AS BIGINT) AS days,
round(greatest(1, count(*) / greatest(1, floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6))), 6) AS fixes_per_day FROM fixes GROUP BY 1""")
def fix_rate_estimate(spark, d):
    return movement.fix_rate(keyed(spark, d)).withColumn("fixes_per_day", r("fixes_per_day"))


@query("SELECT count(*) AS n_fixes, count(DISTINCT animal_id) AS n_animals, count(DISTINCT burst_id) AS n_bursts, count(DISTINCT animal_id || '_' || bio_year) AS n_animal_years FROM bursts")
def distinct_counts(spark, d):
    return ingest.distinct_counts(ingest.with_keys(movement.with_burst(fixes(spark, d)), BIO_YEAR))


@query("SELECT CASE WHEN grouping(season) = 1 THEN 'all' ELSE season END AS season, count(DISTINCT animal_id) AS n_animals, count(*) AS n_sequences FROM trips GROUP BY GROUPING SETS ((season), ())")
def season_rollup(spark, d):
    return report.season_rollup(sequences.trips(extracted(spark, d)))


@query("""SELECT s AS season, round(avg(days), 6) AS mean_days, round(stddev_samp(days), 6) AS sd_days, round(min(cumu_km), 6) AS min_cumu_km, round(max(maxpair_km), 6) AS max_maxpair_km FROM (SELECT *, unnest([season, 'all']) AS s FROM trips) GROUP BY 1""")
def season_stats(spark, d):
    s = report.stats(sequences.trips(extracted(spark, d)))
    return s.select("season", *[r(c).alias(c) for c in ("mean_days", "sd_days", "min_cumu_km", "max_maxpair_km")])


CIRC_SQL = """, days AS (SELECT {k}, c, date_diff('day', DATE '2001-01-01', make_date(2001, CAST(month(t) AS INTEGER), CAST(CASE WHEN month(t) = 2 AND day(t) = 29 THEN 28 ELSE day(t) END AS INTEGER))) AS v FROM {src})"""


@query(CIRC_SQL.format(k="season", src="(SELECT season, unnest(['start', 'end']) AS c, unnest([start_date, end_date]) AS t FROM trips)") + """,
m0 AS (SELECT season, c, atan2(avg(sin(v * 2 * pi() / 365)), avg(cos(v * 2 * pi() / 365))) * 365 / (2 * pi()) AS m FROM days GROUP BY 1, 2),
m1 AS (SELECT season, c, CAST(round_even(m - 365 * floor(m / 365), 0) AS INTEGER) % 365 AS m FROM m0)
SELECT season, c AS edge, strftime(DATE '2001-01-01' + m, '%m/%d') AS mean_day FROM m1""")
def circular_mean(spark, d):
    c = report.circular_dates(sequences.trips(extracted(spark, d)), ["season"])
    return c.select("season", F.inline(F.array(F.struct(F.lit("start").alias("edge"), F.col("mean_start").alias("mean_day")), F.struct(F.lit("end").alias("edge"), F.col("mean_end").alias("mean_day")))))


@query(CIRC_SQL.format(k="animal_id", src="(SELECT o_custkey AS animal_id, 'x' AS c, o_orderdate AS t FROM orders)") + """,
o AS (SELECT animal_id, v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY animal_id) AS n, lead(v) OVER w AS nx, min(v) OVER (PARTITION BY animal_id) AS mn FROM days WINDOW w AS (PARTITION BY animal_id ORDER BY v)),
gap AS (SELECT *, coalesce(nx - v, mn + 365 - v) AS g FROM o),
seam AS (SELECT animal_id, arg_max(i, g * 100000 - i) AS s, any_value(n) AS n FROM gap GROUP BY 1)
SELECT CAST(animal_id AS VARCHAR) AS animal_id, CAST(v AS INTEGER) AS median_day FROM seam JOIN o USING (animal_id) WHERE o.i = (s + 1 + seam.n // 2) % seam.n""")
def circular_median(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("animal_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("t"))
    return o.groupBy("animal_id").agg(temporal.circular_median_day(F.col("t")).cast("int").alias("median_day"))


@query(""", trip2 AS (SELECT *, unnest([CAST(bio_year AS VARCHAR), 'All_Years']) AS y FROM trips),
edge AS (SELECT season, y, unnest(['start', 'end']) AS c, unnest([start_date, end_date]) AS t FROM trip2),
dd AS (SELECT season, y, c, t, date_diff('day', DATE '2001-01-01', make_date(2001, CAST(month(t) AS INTEGER), CAST(CASE WHEN month(t) = 2 AND day(t) = 29 THEN 28 ELSE day(t) END AS INTEGER))) AS v FROM edge),
m0 AS (SELECT season, y, c, min(t) AS lo, max(t) AS hi, atan2(avg(sin(v * 2 * pi() / 365)), avg(cos(v * 2 * pi() / 365))) * 365 / (2 * pi()) AS m FROM dd GROUP BY 1, 2, 3),
m1 AS (SELECT *, CAST(round_even(m - 365 * floor(m / 365), 0) AS INTEGER) % 365 AS mean_v FROM m0),
o AS (SELECT season, y, c, v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY season, y, c) AS n, lead(v) OVER w AS nx, min(v) OVER (PARTITION BY season, y, c) AS mn FROM dd WINDOW w AS (PARTITION BY season, y, c ORDER BY v)),
seam AS (SELECT season, y, c, arg_max(i, coalesce(nx - v, mn + 365 - v) * 1000000 - i) AS s, any_value(n) AS n FROM o GROUP BY 1, 2, 3),
med AS (SELECT season, y, c, v AS med_v FROM seam JOIN o USING (season, y, c) WHERE o.i = (s + 1 + seam.n // 2) % seam.n),
one AS (SELECT season, y, c, unnest(['earliest_' || c, 'latest_' || c, 'median_' || c, 'average_' || c]) AS metric, unnest([strftime(lo, '%m/%d'), strftime(hi, '%m/%d'), strftime(DATE '2001-01-01' + CAST(med_v AS INTEGER), '%m/%d'), strftime(DATE '2001-01-01' + mean_v, '%m/%d')]) AS value FROM m1 JOIN med USING (season, y, c))
SELECT season, y AS year, metric, value FROM one UNION ALL SELECT season, y, 'n', CAST(count(*) AS VARCHAR) FROM trip2 GROUP BY 1, 2""")
def sequences_summary(spark, d):
    return report.sequences_summary(sequences.trips(extracted(spark, d)))


@query("""SELECT season, count(DISTINCT animal_id) AS n_animals, count(*) AS n_sequences, make_timestamp(CAST(floor(median(epoch_us(start_date))) AS BIGINT)) AS median_start, make_timestamp(CAST(floor(median(epoch_us(end_date))) AS BIGINT)) AS median_end,
round(avg(cumu_km), 6) AS mean_cumu_km, round(median(cumu_km), 6) AS median_cumu_km, round(stddev_samp(cumu_km), 6) AS std_cumu_km, round(min(cumu_km), 6) AS min_cumu_km, round(max(cumu_km), 6) AS max_cumu_km,
round(avg(days), 6) AS mean_days, round(median(days), 6) AS median_days, round(stddev_samp(days), 6) AS std_days, round(min(days), 6) AS min_days, round(max(days), 6) AS max_days FROM trips GROUP BY 1""")
def season_summary(spark, d):
    s = report.season_summary(sequences.trips(extracted(spark, d)))
    return s.select(*[r(c).alias(c) if c.endswith(("_km", "_days")) else c for c in s.columns])


@query(""", t2 AS (SELECT *, unnest([season, 'all']) AS s FROM trips), ang AS (SELECT s, (date_diff('day', DATE '2001-01-01', make_date(2001, CAST(month(start_date) AS INTEGER), CAST(CASE WHEN month(start_date) = 2 AND day(start_date) = 29 THEN 28 ELSE day(start_date) END AS INTEGER)))) * 2 * pi() / 365 AS a FROM t2),
ms AS (SELECT s, atan2(avg(sin(a)), avg(cos(a))) * 365 / (2 * pi()) AS m FROM ang GROUP BY 1), fr AS (SELECT max(fix_rate_hours) AS mx, median(fix_rate_hours) AS md FROM steps)
SELECT 'D' AS herd_id, (SELECT count(DISTINCT animal_id) FROM fixes) AS num_ind, (SELECT count(DISTINCT animal_id) FROM trips) AS mig_ind, (SELECT round(mx, 6) FROM fr) AS max_hours, (SELECT round(md, 6) FROM fr) AS median_hours,
(SELECT count(*) FROM (SELECT animal_id, arg_min("Sex", timestamp) FILTER ("Sex" IS NOT NULL) AS x FROM fixes GROUP BY 1) WHERE upper(x) IN ('F', 'FEMALE')) AS n_female,
s AS season, count(DISTINCT animal_id) AS n_animals, count(*) AS n_sequences, round(avg(days), 6) AS mean_days, round(stddev_samp(eucl_km), 6) AS sd_eucl_km, strftime(DATE '2001-01-01' + CAST(round_even(any_value(m) - 365 * floor(any_value(m) / 365), 0) AS INTEGER) % 365, '%m/%d') AS mean_start
FROM t2 JOIN ms USING (s) GROUP BY s""")
def herd_row(spark, d):
    """The wide row of the herd, a row for each of its seasons."""
    f = stepped(spark, d)
    row = report.herd_metadata(f, sequences.trips(extracted(spark, d)), spark.range(1).select(F.lit("D").alias("herd_id")))
    wide = row.select("herd_id", "num_ind", "mig_ind", r("max_hours").alias("max_hours"), r("median_hours").alias("median_hours"), "n_female", F.explode("seasons").alias("season", "s"))
    return wide.select("herd_id", "num_ind", "mig_ind", "max_hours", "median_hours", "n_female", "season", "s.n_animals", "s.n_sequences", r("s.mean_days").alias("mean_days"), r("s.sd_eucl_km").alias("sd_eucl_km"), "s.mean_start")


@query("SELECT mig AS id, '01-15' AS wrr_date, round(maxpair_km, 6) AS maxpair_km, CAST(n_fixes AS INTEGER) AS n_points FROM lines JOIN maxpair USING (mig)")
def line_features(spark, d):
    from ..sinks.tables import mig_lines

    t = mig_lines(extracted(spark, d), start=BIO_YEAR)
    return t.select(F.col("mig").alias("id"), "wrr_date", r("maxpair_km").alias("maxpair_km"), F.size("line").alias("n_points"))


ASOF_SQL = """, gps AS (SELECT ord, animal_id, date_trunc('second', timestamp) AS t FROM fixes WHERE event_type IN ('click', 'view', 'purchase')),
wld AS (SELECT animal_id, date_trunc('second', timestamp) AS t, min(value) AS var FROM fixes WHERE event_type IN ('error', 'signup') GROUP BY 1, 2),
b AS (SELECT g.ord, g.t, w.t AS t1, w.var AS v1 FROM gps g ASOF LEFT JOIN wld w ON g.animal_id = w.animal_id AND g.t >= w.t),
a AS (SELECT g.ord, w.t AS t2, w.var AS v2 FROM gps g ASOF LEFT JOIN wld w ON g.animal_id = w.animal_id AND g.t <= w.t),
m AS (SELECT ord, epoch(t) - epoch(t1) AS db, epoch(t2) - epoch(t) AS da, v1, v2 FROM b JOIN a USING (ord))
SELECT ord, CASE WHEN least(db, da) <= 21600 THEN CASE WHEN da IS NULL OR db < da THEN v1 ELSE v2 END END AS var, CASE WHEN least(db, da) <= 21600 THEN CAST(least(db, da) AS DOUBLE) END AS diff_s FROM m"""


@query(ASOF_SQL)
def asof_nearest(spark, d):
    f = fixes(spark, d)
    gps = f.where("event_type in ('click', 'view', 'purchase')").select("ord", "animal_id", "timestamp")
    wld = f.where("event_type in ('error', 'signup')").select("animal_id", "timestamp", F.col("value").alias("var"))
    return enrich.nearest_in_time(gps, wld, ["var"], tolerance_s=21600).select("ord", "var", "diff_s")


@query(""", g AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS g FROM events), s AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS w, o_custkey AS o FROM orders WHERE o_custkey <= 2000),
p AS (SELECT g, w, o FROM g, s WHERE contains(g, w) OR contains(w, g)) SELECT g, arg_min(w, o) AS w FROM p GROUP BY 1""")
def substring_id_map(spark, d):
    g = table(spark, d, "events").select(F.col("user_id").cast("string").alias("animal_id"))
    s = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("wld_serial"), F.col("o_custkey").alias("o"))
    return enrich.match_ids(g, s, order="o")


@query("""SELECT ord, CASE WHEN lon BETWEEN -108.25 AND -106.75 AND lat BETWEEN 39.0 AND 40.5 THEN CASE WHEN (CAST(least(59, floor((40.5 - lat) / 1.5 * 60)) AS INTEGER) + CAST(least(59, floor((lon + 108.25) / 1.5 * 60)) AS INTEGER)) % 7 <> 0
THEN CAST(1500 + 10 * least(59, floor((40.5 - lat) / 1.5 * 60)) + least(59, floor((lon + 108.25) / 1.5 * 60)) AS DOUBLE) END END AS elevation_m FROM fixes""")
def dem_lookup(spark, d):
    tiles = spark.range(1).select(F.lit("n40w108").alias("tile"), *[F.lit(v).alias(n) for n, v in (("west", -108.25), ("south", 39.0), ("east", -106.75), ("north", 40.5))], F.lit(60).alias("nrows"), F.lit(60).alias("ncols"))
    rc = spark.range(3600).select(F.lit("n40w108").alias("tile"), F.floor(F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"))
    cells = rc.withColumn("v", F.when((F.col("row") + F.col("col")) % 7 == 0, -9999.0).otherwise((1500 + 10 * F.col("row") + F.col("col")).cast("double")))
    return enrich.sample_elevation(fixes(spark, d).select("ord", "lon", "lat"), tiles, cells).select("ord", "elevation_m")


@query("""SELECT c_name AS name, c_custkey % 17 AS size_bytes FROM (SELECT *, 'n' || c_nationkey || 'w' || (c_custkey % 9) AS cell FROM customer) QUALIFY row_number() OVER (PARTITION BY cell ORDER BY c_custkey % 17 DESC, 'usgs_' || cell || '_' || c_name) = 1""")
def dem_tile_dedup(spark, d):
    c = table(spark, d, "customer")
    files = c.select(F.concat(F.lit("usgs_n"), F.col("c_nationkey").cast("string"), F.lit("w"), (F.col("c_custkey") % 9).cast("string"), F.lit("_"), F.col("c_name")).alias("name"), (F.col("c_custkey") % 17).alias("size_bytes"))
    return enrich.largest_tiles(files).select(F.regexp_replace("name", "^usgs_n[0-9]+w[0-9]+_", "").alias("name"), "size_bytes")


@query("""SELECT ord, CASE WHEN (CAST(floor(y / 2000) AS INTEGER) + day(timestamp)) % 3 = 0 THEN 0 ELSE (CAST(floor(x / 2000) AS INTEGER) % 5) / 4.0 END AS snow_depth_m,
CASE WHEN (CAST(floor(y / 2000) AS INTEGER) + day(timestamp)) % 3 = 0 THEN 0 ELSE 0.25 END AS swe_m,
round(CASE WHEN (CAST(floor(y / 2000) AS INTEGER) + day(timestamp)) % 3 <> 0 AND CAST(floor(x / 2000) AS INTEGER) % 5 > 0 THEN 0.25 / ((CAST(floor(x / 2000) AS INTEGER) % 5) / 4.0) * 1000 ELSE 0 END, 6) AS snow_density_kgm3 FROM fixes""")
def snow_lookup(spark, d):
    f = fixes(spark, d).select("ord", "timestamp", F.floor(F.col("y") / 2000).cast("int").alias("r"), F.floor(F.col("x") / 2000).cast("int").alias("c"))
    snow = f.select(F.date_format("timestamp", "yyyyMMdd").alias("date"), F.col("r").alias("row"), F.col("c").alias("col"), F.dayofmonth("timestamp").alias("dd")).distinct().where("(row + dd) % 3 <> 0").select("date", "row", "col", ((F.col("col") % 5) / 4.0).alias("depth"), F.lit(0.25).alias("swe"))
    return enrich.sample_snow(f, snow, F.col("r"), F.col("c")).select("ord", "snow_depth_m", "swe_m", r("snow_density_kgm3").alias("snow_density_kgm3"))


@query(""", seg AS (SELECT animal_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fixes WINDOW w AS (PARTITION BY animal_id ORDER BY timestamp)),
hit AS (SELECT animal_id, mtfcc FROM seg JOIN roads ON rx BETWEEN least(x1, x2) AND greatest(x1, x2) AND CASE WHEN x1 = x2 THEN least(y1, y2) <= 4430000 AND greatest(y1, y2) >= 4390000 ELSE y1 + (rx - x1) / (x2 - x1) * (y2 - y1) BETWEEN 4390000 AND 4430000 END WHERE x2 IS NOT NULL)
SELECT a.animal_id, coalesce(bool_or(mtfcc = 'S1400'), FALSE) AS crosses_road, coalesce(bool_or(mtfcc IN ('S1100', 'S1200')), FALSE) AS crosses_highway FROM (SELECT DISTINCT animal_id FROM fixes) a LEFT JOIN hit USING (animal_id) GROUP BY 1""")
def road_crossings(spark, d):
    return enrich.road_crossings(fixes(spark, d), fixtures.roads(spark, d), key="animal_id", cell=3000.0)


@query(""", w AS (SELECT animal_id, bio_year, max(CASE WHEN slot = 1 THEN "end" END) AS se, max(CASE WHEN slot = 1 THEN "start" END) AS ss, max(CASE WHEN slot = 2 THEN "start" END) AS fs, max(CASE WHEN slot = 2 THEN "end" END) AS fe FROM migtime GROUP BY 1, 2)
SELECT a.animal_id, CAST(a.bio_year AS INTEGER) AS bio_year, 'Summer' AS season, a.se AS "start", a.fs AS "end", CASE WHEN a.se >= a.fs THEN 'bounds are reversed' END AS skipped FROM w a UNION ALL
SELECT a.animal_id, CAST(a.bio_year AS INTEGER), 'Winter', a.fe, b.ss, CASE WHEN b.ss IS NULL THEN 'a bound is missing' WHEN a.fe >= b.ss THEN 'bounds are reversed' END FROM w a LEFT JOIN w b ON b.animal_id = a.animal_id AND b.bio_year = a.bio_year + 1""")
def range_windows(spark, d):
    return sequences.range_windows(fixtures.windows(spark, d))


@query(""", g AS (SELECT ord, x, lag(x) OVER w AS p, lead(x) OVER w AS q FROM fixes WINDOW w AS (PARTITION BY animal_id ORDER BY timestamp)) SELECT ord, round(coalesce((q - p) / 2, q - x, x - p), 6) AS gradient FROM g""")
def gradient(spark, d):
    return movement.with_gradient(fixes(spark, d), "x", ("animal_id",)).select("ord", r("gradient").alias("gradient"))


@query(""", g AS (SELECT animal_id, timestamp, CAST(sign(value - 100) AS INTEGER) AS s FROM fixes WHERE value IS NOT NULL), h AS (SELECT *, CASE WHEN lag(s) OVER w IS NOT DISTINCT FROM s THEN 0 ELSE 1 END AS n FROM g WINDOW w AS (PARTITION BY animal_id ORDER BY timestamp)),
i AS (SELECT *, sum(n) OVER (PARTITION BY animal_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS run FROM h)
SELECT animal_id, CAST(run AS BIGINT) AS run, s AS sign, count(*) AS n, min(timestamp) AS "start", max(timestamp) AS "end" FROM i WHERE s <> 0 GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def run_length_segments(spark, d):
    return detect.runs(fixes(spark, d).withColumn("v", F.col("value") - 100), "v", ("animal_id",))


@query()
def detect_migrations(spark, d):
    f = movement.with_nsd(keyed(spark, d), ["animal_id", "bio_year"], "id_bio_year")
    return detect.detect_migrations(f)


@query(GRID_SQL + "SELECT round(minx, 6) AS minx, round(miny, 6) AS miny, round(maxx, 6) AS maxx, round(maxy, 6) AS maxy, nrows, ncols, CAST(2000 AS DOUBLE) AS cell_size FROM grid")
def pop_grid(spark, d):
    g = ud.grid_table(points(spark, d), CELL)
    return g.select(*[r(c).alias(c) for c in ("minx", "miny", "maxx", "maxy")], "nrows", "ncols", "cell_size")


@query(GRID_SQL + """SELECT seq_id, "row", col, round(sum(exp(-((gx - x) * (gx - x) + (gy - y) * (gy - y)) / (2 * h * h)) / (2 * pi() * h * h * n)) * 1e6, 6) AS density FROM cl JOIN pts USING (seq_id) WHERE n >= 5 AND h > 0 GROUP BY 1, 2, 3""")
def kernel_ud(spark, d):
    p = points(spark, d)
    k = ud.kernel_sql(p, ud.make_grid(p, CELL))
    return k.select("seq_id", "row", "col", r(F.col("density") * 1e6).alias("density"))


@query(GRID_SQL + """, seg AS (SELECT seq_id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2, (epoch_us(lead(timestamp) OVER w) - epoch_us(timestamp)) / 60e6 AS lag FROM pts WINDOW w AS (PARTITION BY seq_id ORDER BY timestamp)),
st AS (SELECT *, unnest(range(0, CAST(floor(lag / 30) AS BIGINT) + 1)) AS k FROM seg WHERE lag > 0 AND lag <= 480), sa AS (SELECT *, least(1.0, k * 30 / lag) AS a FROM st),
br AS (SELECT seq_id, x + a * (x2 - x) AS mx, y + a * (y2 - y) AS my, lag * a * (1 - a) * 1000 + ((1 - a) * (1 - a) + a * a) * 250000 AS v FROM sa),
raw AS (SELECT seq_id, "row", col, sum(exp(-((gx - mx) * (gx - mx) + (gy - my) * (gy - my)) / (2 * v)) / (2 * pi() * v)) AS density FROM cl JOIN br USING (seq_id) GROUP BY 1, 2, 3)
SELECT seq_id, "row", col, round(density / sum(density) OVER (PARTITION BY seq_id), 6) AS density FROM raw""")
def bbmm_fmv(spark, d):
    p = points(spark, d)
    b = ud.bridge_sql(p, ud.make_grid(p, CELL), bm_var=1000, error=500, step=30)
    return b.select("seq_id", "row", "col", r("density").alias("density"))


@query()
def bbmm_eb(spark, d):
    p = points(spark, d)
    return ud.run_sequences(p, ud.make_grid(p, CELL), model_config("BBMM", location_error=500, time_step=30, max_lag_hours=27, cell_size=CELL), "seq_id")


@query()
def kernel_models(spark, d):
    p = points(spark, d)
    return ud.run_sequences(p, ud.make_grid(p, CELL), model_config("Kernel", cell_size=CELL), "seq_id")


CUT = """, tk AS (SELECT *, sum(density) OVER (PARTITION BY seq_id ORDER BY density DESC, "row", col ROWS UNBOUNDED PRECEDING) / sum(density) OVER (PARTITION BY seq_id) AS run FROM uc),
tc AS (SELECT *, max(CASE WHEN run > {c} THEN density END) OVER (PARTITION BY seq_id) AS cut FROM tk), kept AS (SELECT * FROM tc WHERE cut IS NULL OR density >= cut)"""


@query(USE_SQL + CUT.format(c="0.813") + """ SELECT seq_id, "row", col, round(density / sum(density) OVER (PARTITION BY seq_id), 6) AS density FROM kept""")
def tail_cut(spark, d):
    return ud.tail_cut(use_cells(points(spark, d)), 0.813).select("seq_id", "row", "col", r("density").alias("density"))


@query(USE_SQL + CUT.format(c="0.517") + """ SELECT seq_id, "row", col FROM kept""")
def footprint(spark, d):
    return ud.footprint(use_cells(points(spark, d)), 51.7)


@query(USE_SQL + """, tk AS (SELECT *, sum(density) OVER (PARTITION BY seq_id ORDER BY density DESC, "row", col ROWS UNBOUNDED PRECEDING) AS run FROM uc) SELECT seq_id, "row", col FROM tk WHERE run - density < 0.517""")
def contour_cells(spark, d):
    return ud.contour_cells(use_cells(points(spark, d)), 51.7)


@query(GRID_SQL + """, seg AS (SELECT seq_id, x, y, coalesce(lead(x) OVER w, CASE WHEN count(*) OVER (PARTITION BY seq_id) = 1 THEN x END) AS x2, coalesce(lead(y) OVER w, CASE WHEN count(*) OVER (PARTITION BY seq_id) = 1 THEN y END) AS y2 FROM pts WINDOW w AS (PARTITION BY seq_id ORDER BY timestamp)),
sg AS (SELECT *, (x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) AS ll FROM seg WHERE x2 IS NOT NULL),
allc AS (SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, minx + (c + 0.5) * pw AS gx, maxy - (r + 0.5) * ph AS gy FROM gg, range(0, 400) t1(r), range(0, 400) t2(c) WHERE r < nrows AND c < ncols),
pr AS (SELECT seq_id, "row", col, gx, gy, x, y, x2, y2, CASE WHEN ll > 0 THEN greatest(0, least(1, ((gx - x) * (x2 - x) + (gy - y) * (y2 - y)) / ll)) ELSE 0 END AS t FROM sg JOIN allc ON gx BETWEEN least(x, x2) - 1500 AND greatest(x, x2) + 1500 AND gy BETWEEN least(y, y2) - 1500 AND greatest(y, y2) + 1500)
SELECT DISTINCT seq_id, "row", col FROM pr WHERE sqrt(pow(x + t * (x2 - x) - gx, 2) + pow(y + t * (y2 - y) - gy, 2)) <= 1500""")
def line_buffer(spark, d):
    p = points(spark, d)
    return ud.line_buffer(p, ud.make_grid(p, CELL), 1500)


@query(USE_SQL + """SELECT animal_id, "row", col, round(density, 6) AS density FROM ind""")
def individual_ud(spark, d):
    return population.individual_ud(*used(spark, d)).withColumn("density", r("density"))


@query(USE_SQL + """SELECT DISTINCT animal_id, "row", col FROM uc JOIN mem USING (seq_id)""")
def individual_footprint(spark, d):
    return population.individual_footprint(*used(spark, d))


@query(USE_SQL + """SELECT "row", col, round(sum(density) / (SELECT count(DISTINCT animal_id) FROM ind), 8) AS density FROM ind GROUP BY 1, 2""")
def range_density(spark, d):
    return population.range_density(*used(spark, d)).withColumn("density", r("density", 8))


LAYER_SQL = USE_SQL + """, ay0 AS (SELECT animal_id, bio_year, count(*) AS k FROM mem GROUP BY 1, 2), ay AS (SELECT animal_id, bio_year, "row", col, sum(density) / any_value(k) AS density FROM uc JOIN mem USING (seq_id) JOIN ay0 USING (animal_id, bio_year) GROUP BY 1, 2, 3, 4),
yk AS (SELECT animal_id, count(DISTINCT bio_year) AS k FROM mem GROUP BY 1), lay AS (SELECT animal_id AS layer, "row", col, sum(density) / any_value(k) AS density FROM ay JOIN yk USING (animal_id) GROUP BY 1, 2, 3)"""


@query(LAYER_SQL + """ SELECT "row", col, round(count(DISTINCT layer) * 100.0 / (SELECT count(DISTINCT layer) FROM lay), 6) AS value FROM lay WHERE density > 0 GROUP BY 1, 2""")
def population_use_area(spark, d):
    return population.use_area(population.merged_layers(*used(spark, d))).withColumn("value", r("value"))


@query(LAYER_SQL + """, v0 AS (SELECT "row", col, sum(density) AS v FROM lay GROUP BY 1, 2),
v1 AS (SELECT "row", col, v / (SELECT sum(v) FROM v0) AS density FROM v0)
SELECT "row", col, round(density, 8) AS density, round(sum(density) OVER (ORDER BY round(density, 12) DESC, "row", col ROWS UNBOUNDED PRECEDING), 8) AS cum FROM v1""")
def population_use_volume(spark, d):
    return population.use_volume(population.merged_layers(*used(spark, d))).select("row", "col", r("density", 8).alias("density"), r("cum", 8).alias("cum"))


@query(USE_SQL + """SELECT "row", col, round(count(DISTINCT seq_id) * 100.0 / (SELECT count(DISTINCT seq_id) FROM uc), 6) AS value FROM uc GROUP BY 1, 2""")
def population_footprint(spark, d):
    return population.footprint_share(use_cells(points(spark, d))).withColumn("value", r("value"))


def _season(spark, d, name: str, **settings) -> DataFrame:
    individual = population.individual_ud(*used(spark, d), by_season=True)
    return population.season_products(individual, ["season"], only={name}, **settings)[name]


@query(USE_SQL + """SELECT season, "row", col, CAST(n AS INTEGER) AS n FROM surf""")
def season_count(spark, d):
    return _season(spark, d, "count")


@query(USE_SQL + """SELECT season, "row", col, round(mean_ud, 8) AS mean_ud FROM surf""")
def season_mean_ud(spark, d):
    return _season(spark, d, "mean_ud").withColumn("mean_ud", r("mean_ud", 8))


@query(USE_SQL + """SELECT season, "row", col, CAST(n AS INTEGER) AS n FROM surf WHERE n >= 2""")
def season_minimum_n(spark, d):
    return _season(spark, d, "minimum2_count")


@query(USE_SQL + """SELECT season, "row", col, CAST(n AS DOUBLE) AS n FROM (SELECT *, sum(n) OVER (PARTITION BY season ORDER BY n DESC, "row", col ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY season) AS t FROM surf) WHERE run - n < t * 20 / 100""")
def season_top_p(spark, d):
    return _season(spark, d, "top20")


@query(USE_SQL + """, su AS (SELECT season, "row", col, round(mean_ud, 10) AS u FROM surf) SELECT season, "row", col, u AS mean_ud FROM (SELECT *, sum(u) OVER (PARTITION BY season ORDER BY u DESC, "row", col ROWS UNBOUNDED PRECEDING) AS run, sum(u) OVER (PARTITION BY season) AS t FROM su) WHERE run - u < t * 0.137""")
def season_stopover(spark, d):
    s = population.season_surface(population.individual_ud(*used(spark, d), by_season=True), ["season"])
    return population.smallest_prefix(s.withColumn("mean_ud", r("mean_ud", 10)), "mean_ud", 13.7, ["season"])


@query()
def contour_components(spark, d):
    p = points(spark, d)
    grid = ud.make_grid(p, CELL)
    share = population.footprint_share(ud.line_buffer(p, grid, 1500))
    return contours.areas(contours.components(population.level_cells(share, [5.0, 10.0, 20.0]), grid, drop_m2=grid.px_w * grid.px_h * 1.5, fill_m2=grid.px_w * grid.px_h * 1.5), grid)


@query("SELECT mig AS id, season, start_date, end_date, n_fixes, round(eucl_km, 6) AS eucl_km, round(cumu_km, 6) AS cumu_km FROM lines")
def line_attributes(spark, d):
    t = sequences.line_distances(extracted(spark, d), extra=("label",))
    return t.select(F.col("mig").alias("id"), F.col("label").alias("season"), "start_date", "end_date", "n_fixes", r("eucl_km").alias("eucl_km"), r("cumu_km").alias("cumu_km"))


@query("""SELECT s.mig, s.ord, f."DOP" AS dop, f."Sex" AS sex FROM seqs s LEFT JOIN fixes f ON f.animal_id = s.animal_id AND f.timestamp = s.timestamp""")
def mig_points_enriched(spark, d):
    from ..sinks.tables import mig_points

    return mig_points(extracted(spark, d).select("mig", "ord", "animal_id", "timestamp"), fixes(spark, d).select("animal_id", "timestamp", F.col("DOP").alias("dop"), F.col("Sex").alias("sex"))).select("mig", "ord", "dop", "sex")


@query("""SELECT animal_id, arg_min(v, -n * 1000 + rk) AS value FROM (SELECT animal_id, event_type AS v, count(*) AS n, row_number() OVER (PARTITION BY animal_id ORDER BY event_type) AS rk FROM fixes GROUP BY 1, 2) GROUP BY 1""")
def age_sex_mode(spark, d):
    return ingest.usual_value(fixes(spark, d), "event_type")


@query("""SELECT ord, TRUE AS kept FROM fixes WHERE coalesce(nullif(trim("AgeClass"), ''), '(blank)') IN ('Adult', '(blank)') UNION ALL SELECT ord, FALSE FROM fixes WHERE coalesce(nullif(trim("AgeClass"), ''), '(blank)') NOT IN ('Adult', '(blank)')""")
def include_filter(spark, d):
    kept, gone = ingest.include_values(fixes(spark, d), "AgeClass", ["Adult", "(blank)"])
    return kept.select("ord", F.lit(True).alias("kept")).unionByName(gone.select("ord", F.lit(False).alias("kept")))


CLASS_SQL = ", cls AS (SELECT DISTINCT animal_id || '_' || bio_year AS id_bio_year, CASE user_id % 4 WHEN 0 THEN 'resident' WHEN 1 THEN 'nomadic' ELSE 'migrant' END AS classification FROM fixes)"


def _classes(spark, d) -> DataFrame:
    u = F.col("user_id") % 4
    return keyed(spark, d).select("id_bio_year", F.when(u == 0, "resident").when(u == 1, "nomadic").otherwise("migrant").alias("classification")).distinct()


@query(CLASS_SQL + " SELECT id_bio_year, animal_id, classification, count(*) AS n_fixes, min(timestamp) AS first_fix, max(timestamp) AS last_fix FROM (SELECT *, animal_id || '_' || bio_year AS id_bio_year FROM fixes) JOIN cls USING (id_bio_year) WHERE classification <> 'migrant' GROUP BY 1, 2, 3")
def removed_animal_years(spark, d):
    return sequences.removed_animal_years(keyed(spark, d), _classes(spark, d))


@query(CLASS_SQL + " SELECT ord FROM (SELECT *, animal_id || '_' || bio_year AS id_bio_year FROM flagged) JOIN cls USING (id_bio_year) WHERE classification = 'migrant' AND (problem = 1 OR mortality_flag = 1)")
def removed_fixes(spark, d):
    return sequences.removed_fixes(flagged(spark, d), _classes(spark, d)).select("ord")


@query("SELECT ord FROM flagged WHERE problem = 0 AND mortality_flag = 0")
def flags_removed(spark, d):
    return movement.unflagged(flagged(spark, d)).select("ord")


@query("SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY animal_id ORDER BY timestamp) - 1 AS n, greatest(1, count(*) OVER (PARTITION BY animal_id) // 20) AS st FROM fixes) WHERE n % st = 0")
def thin_tracks(spark, d):
    return movement.thin(fixes(spark, d), 20).select("ord")


@query("SELECT animal_id, arg_min(ord, abs(epoch_us(timestamp) - epoch_us(TIMESTAMP '2024-01-16 12:00:00'))) AS ord FROM fixes GROUP BY 1")
def nearest_fix(spark, d):
    return movement.nearest_fix(fixes(spark, d), F.lit("2024-01-16 12:00:00").cast("timestamp_ntz")).select("animal_id", "ord")


@query("SELECT ord, animal_id, timestamp FROM fixes ORDER BY ord LIMIT 25 OFFSET 50")
def preview_page(spark, d):
    from ..sources.tables import preview

    return preview(fixes(spark, d).select("ord", "animal_id", "timestamp"), 2, order="ord")


_NSD_GROUPS = {"id_yr": "animal_id, year(timestamp)", "animal_id": "animal_id", "id_bio_year": "animal_id, bio_year"}
_CHAIN_SQL = "".join(
    f", r{i} AS (SELECT ord, avg(CASE WHEN n <= 20 THEN x END) OVER (PARTITION BY {k}) AS rx{i}, avg(CASE WHEN n <= 20 THEN y END) OVER (PARTITION BY {k}) AS ry{i} FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY timestamp) AS n FROM fixes))"
    for i, k in enumerate(_NSD_GROUPS.values())
)


@query(_CHAIN_SQL + " SELECT ord, burst_id, round(dist, 5) AS dist, round(dt, 3) AS dt, round(speed, 6) AS speed, round(abs_angle, 5) AS abs_angle, round(rel_angle, 5) AS rel_angle, problem, mortality_flag, animal_id || '_' || bio_year AS id_bio_year, "
       + ", ".join(f"round(rx{i}, 6) AS ref_x_{n}, round(((x - rx{i}) * (x - rx{i}) + (y - ry{i}) * (y - ry{i})) / 1e6, 6) AS nsd_{n}" for i, n in enumerate(_NSD_GROUPS)) + " FROM flagged JOIN r0 USING (ord) JOIN r1 USING (ord) JOIN r2 USING (ord)")
def process_chain(spark, d):
    f = measure(fixes(spark, d), ProcessConfig(bio_year_start=BIO_YEAR), "ord")
    nsd = [c for n in _NSD_GROUPS for c in (r(f"ref_x_{n}", 6).alias(f"ref_x_{n}"), r(f"nsd_{n}").alias(f"nsd_{n}"))]
    return f.select("ord", "burst_id", r("dist", 5).alias("dist"), r("dt", 3).alias("dt"), r("speed").alias("speed"), r("abs_angle", 5).alias("abs_angle"), r("rel_angle", 5).alias("rel_angle"), "problem", "mortality_flag", "id_bio_year", *nsd)


def _utm_sql() -> str:
    """Krueger's series as SQL, for the zone of each longitude."""
    radius, alpha = geo._kruger()
    e = 0.0818191908426215
    sums = ["xi" + "".join(f" + {a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1)), "eta" + "".join(f" + {a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))]
    return f""", a0 AS (SELECT ord, CAST(floor((lon + 180) / 6) + 1 AS INTEGER) AS utm_zone, radians(lat) AS p, radians(lon - (6 * (floor((lon + 180) / 6) + 1) - 183)) AS l FROM fixes WHERE lon IS NOT NULL),
a1 AS (SELECT *, sinh(atanh(sin(p)) - {e!r} * atanh({e!r} * sin(p))) AS t FROM a0), a2 AS (SELECT *, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM a1)
SELECT ord, utm_zone, round(500000 + {0.9996 * radius!r} * ({sums[1]}), 3) AS x, round({0.9996 * radius!r} * ({sums[0]}), 3) AS y FROM a2"""


@query(_utm_sql())
def utm_forward(spark, d):
    f = fixes(spark, d).where("lon is not null").select("ord", "lon", "lat", geo.utm_zone(F.col("lon")).alias("utm_zone"))
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), F.col("utm_zone"))
    return f.select("ord", "utm_zone", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query("SELECT ord, round(lon, 8) AS lon, round(lat, 8) AS lat FROM fixes WHERE lon IS NOT NULL")
def utm_inverse(spark, d):
    f = fixes(spark, d).where("lon is not null").withColumn("zone", geo.utm_zone(F.col("lon")))
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    lon, lat = geo.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.lit(False))
    return f.select("ord", "zone", x.alias("e"), y.alias("n")).select("ord", r(lon, 8).alias("lon"), r(lat, 8).alias("lat"))


@query("SELECT ord, CASE WHEN ord % 10 < 8 THEN date_trunc('minute', timestamp) END AS timestamp FROM fixes")
def timestamp_spellings(spark, d):
    text = F.when(F.col("ord") % 10 < 6, F.date_format("timestamp", "M/d/yyyy H:mm")).when(F.col("ord") % 10 < 8, F.date_format("timestamp", "yyyy-MM-dd HH:mm")).otherwise("never")
    return temporal.parse_flexibly(fixes(spark, d).select("ord", text.alias("t")), "t", "yyyy-MM-dd HH:mm:ss").select("ord", "timestamp")


@query(""", g AS (SELECT animal_id || '_' || bio_year AS id_bio_year, *, row_number() OVER (PARTITION BY animal_id, bio_year ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY animal_id, bio_year) AS n,
  avg(CASE WHEN k20 <= 20 THEN x END) OVER (PARTITION BY animal_id, bio_year) AS rx, avg(CASE WHEN k20 <= 20 THEN y END) OVER (PARTITION BY animal_id, bio_year) AS ry,
  min(timestamp) OVER (PARTITION BY animal_id, bio_year) AS t0, max(timestamp) OVER (PARTITION BY animal_id, bio_year) AS t1 FROM (SELECT *, row_number() OVER (PARTITION BY animal_id, bio_year ORDER BY timestamp) AS k20 FROM fixes)),
w AS (SELECT id_bio_year, ord, timestamp, i, n, ((x - rx) * (x - rx) + (y - ry) * (y - ry)) / 1e6 AS v, CAST(greatest(3, round_even(7 * greatest(1, n / greatest(1, floor((epoch_us(t1) - epoch_us(t0)) / 86400e6))), 0)) AS BIGINT) AS s0 FROM g),
s AS (SELECT *, (s0 - 1 + s0 % 2) // 2 + CASE WHEN s0 % 2 = 0 THEN 1 ELSE 0 END - CASE WHEN s0 % 2 = 0 THEN 0 ELSE 0 END AS side, greatest(1, 2 * (n - 1)) AS p FROM w),
j AS (SELECT id_bio_year, ord, timestamp, v, n, p, unnest(range(i - CAST(side AS BIGINT), i + CAST(side AS BIGINT) + 1)) AS q FROM s),
f AS (SELECT *, CASE WHEN ((q % p) + p) % p >= n THEN p - ((q % p) + p) % p ELSE ((q % p) + p) % p END AS at FROM j)
SELECT f.id_bio_year, f.timestamp, round(f.v, 6) AS nsd, round(median(w.v), 6) AS smoothed FROM f JOIN w ON w.id_bio_year = f.id_bio_year AND w.i = f.at GROUP BY f.ord, 1, 2, f.v""")
def smoothed_nsd(spark, d):
    f = movement.with_nsd(keyed(spark, d), ["animal_id", "bio_year"], "id_bio_year")
    return detect.smoothed(f).select("id_bio_year", "timestamp", r("nsd").alias("nsd"), r("smoothed").alias("smoothed"))


@query(""", tri AS (SELECT n_nationkey AS k, 10.0 + n_nationkey AS ax, 15.0 AS ay, 60.0 + n_nationkey AS bx, 25.0 AS b_y, 30.0 AS cx, 70.0 + n_nationkey AS cy FROM nation),
cell AS (SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, (c + 0.5) * 2.5 AS x, 100 - (r + 0.5) * 2.5 AS y FROM range(40) a(r), range(40) b(c)),
side AS (SELECT k, "row", col, (bx - ax) * (y - ay) - (b_y - ay) * (x - ax) AS s1, (cx - bx) * (y - b_y) - (cy - b_y) * (x - bx) AS s2, (ax - cx) * (y - cy) - (ay - cy) * (x - cx) AS s3 FROM tri, cell)
SELECT CAST(k AS VARCHAR) AS id, "row", col FROM side WHERE (s1 > 0 AND s2 > 0 AND s3 > 0) OR (s1 < 0 AND s2 < 0 AND s3 < 0)""")
def rasterised_polygons(spark, d):
    k = F.col("n_nationkey")
    corners = [(10.0 + k, F.lit(15.0)), (60.0 + k, F.lit(25.0)), (F.lit(30.0), 70.0 + k)]
    ring = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])
    shapes = table(spark, d, "nation").select(k.cast("string").alias("id"), F.lit(0).alias("ring_no"), ring.alias("ring"))
    return ud.rasterise(shapes, ud.Grid(0.0, 0.0, 100.0, 100.0, 40, 40, 2.5))


@query(""", y AS (SELECT animal_id, bio_year, max(CASE WHEN slot = 1 THEN "end" END) AS se, max(CASE WHEN slot = 2 THEN "start" END) AS fs FROM migtime GROUP BY 1, 2),
i AS (SELECT f.ord, f.animal_id, y.bio_year AS range_year, CAST(f.timestamp AS DATE) AS day FROM flagged f JOIN y ON y.animal_id = f.animal_id AND f.timestamp BETWEEN y.se AND y.fs WHERE y.se < y.fs AND problem = 0 AND mortality_flag = 0),
n AS (SELECT animal_id, range_year, count(DISTINCT day) AS nd FROM i GROUP BY 1, 2)
SELECT ord, animal_id || '_' || range_year || '_Summer' AS mig FROM i JOIN n USING (animal_id, range_year) WHERE nd >= 3""")
def range_sequences(spark, d):
    return sequences.range_sequences(flagged(spark, d), fixtures.windows(spark, d), min_days=3)[0].select("ord", "mig")


@query("""SELECT animal_id, strftime(timestamp, '%Y-%m-%d %H:%M') AS timestamp, ord AS "fix_number", round(x, 4) AS "cumulative", round(y, 4) AS "Cumulativ1" FROM fixes""")
def flat_attributes(spark, d):
    from ..sinks.tables import flat_fields

    f = fixes(spark, d)
    return flat_fields(f.select("animal_id", "timestamp", F.col("ord").alias("fix.number.of.animal"), r("x", 4).alias("cumulative.km"), r("y", 4).alias("Cumulative_m"), F.array("x").alias("nested")))


@query(""", det AS (SELECT animal_id || '_' || bio_year AS id_bio_year, CAST(timestamp AS TIMESTAMP) AS s, row_number() OVER (PARTITION BY animal_id, bio_year ORDER BY timestamp) AS n FROM fixes WHERE event_type = 'signup')
SELECT f.id_bio_year, max(CASE WHEN n = 1 THEN s END) AS mig1start, max(CASE WHEN n = 1 THEN s + INTERVAL 2 DAY END) AS mig1end, max(CASE WHEN n = 8 THEN s END) AS mig8start, coalesce(bool_or(n IS NOT NULL), FALSE) AS auto_detected
FROM (SELECT DISTINCT animal_id || '_' || bio_year AS id_bio_year FROM fixes) f LEFT JOIN det USING (id_bio_year) GROUP BY 1""")
def detections_applied(spark, d):
    k = keyed(spark, d)
    found = k.where("event_type = 'signup'").select("id_bio_year", F.col("timestamp").alias("start_date"), F.expr("timestamp + interval 2 days").alias("end_date"))
    return sequences.apply_detections(sequences.migtime_scaffold(k), found).select("id_bio_year", "mig1start", "mig1end", "mig8start", "auto_detected")


@query("SELECT id_bio_year, animal_id, CAST(bio_year AS INTEGER) AS bio_year, CAST(slot AS INTEGER) AS slot, 'mig' || slot AS label, \"start\", \"end\" FROM migtime")
def migtime_import(spark, d):
    """An outside table with other spellings of keys and names, and NA for what is missing."""
    wide = sequences.to_wide(fixtures.windows(spark, d))
    text = [F.coalesce(F.date_format(f"mig{s}{e}", "yyyy-MM-dd HH:mm:ss"), F.lit("NA")).alias(f"Mig{s}.{e.title()}") for s in (1, 2, 3) for e in ("start", "end")]
    outside = wide.select(F.upper(F.regexp_replace("id_bio_year", "_", " - ")).alias("id_bioYear"), *text)
    return sequences.import_migtime(outside, keyed(spark, d))


@query(CLASS_SQL + """ SELECT f.id_bio_year, coalesce(classification, 'unclassified') AS classification, classification IS NOT NULL OR id_bio_year IN (SELECT id_bio_year FROM migtime WHERE CAST(substr(animal_id, 2) AS INTEGER) % 2 = 0) AS reviewed
FROM (SELECT DISTINCT animal_id || '_' || bio_year AS id_bio_year FROM fixes) f LEFT JOIN (SELECT * FROM cls WHERE classification = 'migrant') USING (id_bio_year)""")
def review_states(spark, d):
    k = keyed(spark, d)
    w = fixtures.windows(spark, d).where(F.substring("animal_id", 2, 9).cast("int") % 2 == 0).select("id_bio_year", F.col("start").alias("start_date"), F.col("end").alias("end_date"))
    wide = sequences.apply_detections(sequences.migtime_scaffold(k), w)
    return sequences.review_state(wide, _classes(spark, d).where("classification = 'migrant'")).select("id_bio_year", "classification", "reviewed")


@query("""SELECT id_bio_year, slot, CASE label WHEN 'Spring' THEN 'To summer' ELSE label END AS shown, label AS restored FROM (SELECT id_bio_year, CAST(slot AS INTEGER) AS slot, label FROM migtime)""")
def labels_renamed(spark, d):
    w = fixtures.windows(spark, d).select("id_bio_year", "slot", "label")
    shown, legend = sequences.renamed_labels(w, {"Spring": "To summer"})
    back = sequences.restored_labels(shown, legend)
    return shown.withColumnRenamed("label", "shown").join(back.withColumnRenamed("label", "restored"), ["id_bio_year", "slot"])


EDIT_SQL = """, ed AS (SELECT animal_id, timestamp, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS flag, event_type AS e FROM fixes WHERE event_type IN ('signup', 'error')),
pe AS (SELECT animal_id, timestamp, flag FROM ed WHERE e = 'signup'), me AS (SELECT animal_id, timestamp, flag FROM ed WHERE e = 'error'),
j AS (SELECT f.ord, f.animal_id, f.timestamp, f.problem, f.mortality_flag, pe.flag AS p, me.flag AS m, max(CASE WHEN me.flag = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY f.animal_id ORDER BY f.timestamp ROWS UNBOUNDED PRECEDING) AS dead
FROM flagged f LEFT JOIN pe ON pe.animal_id = f.animal_id AND pe.timestamp = f.timestamp LEFT JOIN me ON me.animal_id = f.animal_id AND me.timestamp = f.timestamp)"""


@query(EDIT_SQL + " SELECT ord, coalesce(p, problem) AS problem, CASE WHEN m = 0 THEN 0 WHEN dead = 1 THEN 1 ELSE mortality_flag END AS mortality_flag FROM j")
def edits_applied(spark, d):
    f = flagged(spark, d)
    e = fixes(spark, d).where("event_type in ('signup', 'error')")
    flag = F.when(F.col("k") % 2 == 0, 1).otherwise(0)
    kind = F.when(F.col("event_type") == "signup", "problem").otherwise("mortality")
    at = F.col("timestamp")
    edits = e.select("animal_id", "timestamp", kind.alias("kind"), flag.alias("flag"), at.alias("edited_at"))
    older = e.select("animal_id", "timestamp", kind.alias("kind"), (1 - flag).alias("flag"), F.expr("timestamp - interval 1 day").alias("edited_at"))  # overruled
    return movement.apply_edits(f, edits.unionByName(older)).select("ord", "problem", "mortality_flag")


@query("SELECT c_custkey, regexp_replace(trim(c_name || ' (' || c_mktsegment || ')/' || c_nationkey), '[^a-zA-Z0-9_\\-]+', '_', 'g') AS token FROM customer")
def file_tokens(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.file_token(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")/"), F.col("c_nationkey").cast("string"))).alias("token"))


@query("SELECT ord, CASE WHEN ord % 5 = 0 THEN NULL ELSE round(x, 3) END AS value FROM fixes")
def tolerant_numbers(spark, d):
    raw = F.when(F.col("ord") % 10 == 0, "n/a").when(F.col("ord") % 5 == 0, "NaN").otherwise(F.col("x").cast("string"))
    return fixes(spark, d).select("ord", r(text.number(raw), 3).alias("value"))


@query(USE_SQL + """, sb AS (SELECT animal_id, season, bio_year, "row", col, sum(density) / any_value(k) AS d FROM uc JOIN mem USING (seq_id) JOIN (SELECT animal_id, season, bio_year, count(*) AS k FROM mem GROUP BY 1, 2, 3) USING (animal_id, season, bio_year) GROUP BY 1, 2, 3, 4, 5),
h2 AS (SELECT season, bio_year, count(DISTINCT animal_id) AS h FROM sb GROUP BY 1, 2) SELECT season, CAST(bio_year AS INTEGER) AS bio_year, "row", col, CAST(count(DISTINCT animal_id) AS INTEGER) AS n, round(sum(d) / any_value(h), 8) AS mean_ud FROM sb JOIN h2 USING (season, bio_year) GROUP BY 1, 2, 3, 4""")
def season_year_surface(spark, d):
    return population.year_summaries(*used(spark, d))["season_year"].withColumn("mean_ud", r("mean_ud", 8))


@query(ORACLES["line_buffer"][len(f"WITH {SQL.strip()}"):].replace("SELECT DISTINCT seq_id,", "SELECT DISTINCT animal_id,").replace("FROM pr WHERE", "FROM pr JOIN (SELECT DISTINCT seq_id, animal_id FROM pts) USING (seq_id) WHERE").replace("1500", "900"))
def animal_line_buffer(spark, d):
    p = points(spark, d)
    return ud.animal_line_buffer(p, members(p), ud.make_grid(p, CELL), 900)


@query(USE_SQL + """SELECT season, "row", col FROM surf WHERE n >= 4""")
def season_minimum_mask(spark, d):
    return _season(spark, d, "minimum4", min_individuals=(4,))


@query(USE_SQL + """, ps AS (SELECT quantile_cont(mean_ud, 0.98) AS p FROM surf) SELECT season, "row", col, round(least(1, mean_ud / p), 6) AS shown FROM surf, ps""")
def display_values(spark, d):
    s = population.season_surface(population.individual_ud(*used(spark, d), by_season=True), ["season"])
    return population.display_scale(s, "mean_ud").select("season", "row", "col", r("shown").alias("shown"))


@query("SELECT DISTINCT animal_id FROM fixes WHERE CAST(substr(animal_id, 2) AS INTEGER) % 7 IN (0, 1)")
def crossings_stale(spark, d):
    """One animal in seven moved since, and one in seven is new."""
    f = fixes(spark, d)
    k = F.col("user_id") % 7
    before = enrich.track_signature(f.where(k != 1).withColumn("x", F.when(k == 0, F.col("x") + 1).otherwise(F.col("x"))), "animal_id")
    return enrich.stale_crossings(before, f, "animal_id")
