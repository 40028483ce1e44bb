"""Fix-shaped views over the driver's tables, by arithmetic that any SQL engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import temporal

BIO_YEAR = (1, 15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixes(spark: SparkSession, sf_dir: str, duplicates: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.withColumn("d", (temporal.micros(F.col("ts")) / 1e6 - 1704067200) / 86400)
    if duplicates:
        e = e.unionByName(e.where("event_type = 'signup' and k % 2 = 0").withColumn("event_id", F.col("event_id") + 1000000000))
    mover, u = F.col("user_id") % 5 != 0, F.col("user_id")
    ramp = F.when(mover, F.least("d", 30 - F.col("d"))).otherwise(0.0)
    scale = F.when(mover, 2.0).otherwise(0.1)
    out = e.select(
        F.col("event_id").alias("ord"), F.concat(F.lit("A"), F.lpad(u.cast("string"), 5, "0")).alias("animal_id"), F.col("ts").alias("timestamp"), "event_type", "k", "value", "user_id",
        (400000 + (u % 50) * 1000 + 2000 * ramp + scale * F.col("value")).alias("x"), (4400000 + (u % 7) * 1000 + 1000 * ramp + scale * F.col("k")).alias("y"),
        (1 + F.col("k") % 12).cast("int").alias("DOP"), (3 + F.col("k") % 9).cast("int").alias("NumSats"),
        F.when(u % 3 == 0, "F").when(u % 3 == 1, "Male").alias("Sex"), F.when(u % 4 == 0, "Adult").when(u % 4 == 1, "Yearling").when(u % 4 == 2, "Calf").otherwise("").alias("AgeClass"), F.concat(F.lit("D"), (u % 3).cast("string")).alias("DAU"),
    )
    error = F.col("event_type") == "error"
    lon = F.when(error & (F.col("k") < 5), 8.5).when(error & (F.col("k") < 8), None).otherwise(-108.0 + (F.col("x") - 400000) / 85000)
    return out.withColumns({"lon": lon, "lat": 39.7 + (F.col("y") - 4400000) / 111000})


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows an animal and year 2023 or 2024 of its biological year."""
    keys = fixes(spark, sf_dir).select("animal_id", temporal.bio_year(F.col("timestamp"), BIO_YEAR).alias("bio_year")).distinct()
    def at(day: int):
        return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp_ntz")
    rows = F.array(F.struct(F.lit(1).alias("slot"), F.lit("Spring").alias("label"), at(3).alias("start"), at(13).alias("end")), F.struct(F.lit(2).alias("slot"), F.lit("Fall").alias("label"), at(19).alias("start"), at(29).alias("end")))
    return keys.select(F.concat_ws("_", "animal_id", "bio_year").alias("id_bio_year"), "animal_id", "bio_year", F.inline(rows))


def long_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").cast("string").alias("animal_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"), (400000 + F.col("o_totalprice").cast("double") / 10).alias("x"), (4400000.0 + (F.col("o_orderkey") % 1000) * 30).alias("y"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    x = 400000.0 + 9000.0 * n
    return table(spark, sf_dir, "nation").select(n.cast("string").alias("road_id"), F.when(n % 3 == 0, "S1100").when(n % 3 == 1, "S1200").otherwise("S1400").alias("mtfcc"), F.lit(0).alias("seg_no"), x.alias("x1"), F.lit(4390000.0).alias("y1"), x.alias("x2"), F.lit(4430000.0).alias("y2"))


#: The same views in SQL, to be put before a query.
SQL = """
e0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, (epoch_us(ts) / 1e6 - 1704067200) / 86400 AS d FROM events),
e1 AS (SELECT *, user_id % 5 <> 0 AS mover FROM e0),
e2 AS (SELECT *, CASE WHEN mover THEN least(d, 30 - d) ELSE 0.0 END AS ramp, CASE WHEN mover THEN CAST(2.0 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS sc FROM e1),
fixes0 AS (SELECT event_id AS ord, 'A' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS animal_id, ts AS timestamp, event_type, k, value, user_id,
  CAST(400000 + (user_id % 50) * 1000 + 2000 * ramp + sc * value AS DOUBLE) AS x, CAST(4400000 + (user_id % 7) * 1000 + 1000 * ramp + sc * k AS DOUBLE) AS y,
  1 + k % 12 AS "DOP", 3 + k % 9 AS "NumSats", CASE user_id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'Male' END AS "Sex",
  CASE user_id % 4 WHEN 0 THEN 'Adult' WHEN 1 THEN 'Yearling' WHEN 2 THEN 'Calf' ELSE '' END AS "AgeClass", 'D' || CAST(user_id % 3 AS VARCHAR) AS "DAU" FROM e2),
fixes AS (SELECT *, CASE WHEN event_type = 'error' AND k < 5 THEN CAST(8.5 AS DOUBLE) WHEN event_type = 'error' AND k < 8 THEN NULL ELSE CAST(-108.0 AS DOUBLE) + (x - 400000) / 85000 END AS lon,
  CAST(39.7 AS DOUBLE) + (y - 4400000) / 111000 AS lat,
  year(timestamp) - CASE WHEN month(timestamp) < 1 OR (month(timestamp) = 1 AND day(timestamp) < 15) THEN 1 ELSE 0 END AS bio_year FROM fixes0),
fixes_dup AS (SELECT * FROM fixes UNION ALL SELECT * REPLACE (ord + 1000000000 AS ord) FROM fixes WHERE event_type = 'signup' AND k % 2 = 0),
migtime AS (SELECT animal_id || '_' || bio_year AS id_bio_year, animal_id, bio_year, slot, label, "start", "end" FROM (SELECT DISTINCT animal_id, bio_year FROM fixes),
  (VALUES (1, 'Spring', TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-13'), (2, 'Fall', TIMESTAMP '2024-01-19', TIMESTAMP '2024-01-29')) w(slot, label, "start", "end")),
roads AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'S1100' WHEN 1 THEN 'S1200' ELSE 'S1400' END AS mtfcc, 400000.0 + 9000.0 * n_nationkey AS rx FROM nation),
long_fixes AS (SELECT o_orderkey AS ord, CAST(o_custkey AS VARCHAR) AS animal_id, CAST(o_orderdate AS TIMESTAMP) AS timestamp, 400000 + CAST(o_totalprice AS DOUBLE) / 10 AS x, 4400000.0 + (o_orderkey % 1000) * 30 AS y FROM orders),
burst0 AS (SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL OR epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w) > 176400000000 THEN 1 ELSE 0 END AS nb FROM fixes WINDOW w AS (PARTITION BY animal_id ORDER BY timestamp)),
bursts AS (SELECT * EXCLUDE nb, CAST(sum(nb) OVER (ORDER BY animal_id, timestamp ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst_id FROM burst0),
steps0 AS (SELECT *, CASE WHEN lag(burst_id) OVER w = burst_id THEN x - lag(x) OVER w END AS dx, CASE WHEN lag(burst_id) OVER w = burst_id THEN y - lag(y) OVER w END AS dy,
  CASE WHEN lag(burst_id) OVER w = burst_id THEN (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 END AS dt FROM bursts WINDOW w AS (PARTITION BY animal_id ORDER BY timestamp)),
steps1 AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist, degrees(atan2(dx, dy)) - 360 * floor(degrees(atan2(dx, dy)) / 360) AS abs_angle FROM steps0),
steps AS (SELECT *, CASE WHEN dt > 0 THEN dist / dt END AS speed, dt / 3600 AS fix_rate_hours,
  CASE WHEN lag(burst_id) OVER w = burst_id THEN (abs_angle - lag(abs_angle) OVER w + 180) - 360 * floor((abs_angle - lag(abs_angle) OVER w + 180) / 360) - 180 END AS rel_angle FROM steps1 WINDOW w AS (PARTITION BY animal_id ORDER BY timestamp)),
problems AS (SELECT *, CASE WHEN coalesce(speed > 10.8 / 3.6, FALSE) OR "DOP" > 10 OR "NumSats" < 6 THEN 1 ELSE 0 END AS problem FROM steps),
mort AS (SELECT a.ord, CASE WHEN max((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 2500 THEN 1 ELSE 0 END AS mortality_flag
  FROM fixes a LEFT JOIN fixes b ON b.animal_id = a.animal_id AND b.ord <> a.ord AND epoch_us(b.timestamp) >= epoch_us(a.timestamp) AND epoch_us(b.timestamp) <= epoch_us(a.timestamp) + 172800000000 GROUP BY a.ord),
flagged AS (SELECT p.*, coalesce(m.mortality_flag, 0) AS mortality_flag FROM problems p LEFT JOIN mort m USING (ord)),
seqs AS (SELECT f.*, w.slot, w.label, w.id_bio_year || '_' || w.label AS mig FROM flagged f JOIN migtime w ON w.animal_id = f.animal_id AND w.bio_year = f.bio_year AND f.timestamp BETWEEN w."start" AND w."end" WHERE problem = 0 AND mortality_flag = 0),
pts AS (SELECT mig AS seq_id, animal_id, label AS season, bio_year, timestamp, x, y FROM seqs),
seqstep AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / 1000 AS step_km FROM seqs WINDOW w AS (PARTITION BY mig ORDER BY timestamp)),
maxpair AS (SELECT a.mig, max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) / 1000 AS maxpair_km FROM seqs a JOIN seqs b ON a.mig = b.mig GROUP BY a.mig),
lines AS (SELECT mig, min(label) AS season, min(bio_year) AS bio_year, min(animal_id) AS animal_id, min(timestamp) AS start_date, max(timestamp) AS end_date, count(*) AS n_fixes, coalesce(sum(step_km), 0) AS cumu_km,
  sqrt(pow(arg_max(x, timestamp) - arg_min(x, timestamp), 2) + pow(arg_max(y, timestamp) - arg_min(y, timestamp), 2)) / 1000 AS eucl_km FROM seqstep GROUP BY mig),
trips AS (SELECT l.*, maxpair_km, (epoch_us(end_date) - epoch_us(start_date)) / 86400e6 AS days, cumu_km * 0.621371 AS cumu_miles FROM lines l JOIN maxpair USING (mig) WHERE n_fixes >= 2)
"""
