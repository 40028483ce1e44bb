"""Herd and season tables from fixes and trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import temporal, text
from ..plans.store import stored
from .ingest import exact_quantile

METRICS = ("eucl_km", "cumu_km", "maxpair_km")
# fixed values: spellings of the sexes
MALE, FEMALE = ("M", "MALE"), ("F", "FEMALE")


def herd_counts(fixes: DataFrame, trips: DataFrame) -> DataFrame:
    """One row: animals, animals with a migration, first and last year."""
    a = fixes.agg(F.countDistinct("animal_id").alias("num_ind"), F.min(F.year("timestamp")).alias("first_year"), F.max(F.year("timestamp")).alias("last_year"))
    return a.crossJoin(F.broadcast(trips.agg(F.countDistinct("animal_id").alias("mig_ind"))))  # one row each


def sex_counts(fixes: DataFrame, column: str = "Sex") -> DataFrame:
    """``n_male, n_female`` by each animal's first known sex."""
    sex = F.upper(text.or_null(F.col(column)))
    first = fixes.groupBy("animal_id").agg(F.min_by(sex, F.when(sex.isNotNull(), F.col("timestamp"))).alias("s"))
    return first.agg(F.count_if(F.col("s").isin(*MALE)).alias("n_male"), F.count_if(F.col("s").isin(*FEMALE)).alias("n_female"))


def fix_rate_stats(fixes: DataFrame) -> DataFrame:
    ends = fixes.agg(F.max("fix_rate_hours").alias("max_hours"), F.min("fix_rate_hours").alias("min_hours"))
    return ends.crossJoin(F.broadcast(exact_quantile(fixes, "fix_rate_hours").withColumnRenamed("q", "median_hours")))  # one row each


def season_rollup(trips: DataFrame) -> DataFrame:
    """``season`` (``all`` for the whole), animals and sequences."""
    g = trips.groupingSets([["season"], []], "season").agg(F.countDistinct("animal_id").alias("n_animals"), F.count(F.lit(1)).alias("n_sequences"), F.grouping("season").alias("_g"))
    return g.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("season")).alias("season"), "n_animals", "n_sequences")


def annual_collars(fixes: DataFrame) -> DataFrame:
    return fixes.groupBy("bio_year").agg(F.countDistinct("animal_id").alias("n_collars"))


def edge_days(trips: DataFrame, by: list[str]) -> DataFrame:
    """``by, edge, n, first, last, mean, median`` of starts and ends: number of trips, extreme times, circular mean and median as ``MM/dd``.

    Trips are counted by day of the year first, so a group comes to 366 rows at most.
    """
    edges = trips.select(*by, F.inline(F.array(*[F.struct(F.lit(e).alias("edge"), F.col(f"{e}_date").alias("t")) for e in ("start", "end")])))
    daily = edges.groupBy(*by, "edge", temporal.circle_day(F.col("t")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    days = F.collect_list(F.when(F.col("day").isNotNull(), F.struct("day", "n")))
    return daily.groupBy(*by, "edge").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
        temporal.month_day(temporal.circular_mean_of(F.col("day"), F.col("n"))).alias("mean"), temporal.month_day(temporal.circular_median_of(days)).alias("median"),
    )


def circular_dates(trips: DataFrame, by: list[str]) -> DataFrame:
    """Circular mean and median of start and end as ``MM/dd``."""
    return edge_days(trips, by).groupBy(*by).agg(*[F.max(F.when(F.col("edge") == e, F.col(n))).alias(f"{n}_{e}") for e in ("start", "end") for n in ("mean", "median")])


def distance_summary(trips: DataFrame) -> DataFrame:
    """``season, metric, mean_km, sd_km, min_km, max_km, n_sequences`` (deviation 0 for one sequence; four decimals)."""
    long = trips.select("season", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("km")) for m in METRICS])))
    return long.groupBy("season", "metric").agg(
        F.round(F.avg("km"), 4).alias("mean_km"), F.round(F.coalesce(F.stddev_samp("km"), F.lit(0.0)), 4).alias("sd_km"), F.round(F.min("km"), 4).alias("min_km"), F.round(F.max("km"), 4).alias("max_km"), F.count(F.lit(1)).alias("n_sequences")
    )


def stats(trips: DataFrame, columns: tuple[str, ...] = ("days", *METRICS)) -> DataFrame:
    """Per season and in all: mean, sd (NULL below two), min, max of days and distances."""
    both = trips.withColumn("season", F.explode(F.array("season", F.lit("all"))))
    return both.groupBy("season").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))])


def season_summary(trips: DataFrame) -> DataFrame:
    """Animals, sequences, median start and end, distance and duration statistics of each season."""
    def middle(c: str) -> Column:
        return F.timestamp_micros(F.median(temporal.micros(F.col(c))).cast("long")).cast("timestamp_ntz")

    aggs = [f(c).alias(f"{n}_{c}") for c in ("cumu_km", "days") for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return trips.groupBy("season").agg(F.countDistinct("animal_id").alias("n_animals"), F.count(F.lit(1)).alias("n_sequences"), middle("start_date").alias("median_start"), middle("end_date").alias("median_end"), *aggs)


def sequences_summary(trips: DataFrame) -> DataFrame:
    """Long form ``season, year, metric, value``: number, earliest, latest, circular median and mean of start and end, by year and for ``All_Years``."""
    both = trips.withColumn("year", F.explode(F.array(F.col("bio_year").cast("string"), F.lit("All_Years"))))
    found = edge_days(both, ["season", "year"])
    values = {"earliest": F.date_format("first", "MM/dd"), "latest": F.date_format("last", "MM/dd"), "median": F.col("median"), "average": F.col("mean")}
    rows = F.array(*[F.struct(F.concat_ws("_", F.lit(n), "edge").alias("metric"), v.alias("value")) for n, v in values.items()])
    number = F.array(F.struct(F.lit("n").alias("metric"), F.col("n").cast("string").alias("value")))
    return found.select("season", "year", F.inline(F.when(F.col("edge") == "start", F.concat(number, rows)).otherwise(rows)))


def sequences_matrix(summary: DataFrame, years: list[str] | None = None) -> DataFrame:
    """Season and metric by year."""
    return summary.groupBy("season", "metric").pivot("year", years).agg(F.first("value")) if years else summary.groupBy("season", "metric").pivot("year").agg(F.first("value"))


def herd_metadata(fixes: DataFrame, trips: DataFrame, herd: DataFrame, sex_column: str = "Sex") -> DataFrame:
    """One wide row: herd, counts, years, sexes, fix rates, and per season and in all the statistics and mean dates.

    The columns of fixes and trips that it takes are stored, as it reads them many times.
    """
    fixes = stored(fixes.select(*[c for c in dict.fromkeys(("animal_id", "timestamp", "fix_rate_hours", sex_column)) if c in fixes.columns]), "herd-fixes")
    trips = stored(trips.select("animal_id", "season", "start_date", "end_date", "days", *METRICS), "herd-trips")
    parts = [herd, herd_counts(fixes, trips), fix_rate_stats(fixes)] + ([sex_counts(fixes, sex_column)] if sex_column in fixes.columns else [])
    seasons = season_rollup(trips).join(stats(trips), "season", "left").join(circular_dates(trips.withColumn("season", F.explode(F.array("season", F.lit("all")))), ["season"]), "season", "left")
    packed = seasons.agg(F.map_from_entries(F.collect_list(F.struct("season", F.struct(*[c for c in seasons.columns if c != "season"])))).alias("seasons"))  # a row a season
    out = parts[0]
    for p in [*parts[1:], packed]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def removed_groups(fixes: DataFrame) -> DataFrame:
    """Number and span of marked fixes by reason."""
    return fixes.where((F.col("problem") == 1) | (F.col("mortality_flag") == 1)).groupBy("animal_id").agg(F.count_if(F.col("problem") == 1).alias("n_problem"), F.count_if(F.col("mortality_flag") == 1).alias("n_mortality"), F.min("timestamp").alias("first_fix"), F.max("timestamp").alias("last_fix"))
