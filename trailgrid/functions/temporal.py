"""Time column functions: micros, biological years, tolerant parsing, circular day statistics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def whole_days(start: Column, end: Column) -> Column:
    return F.floor(seconds_between(start, end) / 86400)


def bio_year(ts: Column, start: tuple[int, int] = (2, 1)) -> Column:
    """The year in which the biological year of a time began."""
    month, day = start
    early = (F.month(ts) < month) | ((F.month(ts) == month) & (F.dayofmonth(ts) < day))
    return (F.year(ts) - early.cast("int")).cast("int")


# fixed values: the spellings of timestamps in collar downloads
FALLBACK_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm a", "M/d/yy H:mm", "yyyy-MM-dd", "M/d/yyyy")


def parse(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def parse_flexibly(df: DataFrame, column: str, fmt: str, target: str = "timestamp") -> DataFrame:
    """Parse by ``fmt``; if over half of the values fail, by whichever of it and all spellings parses more."""
    kind = df.schema[column].dataType.simpleString()
    if kind.startswith(("timestamp", "date")):
        return df.withColumn(target, F.col(column).cast("timestamp_ntz"))
    text = F.trim(F.col(column))
    strict, loose = parse(text, fmt), F.coalesce(*[parse(text, f) for f in (fmt, *FALLBACK_FORMATS)])
    got = df.agg(F.count(F.lit(1)).alias("n"), F.count(strict).alias("s"), F.count(loose).alias("l")).first()
    return df.withColumn(target, loose if got["n"] - got["s"] > got["n"] / 2 and got["l"] > got["s"] else strict)


def circle_day(ts: Column) -> Column:
    """Day 0..364 of a 365-day year; February 29 counts as the 28th."""
    day = F.when((F.month(ts) == 2) & (F.dayofmonth(ts) == 29), 28).otherwise(F.dayofmonth(ts))
    return F.datediff(F.make_date(F.lit(2001), F.month(ts), day), F.lit(dt.date(2001, 1, 1)))


def month_day(day: Column) -> Column:
    return F.date_format(F.date_add(F.lit(dt.date(2001, 1, 1)), day.cast("int")), "MM/dd")


def circular_mean_day(ts: Column) -> Column:
    """Aggregate: the circular mean of the days of the year, rounded, as a day 0..364."""
    return circular_mean_of(circle_day(ts), F.lit(1))


def circular_mean_of(day: Column, n: Column) -> Column:
    """Aggregate: ``circular_mean_day`` of days 0..364 that occur ``n`` times."""
    angle = day * F.lit(2 * 3.141592653589793 / 365)
    total = F.sum(F.when(day.isNotNull(), n))
    mean = F.atan2(F.sum(F.sin(angle) * n) / total, F.sum(F.cos(angle) * n) / total)
    return F.pmod(F.bround(F.pmod(mean * F.lit(365 / (2 * 3.141592653589793)), F.lit(365.0))), F.lit(365.0)).cast("int")


def circular_median_day(ts: Column) -> Column:
    """Aggregate: cut the circle at its largest gap (the first of equal ones), take the upper middle day.

    It holds a group's days in a list; ``circular_median_of`` takes their counts.
    """
    def middle(days: Column) -> Column:
        n = F.size(days)
        return F.when(n > 0, F.get(days, F.pmod(_seam(days) + 1 + F.floor(n / 2).cast("int"), n)))

    return _once(F.array_sort(F.collect_list(circle_day(ts))), middle)


def circular_median_of(counts: Column) -> Column:
    """``circular_median_day`` from an array of the different days and how often each occurs: structs ``day, n``."""
    def middle(days: Column) -> Column:
        seam, size = _seam(F.transform(days, lambda x: x["day"])), F.size(days)
        turned = F.concat(F.slice(days, seam + 2, size), F.slice(days, F.lit(1), seam + 1))
        half = F.floor(F.aggregate(days, F.lit(0).cast("long"), lambda s, x: s + x["n"]) / 2)
        start = F.struct(half.cast("long").alias("left"), F.lit(None).cast("int").alias("day"))
        step = lambda s, x: F.struct((s["left"] - x["n"]).alias("left"), F.coalesce(s["day"], F.when(s["left"] < x["n"], x["day"])).alias("day"))
        return F.when(size > 0, F.aggregate(turned, start, step)["day"])

    return _once(F.array_sort(counts), middle)


def _seam(days: Column) -> Column:
    """Place of the last of the sorted days before their largest gap."""
    def gaps(d: Column) -> Column:
        after = lambda i: F.when(i + 1 < F.size(d), F.get(d, i + 1)).otherwise(F.get(d, F.lit(0)) + 365)
        return F.transform(F.sequence(F.lit(0), F.size(d) - 1), lambda i: F.struct((after(i) - F.get(d, i)).alias("gap"), (-i).alias("at")))

    return _once(days, lambda d: -F.array_max(gaps(d))["at"])


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value worked out once, not wherever ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def year_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy_DDD")
