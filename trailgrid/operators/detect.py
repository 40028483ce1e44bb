"""Detection of migrations in the course of net squared displacement.

Smoothing, runs and the folding of neighbouring runs depend on the state of
the fold, so one animal-year is handled by numpy at a time, many animal-years
in an Arrow batch; they are spread over the cluster.  ``runs`` is the relational part on its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal
from .grouped import map_groups

DETECTION = "id_bio_year string, animal_id string, sequence_name string, start_date timestamp_ntz, end_date timestamp_ntz, migration_type string, confidence double"
#: fixed values: least fixes, days of smoothing, least days and share of the range of a run, gap that is bridged, weights
LEAST_FIXES, SMOOTH_DAYS, RUN_DAYS, RUN_SHARE, BRIDGE, AMPLITUDE, CONSISTENCY = 10, 7, 5.0, 0.05, 0.2, 0.6, 0.4


def rolling_median(values: np.ndarray, window: int) -> np.ndarray:
    """Median of an odd window, the ends mirrored as often as needed."""
    side = window // 2
    index = np.arange(-side, len(values) + side)
    period = max(1, 2 * (len(values) - 1))
    folded = np.abs((index + period) % period)
    folded = np.where(folded >= len(values), period - folded, folded)
    return np.median(np.lib.stride_tricks.sliding_window_view(values[folded], window), axis=1)


def fix_rate(times: np.ndarray) -> float:
    days = max(1, int((times[-1] - times[0]) / np.timedelta64(1, "D")))
    return max(1.0, len(times) / days)


def smoothing_window(per_day: float) -> int:
    return max(3, round(SMOOTH_DAYS * per_day)) | 1


def detect_one(nsd: np.ndarray, times: np.ndarray, x: np.ndarray | None, y: np.ndarray | None, most: int = 4, reach: bool = True) -> list[dict]:
    """Detections of one animal-year, ordered by start."""
    per_day = fix_rate(times)
    smooth = rolling_median(nsd, smoothing_window(per_day))
    slope = np.sign(np.gradient(smooth))
    spread = float(np.ptp(smooth))
    edges = np.flatnonzero(np.r_[True, slope[1:] != slope[:-1], True])
    found: list[list] = []  # [sign, first, end)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        long_enough = b - a >= max(3, round(RUN_DAYS * per_day))
        if slope[a] and long_enough and abs(smooth[b - 1] - smooth[a]) >= RUN_SHARE * spread:
            last = found[-1] if found else None
            if last and last[0] == slope[a] and a - last[2] <= BRIDGE * min(last[2] - last[1], b - a):
                last[2] = b
            else:
                found.append([slope[a], a, b])
    scored = [(AMPLITUDE * abs(smooth[b - 1] - smooth[a]) / (spread or 1.0) + CONSISTENCY * float((slope[a:b] == s).mean()), s, a, b) for s, a, b in found]
    chosen = sorted(sorted(scored, key=lambda r: -r[0])[:most], key=lambda r: r[2])
    out = []
    for k, (score, sign, a, b) in enumerate(chosen, 1):
        first, last = a, b - 1
        if reach and x is not None and y is not None:
            extra = int(2 * per_day)
            before, after = slice(max(0, a - 5), a + 1), slice(b - 1, b + 5)
            if first > 0 and np.hypot(x[a] - x[before].mean(), y[a] - y[before].mean()) > 5000:
                first = max(0, a - extra)
            if last < len(nsd) - 1 and np.hypot(x[b - 1] - x[after].mean(), y[b - 1] - y[after].mean()) > 5000:
                last = min(len(nsd) - 1, b - 1 + extra)
        out.append({"sequence_name": f"mig{k}", "start_date": times[first], "end_date": times[last], "migration_type": "outbound" if sign > 0 else "return", "confidence": round(score, 3)})
    return out


def detect_migrations(fixes: DataFrame, nsd: str = "nsd_id_bio_year", most: int = 4, reach: bool = True) -> DataFrame:
    """Detections of all animal-years with ten fixes or more."""
    missing = {"animal_id", "id_bio_year", "timestamp", nsd} - set(fixes.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    place = ["x", "y"] if {"x", "y"} <= set(fixes.columns) else []

    def one(key, c: dict[str, np.ndarray]) -> dict:
        found = []
        if len(c["t"]) >= LEAST_FIXES:
            found = detect_one(c["nsd"], c["t"].astype("datetime64[us]"), c.get("x"), c.get("y"), most, reach)
        return {"id_bio_year": [key] * len(found), "animal_id": [c["animal_id"][0]] * len(found)} | {n: [r[n].astype("int64") if n.endswith("_date") else r[n] for r in found] for n in ("sequence_name", "start_date", "end_date", "migration_type", "confidence")}

    rows = fixes.where(F.col(nsd).isNotNull()).select("id_bio_year", "animal_id", temporal.micros(F.col("timestamp")).alias("t"), F.col(nsd).cast("double").alias("nsd"), *[F.col(c).cast("double") for c in place])
    return map_groups(rows, "id_bio_year", ["t"], one, DETECTION)


def smoothed(fixes: DataFrame, nsd: str = "nsd_id_bio_year") -> DataFrame:
    """``id_bio_year, timestamp, nsd, smoothed``: the course of every animal-year and its rolling median."""

    def one(key, c: dict[str, np.ndarray]) -> dict:
        n = len(c["t"])
        course = rolling_median(c["nsd"], smoothing_window(fix_rate(c["t"].astype("datetime64[us]")))) if n > 1 else c["nsd"]
        return {"id_bio_year": [key] * n, "timestamp": c["t"], "nsd": c["nsd"], "smoothed": course}

    rows = fixes.where(F.col(nsd).isNotNull()).select("id_bio_year", temporal.micros(F.col("timestamp")).alias("t"), F.col(nsd).cast("double").alias("nsd"))
    return map_groups(rows, "id_bio_year", ["t"], one, "id_bio_year string, timestamp timestamp_ntz, nsd double, smoothed double")


def runs(df: DataFrame, value: str, keys: tuple[str, ...], least: int = 3) -> DataFrame:
    """Runs of equal sign of ``value``: keys, ``run, sign, n, start, end``; zero runs left out."""
    w = Window.partitionBy(*keys).orderBy("timestamp")
    marked = df.where(F.col(value).isNotNull()).withColumn("sign", F.signum(value).cast("int"))
    marked = marked.withColumn("_new", F.when(F.lag("sign").over(w).eqNullSafe(F.col("sign")), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "run", "sign").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    return out.where((F.col("sign") != 0) & (F.col("n") >= least))


def plot_data(fixes: DataFrame, id_bio_year: str, windows: DataFrame | None = None, nsd: str = "nsd_id_bio_year") -> tuple[DataFrame, DataFrame | None]:
    """The course of one animal-year with its smoothed NSD, and its windows for shading."""
    own = fixes.where(F.col("id_bio_year") == id_bio_year)
    place = [c for c in ("displacement_id_bio_year", "speed") if c in fixes.columns]
    course = smoothed(own, nsd).select("timestamp", "nsd", "smoothed")
    if place:
        course = course.join(own.select("timestamp", *place), "timestamp")
    shade = windows.where(F.col("id_bio_year") == id_bio_year).select("slot", "label", "start", "end") if windows is not None else None
    return course, shade
