"""Bursts, steps, net squared displacement, problem and mortality flags.

All windows are partitioned by ``animal_id`` (or by it and a function of the
row), so one exchange by animal serves the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, temporal, text

HOUR = 3_600_000_000


def _animal() -> Window:
    return Window.partitionBy("animal_id").orderBy("timestamp")


def with_burst(df: DataFrame, tmax_seconds: float = 176400) -> DataFrame:
    """``burst_id``: runs of fixes of an animal no more than ``tmax_seconds`` apart, numbered over all animals in order.

    Numbers within an animal come from its window; each animal's offset is a
    running sum over one row an animal.
    """
    w = _animal()
    gap = temporal.seconds_between(F.lag("timestamp").over(w), F.col("timestamp"))
    own = df.withColumn("_new", F.when(gap.isNull() | (gap > tmax_seconds), 1).otherwise(0))
    own = own.withColumn("_b", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    animals = own.groupBy("animal_id").agg(F.max("_b").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("animal_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = animals.select(F.col("animal_id").alias("_a"), before.alias("_before"))
    # rows without an animal come first in order: their offset is 0
    return own.join(offsets, F.col("animal_id") == F.col("_a"), "left").withColumn("burst_id", (F.col("_b") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_a", "_b", "_before")


def with_steps(df: DataFrame) -> DataFrame:
    """``dist, dt, speed, abs_angle, rel_angle, fix_rate_hours`` from the fix before; NULL on a burst's first fix."""
    w = _animal()
    same = F.lag("burst_id").over(w) == F.col("burst_id")

    def inside(c: Column) -> Column:
        return F.when(same, c)

    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    steps = df.withColumns({"dt": inside(temporal.seconds_between(F.lag("timestamp").over(w), F.col("timestamp"))), "dist": inside(F.sqrt(dx * dx + dy * dy)), "abs_angle": inside(geo.bearing(dx, dy))})
    steps = steps.withColumns({"speed": F.when(F.col("dt") > 0, F.col("dist") / F.col("dt")), "fix_rate_hours": F.col("dt") / 3600})
    return steps.withColumn("rel_angle", F.when(F.lag("burst_id").over(w) == F.col("burst_id"), geo.turn(F.lag("abs_angle").over(w), F.col("abs_angle"))))


def with_nsd(df: DataFrame, keys: list[str], suffix: str, n_ref: int = 20) -> DataFrame:
    """``ref_x, ref_y, nsd`` (square km) and ``displacement`` (km) from the mean of each group's first fixes."""
    group = Window.partitionBy(*keys)
    df = df.withColumn("_n", F.row_number().over(group.orderBy("timestamp")))
    df = df.withColumns({f"ref_{c}_{suffix}": F.avg(F.when(F.col("_n") <= n_ref, F.col(c))).over(group) for c in ("x", "y")}).drop("_n")
    dx, dy = F.col("x") - F.col(f"ref_x_{suffix}"), F.col("y") - F.col(f"ref_y_{suffix}")
    df = df.withColumn(f"nsd_{suffix}", (dx * dx + dy * dy) / 1e6)
    return df.withColumn(f"displacement_{suffix}", F.sqrt(f"nsd_{suffix}"))


def with_problems(df: DataFrame, max_speed_kmh: float | None = 10.8, dop_cutoff: float | None = 10, sat_cutoff: float | None = 6, dop_col: str = "DOP", sat_col: str = "NumSats") -> DataFrame:
    """``problem, problem_reason``; a threshold of None adds no check, a missing value never flags."""
    flags, reasons = [F.lit(False)], []
    if max_speed_kmh is not None and "speed" in df.columns:
        speed = text.number(F.col("speed"))
        flags.append(F.coalesce(speed > max_speed_kmh / 3.6, F.lit(False)))
        reasons.append(F.when(flags[-1], F.format_string(f"speed = %.1f km/h (max {max_speed_kmh})", speed * 3.6)))
    if dop_cutoff is not None and dop_col in df.columns:
        dop = text.number(F.col(dop_col))
        flags.append(F.coalesce(dop > dop_cutoff, F.lit(False)))
        reasons.append(F.when(flags[-1], F.format_string(f"DOP = %.1f (max {dop_cutoff})", dop)))
    if sat_cutoff is not None and sat_col in df.columns:
        sats = text.number(F.col(sat_col))
        flags.append(F.coalesce(sats < sat_cutoff, F.lit(False)))
        reasons.append(F.when(flags[-1], F.format_string(f"satellites = %d (min {int(sat_cutoff)})", sats.cast("int"))))
    any_flag = flags[0]
    for f in flags[1:]:
        any_flag = any_flag | f
    return df.withColumns({"problem": any_flag.cast("int"), "problem_reason": F.concat_ws("; ", *reasons) if reasons else F.lit("")})


def with_mortality(df: DataFrame, distance_m: float | None = 50, hours: float | None = 48) -> DataFrame:
    """``mortality_flag, mortality_reason``: every later fix within ``hours`` lies within ``distance_m``, and there is one.

    A frame holds the fixes of one animal in a window of time only: a row
    costs as much as its animal has fixes in ``hours``.
    """
    if distance_m is None or hours is None:
        return df.withColumns({"mortality_flag": F.lit(0), "mortality_reason": F.lit("")})
    df = df.withColumn("_us", temporal.micros(F.col("timestamp")))
    frame = Window.partitionBy("animal_id").orderBy("_us").rangeBetween(0, int(hours * HOUR))
    df = df.withColumn("_later", F.collect_list(F.struct("x", "y")).over(frame))
    worst = F.aggregate("_later", F.lit(0.0), lambda m, p: F.greatest(m, (p["x"] - F.col("x")) * (p["x"] - F.col("x")) + (p["y"] - F.col("y")) * (p["y"] - F.col("y"))))
    df = df.withColumn("_worst", F.when(F.size("_later") > 1, worst)).drop("_later")
    flag = F.coalesce(F.col("_worst") <= float(distance_m) ** 2, F.lit(False))
    reason = F.when(flag, F.format_string(f"moved at most %.1f m in {hours:g} h (max {distance_m:g})", F.sqrt("_worst"))).otherwise("")
    return df.withColumns({"mortality_flag": flag.cast("int"), "mortality_reason": reason}).drop("_us", "_worst")


def cascade_mortality(df: DataFrame) -> DataFrame:
    """All fixes of an animal after the first marked one are marked."""
    return df.withColumn("mortality_flag", F.max(F.coalesce("mortality_flag", F.lit(0))).over(_animal().rowsBetween(Window.unboundedPreceding, 0)))


def apply_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply the latest edit of each fix.

    ``edits``: animal_id, timestamp, kind ('problem' or 'mortality'), flag
    (0/1), edited_at.  Marking a death cascades, taking a mark back doesn't; a
    reason is given only where none is.
    """
    latest = edits.groupBy("animal_id", "timestamp").agg(*[F.max_by(F.when(F.col("kind") == k, F.col("flag")), F.when(F.col("kind") == k, F.col("edited_at"))).alias(f"_{k}") for k in ("problem", "mortality")])
    out = df.join(latest, ["animal_id", "timestamp"], "left")
    death = F.max((F.col("_mortality") == 1).cast("int")).over(_animal().rowsBetween(Window.unboundedPreceding, 0)) == 1
    out = out.withColumn("_death", F.coalesce(death, F.lit(False)))
    return out.withColumns({
        "problem": F.coalesce("_problem", "problem"), "mortality_flag": F.when(F.col("_mortality") == 0, 0).when(F.col("_death"), 1).otherwise(F.col("mortality_flag")),
        "problem_reason": F.when((F.col("_problem") == 1) & (F.coalesce("problem_reason", F.lit("")) == ""), "manual").otherwise(F.col("problem_reason")),
        "mortality_reason": F.when(F.col("_death") & (F.coalesce("mortality_reason", F.lit("")) == ""), "manual").otherwise(F.col("mortality_reason")),
    }).drop("_problem", "_mortality", "_death")


def unflagged(df: DataFrame) -> DataFrame:
    """Fixes without problem or mortality mark, whether by the present columns or a ``flag`` of old."""
    keep = F.lit(True)
    for c in ("problem", "mortality_flag"):
        if c in df.columns:
            keep = keep & (F.coalesce(F.col(c), F.lit(0)) == 0)
    if "flag" in df.columns:
        keep = keep & ~F.coalesce(F.lower(F.col("flag")).isin("problem", "mortality"), F.lit(False))
    return df.where(keep)


def thin(df: DataFrame, most: int = 3000, keys: tuple[str, ...] = ("animal_id",)) -> DataFrame:
    """Every n-th fix, so that about ``most`` of a group remain."""
    w = Window.partitionBy(*keys)
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / most))
    return df.withColumn("_keep", (F.row_number().over(w.orderBy("timestamp")) - 1) % step == 0).where("_keep").drop("_keep")


def sample_days(df: DataFrame, n: int, seed: int, keys: tuple[str, ...] = ("seq_id",), time: str = "timestamp") -> DataFrame:
    """At most ``n`` fixes of each day of a sequence, drawn by a seeded hash of the fix."""
    w = Window.partitionBy(*keys, F.year(time), F.dayofyear(time)).orderBy(F.xxhash64(F.col(time).cast("string"), F.lit(seed)), time)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def nearest_fix(df: DataFrame, at: Column, keys: tuple[str, ...] = ("animal_id",)) -> DataFrame:
    """Of each group the fix at, or else nearest in time to, ``at``; the earlier of two as near."""
    value = F.struct(*df.columns)
    apart = F.struct(F.abs(temporal.micros(F.col("timestamp")) - temporal.micros(at)), F.col("timestamp"))
    return df.groupBy(*keys).agg(F.min_by(value, apart).alias("_r")).select("_r.*")


def fix_rate(df: DataFrame, keys: tuple[str, ...] = ("id_bio_year",)) -> DataFrame:
    """``n, days, fixes_per_day`` of each group, both at least 1."""
    days = F.greatest(F.lit(1), temporal.whole_days(F.min("timestamp"), F.max("timestamp")))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), days.cast("long").alias("days"), F.greatest(F.lit(1.0), F.count(F.lit(1)) / days).alias("fixes_per_day"))


def with_gradient(df: DataFrame, value: str, keys: tuple[str, ...], target: str = "gradient") -> DataFrame:
    """Central differences, one-sided at the ends; NULL for a single row."""
    w = Window.partitionBy(*keys).orderBy("timestamp")
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn(target, F.coalesce((after - before) / 2, after - F.col(value), F.col(value) - before))
