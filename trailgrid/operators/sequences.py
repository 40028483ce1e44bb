"""Migration windows (migtime) and the fixes inside them.

The long form ``id_bio_year, animal_id, bio_year, slot, label, start, end`` is
the one that plans use; the wide form with eight slots is for review.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, temporal, text
from .grouped import map_groups
from .movement import unflagged

SLOTS = 8
#: Rows of windows that may be broadcast to the fixes; more are joined by key.
BROADCAST_ROWS = 200_000


def migtime_scaffold(fixes: DataFrame, num_sequences: int = 4) -> DataFrame:
    """A wide row for each animal-year, all slots empty."""
    if not 1 <= num_sequences <= SLOTS:
        raise ValueError(f"num_sequences must be 1 to {SLOTS}")
    keys = fixes.select("id_bio_year", "animal_id", *(["bio_year"] if "bio_year" in fixes.columns else [])).dropDuplicates(["id_bio_year"])
    if "bio_year" not in fixes.columns:
        keys = keys.withColumn("bio_year", F.element_at(F.split("id_bio_year", "_"), -1).cast("int"))
    empty = F.lit(None).cast("timestamp_ntz")
    slots = [empty.alias(f"mig{s}{e}") for s in range(1, SLOTS + 1) for e in ("start", "end")]
    return keys.select("id_bio_year", "animal_id", "bio_year", F.col("bio_year").cast("string").alias("bio_year_full"), *slots, F.lit("").alias("notes"), F.lit(False).alias("auto_detected"), F.lit(False).alias("reviewed"))


def to_long(wide: DataFrame, labels: dict[int, str] | None = None) -> DataFrame:
    """Filled slots of the wide form, one row each; ``labels`` maps slots to names (else ``mig1`` and so on)."""
    rows = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit((labels or {}).get(s, f"mig{s}")).alias("label"), F.col(f"mig{s}start").alias("start"), F.col(f"mig{s}end").alias("end")) for s in range(1, SLOTS + 1) if f"mig{s}start" in wide.columns])
    return wide.select("id_bio_year", "animal_id", "bio_year", F.inline(rows)).where("start is not null and end is not null")


def to_wide(long: DataFrame) -> DataFrame:
    """One row an animal-year with the starts and ends of its slots."""
    aggs = [F.max(F.when(F.col("slot") == s, F.col(e))).alias(f"mig{s}{e}") for s in range(1, SLOTS + 1) for e in ("start", "end")]
    return long.groupBy("id_bio_year", "animal_id", "bio_year").agg(*aggs)


def apply_detections(wide: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections, by start, become slots 1 to 8 of their animal-year; other animal-years stay as they are."""
    n = F.row_number().over(Window.partitionBy("id_bio_year").orderBy("start_date", "end_date"))
    found = detections.withColumn("slot", n).where(F.col("slot") <= SLOTS)
    aggs = [F.max(F.when(F.col("slot") == s, F.col(c))).alias(f"_mig{s}{e}") for s in range(1, SLOTS + 1) for e, c in (("start", "start_date"), ("end", "end_date"))]
    out = wide.join(found.groupBy("id_bio_year").agg(*aggs, F.lit(True).alias("_hit")), "id_bio_year", "left")
    cols = {f"mig{s}{e}": F.when(F.col("_hit"), F.col(f"_mig{s}{e}")).otherwise(F.col(f"mig{s}{e}")) for s in range(1, SLOTS + 1) for e in ("start", "end")}
    out = out.withColumns(cols | {"auto_detected": F.coalesce("_hit", "auto_detected")})
    return out.drop("_hit", *[f"_mig{s}{e}" for s in range(1, SLOTS + 1) for e in ("start", "end")])


def import_migtime(df: DataFrame, fixes: DataFrame) -> DataFrame:
    """An external table in the long form, its animal keys snapped to the data's (letters and digits decide)."""
    names = {"".join(ch for ch in c.lower() if ch.isalnum()): f"`{c}`" for c in df.columns}
    key = F.regexp_replace(F.lower(F.trim(F.col(names["idbioyear"]))), "[^a-z0-9]+", "_")
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(f"mig{s}").alias("label"), *[temporal.parse(text.or_null(F.col(names[f"mig{s}{e}"])), "yyyy-MM-dd HH:mm:ss").alias(e) for e in ("start", "end")]) for s in range(1, SLOTS + 1) if f"mig{s}start" in names])
    rows = df.select(key.alias("_key"), F.inline(slots)).where("start is not null and end is not null")
    known = fixes.select("id_bio_year", "animal_id", "bio_year").distinct().withColumn("_key", F.regexp_replace(F.lower(F.trim("id_bio_year")), "[^a-z0-9]+", "_"))
    return rows.join(known, "_key").select("id_bio_year", "animal_id", "bio_year", "slot", "label", "start", "end")


def renamed_labels(long: DataFrame, names: dict[str, str]) -> tuple[DataFrame, str]:
    """Windows with shown labels, and the legend ``old=new;...`` that undoes it."""
    label = F.col("label")
    for old, new in names.items():
        label = F.when(F.col("label") == old, F.lit(new)).otherwise(label)
    return long.withColumn("label", label), ";".join(f"{a}={b}" for a, b in names.items())


def restored_labels(long: DataFrame, legend: str) -> DataFrame:
    pairs = [p.split("=", 1) for p in legend.split(";") if "=" in p]
    return renamed_labels(long, {b: a for a, b in pairs})[0]


def review_state(wide: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``classification`` (``unclassified`` by default) and ``reviewed``: classified, or with a sequence."""
    if classes is not None:
        wide = wide.join(classes.select("id_bio_year", "classification"), "id_bio_year", "left")
    elif "classification" not in wide.columns:
        wide = wide.withColumn("classification", F.lit(None).cast("string"))
    wide = wide.withColumn("classification", F.coalesce("classification", F.lit("unclassified")))
    any_slot = F.coalesce(*[F.col(f"mig{s}start") for s in range(1, SLOTS + 1)]).isNotNull()
    return wide.withColumn("reviewed", (F.col("classification") != "unclassified") | any_slot)


# fixed values: classes that leave the analysis
REMOVED_CLASSES = ("resident", "nomadic", "insufficient")


def without_removed(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of animal-years that aren't classified as resident, nomadic or insufficient."""
    return df.join(classes.where(F.lower("classification").isin(*REMOVED_CLASSES)).select("id_bio_year"), "id_bio_year", "left_anti")


def removed_animal_years(fixes: DataFrame, classes: DataFrame) -> DataFrame:
    """A row each removed animal-year: class, number of fixes, first and last."""
    gone = classes.where(F.lower("classification").isin(*REMOVED_CLASSES)).select("id_bio_year", "classification")
    return fixes.join(gone, "id_bio_year").groupBy("id_bio_year", "animal_id", "classification").agg(F.count(F.lit(1)).alias("n_fixes"), F.min("timestamp").alias("first_fix"), F.max("timestamp").alias("last_fix"))


def removed_fixes(fixes: DataFrame, classes: DataFrame) -> DataFrame:
    """Marked fixes of the animal-years that stay."""
    return without_removed(fixes, classes).where((F.coalesce("problem", F.lit(0)) == 1) | (F.coalesce("mortality_flag", F.lit(0)) == 1))


def extract_sequences(fixes: DataFrame, windows: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Unmarked fixes inside each window, both ends included; a fix may be in several.

    Adds ``slot, label, start, end`` and ``mig``, the key ``<animal>_<year>_<label>``.
    The windows are broadcast if a count shows that they are few.
    """
    windows = windows.where("start is not null and end is not null").select(F.col("id_bio_year").alias("_k"), "slot", "label", "start", "end")
    if broadcast is None:
        broadcast = windows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(windows) if broadcast else windows
    out = unflagged(fixes).join(side, (F.col("id_bio_year") == F.col("_k")) & F.col("timestamp").between(F.col("start"), F.col("end")))
    return out.withColumn("mig", F.concat_ws("_", "id_bio_year", "label")).drop("_k")


def with_window_label(fixes: DataFrame, windows: DataFrame) -> DataFrame:
    """Every fix with the label of the window it lies in, the first slot's of several; NULL outside."""
    w = windows.select(F.col("id_bio_year").alias("_k"), F.col("slot").alias("_s"), F.col("label").alias("_l"), F.col("start").alias("_b"), F.col("end").alias("_e"))
    per = w.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_s", "_l", "_b", "_e"))).alias("_w"))  # eight slots at most
    hit = F.filter("_w", lambda x: F.col("timestamp").between(x["_b"], x["_e"]))
    return fixes.join(per, F.col("id_bio_year") == F.col("_k"), "left").withColumn("window_label", F.get(hit, F.lit(0))["_l"]).drop("_k", "_w")


def with_sequence_steps(seq: DataFrame, key: str = "mig", geographic: bool = False) -> DataFrame:
    """``step_km`` from the fix before in the sequence, planar or along the great circle."""
    w = Window.partitionBy(key).orderBy("timestamp")
    if geographic:
        step = geo.haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    else:
        step = geo.planar(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y")) / 1000
    return seq.withColumn("step_km", step)


def sequence_distances(seq: DataFrame, key: str = "mig", geographic: bool = False) -> DataFrame:
    """``key, start_date, end_date, days, distance_km`` (whole days, three decimals; 0 for a single fix)."""
    return with_sequence_steps(seq, key, geographic).groupBy(key).agg(
        F.min("timestamp").alias("start_date"), F.max("timestamp").alias("end_date"),
        F.greatest(F.lit(0), temporal.whole_days(F.min("timestamp"), F.max("timestamp"))).cast("long").alias("days"), F.round(F.coalesce(F.sum("step_km"), F.lit(0.0)), 3).alias("distance_km"),
    )


def diameter(x: np.ndarray, y: np.ndarray) -> float:
    """The greatest distance between two points: between corners of the hull, after points inside an octagon of extreme points are left out."""
    known = ~(np.isnan(x) | np.isnan(y))
    points = np.stack([x[known], y[known]], axis=1)
    if len(points) > 16:
        turns = np.array([[1, 0], [1, 1], [0, 1], [-1, 1], [-1, 0], [-1, -1], [0, -1], [1, -1]], float)
        ring = points[(points @ turns.T).argmax(0)]
        side = np.roll(ring, -1, 0) - ring
        cross = side[:, None, 0] * (points[None, :, 1] - ring[:, None, 1]) - side[:, None, 1] * (points[None, :, 0] - ring[:, None, 0])
        points = points[~((cross > 0) | (side == 0).all(1)[:, None]).all(0)]
    points = np.unique(points, axis=0)

    def half(rows: list) -> list:
        out: list = []
        for px, py in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (py - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (px - out[-2][0]):
                out.pop()
            out.append((px, py))
        return out

    if len(points) > 64:
        rows = points.tolist()
        points = np.array(sorted({*half(rows), *half(rows[::-1])}))
    best = 0.0
    for i in range(0, len(points), 512):
        d = points[i : i + 512, None, :] - points[None, :, :]
        best = max(best, float((d * d).sum(2).max()))
    return best**0.5


def max_pair(seq: DataFrame, key: str = "mig") -> DataFrame:
    """``key, maxpair_km``: the greatest distance between two fixes of a sequence; sequences without a position are left out."""

    def one(name, c: dict[str, np.ndarray]) -> dict:
        return {"key": [name], "maxpair_km": [diameter(c["x"], c["y"]) / 1000]}

    rows = seq.where("x is not null and y is not null").select(F.col(key).alias("key"), F.col("x").cast("double"), F.col("y").cast("double"))
    return map_groups(rows, "key", [], one, "key string, maxpair_km double").withColumnRenamed("key", key)


def max_pair_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg("maxpair_km").alias("mean_km"), F.coalesce(F.stddev_samp("maxpair_km"), F.lit(0.0)).alias("sd_km"), F.min("maxpair_km").alias("min_km"), F.max("maxpair_km").alias("max_km"))


def line_distances(seq: DataFrame, key: str = "mig", extra: tuple[str, ...] = ()) -> DataFrame:
    """``key, start_date, end_date, n_fixes, eucl_km, cumu_km`` and the first value of each ``extra`` column."""
    ends = {f: F.struct(F.col("x"), F.col("y")) for f in ("a", "b")}
    g = with_sequence_steps(seq, key).groupBy(key).agg(
        F.min("timestamp").alias("start_date"), F.max("timestamp").alias("end_date"), F.count(F.lit(1)).alias("n_fixes"), F.min_by(ends["a"], "timestamp").alias("_a"), F.max_by(ends["b"], "timestamp").alias("_b"),
        F.coalesce(F.sum("step_km"), F.lit(0.0)).alias("cumu_km"), *[F.min_by(c, "timestamp").alias(c) for c in extra],
    )
    return g.withColumn("eucl_km", geo.planar(F.col("_a.x"), F.col("_a.y"), F.col("_b.x"), F.col("_b.y")) / 1000).drop("_a", "_b")


def trips(seq: DataFrame, key: str = "mig") -> DataFrame:
    """The trip table: season, year, animal, start, end, days (with fraction), three distances and miles; two fixes at least.

    One pass over each sequence's fixes gives the line and the diameter.
    """
    def one(name, c: dict[str, np.ndarray]) -> dict:
        x, y, t = c["x"], c["y"], c["t"]
        if len(x) < 2:
            return {n: [] for n in names}
        reach = np.hypot(x[-1] - x[0], y[-1] - y[0]) / 1000
        row = name, c["label"][0], c["bio_year"][0], c["animal_id"][0], t[0], t[-1], float(t[-1] - t[0]) / 86400e6, reach, float(np.nansum(np.hypot(np.diff(x), np.diff(y)))) / 1000, diameter(x, y) / 1000, len(x)
        return {n: [v] for n, v in zip(names, row, strict=True)}

    names = ["key", "season", "bio_year", "animal_id", "start_date", "end_date", "days", "eucl_km", "cumu_km", "maxpair_km", "n_fixes"]
    rows = seq.where("timestamp is not null").select(F.col(key).alias("key"), "label", "bio_year", "animal_id", temporal.micros(F.col("timestamp")).alias("t"), F.col("x").cast("double"), F.col("y").cast("double"))
    kinds = "key string, season string, bio_year int, animal_id string, start_date timestamp_ntz, end_date timestamp_ntz, days double, eucl_km double, cumu_km double, maxpair_km double, n_fixes long"
    found = map_groups(rows, "key", ["t"], one, kinds)
    return found.select(F.col("key").alias(key), *names[1:10], (F.col("cumu_km") * 0.621371).alias("cumu_miles"), "n_fixes")


def range_windows(windows: DataFrame, spring: str = "spring", fall: str = "fall") -> DataFrame:
    """Summer and winter ranges between migrations: ``animal_id, bio_year, season, start, end``.

    Spring and fall are the windows whose label holds those words, else the
    earliest and the latest of the animal-year.  Summer lasts from the end of
    spring to the start of fall, winter from the end of fall to the next
    year's spring.  Windows with a missing or reversed bound are kept with a
    ``skipped`` reason.
    """

    def pick(word: str, edge) -> tuple:
        hit = F.lower("label").contains(word)
        by = edge(F.struct("start", "end"))
        return F.coalesce(edge(F.when(hit, F.struct("start", "end"))), by)

    years = windows.groupBy("animal_id", "bio_year").agg(pick(spring, F.min).alias("s"), pick(fall, F.max).alias("f"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("animal_id").orderBy("bio_year")
    nxt = F.when(F.lead("bio_year").over(order) == F.col("bio_year") + 1, F.lead("s").over(order)["start"])
    fall_too = F.col("n") > 1
    years = years.select("animal_id", "bio_year", F.col("s.end").alias("spring_end"), F.when(fall_too, F.col("f.start")).alias("fall_start"), F.when(fall_too, F.col("f.end")).alias("fall_end"), nxt.alias("next_spring"))
    rows = years.select("animal_id", "bio_year", F.inline(F.array(
        F.struct(F.lit("Summer").alias("season"), F.col("spring_end").alias("start"), F.col("fall_start").alias("end")), F.struct(F.lit("Winter").alias("season"), F.col("fall_end").alias("start"), F.col("next_spring").alias("end")))))
    return rows.withColumn("skipped", F.when(F.col("start").isNull() | F.col("end").isNull(), "a bound is missing").when(F.col("start") >= F.col("end"), "bounds are reversed"))


def range_sequences(fixes: DataFrame, windows: DataFrame, min_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Fixes of each range with ``mig`` and ``season``, and the ranges left out with the reason."""
    ranges = range_windows(windows)
    good = ranges.where("skipped is null").withColumnsRenamed({"animal_id": "_a", "bio_year": "range_year"}).drop("skipped")
    inside = unflagged(fixes).join(good, (F.col("animal_id") == F.col("_a")) & (F.col("timestamp") >= F.col("start")) & (F.col("timestamp") <= F.col("end"))).drop("_a")
    inside = inside.withColumn("mig", F.concat_ws("_", "animal_id", "range_year", "season"))
    days = inside.groupBy("mig", "animal_id", "range_year", "season").agg(F.countDistinct(F.to_date("timestamp")).alias("_d"))
    kept = inside.join(days.where(F.col("_d") >= min_days).select("mig"), "mig", "left_semi")
    short = days.where(F.col("_d") < min_days).select("animal_id", F.col("range_year").alias("bio_year"), "season", F.format_string(f"%d days of fixes, {min_days} needed", "_d").alias("skipped"))
    return kept, ranges.where("skipped is not null").select("animal_id", "bio_year", "season", "skipped").unionByName(short)
