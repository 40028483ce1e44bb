"""Small hand-computed cases of the telemetry operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailgrid.config import ProcessConfig, model_config
from trailgrid.functions import geo, temporal, text
from trailgrid.operators import contours, detect, enrich, ingest, movement, population, report, sequences, ud
from trailgrid.plans.process import process
from trailgrid.sinks import tables as sinks
from trailgrid.sources import collar, geojson
from trailgrid.sources import tables as sources

T0 = dt.datetime(2024, 1, 1)


def fixes(spark, rows, animal="a"):
    """rows: (hours, x, y)."""
    return spark.createDataFrame([(animal, T0 + dt.timedelta(hours=h), float(x), float(y)) for h, x, y in rows], "animal_id string, timestamp timestamp_ntz, x double, y double")


def test_bursts_cut_strictly_after_49_hours(spark):
    df = fixes(spark, [(0, 0, 0), (49, 0, 0), (98 + 1 / 3600, 0, 0)])
    assert [r[0] for r in movement.with_burst(df).orderBy("timestamp").select("burst_id").collect()] == [1, 1, 2]


def test_bursts_number_over_animals_and_empty(spark):
    both = fixes(spark, [(0, 0, 0), (60, 0, 0)], "a").union(fixes(spark, [(0, 0, 0)], "b"))
    assert [r[0] for r in movement.with_burst(both).orderBy("animal_id", "timestamp").select("burst_id").collect()] == [1, 2, 3]
    assert movement.with_steps(movement.with_burst(both.where("false"))).count() == 0


def test_bearings_and_turns(spark):
    df = movement.with_steps(movement.with_burst(fixes(spark, [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)]))).orderBy("timestamp")
    rows = df.select("abs_angle", "rel_angle", "dist", "speed").collect()
    assert [r[0] for r in rows] == [None, 90, 0, 270, 180]
    assert [r[1] for r in rows] == [None, None, -90, -90, -90]
    assert rows[1][3] == pytest.approx(1 / 3600)


def test_reversal_turns_minus_180(spark):
    df = movement.with_steps(movement.with_burst(fixes(spark, [(0, 0, 0), (1, 0, 1), (2, 0, 0)])))
    assert df.orderBy("timestamp").collect()[-1]["rel_angle"] == -180


def test_nsd(spark):
    df = movement.with_nsd(fixes(spark, [(h, 0, 0) for h in range(20)] + [(20 + h, 3000, 4000) for h in range(5)]), ["animal_id"], "a")
    rows = df.orderBy("timestamp").collect()
    assert rows[0]["nsd_a"] == 0 and rows[-1]["nsd_a"] == 25 and rows[-1]["displacement_a"] == 5


def test_bio_year(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31),), (dt.datetime(2024, 2, 1),), (dt.datetime(2024, 2, 29),)], "timestamp timestamp_ntz")
    assert [r[0] for r in df.select(temporal.bio_year(F.col("timestamp"))).collect()] == [2023, 2024, 2024]


def test_mortality_and_cascade(spark):
    df = movement.with_mortality(fixes(spark, [(0, 0, 0), (12, 1, 0), (24, 0, 1), (84, 1000, 0)]))
    assert [r["mortality_flag"] for r in df.orderBy("timestamp").collect()] == [1, 1, 0, 0]
    assert [r["mortality_flag"] for r in movement.cascade_mortality(df).orderBy("timestamp").collect()] == [1, 1, 1, 1]
    off = movement.with_mortality(fixes(spark, [(0, 0, 0), (1, 0, 0)]), distance_m=None)
    assert off.agg(F.sum("mortality_flag")).first()[0] == 0


def test_thresholds_none_zero_and_nan(spark):
    df = spark.createDataFrame([(4.0, 12.0, 3), (math.nan, math.nan, None)], "speed double, DOP double, NumSats int")
    assert [r["problem"] for r in movement.with_problems(df).collect()] == [1, 0]
    assert [r["problem"] for r in movement.with_problems(df, None, None, None).collect()] == [0, 0]
    assert [r["problem"] for r in movement.with_problems(df, None, None, 0).collect()] == [0, 0]
    assert [r["problem_reason"] for r in movement.with_problems(df, None, 10, None).collect()] == ["DOP = 12.0 (max 10)", ""]


def test_remap_and_process_app_download(spark):
    rows = [("x1", "2024-01-01 00:00:00", "-108.0", "39.5", "2", "9", "D1"), ("x1", "2024-01-01 00:00:00", "-108.0", "39.5", "2", "9", "D1"), ("x1", "2024-01-02 00:00:00", "-108.1", "39.6", "20", "4", "D1"), ("x1", "2024-01-03 00:00:00", "8", "39.6", "1", "9", "D1")]
    df = spark.createDataFrame(rows, ["animalIdLocal", "mtReadable", "longitude", "latitude", "dop", "numSats", "dau"])
    out, names = process(df)
    got = out.orderBy("timestamp").collect()
    assert len(got) == 2 and [r["problem"] for r in got] == [0, 1] and got[0]["id_bio_year"] == "x1_2023"
    assert names.first().asDict() == {"herd_id": "D1", "project": "Project"}
    assert got[0]["utm_zone"] == 13 and got[1]["dist"] == pytest.approx(14000, rel=0.02)


def test_us_timestamps_win_when_strict_fails(spark):
    df = spark.createDataFrame([("1/15/2024 7:05",), ("2/3/2024 17:05",), ("2024-03-01 00:00:00",)], ["t"])
    got = [r["timestamp"] for r in temporal.parse_flexibly(df, "t", "yyyy-MM-dd HH:mm:ss").collect()]
    assert got == [dt.datetime(2024, 1, 15, 7, 5), dt.datetime(2024, 2, 3, 17, 5), dt.datetime(2024, 3, 1)]
    with pytest.raises(ValueError):
        ingest.drop_null_times(df.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp_ntz")))


def test_utm_of_a_known_point(spark):
    x, y = geo.to_utm(F.lit(-105.0), F.lit(40.0), F.lit(13))
    east, north = spark.range(1).select(x, y).first()
    assert east == pytest.approx(500000, abs=1e-6) and north == pytest.approx(4427757.2187, abs=1e-3)


def test_line_distances(spark):
    seq = fixes(spark, [(0, 0, 0), (1, 3000, 0), (2, 3000, 4000)]).withColumn("mig", F.lit("m"))
    row = sequences.line_distances(seq).join(sequences.max_pair(seq), "mig").first()
    assert (row["eucl_km"], row["cumu_km"], row["maxpair_km"]) == (5, 7, 5)
    one = sequences.line_distances(seq.limit(1)).join(sequences.max_pair(seq.limit(1)), "mig").first()
    assert (one["eucl_km"], one["cumu_km"], one["maxpair_km"]) == (0, 0, 0)


def test_max_pair_equals_all_pairs(spark):
    xy = np.random.default_rng(3).normal(size=(300, 2)) * 1000
    seq = fixes(spark, [(i, *p) for i, p in enumerate(xy)]).withColumn("mig", F.lit("m"))
    want = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)).max() / 1000
    assert sequences.max_pair(seq).first()["maxpair_km"] == pytest.approx(want, abs=1e-12)


def test_windows_are_closed_and_may_overlap(spark):
    f = fixes(spark, [(h, 0, 0) for h in range(5)]).withColumns({"id_bio_year": F.concat("animal_id", F.lit("_2023")), "problem": F.lit(0), "mortality_flag": F.lit(None).cast("int")})
    w = spark.createDataFrame([("a_2023", 1, "s", T0, T0 + dt.timedelta(hours=2)), ("a_2023", 2, "t", T0 + dt.timedelta(hours=2), T0 + dt.timedelta(hours=3)), ("a_2023", 3, "u", None, T0)], "id_bio_year string, slot int, label string, start timestamp_ntz, end timestamp_ntz")
    out = sequences.extract_sequences(f, w)
    assert sorted((r["mig"], r["timestamp"].hour) for r in out.collect()) == [("a_2023_s", 0), ("a_2023_s", 1), ("a_2023_s", 2), ("a_2023_t", 2), ("a_2023_t", 3)]
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()


def test_detections_fill_slots(spark):
    f = fixes(spark, [(0, 0, 0)]).withColumns({"id_bio_year": F.lit("a_2023"), "bio_year": F.lit(2023)})
    det = spark.createDataFrame([("a_2023", T0 + dt.timedelta(days=d), T0 + dt.timedelta(days=d + 1)) for d in (9, 3)], "id_bio_year string, start_date timestamp_ntz, end_date timestamp_ntz")
    row = sequences.apply_detections(sequences.migtime_scaffold(f), det).first()
    assert row["mig1start"].day == 4 and row["mig2start"].day == 10 and row["auto_detected"]
    assert sequences.review_state(sequences.apply_detections(sequences.migtime_scaffold(f), det)).first()["reviewed"]
    with pytest.raises(ValueError):
        sequences.migtime_scaffold(f, 9)


def test_rolling_median_reflects():
    x = np.array([5.0, 1, 2, 9, 3])
    padded = np.pad(x, 2, mode="reflect")
    assert detect.rolling_median(x, 5).tolist() == [float(np.median(padded[i : i + 5])) for i in range(5)]
    assert len(detect.rolling_median(x, 21)) == 5


def test_detects_a_rise_and_a_return():
    t = np.arange(0, 200) * np.timedelta64(12, "h") + np.datetime64("2024-02-01", "us")
    d = np.arange(200) / 2.0
    nsd = np.where(d < 30, 0, np.where(d < 45, (d - 30) * 10, np.where(d < 70, 150, np.maximum(0, 150 - (d - 70) * 10)))).astype(float)
    got = detect.detect_one(nsd + np.linspace(0, 0, 200), t, None, None)
    assert [g["migration_type"] for g in got] == ["outbound", "return"] and [g["sequence_name"] for g in got] == ["mig1", "mig2"]
    assert abs((got[0]["start_date"] - np.datetime64("2024-03-02")) / np.timedelta64(1, "D")) < 3


def slow_detections(nsd, days, most):
    """The detector's rules one by one on lists; days as numbers, without the reach of places."""
    n = len(nsd)
    per_day = max(1.0, n / max(1, int(days[-1] - days[0])))
    window = max(3, round(7 * per_day))
    window += 1 - window % 2
    side, period = window // 2, max(1, 2 * (n - 1))
    fold = lambda i: min(i % period, period - i % period) if i % period >= n else i % period
    smooth = [sorted(nsd[fold(i + k)] for k in range(-side, side + 1))[side] for i in range(n)]
    slope = [(smooth[min(i + 1, n - 1)] - smooth[max(i - 1, 0)]) for i in range(n)]
    sign = [(v > 0) - (v < 0) for v in slope]
    spread, runs, at = max(smooth) - min(smooth), [], 0
    while at < n:
        end = at
        while end < n and sign[end] == sign[at]:
            end += 1
        if sign[at] and end - at >= max(3, round(5 * per_day)) and abs(smooth[end - 1] - smooth[at]) >= 0.05 * spread:
            if runs and runs[-1][0] == sign[at] and at - runs[-1][2] <= 0.2 * min(runs[-1][2] - runs[-1][1], end - at):
                runs[-1][2] = end
            else:
                runs.append([sign[at], at, end])
        at = end
    scored = [(0.6 * abs(smooth[b - 1] - smooth[a]) / (spread or 1) + 0.4 * sum(x == s for x in sign[a:b]) / (b - a), s, a, b) for s, a, b in runs]
    best = sorted(sorted(scored, key=lambda r: -r[0])[:most], key=lambda r: r[2])
    return [("outbound" if s > 0 else "return", a, b - 1, round(score, 3)) for score, s, a, b in best]


def test_detections_against_plain_rules(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(12):
        n = int(rng.integers(12, 160))
        days = np.cumsum(rng.choice([0.25, 0.5, 1.0], n))
        nsd = np.abs(np.cumsum(rng.normal(size=n))) * 10 + 60 * np.maximum(0, np.sin(days / 15))
        want[f"a{k}"] = [(kind, days[a], days[b], score) for kind, a, b, score in slow_detections(nsd.tolist(), days.tolist(), 4)]
        rows += [(f"a{k}", "a", T0 + dt.timedelta(days=float(d)), float(v)) for d, v in zip(days, nsd, strict=True)]
    df = spark.createDataFrame(rows, "id_bio_year string, animal_id string, timestamp timestamp_ntz, nsd_id_bio_year double").repartition(5)
    got = {}
    for r in detect.detect_migrations(df, reach=False).orderBy("id_bio_year", "start_date").collect():
        got.setdefault(r["id_bio_year"], []).append((r["migration_type"], (r["start_date"] - T0) / dt.timedelta(days=1), (r["end_date"] - T0) / dt.timedelta(days=1), r["confidence"]))
    assert {k: v for k, v in want.items() if v} == got and len(got) > 5


def test_parts_against_a_flood():
    rng = np.random.default_rng(9)
    for _ in range(20):
        mask = rng.random((12, 12)) < 0.55
        row, col = np.nonzero(mask)
        seen, parts = set(), 0
        for cell in zip(row.tolist(), col.tolist(), strict=True):
            if cell in seen:
                continue
            parts, todo = parts + 1, [cell]
            while todo:
                r, c = todo.pop()
                if (r, c) in seen or not (0 <= r < 12 and 0 <= c < 12) or not mask[r, c]:
                    continue
                seen.add((r, c))
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
        part = contours.label(row, col)
        assert len(set(part.tolist())) == parts
        assert all(part[i] == part[j] for i in range(len(row)) for j in range(i) if abs(row[i] - row[j]) + abs(col[i] - col[j]) == 1)


def test_dynamic_variance_equals_windows_one_by_one():
    rng = np.random.default_rng(10)
    xy = np.cumsum(rng.normal(size=(40, 2)) * 100, 0)
    lag = rng.choice([30.0, 60.0, 900.0], 39, p=[0.5, 0.4, 0.1])
    got = ud.dynamic_variance(*xy.T, lag, 20.0, 480, 11, 3)
    total, count = np.zeros(39), np.zeros(39)
    for i in range(30):
        v = ud.motion_variance(*xy[i : i + 11].T, lag[i : i + 10], 20.0, 480)
        total[i + 2 : i + 8] += v
        count[i + 2 : i + 8] += 1
    whole = ud.motion_variance(*xy.T, lag, 20.0, 480)
    assert got == pytest.approx(np.where(count > 0, total / np.maximum(count, 1), whole), rel=1e-4)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    for values in (rng.normal(size=5001), rng.integers(0, 5, 400).astype(float), np.array([3.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for share in (0.0, 0.5, 0.98, 1.0):
            assert ingest.exact_quantile(df, "v", share).first()[0] == pytest.approx(np.quantile(values, share), abs=1e-12)
    assert ingest.exact_quantile(df.where("v is null"), "v").first()[0] is None


def test_running_mass_with_equal_values(spark):
    rng = np.random.default_rng(7)
    cells = [(int(i // 40), int(i % 40) * 300, float(rng.integers(1, 4))) for i in range(1600)]
    got = population.running_mass(spark.createDataFrame([(c, r, v) for r, c, v in cells], "row int, col int, v double"), "v").orderBy(F.desc("v"), "row", "col").collect()
    assert [r["cum"] for r in got] == np.cumsum([r["v"] for r in got]).tolist()


def test_running_mass_of_sums_that_vary(spark):
    """Each evaluation of the surface gives other last digits, as sums over shuffled rows do; no cell is lost."""
    import random

    noisy = F.udf(lambda v: v * (1 + 1e-12 * random.random()), "double").asNondeterministic()
    cells = spark.createDataFrame([(i // 20, i % 20, 1.0 + i % 7) for i in range(400)], "row int, col int, v double")
    got = population.running_mass(cells.withColumn("v", noisy("v")), "v").collect()
    assert len(got) == 400 and max(r["cum"] for r in got) == pytest.approx(sum(r["v"] for r in got))


def test_use_volume_gives_its_running_sum(spark, tables):
    """The sum from the most used cell down is part of the query's rows; uses that differ in their last digits are ties."""
    from trailgrid.plans import queries

    got = queries.population_use_volume(spark, tables).collect()
    cells = sorted(got, key=lambda r: (-r["density"], r["row"], r["col"]))
    assert len(cells) > 1 and np.allclose([r["cum"] for r in cells], np.cumsum([r["density"] for r in cells]), atol=1e-6)
    layers = spark.createDataFrame([("a", i // 4, i % 4, 0.1 * (1 + 1e-15 * (i * 7 % 5))) for i in range(16)] + [("a", 9, 9, 0.4)], "layer string, row int, col int, density double")
    cum = [r["cum"] for r in population.use_volume(layers).orderBy("row", "col").collect()]
    assert cum == pytest.approx([0.2 + 0.05 * (i + 1) for i in range(16)] + [0.2])


def test_diameter_equals_all_pairs():
    rng = np.random.default_rng(4)
    for n in (1, 2, 15, 17, 400):
        for xy in (rng.normal(size=(n, 2)), rng.integers(0, 3, (n, 2)).astype(float), np.ones((n, 2)), np.stack([np.arange(n), np.arange(n)], 1).astype(float)):
            assert sequences.diameter(*xy.T) == pytest.approx(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)).max(), abs=1e-12)


def test_asof_tie_takes_the_later(spark):
    g = fixes(spark, [(1, 0, 0)])
    w = fixes(spark, [(0.5, 10, 0), (1.5, 20, 0)]).select("animal_id", "timestamp", F.col("x").alias("v"))
    assert enrich.nearest_in_time(g, w, ["v"]).first()["v"] == 20
    assert enrich.nearest_in_time(g, w, ["v"], tolerance_s=1799).first()["v"] is None
    assert enrich.nearest_in_time(g, w.where("false"), ["v"]).first()["v"] is None


def test_ids_match_as_parts(spark):
    g = spark.createDataFrame([("4321",), ("A77",), ("5",), (None,)], "animal_id string")
    w = spark.createDataFrame([("32",), ("XA77Z",), ("951",), ("888",)], "wld_serial string")
    assert {(r["g"], r["w"]) for r in enrich.match_ids(g, w).collect()} == {("4321", "32"), ("A77", "XA77Z"), ("5", "951")}
    assert enrich.match_ids(g, w, strict=True).count() == 0


def test_highway_only_track(spark):
    f = fixes(spark, [(0, 0, 0), (1, 10, 0)]).withColumn("id_bio_year", F.col("animal_id"))
    roads = spark.createDataFrame([("r", "S1200", 0, 5.0, -1.0, 5.0, 1.0), ("q", "S1400", 0, 50.0, -1.0, 50.0, 1.0)], "road_id string, mtfcc string, seg_no int, x1 double, y1 double, x2 double, y2 double")
    out = enrich.road_crossings(f, roads)
    assert out.first()[1:] == (False, True)
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    assert enrich.road_crossings(f.limit(1), roads).first()[1:] == (False, False)


def test_circular_dates_do_not_meet_in_summer(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 12, 28),), (dt.datetime(2024, 1, 4),)], "t timestamp_ntz")
    mean = df.agg(temporal.month_day(temporal.circular_mean_day(F.col("t")))).first()[0]
    assert mean in ("12/31", "01/01", "01/02")
    assert df.agg(temporal.month_day(temporal.circular_median_day(F.col("t")))).first()[0] == "01/04"


def test_circular_dates_of_many_trips(spark):
    """Dates of a season are counted by day, as a plain search finds them, and cost no more than their number."""
    import time

    rng = np.random.default_rng(9)
    days = {"a": rng.choice([3, 3, 360, 361, 200], 7), "b": np.array([59]), "c": np.array([10, 10, 192, 192]), "d": (rng.normal(355, 20, 60_000).astype(int)) % 365}
    day = F.date_add(F.lit(dt.date(2023, 1, 1)), F.col("v")).cast("timestamp_ntz")
    rows = spark.createDataFrame([(k, int(v)) for k, x in days.items() for v in x], "season string, v int")
    trips = rows.select("season", F.lit(2023).alias("bio_year"), day.alias("start_date"), F.lit(T0).cast("timestamp_ntz").alias("end_date"))
    began = time.time()
    got = {r["season"]: r for r in report.circular_dates(trips, ["season"]).collect()}
    long = {(r["season"], r["metric"]): r["value"] for r in report.sequences_summary(trips).where("year = 'All_Years'").collect()}
    assert time.time() - began < 60
    for k, x in days.items():
        x, n = np.sort(x), len(x)
        seam = int(np.argmax(np.diff(np.r_[x, x[0] + 365])))
        name = lambda v: (dt.date(2023, 1, 1) + dt.timedelta(days=int(v))).strftime("%m/%d")
        median = name(x[(seam + 1 + n // 2) % n])
        assert got[k]["median_start"] == long[k, "median_start"] == median and got[k]["median_end"] == "01/01"
        assert long[k, "n"] == str(n) and (long[k, "earliest_start"], long[k, "latest_start"]) == (name(x[0]), name(x[-1]))
    assert got["a"]["mean_start"] == long["a", "average_start"]


def test_tail_cut_and_footprint(spark):
    u = spark.createDataFrame([("s", 0, i, d) for i, d in enumerate([0.5, 0.3, 0.1, 0.1])], "seq_id string, row int, col int, density double")
    assert {r["col"] for r in ud.footprint(u, 79).collect()} == {0, 1}
    assert ud.tail_cut(u).agg(F.sum("density")).first()[0] == pytest.approx(1)
    dense = np.array([[0.5, 0.3, 0.1, 0.1]])
    assert ud.cut_tail(dense, 0.79).ravel().tolist() == pytest.approx([0.625, 0.375, 0, 0])


def test_gaussian_isopleths(spark):
    n, size, sd = 120, 400.0, 4000.0
    c = (np.arange(n) - n / 2 + 0.5) * size
    d = np.exp(-(c[:, None] ** 2 + c[None] ** 2) / (2 * sd**2))
    rows = [(int(i), int(j), float(d[i, j])) for i in range(n) for j in range(n)]
    vol = population.running_mass(spark.createDataFrame([(i, j, float(v / d.sum())) for i, j, v in rows], "row int, col int, density double"), "density")
    for level, want in ((95, 301.2), (50, 69.7)):
        assert population.volume_isopleth(vol, level).count() * size**2 / 1e6 == pytest.approx(want, rel=0.01)


def test_smallest_prefix_breaks_ties_by_cell(spark):
    s = spark.createDataFrame([(1, 0, i, v) for i, v in enumerate([5, 3, 3, 1])], "season int, row int, col int, n int")
    assert {r["col"] for r in population.smallest_prefix(s, "n", 40, ["season"]).collect()} == {0}
    assert {r["col"] for r in population.smallest_prefix(s, "n", 50, ["season"]).collect()} == {0, 1}


def test_models_against_plain_loops(spark):
    rng = np.random.default_rng(1)
    xy = np.cumsum(rng.normal(size=(30, 2)) * 300, 0)
    seq = fixes(spark, [(i * 2, *p) for i, p in enumerate(xy)]).withColumn("seq_id", F.lit("s"))
    grid = ud.make_grid(seq, 250)
    got = ud.ud_cells(ud.run_sequences(seq, grid, model_config("kernel"), "seq_id")).collect()
    assert sum(r["density"] for r in got) == pytest.approx(1)
    h = ud.silverman(*xy.T)
    plain = {(r["row"], r["col"]): sum(math.exp(-((gx - a) ** 2 + (gy - b) ** 2) / (2 * h * h)) for a, b in xy) for r in got[:20] for gx, gy in [grid.centre(r["row"], r["col"])]}
    ratio = [r["density"] / plain[r["row"], r["col"]] for r in got[:20]]
    assert max(ratio) == pytest.approx(min(ratio), rel=1e-9)
    narrow, wide = (ud.ud_cells(ud.run_sequences(seq, grid, model_config("BBMM", bm_var=v), "seq_id")) for v in (50.0, 4000.0))
    assert narrow.agg(F.max("density")).first()[0] > wide.agg(F.max("density")).first()[0]
    meta = ud.ud_metadata(ud.run_sequences(seq, grid, model_config("BBMM"), "seq_id")).first()
    assert meta["variance_mode"] == "estimated" and meta["errors"] == ""
    few = ud.ud_metadata(ud.run_sequences(seq.limit(3), grid, model_config("BBMM"), "seq_id")).first()
    assert "fewer" in few["errors"]
    assert ud.ud_metadata(ud.run_sequences(seq, grid, model_config("dBBMM"), "seq_id")).first()["variance_mode"] == "dynamic"
    assert ud.ud_metadata(ud.run_sequences(seq, grid, model_config("CTMM"), "seq_id")).first()["method"] == "CTMM as KERNEL"
    line = ud.ud_cells(ud.run_sequences(seq, grid, model_config("LineBuffer"), "seq_id")).select("row", "col")
    assert line.exceptAll(ud.line_buffer(seq, grid).select("row", "col")).count() == 0 == ud.line_buffer(seq, grid).select("row", "col").exceptAll(line).count()
    with pytest.raises(ValueError):
        model_config("nothing")
    assert model_config("BBMM", 13).bm_var == 1000 and model_config("BBMM", 12).bm_var is None


@pytest.mark.parametrize("surface", [ud.kernel_sql, lambda rows, grid: ud.bridge_sql(rows, grid, 1000)])
def test_fixes_meet_boxes_before_cells(spark, surface):
    """Cells, many more than their boxes' estimated size, are no side of a join."""
    rows = fixes(spark, [(i, 900 * i, 50 * i * i) for i in range(8)]).withColumn("seq_id", F.lit("s"))
    got = surface(rows, ud.make_grid(rows, 500))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("explode(sequence(r0") < plan.index("Join ")
    assert got.count() > 100 and got.where("density is null or density < 0").count() == 0


def test_variance_minimum_beats_a_search():
    rng = np.random.default_rng(2)
    xy = np.cumsum(rng.normal(size=(200, 2)) * math.sqrt(60 * 500), 0)
    v = ud.motion_variance(*xy.T, np.full(199, 60.0), 20.0, 480)
    assert 200 < v < 1200


def test_parts_holes_and_rings():
    cells = np.array([(r, c) for r in range(5) for c in range(5) if (r, c) != (2, 2)] + [(8, 8)])
    row, col, part = contours.clean(*cells.T, 1.0, 2.0, 2.0)
    assert len(row) == 25 and set(part) == {0}
    assert len(contours.clean(np.array([0, 5]), np.array([0, 5]), 1.0, 2.0, 0)[0]) == 2  # all too small: all stay
    assert len(contours.clean(np.array([0]), np.array([0]), 1.0, 2.0, 0)[0]) == 0
    outer, = contours.rings(row, col)
    assert contours.ring_area(outer) == 25
    two = contours.rings(np.array([0, 1]), np.array([0, 1]))
    assert sorted(map(contours.ring_area, two)) == [1, 1]
    plus = np.array([[1, 0], [2, 0], [2, 1], [3, 1], [3, 2], [2, 2], [2, 3], [1, 3], [1, 2], [0, 2], [0, 1], [1, 1]], float) * 1000
    assert 0.7 < contours.ring_area(contours.ksmooth(plus, 2)) / contours.ring_area(plus) <= 1.0


def test_rasterise_uses_cell_centres(spark):
    grid = ud.Grid(0, 0, 10, 10, 10, 10, 1)
    ring = [{"x": 1.0, "y": 1.0}, {"x": 4.0, "y": 1.0}, {"x": 4.0, "y": 3.0}, {"x": 1.0, "y": 3.0}]
    df = spark.createDataFrame([("p", 0, ring)], "id string, ring_no int, ring array<struct<x:double,y:double>>")
    assert {(r["row"], r["col"]) for r in ud.rasterise(df, grid).collect()} == {(r, c) for r in (7, 8) for c in (1, 2, 3)}


def test_collar_files(spark, tmp_path):
    table = np.arange(12.0).reshape(3, 4)
    (tmp_path / "h.wld").write_bytes(collar.encode({7: table, 9: table[:0], 12: table + 100}, {7: "A7"}, "herd"))
    df = collar.read_collars(spark, str(tmp_path / "h.wld"), ["speed_kmh", "elevation_m"])
    rows = df.orderBy("wld_timestamp").collect()
    assert len(rows) == 6 and rows[0]["wld_local_id"] == "A7" and rows[1]["wld_lat"] == 5 and rows[0]["speed_kmh"] == 3 and rows[0]["elevation_m"] is None
    assert collar.read_metadata(spark, str(tmp_path)).first()["rows"] == 6 and collar.column_catalog(spark).count() == 36


def test_geojson_round_trip(spark, tmp_path):
    shapes = spark.createDataFrame([("a", [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 2.0}])], "name string, line array<struct<x:double,y:double>>")
    sinks.write_geojson(shapes, str(tmp_path / "l"))
    rows = geojson.read_lines(spark, str(tmp_path / "l"), ["name"]).orderBy("seg_no").collect()
    assert [(r["x1"], r["y2"]) for r in rows] == [(0.0, 2.0), (1.0, 2.0)]


def test_field_names_and_manifest(spark):
    assert sinks.field_names(["cumulative.km", "Cumulative_m", "x"]) == ["cumulative", "Cumulativ1", "x"]
    m = {r["key"]: r["changed"] for r in sinks.manifest(spark, 2, {"a": 1, "b": 2}, {"a": 1, "c": 3}).collect()}
    assert m == {"a": False, "b": True, "c": True}


def test_csv_scan_keeps_strings(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n1,x\n2,y\n")
    df = sources.read_fixes(spark, str(tmp_path / "f.csv"))
    assert df.dtypes == [("a", "string"), ("b", "string")] and sources.first_existing(spark, [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)


def test_row_order_does_not_matter(spark):
    rng = np.random.default_rng(5)
    rows = [(float(h), *rng.normal(size=2) * 1000) for h in rng.permutation(60) * 7]
    a, b = (movement.with_steps(movement.with_burst(fixes(spark, r))).select("timestamp", "burst_id", "dist") for r in (rows, rows[::-1]))
    assert a.exceptAll(b).count() == 0


def test_texts():
    assert text.MISSING[0] == ""
    assert ProcessConfig().max_speed_kmh == 10.8


def test_stored_outputs_and_their_metadata(spark, tmp_path):
    cells = spark.createDataFrame([("s1", 0, 0, 0.5), ("s2", 1, 1, 0.25)], "seq_id string, row int, col int, density double")
    sinks.write_raster(cells, f"{tmp_path}/ud", partition=["seq_id"])
    sinks.write_csv(spark.createDataFrame([("s1", "Spring"), ("s1", "again")], "sequence string, season string"), f"{tmp_path}/meta")
    uds, none = sources.read_model_outputs(spark, f"{tmp_path}/ud", f"{tmp_path}/meta", f"{tmp_path}/no")
    got = {r["seq_id"]: r["season"] for r in uds.collect()}
    assert none is None and got["s1"] in ("Spring", "again") and got["s2"] is None and uds.count() == 2
    assert {r["value"] for r in spark.read.parquet(f"{tmp_path}/ud").collect()} == {0.5, 0.25}


def test_written_lines_points_and_unflagged(spark, tmp_path):
    f = fixes(spark, [(h, h * 100, 0) for h in range(4)]).withColumns({"problem": F.when(F.col("x") == 100, 1).otherwise(0), "mortality_flag": F.lit(0)})
    seq = f.withColumns({"mig": F.lit("m"), "label": F.lit("Spring"), "bio_year": F.lit(2023)})
    sinks.write_mig_outputs(seq, f, str(tmp_path / "mig"))
    row = geojson.read_attributes(spark, str(tmp_path / "mig" / "lines"), ["mig", "wrr_date", "n_fixes"]).first()
    assert tuple(row) == ("m", "02-01", "4") and spark.read.parquet(str(tmp_path / "mig" / "points")).count() == 4
    assert sinks.write_flags_removed(f, str(tmp_path / "kept")) and spark.read.parquet(str(tmp_path / "kept")).count() == 3
    assert not sinks.write_flags_removed(f.where("problem = 1"), str(tmp_path / "none"))
    flat = sinks.flat_rows(spark.range(1).select(F.struct(F.lit(1).alias("a")).alias("s"), F.lit("x").alias("k"), F.create_map(F.lit("m"), F.lit(2)).alias("mm")))
    assert {tuple(r) for r in flat.collect()} == {("s", "a", "1"), ("", "k", "x"), ("mm", "m", '{"value":2}')}


def test_days_are_sampled_alike(spark):
    f = fixes(spark, [(h / 4, h, h) for h in range(400)]).withColumn("seq_id", F.lit("s"))
    got = [sorted(r["x"] for r in movement.sample_days(x, 5, 42).collect()) for x in (f, f.repartition(7))]
    assert got[0] == got[1] and len(got[0]) == 25 and got[0] != sorted(r["x"] for r in movement.sample_days(f, 5, 43).collect())


def test_snow_days_are_pruned(spark, tmp_path):
    spark.createDataFrame([(20240101 + i, 0, 0, 0.5, 0.1) for i in range(4)], "date int, row int, col int, depth double, swe double").write.partitionBy("date").parquet(str(tmp_path / "snow"))
    got = sources.read_snow(spark, str(tmp_path / "snow"), "20240102", "20240103")
    assert sorted(r["date"] for r in got.collect()) == ["20240102", "20240103"] and "PartitionFilters: [isnotnull" in got._jdf.queryExecution().executedPlan().toString()


def test_plans_hold_no_stale_rows(spark, tmp_path):
    """A query over a table that was written anew gives the new rows."""
    import shutil

    from trailgrid.plans import queries

    for name in ("events",):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    before = queries.pop_grid(spark, str(tmp_path)).first()
    small = spark.read.parquet(f"{tmp_path}/events.parquet").where("user_id % 2 = 0").toPandas()
    small["ts"] = small["ts"].astype("datetime64[us]")
    small.to_parquet(tmp_path / "events.parquet")
    assert queries.pop_grid(spark, str(tmp_path)).first() != before


def test_report_tables(spark):
    rows = [("Spring", 2024, "a", T0, T0 + dt.timedelta(days=3), 3.0, 1.0, 2.0, 2.0), ("Fall", 2024, "b", T0, T0 + dt.timedelta(days=5), 5.0, 1.0, 4.0, 2.0)]
    trips = spark.createDataFrame(rows, "season string, bio_year int, animal_id string, start_date timestamp_ntz, end_date timestamp_ntz, days double, eucl_km double, cumu_km double, maxpair_km double")
    assert {r["season"]: r["n_sequences"] for r in report.season_rollup(trips).collect()} == {"Spring": 1, "Fall": 1, "all": 2}
    assert report.season_summary(trips).count() == 2 and "Spring" in sinks.text_report(report.season_summary(trips))
    assert report.sequences_matrix(report.sequences_summary(trips)).columns[2:] == ["2024", "All_Years"]


def test_herd_row_takes_its_inputs_once(spark):
    """The herd's row works fixes and trips out once, however many of its figures need them."""
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counted(df, acc):
        return df.withColumn("animal_id", F.udf(lambda a: acc.add(1) or a)("animal_id"))

    f = fixes(spark, [(h, h, h) for h in range(10)]).withColumns({"fix_rate_hours": F.lit(1.0), "Sex": F.lit("F")})
    trips = spark.createDataFrame([("a", s, T0, T0 + dt.timedelta(days=k), float(k), 1.0 * k, 2.0, 3.0) for k, s in enumerate(["Spring", "Spring", "Fall"], 1)], "animal_id string, season string, start_date timestamp_ntz, end_date timestamp_ntz, days double, eucl_km double, cumu_km double, maxpair_km double")
    row = report.herd_metadata(counted(f, seen[0]), counted(trips, seen[1]), spark.range(1).select(F.lit("D").alias("herd_id"))).first()
    assert [a.value for a in seen] == [10, 3]
    assert (row["num_ind"], row["n_female"], row["median_hours"]) == (1, 1, 1.0) and row["seasons"]["Spring"]["n_sequences"] == 2
    assert row["seasons"]["all"]["mean_days"] == 2.0 and row["seasons"]["Fall"]["median_end"] == "01/04"


def test_stream_steps_and_bursts(spark, tmp_path):
    from trailgrid.streaming import fixes as stream

    rows = fixes(spark, [(0, 0, 0), (1, 0, 3600), (60, 0, 0), (60, 0, 0)]).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("steps", stream.steps(source), "append"), ("bursts", stream.burst_sessions(source), "complete"), ("dedup", stream.deduplicated(source), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [r["speed"] for r in spark.table("steps").orderBy("timestamp").collect()] == [None, 1.0, None]
    assert sorted(r["n_fixes"] for r in spark.table("bursts").collect()) == [2, 2]
    assert spark.table("dedup").count() == 3


@pytest.mark.parametrize("name", ["animal_summary", "extract_sequences", "asof_nearest", "population_use_area"])
def test_queries_match_sql(spark, tables, name):
    import duckdb

    from trailgrid.plans import queries as q

    con = duckdb.connect()
    for t in ("events", "orders", "nation"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    ours = q.QUERIES[name](spark, tables).toPandas()
    theirs = con.execute(q.ORACLES[name]).df()[list(ours.columns)]
    both = [sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist())) for df in (ours, theirs)]
    assert both[0] == both[1]


def test_one_exchange_serves_the_chain(spark):
    from trailgrid.plans.process import measure

    rows = fixes(spark, [(0, 0, 0), (1, 5, 5)]).withColumns({"lon": F.lit(-108.0), "lat": F.lit(39.0)})
    plan = measure(rows)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # the fixes' own exchange, the one of the branch that counts bursts, and those of one row an animal
    assert sum("REPARTITION_BY_COL" in line for line in exchanges) <= 2 and all("hashpartitioning(animal_id#" in line or "hashpartitioning(_a#" in line for line in exchanges)


def test_id_map_takes_every_serial(spark, tmp_path):
    from trailgrid.plans import queries

    spark.createDataFrame([(4321,), (77,)], "user_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(4321,), (9771,)], "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {tuple(r) for r in queries.substring_id_map(spark, str(tmp_path)).collect()} == {("4321", "4321"), ("77", "9771")}
