"""Fixes as a stream: duplicates, burst sessions and steps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """The first arrival of each animal and time within the watermark."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["animal_id", "timestamp"])


def burst_sessions(stream: DataFrame, gap: str = "49 hours", delay: str = "2 hours") -> DataFrame:
    """``animal_id, start, end, n_fixes`` of each burst; a fix exactly ``gap`` later still belongs to it."""
    s = stream.withWatermark("timestamp", delay).groupBy("animal_id", F.session_window("timestamp", gap))
    return s.agg(F.count(F.lit(1)).alias("n_fixes"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end")).drop("session_window")


STEP = "animal_id string, timestamp timestamp, dist double, dt double, speed double, abs_angle double, rel_angle double"
_STATE = "t double, x double, y double, angle double"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, tmax: float) -> Iterator[pd.DataFrame]:
    t0, x0, y0, a0 = state.get if state.exists else (math.nan,) * 4
    rows = pd.concat(list(frames)).sort_values("timestamp", kind="stable")
    out = []
    for time, x, y in zip(rows["timestamp"], rows["x"], rows["y"], strict=True):
        t = time.timestamp()
        if t <= t0:
            continue  # older than what has been passed: late fixes are the batch plan's
        dt = t - t0
        if not dt <= tmax:
            out.append((key[0], time, None, None, None, None, None))
            angle = math.nan
        else:
            angle = math.degrees(math.atan2(x - x0, y - y0)) % 360
            turn = None if math.isnan(a0) else (angle - a0 + 180) % 360 - 180
            dist = math.hypot(x - x0, y - y0)
            out.append((key[0], time, dist, dt, dist / dt, angle, turn))
        t0, x0, y0, a0 = t, x, y, angle
    state.update((t0, x0, y0, a0))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in STEP.split(", ")])


def steps(stream: DataFrame, tmax_seconds: float = 176400) -> DataFrame:
    """Step metrics from the fix before, kept per animal; the first fix of a burst has none."""
    return stream.select("animal_id", "timestamp", "x", "y").groupBy("animal_id").applyInPandasWithState(lambda k, f, s: _step(k, f, s, tmax_seconds), STEP, _STATE, "append", GroupStateTimeout.NoTimeout)
