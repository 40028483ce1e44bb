"""The processing plan: raw columns to cleaned, measured and flagged fixes, as one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import ProcessConfig
from ..operators import ingest, movement


def standardise(raw: DataFrame, cfg: ProcessConfig = ProcessConfig()) -> DataFrame:
    """Columns resolved, bad positions and missing times dropped, coordinates and timestamps typed."""
    df = ingest.remap_columns(raw)
    cfg_lon, cfg_lat = (ingest.reconcile(c, raw.columns, df.columns) for c in (cfg.lon_col, cfg.lat_col))
    df = ingest.with_standard_names(ingest.with_timestamp(df, cfg), cfg)
    for name, own in (("lon", cfg_lon), ("lat", cfg_lat)):
        if name not in df.columns and own in df.columns:
            df = df.withColumnRenamed(own, name)
    df = ingest.with_coordinates(df)
    return ingest.drop_null_times(ingest.quality_filter(df, cfg.projected))


def measure(fixes: DataFrame, cfg: ProcessConfig = ProcessConfig(), order: str | None = None) -> DataFrame:
    """Duplicates dropped; bursts, steps, keys, three NSDs and flags added.

    Every window is keyed by the animal and a function of its row, so the
    exchange of the first serves them all.
    """
    df = ingest.deduplicate(fixes.repartition("animal_id"), order)  # one exchange for all that follows
    df = movement.with_steps(movement.with_burst(df, cfg.tmax_seconds))
    df = ingest.with_keys(df, cfg.bio_year_start)
    for keys, suffix in ((["animal_id", "year"], "id_yr"), (["animal_id"], "animal_id"), (["animal_id", "bio_year"], "id_bio_year")):
        df = movement.with_nsd(df, keys, suffix, cfg.n_ref_points)
    df = movement.with_problems(df, cfg.max_speed_kmh, cfg.dop_cutoff, cfg.sat_cutoff, cfg.dop_col, cfg.sat_col)
    return movement.with_mortality(df, cfg.mort_distance_m, cfg.mort_time_hours)


def process(raw: DataFrame, cfg: ProcessConfig = ProcessConfig(), order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The measured fixes, and one row ``herd_id, project`` for naming."""
    standard = standardise(raw, cfg)
    names = ingest.herd_id(standard, override=cfg.herd_id).crossJoin(ingest.project_name(standard, "timestamp"))  # one row each
    return measure(standard, cfg, order), names
