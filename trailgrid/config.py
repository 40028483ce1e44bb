"""Settings of the processing and modelling plans; ``None`` leaves a check out, 0 is taken literally."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ProcessConfig:
    # fixed values: column names and thresholds of the collar data's standard naming
    animal_id_col: str = "LoclAID"
    timestamp_col: str | tuple[str, ...] = "DT_MST"
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss"
    lon_col: str = "Long"
    lat_col: str = "Lat"
    utme_col: str = "UTME"
    utmn_col: str = "UTMN"
    utm_zone_col: str = "UTM_Zn"
    dop_col: str = "DOP"
    sat_col: str = "NumSats"
    tmax_seconds: float = 176400
    n_ref_points: int = 20
    bio_year_start: tuple[int, int] = (2, 1)
    max_speed_kmh: float | None = 10.8
    mort_distance_m: float | None = 50
    mort_time_hours: float | None = 48
    dop_cutoff: float | None = 10
    sat_cutoff: float | None = 6
    projected: bool = False
    herd_id: str | None = None


@dataclass(frozen=True)
class ModelConfig:
    """Settings of the utilisation-distribution models."""

    # fixed values: published defaults of the movement models
    method: str = "BBMM"
    mult4buff: float = 0.3
    cell_size: float = 250
    time_step: float = 5
    bm_var: float | None = None
    location_error: float = 20
    max_lag_hours: float = 8
    contour: float = 99
    dbbmm_margin: int = 3
    dbbmm_window: int = 11
    info_criteria: str = "AIC"
    smooth_param: float | None = None
    subsample: int | None = None
    subsample_seed: int = 42
    buff_distance: float = 300
    bm_var_fix_rate_threshold_hours: float | None = None
    extra: dict = field(default_factory=dict)


METHODS = ("BBMM", "CTMM", "DBBMM", "KERNEL", "LINEBUFF", "LINEBUFFER")


def model_config(method: str = "BBMM", fix_rate_hours: float | None = None, **changes) -> ModelConfig:
    """Settings for a method; fixes more than 12 hours apart force the motion variance to 1000."""
    name = method.upper()
    if name not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    coarse = fix_rate_hours is not None and fix_rate_hours > 12
    return ModelConfig(**({"method": "LINEBUFF" if name == "LINEBUFFER" else name, "bm_var": 1000.0 if coarse else None} | changes))
