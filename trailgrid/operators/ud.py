"""Utilisation distributions (UDs) as sparse grids ``seq_id, row, col, density``.

A cell without density has no row.  The grid is a small frozen object.  Models
are numpy per sequence, spread over the cluster; ``kernel_sql`` and
``bridge_sql`` state the same sums relationally.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ModelConfig
from ..functions import geo, temporal
from .grouped import map_groups
from .movement import sample_days

UD = "seq_id string, row int, col int, density double"
KEEP = 0.9999


@dataclass(frozen=True)
class Grid:
    """Cells counted from the upper left corner; cells are stretched to fill the box exactly."""

    minx: float
    miny: float
    maxx: float
    maxy: float
    nrows: int
    ncols: int
    cell_size: float
    srid: int | None = None

    @property
    def px_w(self) -> float:
        return (self.maxx - self.minx) / self.ncols

    @property
    def px_h(self) -> float:
        return (self.maxy - self.miny) / self.nrows

    @property
    def cell_km2(self) -> float:
        return self.px_w * self.px_h / 1e6

    def centre(self, row, col):
        return self.minx + (col + 0.5) * self.px_w, self.maxy - (row + 0.5) * self.px_h


def grid_table(points: DataFrame, cell_size: float = 250, buffer_mult: float = 0.3) -> DataFrame:
    """One row: the box of all points, widened by ``buffer_mult`` of each side, in whole cells."""
    box = points.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    dx, dy = (F.col("b") - F.col("a")) * buffer_mult, (F.col("d") - F.col("c")) * buffer_mult
    wide = box.select((F.col("a") - dx).alias("minx"), (F.col("c") - dy).alias("miny"), (F.col("b") + dx).alias("maxx"), (F.col("d") + dy).alias("maxy"))
    n = {"nrows": ("maxy", "miny"), "ncols": ("maxx", "minx")}
    return wide.select("*", *[F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo)) / cell_size)).cast("int").alias(k) for k, (hi, lo) in n.items()], F.lit(float(cell_size)).alias("cell_size"))


def make_grid(points: DataFrame, cell_size: float = 250, buffer_mult: float = 0.3, srid: int | None = None) -> Grid:
    row = grid_table(points, cell_size, buffer_mult).first()
    if row["minx"] is None:
        raise ValueError("a grid needs points")
    box = row.asDict()
    if box["maxx"] <= box["minx"]:
        box |= {"minx": box["minx"] - cell_size / 2, "maxx": box["maxx"] + cell_size / 2}
    if box["maxy"] <= box["miny"]:
        box |= {"miny": box["miny"] - cell_size / 2, "maxy": box["maxy"] + cell_size / 2}
    return Grid(**box, srid=srid)


def sub_grid(grid: Grid, x: np.ndarray, y: np.ndarray, mult: float) -> tuple[int, int, int, int]:
    """Rows and columns [r0, r1) x [c0, c1) that a sequence's widened box covers; one cell at least."""
    dx, dy = np.ptp(x) * mult, np.ptp(y) * mult
    c0, c1 = math.floor((x.min() - dx - grid.minx) / grid.px_w), math.ceil((x.max() + dx - grid.minx) / grid.px_w)
    r0, r1 = math.floor((grid.maxy - y.max() - dy) / grid.px_h), math.ceil((grid.maxy - y.min() + dy) / grid.px_h)
    r0, c0 = min(max(r0, 0), grid.nrows - 1), min(max(c0, 0), grid.ncols - 1)
    return r0, max(r0 + 1, min(r1, grid.nrows)), c0, max(c0 + 1, min(c1, grid.ncols))


def silverman(x: np.ndarray, y: np.ndarray) -> float:
    """The reference bandwidth sqrt((var x + var y) / 2) n^(-1/6)."""
    return math.sqrt((x.var(ddof=1) + y.var(ddof=1)) / 2) * len(x) ** (-1 / 6)


def _gauss(gx: np.ndarray, gy: np.ndarray, x: np.ndarray, y: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Sum of circular normal densities at the cell centres: the two axes separate, so it is a matrix product."""
    out = np.zeros((len(gy), len(gx)))
    for i in range(0, len(x), 4096):
        v = var[i : i + 4096, None]
        ex = np.exp(-((gx[None] - x[i : i + 4096, None]) ** 2) / (2 * v)) / (2 * np.pi * v)
        out += np.exp(-((gy[None] - y[i : i + 4096, None]) ** 2) / (2 * v)).T @ ex
    return out


def cut_tail(density: np.ndarray, keep: float = KEEP) -> np.ndarray:
    """Normal to 1; cells below the value at which the running sum first exceeds ``keep`` go; normal again."""
    total = density.sum()
    if not total > 0:
        return density * 0
    density = density / total
    down = np.sort(density.ravel())[::-1]
    over = np.flatnonzero(np.cumsum(down) > keep)
    if len(over):
        density = np.where(density < down[over[0]], 0.0, density)
    return density / density.sum()


def minimise(f, low: float, high: float, tolerance: float = 1e-5, most: int = 500) -> float:
    """Least point of a function of one variable: golden sections of the logarithm, then of the last bracket."""
    ratio = (math.sqrt(5) - 1) / 2

    def golden(g, a: float, b: float, tol: float) -> float:
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        fc, fd = g(c), g(d)
        for _ in range(most):
            if abs(b - a) < tol:
                break
            if fc < fd:
                b, d, fd = d, c, fc
                c = b - ratio * (b - a)
                fc = g(c)
            else:
                a, c, fc = c, d, fd
                d = a + ratio * (b - a)
                fd = g(d)
        return (a + b) / 2

    scale = np.linspace(math.log(low), math.log(high), 60)
    best = int(np.argmin([f(math.exp(s)) for s in scale]))
    return math.exp(golden(lambda s: f(math.exp(s)), scale[max(0, best - 1)], scale[min(59, best + 1)], tolerance))


def _triplets(x: np.ndarray, y: np.ndarray, lag: np.ndarray, error: float, max_lag: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each middle fix: is it used, its squared distance from the chord, the noise and the factor of the variance there."""
    a, b = lag[:-1], lag[1:]
    use = (a > 0) & (b > 0) & (a <= max_lag) & (b <= max_lag)
    total = np.where(use, a + b, 1.0)
    alpha = np.where(use, a, 0.5) / total
    sq = sum((v[1:-1] - v[:-2] - alpha * (v[2:] - v[:-2])) ** 2 for v in (x, y))
    return use, sq, ((1 - alpha) ** 2 + 1 + alpha**2) * error**2, total * alpha * (1 - alpha)


def motion_variance(x: np.ndarray, y: np.ndarray, lag: np.ndarray, error: float, max_lag: float) -> float:
    """Maximum-likelihood Brownian motion variance from the middle fixes of triplets; lags in minutes."""
    use, sq, noise, slope = _triplets(x, y, lag, error, max_lag)
    if not use.any():
        raise ValueError("no valid triplets for variance estimation")
    sq, noise, slope = sq[use], noise[use], slope[use]
    return minimise(lambda s: float(np.sum(np.log(slope * s + noise) + sq / (2 * (slope * s + noise)))), 1e-6, 1e9)


def dynamic_variance(x: np.ndarray, y: np.ndarray, lag: np.ndarray, error: float, max_lag: float, window: int, margin: int) -> np.ndarray:
    """A motion variance for each segment: the mean over the sliding windows whose inner part holds it.

    The search of ``minimise`` runs for all windows at once.
    """
    n = len(x) - 1
    use, sq, noise, slope = (np.lib.stride_tricks.sliding_window_view(v, window - 2) for v in _triplets(x, y, lag, error, max_lag))
    good = np.flatnonzero(use.any(1))
    use, sq, noise, slope = (v[good] for v in (use, sq, noise, slope))

    def cost(s: np.ndarray) -> np.ndarray:
        v = slope * s[:, None] + noise
        return np.where(use, np.log(v) + sq / (2 * v), 0.0).sum(1)

    scale = np.linspace(math.log(1e-6), math.log(1e9), 60)
    best = np.argmin(np.stack([cost(np.full(len(good), math.exp(s))) for s in scale], axis=1), axis=1) if len(good) else np.empty(0, int)
    ratio, a, b = (math.sqrt(5) - 1) / 2, scale[np.maximum(best - 1, 0)], scale[np.minimum(best + 1, 59)]
    while len(good) and (b - a).max() >= 1e-5:
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        left = cost(np.exp(c)) < cost(np.exp(d))
        a, b = np.where(left, a, c), np.where(left, d, b)
    found = np.exp((a + b) / 2)
    total, count = np.zeros(n), np.zeros(n)
    for k in range(margin - 1, window - margin):  # the segments of a window's inner part
        np.add.at(total, good + k, found)
        np.add.at(count, good + k, 1)
    whole = motion_variance(x, y, lag, error, max_lag)
    return np.where(count > 0, total / np.maximum(count, 1), whole)


def bridge(grid: Grid, box: tuple[int, int, int, int], x: np.ndarray, y: np.ndarray, lag: np.ndarray, var, error: float, max_lag: float, step: float) -> np.ndarray:
    """Sum of the bridges' densities over steps of ``step`` minutes of every segment no longer than ``max_lag``."""
    px, py, pv = [], [], []
    var = np.broadcast_to(var, len(lag))
    for i in np.flatnonzero((lag > 0) & (lag <= max_lag)):
        a = np.minimum(np.arange(math.floor(lag[i] / step) + 1) * step / lag[i], 1.0)
        px.append(x[i] + a * (x[i + 1] - x[i]))
        py.append(y[i] + a * (y[i + 1] - y[i]))
        pv.append(lag[i] * a * (1 - a) * var[i] + ((1 - a) ** 2 + a**2) * error**2)
    r0, r1, c0, c1 = box
    gx, gy = grid.minx + (np.arange(c0, c1) + 0.5) * grid.px_w, grid.maxy - (np.arange(r0, r1) + 0.5) * grid.px_h
    if not px:
        return np.zeros((len(gy), len(gx)))
    px, py, pv = np.concatenate(px), np.concatenate(py), np.concatenate(pv)
    return _gauss(gx, gy, px[pv > 0], py[pv > 0], pv[pv > 0])


def _line(grid: Grid, x: np.ndarray, y: np.ndarray, distance: float) -> np.ndarray:
    """Rows (row, col) of cells whose centre lies within ``distance`` of the path (of the fix, if there is one)."""
    cells: set[tuple[int, int]] = set()
    if len(x) == 1:
        x, y = np.repeat(x, 2), np.repeat(y, 2)
    for i in range(len(x) - 1):
        c0, c1 = (math.floor((v - grid.minx) / grid.px_w) for v in (min(x[i], x[i + 1]) - distance, max(x[i], x[i + 1]) + distance))
        r0, r1 = (math.floor((grid.maxy - v) / grid.px_h) for v in (max(y[i], y[i + 1]) + distance, min(y[i], y[i + 1]) - distance))
        rows, cols = np.arange(max(r0, 0), min(r1, grid.nrows - 1) + 1), np.arange(max(c0, 0), min(c1, grid.ncols - 1) + 1)
        if not len(rows) or not len(cols):
            continue
        gx, gy = grid.centre(rows[:, None], cols[None])
        dx, dy = x[i + 1] - x[i], y[i + 1] - y[i]
        length = dx * dx + dy * dy
        t = np.clip(((gx - x[i]) * dx + (gy - y[i]) * dy) / length, 0, 1) if length > 0 else 0.0
        r, c = np.nonzero((gx - x[i] - t * dx) ** 2 + (gy - y[i] - t * dy) ** 2 <= distance**2)
        cells.update(zip(rows[r].tolist(), cols[c].tolist(), strict=True))
    return np.array(sorted(cells), int).reshape(-1, 2)


RESULT = "seq_id string, kind string, row int, col int, density double, n_fixes int, n_doy int, bandwidth double, bm_var double, variance_mode string, method string, errors string"


def run_one(seq_id: str, x: np.ndarray, y: np.ndarray, time: np.ndarray, grid: Grid, cfg: ModelConfig) -> dict[str, np.ndarray | list]:
    """Columns of ``RESULT``: a sequence's UD cells (kind ``ud``) and one ``meta`` row; a failure is its row's ``errors``."""
    meta = {"n_fixes": len(x), "n_doy": len(np.unique(time.astype("datetime64[D]") - time.astype("datetime64[Y]"))), "bandwidth": None, "bm_var": None, "variance_mode": None, "method": cfg.method, "errors": ""}
    cells = np.empty((0, 2), int)
    values = np.empty(0)
    try:
        method = {"CTMM": "KERNEL"}.get(cfg.method, cfg.method)
        if method != cfg.method:
            meta["method"] = f"{cfg.method} as {method}"
        if method == "LINEBUFF":
            cells = _line(grid, x, y, cfg.buff_distance)
            values = np.full(len(cells), 1 / max(1, len(cells)))
            if len(x) < 2:
                meta["errors"] = "fewer than 2 fixes: a disc around one"
        else:
            box = sub_grid(grid, x, y, cfg.mult4buff)
            if method == "KERNEL":
                if len(x) < 5:
                    raise ValueError("fewer than 5 fixes")
                h = meta["bandwidth"] = cfg.smooth_param or silverman(x, y)
                if not (h > 0 and math.isfinite(h)):
                    raise ValueError("the bandwidth isn't positive")
                r0, r1, c0, c1 = box
                gx, gy = grid.minx + (np.arange(c0, c1) + 0.5) * grid.px_w, grid.maxy - (np.arange(r0, r1) + 0.5) * grid.px_h
                dense = _gauss(gx, gy, x, y, np.full(len(x), h * h)) / len(x)
            else:
                dense = _bbmm(x, y, np.diff(time) / np.timedelta64(60_000_000, "us"), grid, box, cfg, meta)
            dense = cut_tail(dense)
            cells = np.argwhere(dense > 0)
            values = dense[tuple(cells.T)]
            cells = cells + [box[0], box[2]]
            if not len(cells):
                raise ValueError("no density on the grid")
    except Exception as error:  # noqa: BLE001  one sequence's failure is its row
        meta["errors"] = str(error) or type(error).__name__
        cells, values = np.empty((0, 2), int), np.empty(0)
    n = len(cells)
    out = {"seq_id": [seq_id] * (n + 1), "kind": ["ud"] * n + ["meta"], "row": [*cells[:, 0].tolist(), None], "col": [*cells[:, 1].tolist(), None], "density": np.r_[values, np.nan]}
    return out | {k: [None] * n + [v] for k, v in meta.items()}


def _bbmm(x, y, lag, grid, box, cfg: ModelConfig, meta: dict) -> np.ndarray:
    if len(x) < 4:
        raise ValueError("fewer than 4 fixes")
    max_lag = cfg.max_lag_hours * 60
    if (lag > max_lag).mean() > 1 / 3:
        raise ValueError("over a third of the gaps exceed the longest lag")
    if cfg.method == "DBBMM" and len(x) >= cfg.dbbmm_window and cfg.bm_var is None:
        var = dynamic_variance(x, y, lag, cfg.location_error, max_lag, cfg.dbbmm_window, cfg.dbbmm_margin)
        meta |= {"variance_mode": "dynamic", "bm_var": float(np.mean(var))}
    else:
        limit = cfg.bm_var_fix_rate_threshold_hours
        forced = cfg.bm_var is not None and (limit is None or float(np.median(lag)) / 60 > limit)
        var = cfg.bm_var if forced else motion_variance(x, y, lag, cfg.location_error, max_lag)
        meta |= {"variance_mode": ("conditional forced" if limit is not None else "forced") if forced else "estimated", "bm_var": float(var)}
        if cfg.method == "DBBMM":
            meta["method"] = "DBBMM as BBMM"
    return bridge(grid, box, x, y, lag, var, cfg.location_error, max_lag, cfg.time_step)


def run_sequences(seq: DataFrame, grid: Grid, cfg: ModelConfig, key: str = "mig") -> DataFrame:
    """Model every sequence; rows of ``RESULT``.  Sequences run in parallel tasks, failures don't stop others."""
    rows = seq.select(F.col(key).alias("seq_id"), "timestamp", F.col("x").cast("double"), F.col("y").cast("double")).where("x is not null and y is not null")
    if cfg.subsample:
        rows = sample_days(rows, cfg.subsample, cfg.subsample_seed)
    rows = rows.withColumn("t", temporal.micros(F.col("timestamp"))).drop("timestamp")
    return map_groups(rows, "seq_id", ["t"], lambda k, c: run_one(k, c["x"], c["y"], c["t"].astype("datetime64[us]"), grid, cfg), RESULT)


def ud_cells(results: DataFrame) -> DataFrame:
    return results.where("kind = 'ud'").select("seq_id", "row", "col", "density")


def ud_metadata(results: DataFrame) -> DataFrame:
    return results.where("kind = 'meta'").drop("kind", "row", "col", "density")


def valid_uds(results: DataFrame) -> DataFrame:
    """Cells of sequences without an error text."""
    good = ud_metadata(results).where(F.coalesce("errors", F.lit("")).isin("", "None")).select("seq_id")
    return ud_cells(results).join(good, "seq_id", "left_semi")


def _mass(keys: list[str], value: str) -> tuple[Column, Column]:
    """Running sum from the greatest value down (ties by cell) and the total, of each UD."""
    w = Window.partitionBy(*keys)
    return F.sum(value).over(w.orderBy(F.desc(value), "row", "col").rowsBetween(Window.unboundedPreceding, 0)), F.sum(value).over(w)


def tail_cut(ud: DataFrame, keep: float = KEEP, keys: tuple[str, ...] = ("seq_id",), renormalise: bool = True) -> DataFrame:
    """The cells at or above the density where the running share first exceeds ``keep``; ties stay."""
    w = Window.partitionBy(*keys)
    run, total = _mass(list(keys), "density")
    ranked = ud.where("density > 0").withColumns({"_run": run / total, "_total": total})
    cutoff = F.max(F.when(F.col("_run") > keep, F.col("density"))).over(w)
    kept = ranked.withColumn("_cut", cutoff).where("_cut is null or density >= _cut").drop("_run", "_cut")
    return kept.withColumn("density", F.col("density") / (F.sum("density").over(w) if renormalise else F.col("_total"))).drop("_total")


def footprint(ud: DataFrame, contour: float = 99, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """Cells of the contour's share of use."""
    return tail_cut(ud, contour / 100, keys, renormalise=False).select(*keys, "row", "col")


def contour_cells(ud: DataFrame, contour: float, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """Cells up to and with the one that reaches the contour's share."""
    run, total = _mass(list(keys), "density")
    return ud.withColumns({"_run": run, "_total": total}).where((F.col("_run") - F.col("density")) / F.col("_total") < contour / 100).select(*keys, "row", "col")


def cells_of(box: DataFrame) -> DataFrame:
    """Rows ``r0..r1`` and ``c0..c1`` (ends included) become one row a cell."""
    return box.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1"))).drop("r0", "r1", "c0", "c1")


def boxes(seq: DataFrame, grid: Grid, mult: float, key: str = "seq_id") -> DataFrame:
    """Each sequence's sub-grid as ``r0, r1, c0, c1`` (ends included)."""
    b = seq.groupBy(key).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    dx, dy = (F.col("b") - F.col("a")) * mult, (F.col("d") - F.col("c")) * mult
    c0, c1 = F.floor((F.col("a") - dx - grid.minx) / grid.px_w), F.ceil((F.col("b") + dx - grid.minx) / grid.px_w) - 1
    r0, r1 = F.floor((grid.maxy - F.col("d") - dy) / grid.px_h), F.ceil((grid.maxy - F.col("c") + dy) / grid.px_h) - 1

    def clamp(v: Column, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("int")

    out = b.select(key, clamp(r0, grid.nrows).alias("r0"), clamp(r1, grid.nrows).alias("r1"), clamp(c0, grid.ncols).alias("c0"), clamp(c1, grid.ncols).alias("c1"))
    return out.withColumns({"r1": F.greatest("r0", "r1"), "c1": F.greatest("c0", "c1")})


def _centre(grid: Grid) -> tuple[Column, Column]:
    return F.lit(grid.minx) + (F.col("col") + 0.5) * grid.px_w, F.lit(grid.maxy) - (F.col("row") + 0.5) * grid.px_h


def kernel_sql(seq: DataFrame, grid: Grid, smooth: float | None = None, mult: float = 0.3) -> DataFrame:
    """The kernel UD as a join of fixes and cells of one sequence; for small grids.

    Fixes meet their sequence's box, a row a sequence, and only then its cells: a
    planner that takes the cells for as small as their boxes would broadcast them.
    """
    h = F.lit(float(smooth)) if smooth else F.sqrt((F.var_samp("x") + F.var_samp("y")) / 2) * F.pow(F.count(F.lit(1)), F.lit(-1 / 6))
    stats = seq.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), h.alias("h")).where("n >= 5 and h > 0")
    box = boxes(seq, grid, mult).join(stats, "seq_id")
    gx, gy = _centre(grid)
    d2 = (gx - F.col("x")) * (gx - F.col("x")) + (gy - F.col("y")) * (gy - F.col("y"))
    term = F.exp(-d2 / (2 * F.col("h") * F.col("h"))) / (2 * math.pi * F.col("h") * F.col("h") * F.col("n"))
    return cells_of(seq.select("seq_id", "x", "y").join(box, "seq_id")).groupBy("seq_id", "row", "col").agg(F.sum(term).alias("density"))


def bridge_steps(seq: DataFrame, bm_var: float, error: float = 20, max_lag_hours: float = 8, step: float = 5) -> DataFrame:
    """``seq_id, mx, my, var`` of every time step of every bridge."""
    w = Window.partitionBy("seq_id").orderBy("timestamp")
    seg = seq.select("seq_id", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), (temporal.seconds_between(F.col("timestamp"), F.lead("timestamp").over(w)) / 60).alias("lag"))
    seg = seg.where((F.col("lag") > 0) & (F.col("lag") <= max_lag_hours * 60)).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("lag") / step).cast("int"))))
    seg = seg.withColumn("a", F.least(F.lit(1.0), F.col("k") * step / F.col("lag")))
    var = F.col("lag") * F.col("a") * (1 - F.col("a")) * bm_var + ((1 - F.col("a")) * (1 - F.col("a")) + F.col("a") * F.col("a")) * error**2
    return seg.select("seq_id", (F.col("x") + F.col("a") * (F.col("x2") - F.col("x"))).alias("mx"), (F.col("y") + F.col("a") * (F.col("y2") - F.col("y"))).alias("my"), var.alias("var")).where("var > 0")


def bridge_sql(seq: DataFrame, grid: Grid, bm_var: float, error: float = 20, max_lag_hours: float = 8, step: float = 5, mult: float = 0.3) -> DataFrame:
    """The Brownian bridge UD, normal to 1, as a join of steps and cells of one sequence; for small grids.

    Steps meet boxes before cells, as in ``kernel_sql``.
    """
    gx, gy = _centre(grid)
    d2 = (gx - F.col("mx")) * (gx - F.col("mx")) + (gy - F.col("my")) * (gy - F.col("my"))
    steps = bridge_steps(seq, bm_var, error, max_lag_hours, step)
    raw = cells_of(steps.join(boxes(seq, grid, mult), "seq_id")).groupBy("seq_id", "row", "col").agg(F.sum(F.exp(-d2 / (2 * F.col("var"))) / (2 * math.pi * F.col("var"))).alias("density"))
    return raw.withColumn("density", F.col("density") / F.sum("density").over(Window.partitionBy("seq_id")))


def line_buffer(seq: DataFrame, grid: Grid, distance: float = 300, key: str = "seq_id") -> DataFrame:
    """``key, row, col``: cells whose centre lies within ``distance`` of the path; each segment meets the cells of its own box only."""
    w = Window.partitionBy(key).orderBy("timestamp")
    seg = seq.select(key, "x", "y", F.coalesce(F.lead("x").over(w), F.when(F.count(F.lit(1)).over(Window.partitionBy(key)) == 1, F.col("x"))).alias("x2"), F.coalesce(F.lead("y").over(w), F.when(F.count(F.lit(1)).over(Window.partitionBy(key)) == 1, F.col("y"))).alias("y2")).where("x2 is not null")

    def span(lo: Column, hi: Column, n: int, a: str, b: str) -> DataFrame:
        return {a: F.greatest(F.lit(0), F.floor(lo)).cast("int"), b: F.least(F.lit(n - 1), F.floor(hi)).cast("int")}

    seg = seg.withColumns(
        span((F.least("x", "x2") - distance - grid.minx) / grid.px_w, (F.greatest("x", "x2") + distance - grid.minx) / grid.px_w, grid.ncols, "c0", "c1")
        | span((grid.maxy - F.greatest("y", "y2") - distance) / grid.px_h, (grid.maxy - F.least("y", "y2") + distance) / grid.px_h, grid.nrows, "r0", "r1")
    ).where("r0 <= r1 and c0 <= c1")
    gx, gy = _centre(grid)
    near = geo.point_segment(gx, gy, F.col("x"), F.col("y"), F.col("x2"), F.col("y2")) <= distance
    return cells_of(seg).where(near).select(key, "row", "col").distinct()


def animal_line_buffer(seq: DataFrame, members: DataFrame, grid: Grid, distance: float = 200, key: str = "seq_id") -> DataFrame:
    """``animal_id, row, col``: the cells of all of an animal's sequences' buffers; sequences aren't joined to each other."""
    return line_buffer(seq, grid, distance, key).join(members.select(key, "animal_id"), key).select("animal_id", "row", "col").distinct()


def rasterise(polygons: DataFrame, grid: Grid, key: str = "id") -> DataFrame:
    """Cells whose centre lies inside a polygon: ``polygons`` has ``ring_no`` and ``ring``, an array of (x, y); even-odd rule."""
    n = F.size("ring")
    edges = polygons.select(key, F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("ring", i).alias("p"), F.get("ring", (i + 1) % n).alias("q")))).alias("e")).select(key, F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))
    box = edges.groupBy(key).agg(F.min("x1").alias("x"), F.max("x1").alias("xx"), F.min("y1").alias("y"), F.max("y1").alias("yy"))
    box = box.select(key, F.inline(F.array(F.struct(F.col("x"), F.col("y")), F.struct(F.col("xx").alias("x"), F.col("yy").alias("y")))))
    # an edge meets the rows of cell centres that it passes, and there the cells to its left
    passes = edges.where("y1 <> y2").withColumns({"r0": F.greatest(F.lit(0), F.ceil((grid.maxy - F.greatest("y1", "y2")) / grid.px_h - 0.5)).cast("int"), "r1": F.least(F.lit(grid.nrows - 1), F.ceil((grid.maxy - F.least("y1", "y2")) / grid.px_h - 0.5) - 1).cast("int")}).where("r0 <= r1").withColumn("row", F.explode(F.sequence("r0", "r1")))
    yc = F.lit(grid.maxy) - (F.col("row") + 0.5) * grid.px_h
    cross = passes.select(key, "row", (F.col("x1") + (yc - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))).alias("cx"))
    cells = cells_of(boxes(box, grid, 0.0, key))
    gx, _ = _centre(grid)
    return cells.join(cross, [key, "row"]).groupBy(key, "row", "col").agg(F.count_if(F.col("cx") > gx).alias("n")).where("n % 2 = 1").select(key, "row", "col")
