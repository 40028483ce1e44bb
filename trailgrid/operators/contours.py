"""From masks of cells to areas and outlines: 4-connected parts, holes, rings, smoothing.

Areas are exact sums of cells.  Masks are handled one at a time by numpy, in
parallel; a mask is a surface's cells, so it has the grid's size at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ud import Grid

#: fixed values: ratio of the kernel's deviation to its width, outline points, points of a side
KSMOOTH_SD, OUTLINE_POINTS, SIDE_POINTS = 0.3706506, 2500, 8


def label(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """A part number for every cell; cells that share a side share it.  Runs of a row are joined to those above."""
    if not len(row):
        return np.empty(0, int)
    order = np.lexsort((col, row))
    r, c = row[order], col[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)]
    run = np.cumsum(new) - 1
    parent = np.arange(run[-1] + 1)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    key = r.astype(np.int64) * (1 << 32) + c
    above = np.searchsorted(key, key - (1 << 32))
    hit = (above < len(key)) & (key[np.minimum(above, len(key) - 1)] == key - (1 << 32))
    for a, b in {(int(x), int(y)) for x, y in zip(run[hit], run[above[hit]], strict=True)}:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(parent))])
    out = np.empty(len(row), int)
    out[order] = np.unique(roots, return_inverse=True)[1][run]
    return out


def fill(row: np.ndarray, col: np.ndarray, most_cells: float) -> tuple[np.ndarray, np.ndarray]:
    """The cells with every enclosed hole of fewer than ``most_cells`` filled."""
    if not len(row):
        return row, col
    r0, c0 = row.min() - 1, col.min() - 1
    empty = np.ones((row.max() - r0 + 2, col.max() - c0 + 2), bool)
    empty[row - r0, col - c0] = False
    er, ec = np.nonzero(empty)
    part = label(er, ec)
    outside = part[0]  # the corner
    size = np.bincount(part)
    small = (size < most_cells) & (np.arange(len(size)) != outside)
    take = small[part]
    return np.r_[row, er[take] + r0], np.r_[col, ec[take] + c0]


def clean(row: np.ndarray, col: np.ndarray, cell_m2: float, drop_m2: float, fill_m2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts smaller than ``drop_m2`` go and holes smaller than ``fill_m2`` are filled: rows, columns, part numbers.

    If there are several parts and all are too small, all stay; a single one goes.
    """
    part = label(row, col)
    size = np.bincount(part) if len(part) else np.empty(0, int)
    large = size * cell_m2 >= drop_m2
    if len(size) > 1 and not large.any():
        large[:] = True
    keep = large[part] if len(part) else np.empty(0, bool)
    row, col = fill(row[keep], col[keep], fill_m2 / cell_m2)
    return row, col, label(row, col)


def components(cells: DataFrame, grid: Grid, keys: tuple[str, ...] = ("level",), drop_m2: float = 20000, fill_m2: float = 20000) -> DataFrame:
    """``keys, part, row, col`` of every mask's cleaned cells."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*keys).schema.fields)
    area = grid.px_w * grid.px_h

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row, col, part = clean(pdf["row"].to_numpy(), pdf["col"].to_numpy(), area, drop_m2, fill_m2)
        return pd.DataFrame(dict(zip(keys, key, strict=True)) | {"part": part.astype(np.int32), "row": row.astype(np.int32), "col": col.astype(np.int32)})

    return cells.select(*keys, "row", "col").distinct().groupBy(*keys).applyInPandas(one, f"{schema}, part int, row int, col int")


def areas(parts: DataFrame, grid: Grid, keys: tuple[str, ...] = ("level",)) -> DataFrame:
    """``keys, n_parts, n_cells, area_km2``."""
    return parts.groupBy(*keys).agg(F.countDistinct("part").alias("n_parts"), F.count(F.lit(1)).alias("n_cells"), (F.count(F.lit(1)) * grid.cell_km2).alias("area_km2"))


def rings(row: np.ndarray, col: np.ndarray) -> list[np.ndarray]:
    """Closed outlines of cells in grid corners (column, row), cells to the right; holes turn the other way."""
    cells = set(zip(row.tolist(), col.tolist(), strict=True))
    sides: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in cells:
        for (dr, dc), a, b in (((-1, 0), (c, r), (c + 1, r)), ((0, 1), (c + 1, r), (c + 1, r + 1)), ((1, 0), (c + 1, r + 1), (c, r + 1)), ((0, -1), (c, r + 1), (c, r))):
            if (r + dr, c + dc) not in cells:
                sides.setdefault(a, []).append(b)
    out = []
    while sides:
        start = min(sides)
        ring, at, came = [start], start, None
        while True:
            ways = sides[at]
            if len(ways) > 1 and came is not None:  # at a corner where parts touch turn right, so they stay apart
                ways.sort(key=lambda b: (came[0] * (b[1] - at[1]) - came[1] * (b[0] - at[0])), reverse=True)
            nxt = ways.pop(0)
            if not ways:
                del sides[at]
            came, at = (nxt[0] - at[0], nxt[1] - at[1]), nxt
            if at == start:
                break
            ring.append(at)
        points = np.array(ring)
        turn = (points != np.roll(points, 1, 0)).argmax(1) != (points != np.roll(points, -1, 0)).argmax(1)
        out.append(points[turn])
    return out


def ksmooth(ring: np.ndarray, smoothness: float) -> np.ndarray:
    """A closed ring smoothed by circular Gaussian regression along its length."""
    if smoothness <= 0 or len(ring) < 4:
        return ring
    per = int(max(1, min(SIDE_POINTS, -(-OUTLINE_POINTS // len(ring)))))
    nxt = np.roll(ring, -1, 0)
    t = np.arange(per)[None, :, None] / per
    dense = (ring[:, None] + (nxt - ring)[:, None] * t).reshape(-1, 2).astype(float)
    step = np.hypot(*(np.roll(dense, -1, 0) - dense).T)
    along, length = np.r_[0, np.cumsum(step)[:-1]], step.sum()
    sd = KSMOOTH_SD * smoothness * np.hypot(*(nxt - ring).T).mean()
    out = np.empty_like(dense)
    for i in range(0, len(dense), 256):
        gap = np.abs(along[i : i + 256, None] - along[None])
        w = np.exp(-(np.minimum(gap, length - gap) ** 2) / (2 * sd * sd))
        out[i : i + 256] = w @ dense / w.sum(1, keepdims=True)
    return out


def ring_area(ring: np.ndarray) -> float:
    x, y = ring.T
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def outlines(parts: DataFrame, grid: Grid, keys: tuple[str, ...] = ("level",), smoothness: float = 2) -> DataFrame:
    """``keys, part, ring_no, ring, ring_area_km2``: smoothed outlines in map coordinates."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*keys).schema.fields)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, ring in enumerate(rings(pdf["row"].to_numpy(), pdf["col"].to_numpy())):
            xy = ksmooth(np.stack([grid.minx + ring[:, 0] * grid.px_w, grid.maxy - ring[:, 1] * grid.px_h], 1), smoothness)
            out.append(dict(zip((*keys, "part"), key, strict=True)) | {"ring_no": k, "ring": [{"x": a, "y": b} for a, b in xy], "ring_area_km2": ring_area(xy) / 1e6})
        return pd.DataFrame(out)

    return parts.groupBy(*keys, "part").applyInPandas(one, f"{schema}, part int, ring_no int, ring array<struct<x:double,y:double>>, ring_area_km2 double")
