"""Herd surfaces from sequences' UDs: individuals, use, footprints, season products.

``ud``: ``seq_id, row, col, density``; ``members``: ``seq_id, animal_id,
bio_year, season`` (names, never parsed from keys).  Absent cells are zeros,
so means divide by the number of members, not of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import stored
from .ingest import exact_quantile


def normalise(ud: DataFrame, keys: list[str], value: str = "density") -> DataFrame:
    """Each surface's values over its sum; NaN and missing values are zeros."""
    clean = F.nanvl(F.coalesce(value, F.lit(0.0)), F.lit(0.0))
    total = F.sum(clean).over(Window.partitionBy(*keys))
    return ud.withColumn(value, F.when(total > 0, clean / total).otherwise(0.0)).where(F.col(value) > 0)


def mean_surface(ud: DataFrame, members: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """Mean of the ``unit`` surfaces of each ``by`` group, over all members of the group."""
    n = members.select(unit, *by).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else members.select(unit).distinct().agg(F.count(F.lit(1)).alias("_n"))
    cells = ud.groupBy(*by, "row", "col").agg(F.sum("density").alias("density"))
    out = cells.join(n, by) if by else cells.crossJoin(F.broadcast(n))  # one row
    return out.withColumn("density", F.col("density") / F.col("_n")).drop("_n")


def individual_ud(ud: DataFrame, members: DataFrame, by_season: bool = False) -> DataFrame:
    """One surface an animal (and season): the normal mean of its sequences' normal surfaces."""
    by = ["animal_id", "season"] if by_season else ["animal_id"]
    named = normalise(ud, ["seq_id"]).join(members.select("seq_id", *by), "seq_id")
    used = members.join(ud.select("seq_id").distinct(), "seq_id", "left_semi")
    return normalise(mean_surface(named, used, "seq_id", by), by).select(*by, "row", "col", "density")


def individual_footprint(cells: DataFrame, members: DataFrame, by_season: bool = False) -> DataFrame:
    """Cells of any of an animal's (and season's) sequences."""
    by = ["animal_id", "season"] if by_season else ["animal_id"]
    return cells.join(members.select("seq_id", *by), "seq_id").select(*by, "row", "col").distinct()


def range_density(ud: DataFrame, members: DataFrame) -> DataFrame:
    """``row, col, density`` of the whole herd: mean of the animals' surfaces, normal to 1."""
    animals = individual_ud(ud, members)
    out = mean_surface(animals, animals.select("animal_id").distinct(), "animal_id", [])
    return _share(out)


def _share(surface: DataFrame) -> DataFrame:
    total = surface.agg(F.sum("density").alias("_t"))  # one row
    return surface.crossJoin(F.broadcast(total)).select("row", "col", (F.col("density") / F.col("_t")).alias("density"))


def merged_layers(ud: DataFrame, members: DataFrame, merge_order: tuple[str, ...] = ("id", "year")) -> DataFrame:
    """``layer, row, col, density``: sequences meaned to animal-years, then to the unit named first."""
    names = {"id": "animal_id", "year": "bio_year"}
    unit = names[merge_order[0]]
    named = normalise(ud, ["seq_id"]).join(members.select("seq_id", "animal_id", "bio_year"), "seq_id")
    used = members.join(ud.select("seq_id").distinct(), "seq_id", "left_semi")
    if len(merge_order) < 2:
        inner, pairs, step = named, used, "seq_id"
    else:
        inner, step = mean_surface(named, used, "seq_id", ["animal_id", "bio_year"]), names[merge_order[1]]
        pairs = used
    return mean_surface(inner, pairs, step, [unit]).select(F.col(unit).cast("string").alias("layer"), "row", "col", "density")


def use_area(layers: DataFrame) -> DataFrame:
    """``row, col, value``: percentage of the layers that use the cell."""
    n = layers.agg(F.countDistinct("layer").alias("_n"))
    return layers.where("density > 0").groupBy("row", "col").agg(F.countDistinct("layer").alias("k")).crossJoin(F.broadcast(n)).select("row", "col", (F.col("k") * 100.0 / F.col("_n")).alias("value"))


#: Grid rows of a block of cells of equal value.
BLOCK_ROWS = 256
#: Decimals by which uses are compared.
USE_DIGITS = 12


def use_volume(layers: DataFrame) -> DataFrame:
    """``row, col, density, cum``: the summed use, normal to 1, and its running sum from the most used cell down.

    The sum runs in two steps: over bands of like use, which are few, and
    inside each band.  Uses that agree in ``USE_DIGITS`` decimals are equal:
    the last digits of a sum depend on the order of its rows.
    """
    raw = _share(layers.groupBy("row", "col").agg(F.sum("density").alias("density")))
    return running_mass(raw.withColumn("_rank", F.round("density", USE_DIGITS)), "_rank", mass="density").drop("_rank")


def running_mass(surface: DataFrame, value: str, keys: tuple[str, ...] = (), bands: int = 64, mass: str | None = None) -> DataFrame:
    """``cum``: for each cell the sum of ``mass`` (or ``value``) over cells of greater value (ties by row and column) and itself.

    Cells are dealt by bands of like logarithm of the value, and by blocks of
    ``BLOCK_ROWS`` grid rows in a band: equal values, as counts are, are many.
    A cell's sum has three parts: greater bands, greater values of its band,
    and cells of its own value before it.  Each runs over pre-aggregated rows,
    so no task holds all cells.  The parts meet by equal values, so the surface
    is stored first: sums worked out again in another order may differ in the
    last digit.
    """
    surface, mass = stored(surface, "surface"), mass or value
    top = surface.groupBy(*keys).agg(F.max(value).alias("_top")) if keys else surface.agg(F.max(value).alias("_top"))
    banded = surface.join(top, list(keys)) if keys else surface.crossJoin(F.broadcast(top))  # one row
    band = F.when(F.col(value) > 0, F.least(F.lit(bands - 1), F.floor(-F.log2(F.col(value) / F.col("_top")) * 2).cast("int"))).otherwise(bands)
    banded = banded.withColumns({"_band": band, "_block": F.floor(F.col("row") / BLOCK_ROWS)}).drop("_top")
    up_to = Window.unboundedPreceding, -1

    def before(rows: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
        return rows.withColumn(name, F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*up_to)), F.lit(0.0))).drop("_s")

    sums = banded.groupBy(*keys, "_band", value, "_block").agg(F.sum(mass).alias("_s"))
    values = sums.groupBy(*keys, "_band", value).agg(F.sum("_s").alias("_s"))
    by_band = before(values.groupBy(*keys, "_band").agg(F.sum("_s").alias("_s")), [*keys], ["_band"], "_a")
    by_value = before(values, [*keys, "_band"], [F.desc(value)], "_b")
    by_block = before(sums, [*keys, "_band", value], ["_block"], "_c")
    ahead = by_block.join(by_value, [*keys, "_band", value]).join(by_band, [*keys, "_band"]).select(*keys, "_band", value, "_block", (F.col("_a") + F.col("_b") + F.col("_c")).alias("_before"))
    inside = F.sum(mass).over(Window.partitionBy(*keys, "_band", value, "_block").orderBy("row", "col").rowsBetween(Window.unboundedPreceding, 0))
    return banded.withColumn("_in", inside).join(ahead, [*keys, "_band", value, "_block"]).withColumn("cum", F.col("_in") + F.col("_before")).drop("_band", "_block", "_in", "_before")


def volume_isopleth(volume: DataFrame, level: float) -> DataFrame:
    """Cells in use up to the level's share of all use."""
    return volume.where((F.col("density") > 0) & ((1 - F.col("cum")) * 100 >= 100 - level)).select("row", "col")


def footprint_share(cells: DataFrame, n_sequences: int | None = None) -> DataFrame:
    """``row, col, value``: percentage of the sequences whose footprint holds the cell."""
    n = cells.agg(F.countDistinct("seq_id").alias("_n")) if n_sequences is None else cells.sparkSession.range(1).select(F.lit(n_sequences).alias("_n"))
    return cells.groupBy("row", "col").agg(F.countDistinct("seq_id").alias("k")).crossJoin(F.broadcast(n)).select("row", "col", (F.col("k") * 100.0 / F.col("_n")).alias("value"))


def levels_with_minimums(levels: list[float], n: int) -> list[float]:
    """Percentage levels, and those of one and of two animals among ``n``."""
    extra = [100 * k / n for k in (1, 2) if n]
    return sorted({round(x, 6) for x in [*levels, *extra] if x <= 100})


def level_cells(surface: DataFrame, levels: list[float], value: str = "value") -> DataFrame:
    """``level, row, col`` of the cells at or above each level."""
    return surface.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).where(F.col(value) >= F.col("level")).select("level", "row", "col")


def season_surface(individual: DataFrame, by: list[str]) -> DataFrame:
    """``by, row, col, n, mean_ud``: animals that use a cell, and the mean of all animals' surfaces."""
    herd = individual.groupBy(*by).agg(F.countDistinct("animal_id").alias("_n"))
    cells = individual.where("density > 0").groupBy(*by, "row", "col").agg(F.countDistinct("animal_id").cast("int").alias("n"), F.sum("density").alias("_s"))
    return cells.join(herd, by).withColumn("mean_ud", F.col("_s") / F.col("_n")).drop("_s", "_n")


def smallest_prefix(surface: DataFrame, value: str, percent: float, by: list[str]) -> DataFrame:
    """The fewest most-valued cells that reach ``percent`` of the sum; ties by row and column."""
    total = surface.groupBy(*by).agg(F.sum(value).alias("_t"))
    ranked = running_mass(surface.withColumn(value, F.col(value).cast("double")), value, tuple(by)).join(total, by)
    return ranked.where(F.col("cum") - F.col(value) < F.col("_t") * percent / 100).select(*by, "row", "col", value)


def season_products(individual: DataFrame, by: list[str], min_individuals: tuple[int, ...] = (2, 3), top_pct: tuple[float, ...] = (10, 20), stopover_pct: float = 10, isopleths: tuple[float, ...] = (5, 10, 15, 20, 30, 50, 75, 95), only: set[str] | None = None) -> dict[str, DataFrame]:
    """Named surfaces of each season: count, mean UD, extent, minimumN counts and masks, top use, stopovers; or ``only`` some.

    ``isopleths`` is accepted for compatibility: the extent is every used cell.
    """
    s = season_surface(individual, by)
    cell = [*by, "row", "col"]
    plans = {"count": lambda: s.select(*cell, "n"), "mean_ud": lambda: s.select(*cell, "mean_ud"), "extent": lambda: s.select(*cell)}
    for k in min_individuals:
        plans[f"minimum{k}_count"] = lambda k=k: s.where(F.col("n") >= k).select(*cell, "n")
        plans[f"minimum{k}"] = lambda k=k: s.where(F.col("n") >= k).select(*cell)
    for p in top_pct:
        plans[f"top{p:g}"] = lambda p=p: smallest_prefix(s, "n", p, by)
    plans["stopover"] = lambda: smallest_prefix(s, "mean_ud", stopover_pct, by)
    return {name: plan() for name, plan in plans.items() if only is None or name in only}


def year_summaries(ud: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Season by year, all seasons of a year, and each animal's surface a year."""
    named = normalise(ud, ["seq_id"]).join(members.select("seq_id", "animal_id", "bio_year", "season"), "seq_id")
    used = members.join(ud.select("seq_id").distinct(), "seq_id", "left_semi")
    by_season = mean_surface(named, used, "seq_id", ["animal_id", "season", "bio_year"])
    by_year = mean_surface(named, used, "seq_id", ["animal_id", "bio_year"])
    return {"season_year": season_surface(by_season, ["season", "bio_year"]), "year": season_surface(by_year, ["bio_year"]), "animal_year": by_year}


def overlap(cells: DataFrame, a: str, b: str, key: str = "animal_id") -> DataFrame:
    """One row: cells of ``a``, of ``b`` and of both."""
    two = cells.where(F.col(key).isin(a, b)).groupBy("row", "col").agg(F.max(F.col(key) == a).alias("a"), F.max(F.col(key) == b).alias("b"))
    return two.agg(F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(F.col("a") & F.col("b")).alias("n_both"))


def display_scale(surface: DataFrame, value: str) -> DataFrame:
    """``shown``: the value over the 98th percentile of the positive ones, 1 at most."""
    top = exact_quantile(surface.where(F.col(value) > 0), value, 0.98).withColumnRenamed("q", "_p")
    return surface.crossJoin(F.broadcast(top)).withColumn("shown", F.least(F.lit(1.0), F.col(value) / F.col("_p"))).drop("_p")


def product_names(herd: str, season: str, stamp: str) -> Column:
    """File-name stem of a product."""
    return F.concat_ws("_", F.lit(herd), F.lit(season), F.lit(stamp))
