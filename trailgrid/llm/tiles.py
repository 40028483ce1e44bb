"""Links inside groups of any size: a large group meets its hub first, and only what the hub doesn't reach is compared with all.

A group of more rows than a tile holds is cut into tiles by the ids' hash.
Its row of least id, the hub, goes to every tile.  What a tile's comparison
joins to the hub is one component over all tiles; so pairs of such rows need
no comparison, and the other rows, the rest, are compared with every tile.  A
group of copies that are like one another thus costs its size, not its square,
and no link is lost: any two rows that are not both joined to the hub meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grouped import map_groups
from .common import bound_batches, materialize

#: Rows of a list of large groups that may be broadcast (24 bytes each); a longer one is joined by a shuffle.
BROADCAST_GROUPS = 200_000


def forest(ids: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every id to the least id of its class (numbers below that of the ids): stars whose centres come first, so that no node has many smaller neighbours."""
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, ids)
    least = least[labels]
    rest = ids != least
    return ids[rest], least[rest]


def _side(few: DataFrame) -> DataFrame:
    return F.broadcast(few) if few.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else few


def _tile(t: Column | str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(5)), F.col(t) if isinstance(t, str) else t).cast("int")


def link_large(rows: DataFrame, sizes: DataFrame, label: Callable[[dict[str, np.ndarray]], np.ndarray], tile_rows: int, name: str) -> DataFrame:
    """``u, v``: links that join what ``label`` joins in the large groups of ``rows``.

    ``rows``: g, id and what is compared.  ``sizes``: hg, t, hub: each large
    group's number of tiles and its least id.  ``label`` takes the columns of
    some rows, with different ids, and gives each row the number of a row of
    its class.  A class need only be right for the pairs of rows it is given.
    """
    bound_batches(rows.sparkSession)
    rest = [c for c in rows.columns if c not in ("g", "id")]
    hot = rows.join(_side(sizes), F.col("g") == F.col("hg")).drop("hg")
    hot = materialize(hot.withColumn("o", _tile("t")), f"{name}-rows")

    def classes(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, pick = np.unique(c["id"], return_index=True)
        return ids, label({k: v[pick] for k, v in c.items()}), pick

    def with_hub(key, c: dict[str, np.ndarray]) -> dict:
        ids, labels, _ = classes(c)
        u, v = forest(ids, labels)
        alone = ids[labels != labels[np.searchsorted(ids, c["hub"][0])]]
        return {"g": [c["g"][0]] * (len(u) + len(alone)), "u": [*u.tolist(), *alone.tolist()], "v": [*v.tolist(), *[None] * len(alone)]}

    def with_rest(key, c: dict[str, np.ndarray]) -> dict:
        ids, labels, _ = classes(c)
        u, v = forest(ids, labels)
        return {"u": u, "v": v}

    hubs = hot.where("id = hub").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    first = hot.unionByName(hubs).select(F.xxhash64("g", "o").alias("k"), "g", "hub", "id", *rest)
    found = materialize(map_groups(first, "k", [], with_hub, "g long, u long, v long"), f"{name}-hubs")
    links = found.where("v is not null").select("u", "v")
    alone = materialize(found.where("v is null").select(F.col("g").alias("ag"), F.col("u").alias("au")).distinct(), f"{name}-rest")
    if not alone.head(1):
        return links
    parts = materialize(alone.groupBy("ag").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("s")), f"{name}-parts")
    far = hot.join(_side(parts), F.col("g") == F.col("ag")).drop("ag")
    all_rows = far.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    few = far.join(alone, (F.col("g") == F.col("ag")) & (F.col("id") == F.col("au"))).drop("ag", "au").withColumn("p", F.pmod(F.xxhash64("id", F.lit(6)), F.col("s")).cast("int"))
    few = few.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    second = all_rows.unionByName(few).select(F.xxhash64("g", "o", "p").alias("k"), "id", *rest)
    return links.unionByName(map_groups(second, "k", [], with_rest, "u long, v long"))
