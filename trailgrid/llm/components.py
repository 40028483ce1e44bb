"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame, name: str) -> DataFrame:
    """Larger neighbours of each node move to the least node of its neighbourhood.

    The nodes' least neighbours are stored before the join: with a plain table
    on either side, the rows of a node with very many neighbours can be split
    between tasks.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    least = materialize(least, f"{name}-least")
    joined = both.join(least, F.col("u") == F.col("c")).where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the least of them; links to a star's least node give a node few of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    joined = down.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """``node, root`` for every endpoint of ``edges`` (columns ``u``, ``v``).

    ``root`` is the smallest node that can be reached.  No component or edge
    list leaves the executors; each round is written to the shared folder, so
    a lost executor costs one round at most.  Self-loops are ignored; an empty
    edge table gives an empty result.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    sign = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")]
    before = now.agg(*sign).first()
    while before["n"]:
        now = materialize(_small_star(_large_star(now, name)), name)
        after = now.agg(*sign).first()
        if after == before:
            break
        before = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
