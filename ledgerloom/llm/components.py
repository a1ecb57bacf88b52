"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    leaves = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return leaves.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Edges ``(u, v)`` to ``(node, root)`` for every node with an edge, roots too.

    ``root`` is the smallest node of the component.  Loops and repeated or
    null-ended edges are ignored; no edges give no rows.  Each round is a
    written table, so a lost executor costs at most one round.  A round moves
    at most a few rows per edge: stars shrink groups instead of expanding
    pairs, and minima are combined before the shuffle.
    """
    edges = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        edges = written(_small_star(_large_star(edges)), "edges")
        # sums of 32-bit halves stay within a long below 2^32 edges whatever their signs
        now = edges.agg(
            F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 32)), F.bit_xor(F.xxhash64("u", "v"))
        ).first()
        if tuple(now) == seen:
            own = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own)
        seen = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
