"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free sum of hashes of the edges, to tell whether a round changed them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the smallest node that can be reached, for every node of ``edges``
    (columns x and y). Nodes are linked to smaller and smaller neighbours, round by round (large
    stars, then small stars), until all point to their smallest; a node's neighbours are never
    gathered, only their minimum is. Rounds grow with the logarithm of the longest chain."""
    now = stored(edges.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
                 .distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = stored(large, "edges")
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        following = stored(least.select("x", F.col("m").alias("y")).unionByName(
            small.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))).distinct(), "edges")
        after = _mark(following)
        now, done, mark = following, after == mark, after
        if done:
            break
    return now.select(F.col("x").alias("node"), F.col("y").alias("comp")).unionByName(
        now.select(F.col("y").alias("node"), F.col("y").alias("comp"))).distinct()
