"""Connected components by alternating large-star and small-star rounds, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _with_smallest(pairs: DataFrame, smallest: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with the smallest neighbour of u. Joined on a hash of u (a bijection of 64-bit values), so that
    both sides are exchanged and adaptive execution may split a node with very many neighbours."""
    right = smallest.select(F.xxhash64("u").alias("node_key"), F.col("m"))
    return pairs.withColumn("pair_key", F.xxhash64("u")).join(right, F.col("pair_key") == F.col("node_key")).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in ``edges`` (two bigint columns); component is the smallest node reachable.

    Rounds go on until the edges no longer change, each cut by a reliable checkpoint. Edges with a null end and loops
    are ignored, repeated edges count once, no edges give an empty result. Nothing but a count and a hash per round
    reaches the driver.
    """
    ends = [F.col(a).cast("bigint"), F.col(b).cast("bigint")]
    stars = cut_lineage(edges.select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v")).where(ends[0].isNotNull() & ends[1].isNotNull()).where("u > v").distinct())
    seen = None
    while True:
        mark = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_smallest(both, smallest).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_smallest(large, smallest).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        stars = cut_lineage(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
    centres = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres.select("node", F.col("node").alias("component")))
