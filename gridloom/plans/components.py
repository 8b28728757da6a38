"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.durable import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of an edge.

    Each round points the neighbours of a node at the least one it knows
    (larger ones in one half, smaller ones in the other) until nothing
    changes. Minima are combined before the shuffle, so a node with many
    edges is no hot spot; rounds grow with the logarithm of the longest path.
    Edges with a null end are ignored; loops only name their node.
    """
    known = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = known.select("u", F.col("u").alias("v")).union(known.select(F.col("v").alias("u"), "v")).distinct()
    star = cut(known.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops, mark = cut(loops), _mark(star)
    while True:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        star = cut(small)
        before, mark = mark, _mark(star)
        if mark == before:
            break
    least = star.groupBy("u").agg(F.min("v").alias("m"))
    return loops.join(least, "u", "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))
