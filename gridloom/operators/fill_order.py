"""An order of elimination that leaves little fill-in, found in rounds on a quotient graph.

An eliminated node is an element: it stands for the clique of those that it
left behind, stored as their membership instead of all their pairs, so the
graph never needs more rows than the matrix has entries. A round takes nodes of
small degree that are no neighbours of each other (Luby's choice: each that
comes first among its neighbours), which does not change what any of them
fills in; a degree is bounded by the sizes of the elements around a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.durable import cut, written
from gridloom.plans.ordering import dense_order


def fill_reducing_order(a: DataFrame, slack: float = 2.0) -> DataFrame:
    """``old, new``: the nodes of a symmetric pattern ``i, j``, one half or both, and their places in the order, from 0.

    A round takes nodes of at most ``slack`` times the least degree; a larger
    slack needs fewer rounds and may leave more fill-in. Ties go by a hash of
    the node.
    """
    with written(a.sparkSession) as keep:
        ties = a.where("i <> j").select(F.col("i").alias("u"), F.col("j").alias("v"))
        edges = keep(ties.union(ties.select("v", "u")).distinct())
        live = keep(a.select(F.col("i").alias("v")).union(a.select("j")).distinct())
        members = keep(edges.select(F.col("u").alias("e"), "v").where("false"))
        taken = []
        while not live.isEmpty():
            sizes = members.groupBy("e").agg((F.count(F.lit(1)) - 1).alias("more"))
            known = edges.groupBy(F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("d"))
            known = known.union(members.join(sizes, "e").groupBy("v").agg(F.sum("more").alias("d"))).groupBy("v").agg(F.sum("d").alias("d"))
            degrees = keep(live.join(known, "v", "left").select("v", F.coalesce("d", F.lit(0)).alias("d")))
            least = degrees.agg(F.min("d")).first()[0]
            small = degrees.where(F.col("d") <= int(slack * least)).select("v", F.struct("d", F.xxhash64("v").alias("h"), "v").alias("key"))
            small = keep(small)
            by_edge = edges.join(small, "v").groupBy(F.col("u").alias("v")).agg(F.min("key").alias("other"))
            by_element = members.join(small, "v").groupBy("e").agg(F.min("key").alias("other"))
            by_element = members.join(by_element, "e").groupBy("v").agg(F.min("other").alias("other"))
            first = by_edge.union(by_element).groupBy("v").agg(F.min("other").alias("other"))
            chosen = keep(small.join(first, "v", "left").where("other IS NULL OR key <= other").select("v", "key.d", "key.h"))
            taken.append(chosen.select(F.lit(len(taken)).alias("round"), "d", "h", F.col("v").alias("old")))
            gone = chosen.select("v")
            # an element has one chosen member at most, which takes it over with all that it had beside it
            into = members.join(gone, "v").select("e", F.col("v").alias("by"))
            moved = members.join(into, "e", "left").select(F.coalesce("by", "e").alias("e"), "v")
            beside = edges.join(gone.select(F.col("v").alias("u")), "u").select(F.col("u").alias("e"), "v")
            members = keep(moved.union(beside).join(gone, "v", "left_anti").select("e", "v").distinct())
            edges = edges.join(gone, "v", "left_anti").join(gone.select(F.col("v").alias("u")), "u", "left_anti")
            fresh = members.join(gone.select(F.col("v").alias("e")), "e")
            # pairs that an element holds need no edge of their own
            held = edges.join(fresh.select("e", F.col("v").alias("u")), "u").join(fresh, ["e", "v"]).select("u", "v").distinct()
            edges = keep(edges.join(held, ["u", "v"], "left_anti").select("u", "v"))
            live = keep(live.join(gone, "v", "left_anti"))
        if not taken:
            return cut(live.select(F.col("v").alias("old"), F.col("v").cast("long").alias("new")))
        whole = taken[0]
        for part in taken[1:]:
            whole = whole.union(part)
        return cut(dense_order(whole, ["round", "d", "h", "old"], "new").select("old", "new"))


def reordered(a: DataFrame, order: DataFrame) -> DataFrame:
    """The lower half ``i, j, v`` of P A P' for a symmetric A of which one half is given, and ``old, new``."""
    x, y = (order.select(F.col("old").alias(side), F.col("new").alias(f"new_{side}")) for side in "ij")
    moved = a.join(x, "i").join(y, "j")
    return moved.select(F.greatest("new_i", "new_j").alias("i"), F.least("new_i", "new_j").alias("j"), "v")
