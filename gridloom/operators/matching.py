"""Matchings of rows with columns of a pattern ``i, j``, and the blocks that they show, all in frames.

Alternating paths grow from all free columns at once, a layer at a time. A row
is entered once, so the paths form trees without common nodes, and every tree
that ends in a free row gives one augmenting path; all of a phase are turned
over together. No task holds more than the rows that a join deals to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.graphs import strong_components
from gridloom.plans.durable import cut, written

Keep = Callable[[DataFrame], DataFrame]


def _greedy(edges: DataFrame, keep: Keep) -> DataFrame:
    """A matching to which no entry can be added: columns ask for a row, rows take one that asks, until nobody asks."""
    matched = keep(edges.select("i", "j").where("false"))
    left = edges
    while True:
        asked = left.groupBy("j").agg(F.min(F.struct(F.xxhash64("i", "j").alias("by"), "i")).alias("a")).select("j", "a.i")
        taken = keep(asked.groupBy("i").agg(F.min("j").alias("j")))
        if taken.isEmpty():
            return matched
        matched = matched.union(taken)
        left = keep(left.join(taken.select("i"), "i", "left_anti").join(taken.select("j"), "j", "left_anti").select("i", "j"))


def _augmented(edges: DataFrame, columns: DataFrame, matched: DataFrame, keep: Keep) -> DataFrame | None:
    """The matching after one phase, or None if no augmenting path is left."""
    mate = matched.select("i", F.col("j").alias("next"))
    free = columns.join(matched.select("j"), "j", "left_anti")
    front = keep(free.select("j", F.col("j").alias("root")))
    visited, ends, layers = None, None, []
    while not front.isEmpty():
        met = edges.join(front, "j")
        if visited is not None:
            met = met.join(visited.select("i"), "i", "left_anti")
        new = met.groupBy("i").agg(F.min(F.struct("j", "root")).alias("p")).select("i", "p.j", "p.root")
        new = keep(new.join(mate, "i", "left"))
        visited = new if visited is None else visited.union(new)
        layers.append(new)
        found = keep(new.where("next IS NULL").groupBy("root").agg(F.min("i").alias("i")))
        ends = found if ends is None else ends.union(found)
        # a tree that has an end grows no further
        front = keep(new.where("next IS NOT NULL").select(F.col("next").alias("j"), "root").join(found.select("root"), "root", "left_anti").select("j", "root"))
    if ends is None or ends.isEmpty():
        return None
    # back along the layers: the row takes the column it was entered from, whose former row goes on
    path, turned = ends.select("i"), []
    back = matched.select(F.col("i").alias("before"), "j")
    for layer in reversed(layers):
        step = keep(layer.join(path, "i").select("i", "j").join(back, "j", "left"))
        turned.append(step.select("i", "j"))
        passed = path.join(layer.select("i"), "i", "left_anti")
        path = keep(passed.union(step.where("before IS NOT NULL").select(F.col("before").alias("i"))))
    flipped = turned[0]
    for part in turned[1:]:
        flipped = flipped.union(part)
    flipped = keep(flipped)
    return keep(matched.join(flipped.select("j"), "j", "left_anti").select("i", "j").union(flipped))


def _matching(edges: DataFrame, keep: Keep) -> DataFrame:
    matched, columns = _greedy(edges, keep), keep(edges.select("j").distinct())
    while (better := _augmented(edges, columns, matched, keep)) is not None:
        matched = better
    return matched


def maximum_matching(a: DataFrame) -> DataFrame:
    """``i, j``: entries of which each row and each column has one at most, as many as can be.

    Entries with a null end are left out, repeated ones count once.
    """
    with written(a.sparkSession) as keep:
        return cut(_matching(keep(_entries(a)), keep))


def _entries(a: DataFrame) -> DataFrame:
    return a.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).where("i IS NOT NULL AND j IS NOT NULL").distinct()


def _alternating(edges: DataFrame, mate: DataFrame, start: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """``own`` and ``other`` nodes on alternating paths from ``start`` over ``own, other``; ``mate`` is a matching of the same columns."""
    own = front = keep(start)
    other = None
    while not front.isEmpty():
        new = edges.join(front, "own").select("other").distinct()
        new = keep(new if other is None else new.join(other, "other", "left_anti"))
        other = new if other is None else other.union(new)
        front = keep(mate.join(new, "other").select("own").join(own, "own", "left_anti"))
        own = own.union(front)
    return own, other if other is not None else edges.select("other").where("false")


def dulmage_mendelsohn(a: DataFrame) -> DataFrame:
    """``side, node, part, block``: the canonical blocks of a pattern.

    Columns without a partner and all that alternating paths from them reach
    are ``under`` (more columns than rows), rows without one and what paths
    from them reach ``over``, the rest ``square``; which partners were chosen
    makes no difference. The square part falls into the strong components of
    its columns, where one leads to the partner of a row that it has an entry
    in: ``block`` is the smallest column, also for the rows; it is null
    elsewhere. Rows and columns without an entry are unknown here.
    """
    with written(a.sparkSession) as keep:
        edges = keep(_entries(a))
        matched = _matching(edges, keep)
        rows, columns = keep(edges.select("i").distinct()), keep(edges.select("j").distinct())
        free_columns = columns.join(matched.select("j"), "j", "left_anti").select(F.col("j").alias("own"))
        free_rows = rows.join(matched.select("i"), "i", "left_anti").select(F.col("i").alias("own"))
        from_column, from_row = [F.col("j").alias("own"), F.col("i").alias("other")], [F.col("i").alias("own"), F.col("j").alias("other")]
        wide_columns, wide_rows = _alternating(edges.select(*from_column), matched.select(*from_column), free_columns, keep)
        tall_rows, tall_columns = _alternating(edges.select(*from_row), matched.select(*from_row), free_rows, keep)

        def placed(side: str, nodes: DataFrame, wide: DataFrame, tall: DataFrame) -> DataFrame:
            under, over = wide.toDF("node").withColumn("under", F.lit(True)), tall.toDF("node").withColumn("over", F.lit(True))
            part = F.when(F.col("under"), "under").when(F.col("over"), "over").otherwise("square")
            return nodes.toDF("node").join(under, "node", "left").join(over, "node", "left").select(F.lit(side).alias("side"), "node", part.alias("part"))

        parts = keep(placed("row", rows, wide_rows, tall_rows).union(placed("column", columns, wide_columns, tall_columns)))
        square = parts.where("part = 'square'")
        inner = edges.join(square.where("side = 'row'").select(F.col("node").alias("i")), "i").join(square.where("side = 'column'").select(F.col("node").alias("j")), "j")
        steps = keep(inner.join(matched.withColumnRenamed("j", "to"), "i").select(F.col("to").alias("i"), "j"))
        blocks = strong_components(steps).select(F.lit("column").alias("side"), "node", F.col("component").alias("block"))
        blocks = keep(blocks)
        of_rows = matched.join(blocks.select(F.col("node").alias("j"), "block"), "j").select(F.lit("row").alias("side"), F.col("i").alias("node"), "block")
        return cut(parts.join(blocks.union(of_rows), ["side", "node"], "left").select("side", "node", "part", "block"))
