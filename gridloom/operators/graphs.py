"""Reachability over the pattern of a matrix: an entry i, j is an edge from j to i."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.durable import cut


def breadth_first(a: DataFrame, start: list[int]) -> DataFrame:
    """``node, level`` of all nodes that can be reached."""
    spark = a.sparkSession
    edges = cut(a.select(F.col("j").alias("node"), F.col("i").alias("next")).where("i <> j").distinct())
    seen = cut(spark.createDataFrame([(s, 0) for s in start], "node long, level int"))
    front, level = seen, 0
    while not front.isEmpty():
        level += 1
        reached = front.join(edges, "node").select(F.col("next").alias("node")).distinct()
        front = cut(reached.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        seen = cut(seen.union(front))
    return seen


def strong_components(a: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node in it) by spreading the smallest ancestor and descendant.

    Nodes whose smallest ancestor is also their smallest descendant are
    together; they leave and the rest goes on.
    """
    edges = cut(a.select(F.col("j").alias("u"), F.col("i").alias("v")).where("i <> j").distinct())
    left = cut(a.select(F.col("i").alias("node")).union(a.select(F.col("j").alias("node"))).distinct())
    done = None
    while not left.isEmpty():
        forward, backward = _least(left, edges, "u", "v"), _least(left, edges, "v", "u")
        both = cut(forward.withColumnRenamed("least", "f").join(backward.withColumnRenamed("least", "b"), "node"))
        settled = cut(both.where("f = b").select("node", F.col("f").alias("component")))
        done = settled if done is None else cut(done.union(settled))
        left = cut(left.join(settled, "node", "left_anti"))
        inside = edges.join(left.withColumnRenamed("node", "u"), "u").join(left.withColumnRenamed("node", "v"), "v")
        edges = cut(inside.select("u", "v"))
    return done if done is not None else left.select("node", F.col("node").alias("component"))


def _least(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    known = cut(nodes.select("node", F.col("node").alias("least")))
    while True:
        sent = edges.join(known.withColumnRenamed("node", source), source).groupBy(F.col(target).alias("node")).agg(F.min("least").alias("sent"))
        new = cut(known.join(sent, "node", "left").select("node", F.least("least", "sent").alias("new"), "least"))
        changed = new.where("new < least").isEmpty()
        known = new.select("node", F.col("new").alias("least"))
        if changed:
            return known
