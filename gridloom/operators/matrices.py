"""Matrices as rows ``i, j, v`` and vectors as rows ``i, x``; absent entries are zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product: join on the inner index, sum per entry with map-side partials."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def times_vector(a: DataFrame, x: DataFrame) -> DataFrame:
    """``i, x`` of A x."""
    terms = a.join(x.withColumnRenamed("i", "j"), "j")
    return terms.groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def scaled_times_vector(a: DataFrame, x: DataFrame, y: DataFrame, alpha: float, beta: float) -> DataFrame:
    """alpha A x + beta y."""
    product = times_vector(a, x).withColumnRenamed("x", "ax")
    both = y.join(product, "i", "full")
    return both.select("i", (alpha * F.coalesce("ax", F.lit(0.0)) + beta * F.coalesce("x", F.lit(0.0))).alias("x"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def scaled_sum(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha A + beta B."""
    both = a.select("i", "j", (alpha * F.col("v")).alias("v")).unionByName(b.select("i", "j", (beta * F.col("v")).alias("v")))
    return sum_duplicates(both)


def sum_duplicates(a: DataFrame) -> DataFrame:
    """Triplets with repeated entries added up."""
    return a.groupBy("i", "j").agg(F.sum("v").alias("v"))


def drop_small(a: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Entries of larger magnitude than the tolerance."""
    return a.where(F.abs("v") > tolerance)


def permute(a: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Entries moved by tables ``old, new`` of row and column numbers."""
    moved = a.join(rows.select(F.col("old").alias("i"), F.col("new").alias("to_i")), "i")
    moved = moved.join(columns.select(F.col("old").alias("j"), F.col("new").alias("to_j")), "j")
    return moved.select(F.col("to_i").alias("i"), F.col("to_j").alias("j"), "v")


def inverse_permutation(p: DataFrame) -> DataFrame:
    return p.select(F.col("new").alias("old"), F.col("old").alias("new"))


def permute_vector(x: DataFrame, p: DataFrame) -> DataFrame:
    return x.join(p.select(F.col("old").alias("i"), "new"), "i").select(F.col("new").alias("i"), "x")


def running_sum(counts: DataFrame) -> DataFrame:
    """``i, before``: sum of ``x`` of all smaller ``i``.

    Partitions of the range-sorted rows are summed first, so no task sees
    more than its own part.
    """
    parts = max(1, counts.sparkSession.sparkContext.defaultParallelism)
    bounds = counts.agg(F.min("i"), F.max("i")).first()
    if bounds[0] is None:
        return counts.select("i", F.lit(0.0).alias("before"))
    width = max(1, -(-(bounds[1] - bounds[0] + 1) // parts))
    dealt = counts.withColumn("part", F.expr(f"(i - {bounds[0]}) div {width}"))
    totals = dealt.groupBy("part").agg(F.sum("x").alias("s"))
    below = totals.alias("a").join(F.broadcast(totals.alias("b")), F.col("b.part") < F.col("a.part"), "left")
    offsets = below.groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.s"), F.lit(0.0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("inside", F.coalesce(F.sum("x").over(inside), F.lit(0.0)))
    return summed.join(F.broadcast(offsets), "part").select("i", (F.col("offset") + F.col("inside")).alias("before"))


def symmetric(lower: DataFrame) -> DataFrame:
    """Both halves of a matrix of which one is stored."""
    return lower.select("i", "j", "v").unionByName(transpose(lower.where("i <> j")))


def zero_based(a: DataFrame) -> DataFrame:
    return a.select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "v")


def tiled(a: DataFrame, tile: int) -> DataFrame:
    """Entries with tile numbers ``bi, bj`` and places ``ti, tj`` inside the tile."""
    parts = {"bi": f"i div {tile}", "bj": f"j div {tile}", "ti": f"i % {tile}", "tj": f"j % {tile}"}
    return a.select("i", "j", "v", *(F.expr(e).alias(n) for n, e in parts.items()))


def untiled(tiles: DataFrame, tile: int) -> DataFrame:
    return tiles.select((F.col("bi") * tile + F.col("ti")).alias("i"), (F.col("bj") * tile + F.col("tj")).alias("j"), "v")


def gather_tile(a: DataFrame, tile: int, bi: int, bj: int) -> DataFrame:
    """One tile as a matrix of its own; the range filter reaches the scan."""
    inside = F.col("i").between(bi * tile, (bi + 1) * tile - 1) & F.col("j").between(bj * tile, (bj + 1) * tile - 1)
    return a.where(inside).select((F.col("i") - bi * tile).alias("i"), (F.col("j") - bj * tile).alias("j"), "v")


def scatter_tile(a: DataFrame, part: DataFrame, tile: int, bi: int, bj: int) -> DataFrame:
    """``a`` with one tile replaced."""
    inside = F.col("i").between(bi * tile, (bi + 1) * tile - 1) & F.col("j").between(bj * tile, (bj + 1) * tile - 1)
    placed = part.select((F.col("i") + bi * tile).alias("i"), (F.col("j") + bj * tile).alias("j"), "v")
    return a.where(~inside).select("i", "j", "v").unionByName(placed)


def diagonal_blocks(a: DataFrame, block: int) -> DataFrame:
    return a.where(F.expr(f"i div {block} = j div {block}")).select(F.expr(f"i div {block}").alias("block"), "i", "j", "v")


def add_to_diagonal(a: DataFrame, alpha: float | Column) -> DataFrame:
    return a.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("v") + alpha).otherwise(F.col("v")).alias("v"))


def identity_like(a: DataFrame) -> DataFrame:
    return a.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0).alias("v"))


def unit_lower(a: DataFrame) -> DataFrame:
    """L of a combined factor: below the diagonal, with ones on it."""
    return a.where("i >= j").select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("v")).alias("v"))


def upper(a: DataFrame) -> DataFrame:
    return a.where("i <= j").select("i", "j", "v")


def row_norm(a: DataFrame) -> DataFrame:
    """``norm``: the largest absolute row sum."""
    return a.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("norm"))


def column_norm(a: DataFrame) -> DataFrame:
    """``norm``: the largest absolute column sum."""
    return row_norm(transpose(a))


def squared_error(a: DataFrame, b: DataFrame, tile: int) -> DataFrame:
    """``bi, bj, error``: sums of squared differences by tile, missing entries as zero."""
    both = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"], "full")
    d = F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))
    return both.groupBy(F.expr(f"i div {tile}").alias("bi"), F.expr(f"j div {tile}").alias("bj")).agg(F.sum(d * d).alias("error"))


def dots(pairs: dict[str, tuple[str, str]]) -> list[Column]:
    """Several dot products of columns as aggregates of one pass."""
    return [F.sum(F.col(a) * F.col(b)).alias(name) for name, (a, b) in pairs.items()]
