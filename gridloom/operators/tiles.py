"""Block algebra on frames of tiles ``bi, bj, t``: row-major square tiles, absent ones zero.

Steps that depend on each other are one job for each block column; within
one, tiles meet in joins on block numbers and each product is a numpy call.
Matrices come and go as entries ``i, j, v``; their size need not be a multiple
of the tile, since the identity is added beyond it and cut off again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.factorise import _tile_function, entries_of, solve_lower, tiled_cholesky, unit_lu
from gridloom.operators.matrices import multiply, scaled_sum, transpose
from gridloom.plans.durable import cut
from gridloom.plans.shipping import ship

TILE = 128
_KEYS = ["bi", "bj"]


def sized(n: int, tile: int) -> int:
    """The next multiple of the tile."""
    return -(-n // tile) * tile


def with_diagonal(a: DataFrame, n: int, tile: int) -> DataFrame:
    """``a`` with ones on the diagonal beyond its size, up to a multiple of the tile."""
    more = a.sparkSession.range(n, max(n, sized(n, tile))).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    return a.select("i", "j", "v").unionByName(more)


def to_tiles(a: DataFrame, tile: int) -> DataFrame:
    """Tiles that have an entry; what is absent inside them is zero."""
    ship(a.sparkSession)

    def fill(places: pd.Series, values: pd.Series) -> pd.Series:
        made = []
        for at, v in zip(places, values, strict=True):
            whole = np.zeros(tile * tile)
            whole[np.asarray(at, dtype=np.int64)] = v
            made.append(whole.tolist())
        return pd.Series(made)

    place = F.expr(f"i % {tile} * {tile} + j % {tile}")
    grouped = a.groupBy(F.expr(f"i div {tile}").alias("bi"), F.expr(f"j div {tile}").alias("bj")).agg(
        F.collect_list(F.struct(place.alias("at"), F.col("v").cast("double").alias("v"))).alias("e")
    )
    return grouped.select(*_KEYS, F.pandas_udf(fill, "array<double>")("e.at", "e.v").alias("t"))


def from_tiles(tiles: DataFrame, tile: int, rows: int | None = None, columns: int | None = None) -> DataFrame:
    """Entries that are not zero, without those beyond the size."""
    entries = entries_of(tiles, tile).where("v <> 0")
    if rows is not None:
        entries = entries.where(F.col("i") < rows)
    return entries if columns is None else entries.where(F.col("j") < columns)


def transposed(tiles: DataFrame, tile: int) -> DataFrame:
    ship(tiles.sparkSession)
    return tiles.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), _tile_function(np.transpose, tile)("t").alias("t"))


def product(a: DataFrame, b: DataFrame, tile: int) -> DataFrame:
    """Tiles of A B: pairs of tiles meet by the inner block, each tile of the result adds up its own."""
    ship(a.sparkSession)
    pairs = a.select("bi", F.col("bj").alias("k"), F.col("t").alias("x")).join(b.select(F.col("bi").alias("k"), "bj", F.col("t").alias("y")), "k")

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((tile, tile))
        for x, y in zip(rows.x, rows.y, strict=True):
            out += np.reshape(x, (tile, tile)) @ np.reshape(y, (tile, tile))
        return pd.DataFrame({"bi": rows.bi.iloc[:1], "bj": rows.bj.iloc[:1], "t": [out.ravel().tolist()]})

    return pairs.groupBy(*_KEYS).applyInPandas(total, "bi long, bj long, t array<double>")


def _less_product(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return c - a @ b


def _less_products(rest: DataFrame, column: DataFrame, row: DataFrame, tile: int, first: int, blocks: int) -> DataFrame:
    """``rest`` less the products of a block column ``bi, x`` and a block row ``bj, y``; tiles that were absent appear."""
    if first >= blocks:
        return rest
    dealt = column.select("bi", "x", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(blocks - 1).cast("long"))).alias("bj")).join(row, "bj")
    both = rest.join(dealt, _KEYS, "full")
    zeros = F.array_repeat(F.lit(0.0), tile * tile)
    changed = both.where("x IS NOT NULL").select(*_KEYS, _tile_function(_less_product, tile)(F.coalesce("t", zeros), F.col("x"), F.col("y")).alias("t"))
    return both.where("x IS NULL").select(*_KEYS, "t").unionByName(changed)


def _below(a: np.ndarray, lu: np.ndarray) -> np.ndarray:
    """a U^-1."""
    return solve_lower(np.triu(lu).T, a.T).T


def _beside(a: np.ndarray, lu: np.ndarray) -> np.ndarray:
    """L^-1 a, L with ones on the diagonal."""
    return solve_lower(np.tril(lu, -1) + np.eye(len(lu)), a)


def block_lu(a: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """Combined factor ``i, j, v`` without pivoting; tiles that stay zero are never made, fill-in appears where needed."""
    ship(a.sparkSession)
    blocks = sized(n, tile) // tile
    factor, below, beside = (_tile_function(f, tile) for f in (unit_lu, _below, _beside))
    rest, done = cut(to_tiles(with_diagonal(a, n, tile), tile)), None
    for k in range(blocks):
        in_row, in_column = F.col("bi") == k, F.col("bj") == k
        diagonal = rest.where(in_row & in_column).select(*_KEYS, factor("t").alias("t"))
        known = F.broadcast(diagonal.select(F.col("t").alias("d")))  # one tile
        column = rest.where(in_column & (F.col("bi") > k)).crossJoin(known).select(*_KEYS, below("t", "d").alias("t"))
        row = rest.where(in_row & (F.col("bj") > k)).crossJoin(known).select(*_KEYS, beside("t", "d").alias("t"))
        step = cut(diagonal.unionByName(column).unionByName(row))
        done = step if done is None else done.unionByName(step)
        left = step.where(F.col("bi") > k).select("bi", F.col("t").alias("x"))
        right = step.where(F.col("bj") > k).select("bj", F.col("t").alias("y"))
        rest = cut(_less_products(rest.where((F.col("bi") > k) & (F.col("bj") > k)), left, right, tile, k + 1, blocks))
    return from_tiles(done, tile, n, n)


def solve_lower_tiles(lower: DataFrame, right: DataFrame, blocks: int, columns: int, tile: int, unit: bool = False) -> DataFrame:
    """Tiles of L^-1 B by block forward substitution; ``columns`` is the number of block columns of B."""
    ship(lower.sparkSession)
    solve = _tile_function(_beside if unit else _solve, tile)
    lower, rest, done = cut(lower), cut(right), None
    for k in range(blocks):
        diagonal = F.broadcast(lower.where((F.col("bi") == k) & (F.col("bj") == k)).select(F.col("t").alias("d")))  # one tile
        row = cut(rest.where(F.col("bi") == k).crossJoin(diagonal).select(*_KEYS, solve("t", "d").alias("t")))
        done = row if done is None else done.unionByName(row)
        column = lower.where((F.col("bj") == k) & (F.col("bi") > k)).select("bi", F.col("t").alias("x"))
        rest = cut(_less_products(rest.where(F.col("bi") > k), column, row.select("bj", F.col("t").alias("y")), tile, 0, columns))
    return done


def _solve(a: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return solve_lower(np.tril(lower), a)


def _upside_down(a: DataFrame, n: int, columns: bool) -> DataFrame:
    j = F.lit(n - 1) - F.col("j") if columns else F.col("j")
    return a.select((F.lit(n - 1) - F.col("i")).alias("i"), j.alias("j"), "v")


def triangle(a: DataFrame, lower: bool = True, unit: bool = False) -> DataFrame:
    """The entries of one triangle; with ones on the diagonal if ``unit``."""
    inside = a.where("i >= j" if lower else "i <= j")
    return inside.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("v")).alias("v")) if unit else inside.select("i", "j", "v")


def triangular_product(a: DataFrame, b: DataFrame, alpha: float = 1.0, side: str = "left", lower: bool = True, trans: bool = False, unit: bool = False) -> DataFrame:
    """alpha op(A) B, or alpha B op(A) from the right, of which only one triangle of A is read."""
    part = triangle(a, lower, unit)
    part = transpose(part) if trans else part
    made = multiply(part, b) if side == "left" else multiply(b, part)
    return made.select("i", "j", (alpha * F.col("v")).alias("v"))


def triangular_solve(
    a: DataFrame, b: DataFrame, n: int, columns: int, side: str = "left", lower: bool = True, trans: bool = False, unit: bool = False, tile: int = TILE
) -> DataFrame:
    """X of op(A) X = B, or of X op(A) = B from the right; ``columns`` is B's other size."""
    if side == "right":
        return transpose(triangular_solve(a, transpose(b), n, columns, "left", lower, not trans, unit, tile))
    part = triangle(a, lower, unit)
    part, lower = (transpose(part), not lower) if trans else (part, lower)
    right = b.select("i", "j", "v")
    if not lower:
        part, right = _upside_down(part, n, True), _upside_down(right, n, False)
    # rows of B that are absent still get a part of the solution
    whole = b.sparkSession.range(0, sized(columns, tile), tile).select(F.col("id").alias("j"))
    rows = b.sparkSession.range(0, sized(n, tile), tile).select(F.col("id").alias("i")).crossJoin(whole)
    full = to_tiles(right.unionByName(rows.select("i", "j", F.lit(0.0).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v")), tile)
    solved = solve_lower_tiles(to_tiles(with_diagonal(part, n, tile), tile), full, sized(n, tile) // tile, sized(columns, tile) // tile, tile)
    entries = from_tiles(solved, tile, n, columns)
    return entries if lower else _upside_down(entries, n, False)


def general_product(
    a: DataFrame, b: DataFrame, c: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0, trans_a: bool = False, trans_b: bool = False
) -> DataFrame:
    """alpha op(A) op(B) + beta C."""
    made = multiply(transpose(a) if trans_a else a, transpose(b) if trans_b else b)
    return scaled_sum(made, c if c is not None else made.limit(0), alpha, beta)


def symmetric_update(a: DataFrame, c: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0, lower: bool = True, trans: bool = False) -> DataFrame:
    """One triangle of alpha A A^T + beta C, of A^T A if ``trans``."""
    return triangle(general_product(a, a, c, alpha, beta, trans, not trans), lower)


def lower_inverse(lower: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """L^-1, tile by tile."""
    spark = lower.sparkSession
    ones = spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    return triangular_solve(lower, ones, n, n, tile=tile)


def gram(lower: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """L^T L of a lower triangle."""
    tiles = cut(to_tiles(triangle(lower), tile))
    return from_tiles(product(transposed(tiles, tile), tiles, tile), tile, n, n)


def positive_inverse(a: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """Inverse of a positive definite matrix of any size: its factor, the factor's inverse, and that one's Gram matrix."""
    lower = tiled_cholesky(_dense_tiles_of(a, n, tile), sized(n, tile), tile)
    return gram(lower_inverse(lower.where((F.col("i") < n) & (F.col("j") < n)), n, tile), n, tile)


def _dense_tiles_of(a: DataFrame, n: int, tile: int) -> DataFrame:
    """All entries of a padded matrix, zeros too."""
    size = sized(n, tile)
    cells = a.sparkSession.range(size * size).select(F.expr(f"id div {size}").alias("i"), (F.col("id") % size).alias("j"))
    return cells.join(with_diagonal(a, n, tile), ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def block_qr(a: DataFrame, rows: int, columns: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Q and R of a matrix of full column rank, by block columns of classical Gram-Schmidt done twice.

    Each block column is made orthogonal to those before it, twice, and then
    factorised by its Gram matrix, twice as well; R has a positive diagonal.
    Memory is a tile, jobs are as many as block columns.
    """
    size = sized(columns, tile)
    # columns beyond the size get rows of their own, so that they are orthogonal to all
    high = sized(rows, tile)
    padded = a.select("i", "j", "v").unionByName(
        a.sparkSession.range(columns, max(columns, size)).select((F.col("id") - columns + high).alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    )
    left = cut(to_tiles(padded, tile))
    q, r = None, None
    for k in range(size // tile):
        panel, factors = cut(left.where(F.col("bj") == k)), []
        for _ in range(2):
            if q is not None:
                share = cut(product(transposed(q, tile), panel, tile))
                factors.append(share)
                back = product(q, share, tile).select(*_KEYS, F.col("t").alias("x"))
                panel = cut(panel.join(back, _KEYS, "full").select(*_KEYS, _difference(tile)(_or_zeros("t", tile), _or_zeros("x", tile)).alias("t")))
            square = product(transposed(panel, tile), panel, tile)
            upper = cut(square.select(*_KEYS, _tile_function(_upper_factor, tile)("t").alias("t")))
            known = F.broadcast(upper.select(F.col("t").alias("d")))  # one tile
            panel = cut(panel.crossJoin(known).select(*_KEYS, _tile_function(_right_divided, tile)("t", "d").alias("t")))
            factors.append(upper)
        r = _joined_factors(r, factors, tile, q is not None)
        q = panel if q is None else q.unionByName(panel)
    return from_tiles(q, tile, rows, columns), from_tiles(r, tile, columns, columns)


def _or_zeros(column: str, tile: int):
    return F.coalesce(F.col(column), F.array_repeat(F.lit(0.0), tile * tile))


def _difference(tile: int) -> Callable:
    return _tile_function(np.subtract, tile)


def _upper_factor(square: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky(square).T


def _right_divided(panel: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """panel upper^-1."""
    return solve_lower(upper.T, panel.T).T


def _joined_factors(r: DataFrame | None, factors: list[DataFrame], tile: int, several: bool) -> DataFrame:
    """R with the block column that two rounds of shares and triangles make: S1 + S2 U1 above U2 U1."""
    if several:
        share1, upper1, share2, upper2 = factors
        second = product(share2, upper1.select(F.col("bj").alias("bi"), "bj", "t"), tile).select(*_KEYS, F.col("t").alias("x"))
        above = share1.join(second, _KEYS, "full").select(*_KEYS, _tile_function(np.add, tile)(_or_zeros("t", tile), _or_zeros("x", tile)).alias("t"))
        made = above.unionByName(product(upper2, upper1, tile))
    else:
        made = product(factors[1], factors[0], tile)
    return cut(made if r is None else r.unionByName(made))

