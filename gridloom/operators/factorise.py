"""Dense factorisations.

Cholesky works on tiles spread over the cluster: for each block column the
diagonal tile is factorised, the tiles below it solved against it, and all
tiles to the right updated, each a join of tiles. Factors of the small
matrices of a group (diagonal blocks, covariances) come from numpy, one group
in one task; such a matrix may have MOST rows. QR is the tall-skinny kind:
each part of the rows is reduced to a triangle and the triangles are reduced
together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.durable import cut
from gridloom.plans.shipping import ship

#: Rows of a matrix that one task may hold.
MOST = 512


def dense(rows: pd.DataFrame) -> np.ndarray:
    n = int(max(rows.i.max(), rows.j.max())) + 1
    if n > MOST:
        raise ValueError(f"a matrix of one group may have {MOST} rows, not {n}")
    out = np.zeros((n, n))
    out[rows.i.to_numpy(), rows.j.to_numpy()] = rows.v.to_numpy()
    return out


def sparse(matrix: np.ndarray, **keys) -> pd.DataFrame:
    i, j = np.indices(matrix.shape)
    return pd.DataFrame({**keys, "i": i.ravel(), "j": j.ravel(), "v": matrix.ravel()})


def per_group(a: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``fn`` of the dense matrix of each group of ``g, i, j, v``."""
    ship(a.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return sparse(fn(dense(rows)), g=rows.g.iloc[0])

    return a.groupBy("g").applyInPandas(run, "g long, i long, j long, v double")


def lower_factor(matrix: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky(matrix)


def positive_inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix through its factor: A^-1 = L^-T L^-1."""
    half = lower_inverse(np.linalg.cholesky(matrix))
    return half.T @ half


def lower_inverse(lower: np.ndarray) -> np.ndarray:
    return solve_lower(lower, np.eye(len(lower)))


def solve_lower(lower: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Forward substitution for all right-hand sides at once."""
    x = np.array(right, dtype=np.float64)
    for r in range(len(lower)):
        x[r] = (x[r] - lower[r, :r] @ x[:r]) / lower[r, r]
    return x


def solve_upper(upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    return solve_lower(upper[::-1, ::-1], np.asarray(right)[::-1])[::-1]


def unit_lu(matrix: np.ndarray) -> np.ndarray:
    """L and U in one matrix, L with ones on the diagonal; no pivoting."""
    a = np.array(matrix, dtype=np.float64)
    for k in range(len(a)):
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a


def tiles_of(a: DataFrame, tile: int) -> DataFrame:
    """``bi, bj, t``: row-major tiles of a dense matrix."""
    entry = F.struct((F.expr(f"(i % {tile}) * {tile} + j % {tile}")).alias("at"), "v")
    grouped = a.groupBy(F.expr(f"i div {tile}").alias("bi"), F.expr(f"j div {tile}").alias("bj")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return grouped.select("bi", "bj", F.transform("e", lambda x: x["v"]).alias("t"))


def entries_of(tiles: DataFrame, tile: int) -> DataFrame:
    spread = tiles.select("bi", "bj", F.posexplode("t").alias("at", "v"))
    return spread.select(F.expr(f"bi * {tile} + at div {tile}").alias("i"), F.expr(f"bj * {tile} + at % {tile}").alias("j"), "v")


def _tile_function(fn: Callable[..., np.ndarray], tile: int):
    def run(*columns: pd.Series) -> pd.Series:
        shaped = ([np.asarray(x, dtype=np.float64).reshape(tile, tile) for x in column] for column in columns)
        return pd.Series([fn(*args).ravel().tolist() for args in zip(*shaped, strict=True)])

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return lambda *columns: F.pandas_udf((one, two, three)[len(columns) - 1], "array<double>")(*columns)


def _solve_right(a: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """a L^-T."""
    return solve_lower(lower, a.T).T


def _less_product(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return c - a @ b.T


def tiled_cholesky(a: DataFrame, n: int, tile: int) -> DataFrame:
    """Lower factor ``i, j, v`` of a positive definite dense matrix whose ``n`` is a multiple of ``tile``."""
    ship(a.sparkSession)
    potrf, trsm, gemm = _tile_function(lower_factor, tile), _tile_function(_solve_right, tile), _tile_function(_less_product, tile)
    rest, done = cut(tiles_of(a.where(F.expr(f"i div {tile} >= j div {tile}")), tile)), None
    for k in range(n // tile):
        here = F.col("bj") == k
        diagonal = rest.where(here & (F.col("bi") == k)).select("bi", "bj", potrf("t").alias("t"))
        below = rest.where(here & (F.col("bi") > k)).crossJoin(F.broadcast(diagonal.select(F.col("t").alias("d"))))
        column = cut(diagonal.unionByName(below.select("bi", "bj", trsm("t", "d").alias("t"))))
        done = column if done is None else done.unionByName(column)
        left = column.select("bi", F.col("t").alias("x"))
        right = column.select(F.col("bi").alias("bj"), F.col("t").alias("y"))
        rest = cut(rest.where(F.col("bj") > k).join(left, "bi").join(right, "bj").select("bi", "bj", gemm("t", "x", "y").alias("t")))
    return entries_of(done, tile).where("i >= j")


def tall_qr(rows: DataFrame, columns: int, parts: int = 8) -> tuple[DataFrame, DataFrame]:
    """Q (``id, q``) and R (``i, j, v``) of rows ``id, vec`` with ``columns`` numbers each.

    Diagonal entries of R are not negative. A task reads its rows in batches
    and keeps one triangle; triangles are stacked and reduced ``parts`` at a
    time until one is left, so a task never holds more than a batch and
    ``columns`` rows. Q needs a matrix of full rank.
    """
    ship(rows.sparkSession)
    vectors = cut(rows.select("id", F.col("vec").cast("array<double>").alias("vec")))

    def triangle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.empty((0, columns))
        for batch in batches:
            if len(batch):
                r = np.linalg.qr(np.vstack([r, np.stack(batch["vec"].to_numpy())]), mode="r")
        if len(r):  # partitions may be empty
            yield pd.DataFrame({"vec": list(r)})

    level = vectors.select("vec")
    while (left := level.rdd.getNumPartitions()) > 1:
        level = cut(level.mapInPandas(triangle, "vec array<double>")).coalesce(-(-left // parts))
    last = level.mapInPandas(triangle, "vec array<double>").collect()  # as many rows as columns
    r = np.linalg.qr(np.array([row.vec for row in last]).reshape(-1, columns), mode="r")
    r = r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]
    upper = rows.sparkSession.createDataFrame(sparse(r), "i long, j long, v double").where("i <= j")

    def back(a: pd.Series) -> pd.Series:
        return pd.Series(list(solve_lower(r.T, np.stack(a.to_numpy()).T).T)) if len(a) else a

    q = vectors.select("id", F.pandas_udf(back, "array<double>")("vec").alias("q"))
    return q, upper
