"""Matrix queries: products, layouts, norms, factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog.tables import QUANTITY_MATRIX, RAMP, quantity_matrix, ramp, square, square_sql, table
from gridloom.operators import factorise, tiles, toolkit
from gridloom.operators import matrices as m
from gridloom.plans.durable import cut

TILE, N_SPD, N_LU = 8, 16, 8


def _rounded(df: DataFrame, column: str = "v", places: int = 3) -> DataFrame:
    return df.withColumn(column, F.round(column, places))


def _rhs(spark: SparkSession) -> DataFrame:
    return spark.range(40).select(F.col("id").alias("i"), (F.lit(2.0) - F.col("id") % 3).alias("x"))


RHS = "SELECT i, 2.0 - i % 3 AS x FROM range(40) t(i)"


def positive_matrix(spark: SparkSession, n: int = N_SPD) -> DataFrame:
    """Diagonally dominant and symmetric: ((i + j) % 7) / 10, plus n on the diagonal."""
    base = square(spark, n).select("i", "j", (((F.col("i") + F.col("j")) % 7) / 10.0).alias("v"))
    return m.add_to_diagonal(base, float(n))


def lu_pattern(spark: SparkSession, n: int = N_LU) -> DataFrame:
    """20 on the diagonal, -1 beside it and where i + j is a multiple of 3; other entries absent."""
    kept = (F.col("i") == F.col("j")) | (F.abs(F.col("i") - F.col("j")) == 1) | ((F.col("i") + F.col("j")) % 3 == 0)
    return square(spark, n).where(kept).select("i", "j", F.when(F.col("i") == F.col("j"), 20.0).otherwise(-1.0).alias("v"))


def block_pattern(spark: SparkSession, blocks: int = 24) -> DataFrame:
    """Blocks of the sparse LU input that are there: the diagonals and the even and multiple-of-three rule."""
    i, j = F.col("i"), F.col("j")
    absent = ((i < j) & (i % 3 != 0)) | ((i > j) & (j % 3 != 0)) | (i % 2 == 1) | (j % 2 == 1)
    kept = (i == j) | (i - 1 == j) | (i == j - 1) | ~absent
    return square(spark, blocks).where(kept).withColumnsRenamed({"i": "bi", "j": "bj"})


def matmul(spark, sf_dir):
    a = quantity_matrix(spark, sf_dir)
    return _rounded(m.multiply(a, a))


def matmul_tiles(spark, sf_dir):
    a = quantity_matrix(spark, sf_dir)
    t = cut(tiles.to_tiles(a, TILE))
    return _rounded(tiles.from_tiles(tiles.product(t, t, TILE), TILE))


def tile_layout(spark, sf_dir):
    return m.tiled(quantity_matrix(spark, sf_dir), TILE)


def tile_roundtrip(spark, sf_dir):
    return m.untiled(m.tiled(quantity_matrix(spark, sf_dir), TILE), TILE)


def gather_tile(spark, sf_dir):
    return m.gather_tile(quantity_matrix(spark, sf_dir), TILE, 1, 2)


def scatter_tile(spark, sf_dir):
    a = quantity_matrix(spark, sf_dir)
    part = m.gather_tile(a, TILE, 0, 0).withColumn("v", F.lit(-1.0))
    return m.scatter_tile(a, part, TILE, 2, 1)


def add_diagonal(spark, sf_dir):
    return m.add_to_diagonal(quantity_matrix(spark, sf_dir), 0.5)


def identity_matrix(spark, sf_dir):
    return m.identity_like(square(spark, 12))


def spd_matrix(spark, sf_dir):
    return _rounded(positive_matrix(spark), places=6)


def spmv(spark, sf_dir):
    return _rounded(m.times_vector(quantity_matrix(spark, sf_dir), ramp(spark)), "x")


def spmv_transposed(spark, sf_dir):
    return _rounded(m.times_vector(m.transpose(quantity_matrix(spark, sf_dir)), ramp(spark)), "x")


def spmv_scaled(spark, sf_dir):
    return _rounded(m.scaled_times_vector(quantity_matrix(spark, sf_dir), ramp(spark), _rhs(spark), 0.5, 2.0), "x")


def transpose_matrix(spark, sf_dir):
    return m.transpose(quantity_matrix(spark, sf_dir))


def matrix_sum(spark, sf_dir):
    a = quantity_matrix(spark, sf_dir)
    return _rounded(m.scaled_sum(a, m.transpose(a), 2.0, -0.5))


def sum_duplicates(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    triplets = items.select((F.col("l_partkey") % 50).alias("i"), (F.col("l_suppkey") % 50).alias("j"), F.col("l_tax").alias("v"))
    return _rounded(m.sum_duplicates(triplets), places=4)


def drop_entries(spark, sf_dir):
    return m.drop_small(quantity_matrix(spark, sf_dir), 900.0)


def permute_matrix(spark, sf_dir):
    p = spark.range(40).select(F.col("id").alias("old"), ((F.col("id") * 7 + 3) % 40).alias("new"))
    return m.permute(quantity_matrix(spark, sf_dir), p, m.inverse_permutation(p))


def permute_vector(spark, sf_dir):
    p = spark.range(40).select(F.col("id").alias("old"), ((F.col("id") * 7 + 3) % 40).alias("new"))
    return m.permute_vector(ramp(spark), p)


def running_sum(spark, sf_dir):
    return m.running_sum(ramp(spark))


def symmetric_expansion(spark, sf_dir):
    return m.symmetric(quantity_matrix(spark, sf_dir).where("i >= j"))


def zero_based(spark, sf_dir):
    return m.zero_based(quantity_matrix(spark, sf_dir))


def diagonal_blocks(spark, sf_dir):
    return m.diagonal_blocks(quantity_matrix(spark, sf_dir), TILE)


def matrix_norms(spark, sf_dir):
    a = quantity_matrix(spark, sf_dir)
    rows = m.row_norm(a).select(F.lit("rows").alias("kind"), F.round("norm", 3).alias("norm"))
    return rows.union(m.column_norm(a).select(F.lit("columns").alias("kind"), F.round("norm", 3).alias("norm")))


def vector_dots(spark, sf_dir):
    both = ramp(spark).join(_rhs(spark).withColumnRenamed("x", "y"), "i")
    return both.agg(*m.dots({"xx": ("x", "x"), "xy": ("x", "y"), "yy": ("y", "y")}))


def vector_updates(spark, sf_dir):
    both = ramp(spark).join(_rhs(spark).withColumnRenamed("x", "y"), "i")
    x, y = F.col("x"), F.col("y")
    return both.select("i", (y + 3.0 * x).alias("axpy"), (x - 0.5 * y).alias("gradient"), (0.25 * x + y).alias("direction"), (y - (x / 4.0) * y).alias("ratio"))


def tile_errors(spark, sf_dir):
    a = quantity_matrix(spark, sf_dir)
    return _rounded(m.squared_error(a, m.drop_small(m.transpose(a), 500.0), TILE), "error")


def lu_input(spark, sf_dir):
    return lu_pattern(spark)


def lu_blocks(spark, sf_dir):
    return block_pattern(spark)


def _factor(spark):
    return tiles.block_lu(lu_pattern(spark), N_LU, 4)


def sparse_lu(spark, sf_dir):
    return _rounded(_factor(spark), places=6)


def lu_split(spark, sf_dir):
    a = _factor(spark)
    lower = m.unit_lower(a).select(F.lit("L").alias("part"), "i", "j", "v")
    return _rounded(lower.union(m.upper(a).select(F.lit("U").alias("part"), "i", "j", "v")), places=6)


def lu_check(spark, sf_dir):
    a = _factor(spark)
    product = m.multiply(m.unit_lower(a), m.upper(a))
    return _rounded(m.squared_error(lu_pattern(spark), product, 4), "error", 7)


def cholesky(spark, sf_dir):
    return _rounded(factorise.tiled_cholesky(positive_matrix(spark), N_SPD, 4), places=6)


def cholesky_residual(spark, sf_dir):
    """Norm of L L^T - A over that of A."""
    a = positive_matrix(spark)
    lower = factorise.tiled_cholesky(a, N_SPD, 4)
    off = m.row_norm(m.scaled_sum(m.multiply(lower, m.transpose(lower)), a, 1.0, -1.0)).withColumnRenamed("norm", "off")
    return off.crossJoin(m.row_norm(a)).select((F.col("off") / F.col("norm") < 1e-12).alias("ok"))


def spd_inverse(spark, sf_dir):
    return _rounded(tiles.positive_inverse(positive_matrix(spark), N_SPD, 6), places=8)


def inverse_residual(spark, sf_dir):
    a = positive_matrix(spark)
    off = m.scaled_sum(m.multiply(a, tiles.positive_inverse(a, N_SPD, 6)), m.identity_like(square(spark, N_SPD)), 1.0, -1.0)
    return m.row_norm(off).select((F.col("norm") < 1e-10).alias("ok"))


def triangular_inverse(spark, sf_dir):
    """L times its inverse: the identity."""
    lower = tiles.triangle(positive_matrix(spark))
    return _present(m.multiply(lower, tiles.lower_inverse(lower, N_SPD, 6)))


def _present(a, places=6):
    """Entries that are not zero but for rounding."""
    return a.where(F.abs("v") > 1e-9).select("i", "j", F.round("v", places).alias("v"))


def trmm(spark, sf_dir):
    a = positive_matrix(spark)
    return _present(tiles.triangular_product(a, a, 2.0, lower=True, trans=True))


def trsm(spark, sf_dir):
    """What a triangle was multiplied by comes back."""
    a = positive_matrix(spark)
    return _present(tiles.triangular_solve(a, tiles.triangular_product(a, a, side="right", lower=False), N_SPD, N_SPD, side="right", lower=False, tile=6))


def gemm(spark, sf_dir):
    a = positive_matrix(spark).where("i < 9")
    return _present(tiles.general_product(a, a, a, 2.0, -1.0, True, False))


def syrk(spark, sf_dir):
    a = positive_matrix(spark)
    return _present(tiles.symmetric_update(a, a, 1.0, 0.5))


def lauum(spark, sf_dir):
    return _present(tiles.gram(positive_matrix(spark), N_SPD, 6))


def block_qr(spark, sf_dir):
    """Q times R, and the products of Q's columns."""
    a = positive_matrix(spark)
    q, r = tiles.block_qr(a, N_SPD, N_SPD, 6)
    q = cut(q)
    back = _present(m.multiply(q, r)).select(F.lit("qr").alias("part"), "i", "j", "v")
    return back.unionByName(_present(m.multiply(m.transpose(q), q)).select(F.lit("qq").alias("part"), "i", "j", "v"))


def block_entries(spark, blocks: int = 24, side: int = 4) -> DataFrame:
    """Numbers in the blocks of the sparse LU input, with a heavy diagonal."""
    n = blocks * side
    cells = square(spark, n).withColumns({"bi": F.expr(f"i div {side}"), "bj": F.expr(f"j div {side}")}).join(block_pattern(spark, blocks), ["bi", "bj"])
    v = ((F.col("i") * 7 + F.col("j") * 5) % 11 - 5.5) / 11
    return cells.select("i", "j", (v + F.when(F.col("i") == F.col("j"), float(n)).otherwise(0.0)).alias("v"))


def block_lu_product(spark, sf_dir):
    """L times U of a block-sparse matrix: the matrix."""
    lu = cut(tiles.block_lu(block_entries(spark), 96, 16))
    return _present(m.multiply(m.unit_lower(lu), m.upper(lu)))


def _solved(spark, method: str, part=lambda a: a):
    """The known vector comes back from its product with what the method reads."""
    a = positive_matrix(spark)
    known = ramp(spark, N_SPD)
    right = m.times_vector(part(a), known)
    g = F.lit(0).cast("long").alias("g")
    return toolkit.solve(a.select(g, "i", "j", "v"), right.select(g, "i", "x"), method).select("i", F.round("x", 8).alias("x"))


def lu_solve(spark, sf_dir):
    return _solved(spark, "lu")


def cholesky_solve(spark, sf_dir):
    return _solved(spark, "cholesky")


def qr_solve(spark, sf_dir):
    return _solved(spark, "qr")


def triangular_solves(spark, sf_dir):
    """All four triangular solves, each of its own product."""
    parts = {
        "lower": tiles.triangle, "upper": lambda a: tiles.triangle(a, False),
        "lower_transposed": lambda a: m.transpose(tiles.triangle(a)), "upper_transposed": lambda a: m.transpose(tiles.triangle(a, False)),
    }
    made = [_solved(spark, k, part).select(F.lit(k).alias("kind"), "i", "x") for k, part in parts.items()]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


def incomplete_lu(spark, sf_dir):
    """L times U without fill-in gives the matrix on its own entries."""
    a = lu_pattern(spark)
    lu = toolkit.incomplete_lu(a.withColumn("g", F.lit(0).cast("long"))).drop("g")
    return m.multiply(m.unit_lower(lu), m.upper(lu)).join(a.select("i", "j"), ["i", "j"], "left_semi").select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


def cholesky_update(spark, sf_dir):
    """The factor with a vector added, times its transpose."""
    lower = factorise.tiled_cholesky(positive_matrix(spark), N_SPD, 4).withColumn("g", F.lit(0).cast("long"))
    new = toolkit.updated_factor(lower, ramp(spark, N_SPD).withColumn("g", F.lit(0).cast("long"))).drop("g")
    return _present(m.multiply(new, m.transpose(new)))


def permuted_symmetric(spark, sf_dir):
    p = spark.range(N_SPD).select(F.col("id").alias("old"), ((F.col("id") * 7 + 3) % N_SPD).alias("new"))
    return _present(toolkit.permuted_symmetric(positive_matrix(spark), p))


def tall_qr(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    _, r = factorise.tall_qr(rows, 64)
    return _rounded(r, places=5)


def tall_qr_q(spark, sf_dir):
    """Products of the columns of Q: the identity."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q, _ = factorise.tall_qr(rows, 64)
    pairs = q.select("q", F.posexplode("q").alias("i", "x")).select("i", "x", F.posexplode("q").alias("j", "y"))
    return pairs.groupBy("i", "j").agg((F.round(F.sum(F.col("x") * F.col("y")), 6) + 0.0).alias("v"))


QUERIES = {
    f.__name__: f
    for f in (
        matmul, matmul_tiles, tile_layout, tile_roundtrip, gather_tile, scatter_tile, add_diagonal, identity_matrix, spd_matrix, spmv,
        spmv_transposed, spmv_scaled, transpose_matrix, matrix_sum, sum_duplicates, drop_entries, permute_matrix, permute_vector,
        running_sum, symmetric_expansion, zero_based, diagonal_blocks, matrix_norms, vector_dots, vector_updates, tile_errors, lu_input,
        lu_blocks, sparse_lu, lu_split, lu_check, cholesky, cholesky_residual, spd_inverse, inverse_residual, triangular_inverse, tall_qr, tall_qr_q,
        trmm, trsm, gemm, syrk, lauum, block_qr, block_lu_product, lu_solve, cholesky_solve, qr_solve, triangular_solves, incomplete_lu, cholesky_update,
        permuted_symmetric,
    )
}

_A = f"a AS ({QUANTITY_MATRIX})"
_X = f"x AS ({RAMP}), y AS ({RHS})"
_P = "p AS (SELECT i AS old, (i * 7 + 3) % 40 AS new FROM range(40) t(i))"
_SPD = f"s AS (SELECT i, j, ((i + j) % 7) / 10.0 + CASE WHEN i = j THEN {N_SPD} ELSE 0 END AS v FROM ({square_sql(N_SPD)}))"
_LU0 = f"SELECT i, j, CASE WHEN i = j THEN 20.0::DOUBLE ELSE -1.0 END AS v FROM ({square_sql(N_LU)}) WHERE i = j OR abs(i - j) = 1 OR (i + j) % 3 = 0"


def _lu_steps() -> str:
    steps = [f"f0 AS ({_LU0})"]
    for k in range(N_LU - 1):
        steps.append(
            f"""f{k + 1} AS (
  SELECT coalesce(a.i, c.i) AS i, coalesce(a.j, c.j) AS j,
         CASE WHEN a.i > {k} AND a.j = {k} THEN a.v / (SELECT v FROM f{k} WHERE i = {k} AND j = {k})
              ELSE coalesce(a.v, 0) - coalesce(c.v, 0) END AS v
  FROM f{k} a FULL JOIN (
    SELECT l.i, u.j, l.v / (SELECT v FROM f{k} WHERE i = {k} AND j = {k}) * u.v AS v
    FROM f{k} l, f{k} u WHERE l.j = {k} AND l.i > {k} AND u.i = {k} AND u.j > {k}) c ON a.i = c.i AND a.j = c.j)"""
        )
    return ",\n".join(steps)


_F = f"f{N_LU - 1}"
_PRODUCT = "SELECT a.i, b.j, round(sum(a.v * b.v), 3) AS v FROM a JOIN a b ON a.j = b.i GROUP BY a.i, b.j"


def _eliminated(n: int, start: str) -> str:
    """Matrices e0, e1, ...: elimination without pivoting of ``start``; the last has U above the diagonal."""
    steps = [f"e0 AS MATERIALIZED ({start})"]
    for k in range(n - 1):
        steps.append(
            f"""e{k + 1} AS MATERIALIZED (SELECT s.i, s.j, CASE WHEN s.i > {k} THEN s.v - f.v * r.v / (SELECT v FROM e{k} WHERE i = {k} AND j = {k}) ELSE s.v END AS v
FROM e{k} s JOIN e{k} r ON r.i = {k} AND r.j = s.j JOIN e{k} f ON f.j = {k} AND f.i = s.i)"""
        )
    return ", ".join(steps)


def _cleared(n: int) -> str:
    """Matrices e0, e1, ...: the positive matrix beside the identity, cleared column by column."""
    steps = [f"e0 AS MATERIALIZED (SELECT i, j, v FROM p UNION ALL SELECT a.i, b.j + {n}, CASE WHEN a.i = b.j THEN 1.0::DOUBLE ELSE 0 END FROM range({n}) a(i), range({n}) b(j))"]
    for k in range(n):
        pivot = f"(SELECT v FROM e{k} WHERE i = {k} AND j = {k})"
        steps.append(
            f"""e{k + 1} AS MATERIALIZED (SELECT s.i, s.j, CASE WHEN s.i = {k} THEN s.v / {pivot} ELSE s.v - f.v * r.v / {pivot} END AS v
FROM e{k} s JOIN e{k} r ON r.i = {k} AND r.j = s.j JOIN e{k} f ON f.j = {k} AND f.i = s.i)"""
        )
    return ", ".join(steps)


_GRAM = """SELECT i - 1 AS i, j - 1 AS j, sum(CAST(embedding[i] AS DOUBLE) * CAST(embedding[j] AS DOUBLE)) AS v FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) GROUP BY 1, 2"""
_POSITIVE = "p AS (SELECT i, j, CAST((i + j) % 7 / 10.0 AS DOUBLE) + CASE WHEN i = j THEN 16 ELSE 0 END AS v FROM range(16) a(i), range(16) b(j))"
_KNOWN = "SELECT i, 1.0::DOUBLE + i % 7 AS x FROM range(16) t(i)"

ORACLE_SQL = {
    "matmul": f"WITH {_A} {_PRODUCT}",
    "matmul_tiles": f"WITH {_A} {_PRODUCT}",
    "tile_layout": f"WITH {_A} SELECT *, i // {TILE} AS bi, j // {TILE} AS bj, i % {TILE} AS ti, j % {TILE} AS tj FROM a",
    "tile_roundtrip": f"WITH {_A} SELECT * FROM a",
    "gather_tile": f"WITH {_A} SELECT i % {TILE} AS i, j % {TILE} AS j, v FROM a WHERE i // {TILE} = 1 AND j // {TILE} = 2",
    "scatter_tile": f"""WITH {_A} SELECT * FROM a WHERE NOT (i // {TILE} = 2 AND j // {TILE} = 1)
UNION ALL SELECT i + 2 * {TILE}, j + {TILE}, -1.0 FROM a WHERE i < {TILE} AND j < {TILE}""",
    "add_diagonal": f"WITH {_A} SELECT i, j, CASE WHEN i = j THEN v + 0.5 ELSE v END AS v FROM a",
    "identity_matrix": f"SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM ({square_sql(12)})",
    "spd_matrix": f"WITH {_SPD} SELECT i, j, round(CAST(v AS DOUBLE), 6) AS v FROM s",
    "spmv": f"WITH {_A}, {_X} SELECT a.i, round(sum(a.v * x.x), 3) AS x FROM a JOIN x ON x.i = a.j GROUP BY a.i",
    "spmv_transposed": f"WITH {_A}, {_X} SELECT a.j AS i, round(sum(a.v * x.x), 3) AS x FROM a JOIN x ON x.i = a.i GROUP BY a.j",
    "spmv_scaled": f"""WITH {_A}, {_X}, ax AS (SELECT a.i, sum(a.v * x.x) AS s FROM a JOIN x ON x.i = a.j GROUP BY a.i)
SELECT y.i, round(0.5 * coalesce(s, 0) + CAST(2.0 * y.x AS DOUBLE), 3) AS x FROM y LEFT JOIN ax ON ax.i = y.i""",
    "transpose_matrix": f"WITH {_A} SELECT j AS i, i AS j, v FROM a",
    "matrix_sum": f"""WITH {_A} SELECT i, j, round(sum(v), 3) AS v FROM (
  SELECT i, j, 2.0 * v AS v FROM a UNION ALL SELECT j, i, -0.5 * v FROM a) GROUP BY i, j""",
    "sum_duplicates": "SELECT l_partkey % 50 AS i, l_suppkey % 50 AS j, round(sum(l_tax), 4) AS v FROM lineitem GROUP BY 1, 2",
    "drop_entries": f"WITH {_A} SELECT * FROM a WHERE abs(v) > 900",
    "permute_matrix": f"WITH {_A}, {_P} SELECT r.new AS i, c.old AS j, v FROM a JOIN p r ON r.old = a.i JOIN p c ON c.new = a.j",
    "permute_vector": f"WITH {_X}, {_P} SELECT p.new AS i, CAST(x.x AS DOUBLE) AS x FROM x JOIN p ON p.old = x.i",
    "running_sum": f"WITH {_X} SELECT i, CAST(coalesce(sum(x) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before FROM x",
    "symmetric_expansion": f"WITH {_A} SELECT i, j, v FROM a WHERE i >= j UNION ALL SELECT j, i, v FROM a WHERE i > j",
    "zero_based": f"WITH {_A} SELECT i - 1 AS i, j - 1 AS j, v FROM a",
    "diagonal_blocks": f"WITH {_A} SELECT i // {TILE} AS block, i, j, v FROM a WHERE i // {TILE} = j // {TILE}",
    "matrix_norms": f"""WITH {_A} SELECT 'rows' AS kind, round(max(s), 3) AS norm FROM (SELECT sum(abs(v)) AS s FROM a GROUP BY i)
UNION ALL SELECT 'columns', round(max(s), 3) FROM (SELECT sum(abs(v)) AS s FROM a GROUP BY j)""",
    "vector_dots": f"WITH {_X} SELECT CAST(sum(x.x * x.x) AS DOUBLE) AS xx, CAST(sum(x.x * y.x) AS DOUBLE) AS xy, CAST(sum(y.x * y.x) AS DOUBLE) AS yy FROM x JOIN y USING (i)",
    "vector_updates": f"""WITH {_X}, b AS (SELECT x.i, CAST(x.x AS DOUBLE) AS x, CAST(y.x AS DOUBLE) AS y FROM x JOIN y USING (i))
SELECT i, y + 3.0 * x AS axpy, x - 0.5 * y AS gradient, 0.25 * x + y AS direction, y - (x / 4.0) * y AS ratio FROM b""",
    "tile_errors": f"""WITH {_A}, b AS (SELECT j AS i, i AS j, v FROM a WHERE abs(v) > 500)
SELECT coalesce(a.i, b.i) // {TILE} AS bi, coalesce(a.j, b.j) // {TILE} AS bj, round(sum((coalesce(a.v, 0) - coalesce(b.v, 0)) * (coalesce(a.v, 0) - coalesce(b.v, 0))), 3) AS error
FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j GROUP BY 1, 2""",
    "lu_input": _LU0,
    "lu_blocks": f"""SELECT i AS bi, j AS bj FROM ({square_sql(24)})
WHERE abs(i - j) <= 1 OR NOT ((i < j AND i % 3 <> 0) OR (i > j AND j % 3 <> 0) OR i % 2 = 1 OR j % 2 = 1)""",
    "sparse_lu": f"WITH {_lu_steps()} SELECT i, j, round(v, 6) AS v FROM {_F}",
    "lu_split": f"""WITH {_lu_steps()} SELECT 'L' AS part, i, j, round(CASE WHEN i = j THEN 1.0 ELSE v END, 6) AS v FROM {_F} WHERE i >= j
UNION ALL SELECT 'U', i, j, round(v, 6) FROM {_F} WHERE i <= j""",
    "lu_check": f"""WITH {_lu_steps()}, l AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE v END AS v FROM {_F} WHERE i >= j),
u AS (SELECT * FROM {_F} WHERE i <= j),
pr AS (SELECT l.i, u.j, sum(l.v * u.v) AS v FROM l JOIN u ON l.j = u.i GROUP BY l.i, u.j)
SELECT coalesce(a.i, b.i) // 4 AS bi, coalesce(a.j, b.j) // 4 AS bj,
       round(sum((coalesce(a.v, 0) - coalesce(b.v, 0)) * (coalesce(a.v, 0) - coalesce(b.v, 0))), 7) AS error
FROM f0 a FULL JOIN pr b ON a.i = b.i AND a.j = b.j GROUP BY 1, 2""",
    "cholesky_residual": "SELECT true AS ok",
    "inverse_residual": "SELECT true AS ok",
    "tall_qr_q": "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM range(64) a(i), range(64) b(j)",
    "triangular_inverse": "SELECT i, i AS j, 1.0::DOUBLE AS v FROM range(16) t(i)",
    "trmm": f"WITH {_POSITIVE} SELECT x.j AS i, y.j, round(sum(2 * x.v * y.v), 6) AS v FROM p x JOIN p y ON y.i = x.i WHERE x.i >= x.j GROUP BY 1, 2 HAVING abs(sum(x.v * y.v)) > 1e-9",
    "trsm": f"WITH {_POSITIVE} SELECT i, j, round(v, 6) AS v FROM p WHERE v <> 0",
    "gemm": f"""WITH {_POSITIVE}, q AS (SELECT x.j AS i, y.j, 2 * sum(x.v * y.v) AS v FROM p x JOIN p y ON y.i = x.i WHERE x.i < 9 GROUP BY 1, 2)
SELECT q.i, q.j, round(q.v - CASE WHEN q.i < 9 THEN p.v ELSE 0 END, 6) AS v FROM q JOIN p USING (i, j) WHERE abs(q.v - CASE WHEN q.i < 9 THEN p.v ELSE 0 END) > 1e-9""",
    "syrk": f"""WITH {_POSITIVE}, q AS (SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM p x JOIN p y ON y.j = x.j GROUP BY 1, 2)
SELECT q.i, q.j, round(q.v + 0.5 * p.v, 6) AS v FROM q JOIN p USING (i, j) WHERE q.i >= q.j""",
    "lauum": f"WITH {_POSITIVE} SELECT x.j AS i, y.j, round(sum(x.v * y.v), 6) AS v FROM p x JOIN p y ON y.i = x.i WHERE x.i >= x.j AND y.i >= y.j GROUP BY 1, 2 HAVING abs(sum(x.v * y.v)) > 1e-9",
    "block_qr": f"""WITH {_POSITIVE} SELECT 'qr' AS part, i, j, round(v, 6) AS v FROM p WHERE v <> 0
UNION ALL SELECT 'qq', i, i, 1.0::DOUBLE FROM range(16) t(i)""",
    "block_lu_product": """WITH c AS (SELECT i, j, i // 4 AS bi, j // 4 AS bj FROM range(96) a(i), range(96) b(j)),
k AS (SELECT * FROM c WHERE abs(bi - bj) <= 1 OR NOT ((bi < bj AND bi % 3 <> 0) OR (bi > bj AND bj % 3 <> 0) OR bi % 2 = 1 OR bj % 2 = 1))
SELECT i, j, round(CAST(((i * 7 + j * 5) % 11 - 5.5) / 11 AS DOUBLE) + CASE WHEN i = j THEN 96 ELSE 0 END, 6) AS v FROM k""",
    "lu_solve": _KNOWN,
    "cholesky_solve": _KNOWN,
    "qr_solve": _KNOWN,
    "triangular_solves": f"SELECT kind, i, x FROM ({_KNOWN}), (VALUES ('lower'), ('upper'), ('lower_transposed'), ('upper_transposed')) t(kind)",
    "incomplete_lu": "SELECT i, j, CASE WHEN i = j THEN 20.0::DOUBLE ELSE -1 END AS v FROM range(8) a(i), range(8) b(j) WHERE abs(i - j) <= 1 OR (i + j) % 3 = 0",
    "cholesky_update": f"WITH {_POSITIVE} SELECT i, j, round(v + (1.0 + i % 7) * (1.0 + j % 7), 6) AS v FROM p",
    "permuted_symmetric": f"""WITH {_POSITIVE} SELECT least((i * 7 + 3) % 16, (j * 7 + 3) % 16) AS i, greatest((i * 7 + 3) % 16, (j * 7 + 3) % 16) AS j, round(v, 6) AS v
FROM p WHERE i <= j AND v <> 0""",
    "cholesky": f"""WITH {_POSITIVE}, {_eliminated(16, 'SELECT i, j, v FROM p')}
SELECT u.j AS i, u.i AS j, round(u.v / sqrt(d.v), 6) AS v FROM e15 u JOIN e15 d ON d.i = u.i AND d.j = u.i WHERE u.i <= u.j""",
    "spd_inverse": f"WITH {_POSITIVE}, {_cleared(16)} SELECT i, j - 16 AS j, round(v, 8) AS v FROM e16 WHERE j >= 16",
    "tall_qr": f"""WITH {_eliminated(64, _GRAM)}
SELECT u.i, u.j, round(u.v / sqrt(d.v), 5) AS v FROM e63 u JOIN e63 d ON d.i = u.i AND d.j = u.i WHERE u.i <= u.j""",
}
