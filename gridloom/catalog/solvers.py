"""Iterative solver and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.dense import _LU0, lu_pattern
from gridloom.catalog.tables import square_sql
from gridloom.operators import graphs
from gridloom.operators import solvers as s

P = 4
N = P**3


def _b(spark):
    return spark.range(N).select(F.col("id").alias("i"), (((F.col("id") % 5) - 2) / 4.0).alias("x"))


def _rounded(x):
    return x.select("i", (F.round("x", 6) + 0.0).alias("x"))


def poisson7(spark, sf_dir):
    return s.poisson(spark, P, 7)


def poisson19(spark, sf_dir):
    return s.poisson(spark, P, 19)


def poisson27(spark, sf_dir):
    return s.poisson(spark, P, 27)


def right_hand_side(spark, sf_dir):
    return _b(spark)


def cg_steps(spark, sf_dir):
    return _rounded(s.conjugate_gradient(s.poisson(spark, P), _b(spark), steps=3)[0])


def cg_converged(spark, sf_dir):
    a, b = s.poisson(spark, P), _b(spark)
    x, _ = s.conjugate_gradient(a, b, threshold=1e-6)
    return s.residual(a, x, b).select((F.col("relative") < 1e-6).alias("ok"))


def cg_residual(spark, sf_dir):
    a, b = s.poisson(spark, P), _b(spark)
    half = b.withColumn("x", F.col("x") * 0.5)
    return s.residual(a, half, b).select(F.round("absolute", 6).alias("absolute"), F.round("relative", 6).alias("relative"))


def pcg_converged(spark, sf_dir):
    a, b = s.poisson(spark, P), _b(spark)
    x, _ = s.conjugate_gradient(a, b, block=16, check_every=2, threshold=1e-3)
    return s.residual(a, x, b).select((F.col("relative") < 1e-3).alias("ok"))


def cg_one_reduction(spark, sf_dir):
    return _rounded(s.one_reduction_gradient(s.poisson(spark, P), _b(spark), 3))


def cg_pipelined(spark, sf_dir):
    return _rounded(s.one_reduction_gradient(s.poisson(spark, P), _b(spark), 3, pipelined=True))


def cg_fused(spark, sf_dir):
    """The pipelined form with a test of convergence every five steps."""
    a, b = s.poisson(spark, P), _b(spark)
    x = s.one_reduction_gradient(a, b, None, pipelined=True, threshold=1e-8, check_every=5)
    off = s.times_vector(a, x).withColumnRenamed("x", "ax").join(b, "i")
    return off.agg((F.max(F.abs(F.col("ax") - F.col("x"))) < 1e-6).alias("ok"))


def cg_gropp(spark, sf_dir):
    return _rounded(s.gropp_gradient(s.poisson(spark, P), _b(spark), 3))


def block_jacobi(spark, sf_dir):
    """Blocks of four unknowns: one line of the grid each."""
    z = s.block_jacobi(s.poisson(spark, P), _b(spark), P)
    return z.select("i", (F.round("z", 9) + 0.0).alias("z"))


def graph_levels(spark, sf_dir):
    return graphs.breadth_first(lu_pattern(spark).where("i > j"), [0])


def graph_components(spark, sf_dir):
    ring = lu_pattern(spark).where("i > j or (i = 0 and j = 3) or (i = 5 and j = 7)")
    return graphs.strong_components(ring)


QUERIES = {
    f.__name__: f
    for f in (
        poisson7, poisson19, poisson27, right_hand_side, cg_steps, cg_converged, cg_residual, pcg_converged, cg_one_reduction, cg_pipelined,
        cg_gropp, cg_fused, block_jacobi, graph_levels, graph_components,
    )
}


def _poisson(points: int) -> str:
    values = ", ".join(f"({offset}, {weight})" for offset, weight in s.poisson_stencil(P, points))
    return f"""SELECT i, i + o AS j, CAST(sum(v) AS DOUBLE) AS v FROM range({N}) r(i), (VALUES {values}) t(o, v)
WHERE i + o BETWEEN 0 AND {N - 1} GROUP BY i, i + o"""


_B = f"SELECT i, CAST(((i % 5) - 2) / 4.0 AS DOUBLE) AS x FROM range({N}) r(i)"


def _cg_sql(steps: int) -> str:
    parts = [f"a AS ({_poisson(7)})", f"b AS ({_B})", "s0 AS (SELECT i, CAST(0 AS DOUBLE) AS x, x AS r, x AS p FROM b)"]
    for k in range(steps):
        parts.append(f"q{k} AS (SELECT a.i, sum(a.v * s.p) AS q FROM a JOIN s{k} s ON s.i = a.j GROUP BY a.i)")
        parts.append(f"al{k} AS (SELECT sum(r * r) / sum(p * q) AS alpha, sum(r * r) AS rr FROM s{k} JOIN q{k} USING (i))")
        parts.append(f"t{k} AS (SELECT i, x + alpha * p AS x, r - alpha * q AS r, p FROM s{k} JOIN q{k} USING (i), al{k})")
        parts.append(f"be{k} AS (SELECT sum(r * r) / (SELECT rr FROM al{k}) AS beta FROM t{k})")
        parts.append(f"s{k + 1} AS (SELECT i, x, r, r + beta * p AS p FROM t{k}, be{k})")
    return f"WITH {', '.join(parts)} SELECT i, round(x, 6) + 0.0 AS x FROM s{steps}"


_EDGES = f"e AS (SELECT j AS u, i AS v FROM ({_LU0}) WHERE i > j)"

ORACLE_SQL = {
    "poisson7": _poisson(7),
    "poisson19": _poisson(19),
    "poisson27": _poisson(27),
    "right_hand_side": _B,
    "cg_steps": _cg_sql(3),
    "cg_one_reduction": _cg_sql(3),
    "cg_pipelined": _cg_sql(3),
    "cg_gropp": _cg_sql(3),
    "cg_converged": "SELECT true AS ok",
    "pcg_converged": "SELECT true AS ok",
    "cg_residual": f"""WITH a AS ({_poisson(7)}), b AS ({_B}),
d AS (SELECT b.i, b.x AS b, sum(a.v * 0.5 * y.x) - b.x AS d FROM b JOIN a ON a.i = b.i JOIN b y ON y.i = a.j GROUP BY b.i, b.x)
SELECT round(sqrt(sum(d * d)), 6) AS absolute, round(sqrt(sum(d * d) / sum(b * b)), 6) AS relative FROM d""",
    # the inverse of a line's block (6 on the diagonal, -1 beside it) by the determinants of its leading parts
    "block_jacobi": f"""WITH b AS ({_B}), d(k, v) AS (VALUES (0, 1), (1, 6), (2, 35), (3, 204), (4, 1189))
SELECT r.i, round(sum(x.v * y.v * b.x) / 1189.0::DOUBLE, 9) + 0.0 AS z FROM range({N}) r(i) JOIN b ON b.i // 4 = r.i // 4
JOIN d x ON x.k = least(r.i, b.i) % 4 JOIN d y ON y.k = 3 - greatest(r.i, b.i) % 4 GROUP BY r.i""",
    "cg_fused": "SELECT true AS ok",
    "graph_levels": f"""WITH RECURSIVE {_EDGES},
w AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS level UNION SELECT e.v, w.level + 1 FROM w JOIN e ON e.u = w.node WHERE w.level < 8)
SELECT node, min(level) AS level FROM w GROUP BY node""",
    "graph_components": f"""WITH RECURSIVE e AS (SELECT j AS u, i AS v FROM ({_LU0}) WHERE i > j OR (i = 0 AND j = 3) OR (i = 5 AND j = 7)),
n AS (SELECT DISTINCT i AS node FROM ({square_sql(8)})),
r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b)
SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
}
