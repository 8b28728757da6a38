"""Conjugate gradients on ``i, j, v`` matrices: the plain, preconditioned, one-reduction and pipelined forms.

Each step is one join of the matrix with the direction; scalars travel
through the driver, vectors stay distributed and are cut after each step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.matrices import times_vector
from gridloom.plans.durable import cut
from gridloom.plans.shipping import ship

#: Stencils of the Poisson matrices on a grid of p^3, as (weight, offset in x, y and z).
POISSON = {
    7: {"centre": 6.0, "axis": -1.0, "plane": 0.0, "corner": 0.0},
    19: {"centre": 48.0, "axis": -4.0, "plane": -2.0, "corner": 0.0},
}
#: The 27 weights, plane by plane; the third plane is the first.
POISSON_27 = ((-3, 2, -3, 2, -60, 2, -3, 2, -3), (-18, -60, -18, -60, 600, -60, -18, -60, -18))


def poisson_stencil(p: int, points: int) -> list[tuple[int, float]]:
    """Index offsets and weights; offsets are linear, so rows at a face reach over it."""
    found = []
    for z in (-1, 0, 1):
        for y in (-1, 0, 1):
            for x in (-1, 0, 1):
                kind = ("centre", "axis", "plane", "corner")[abs(x) + abs(y) + abs(z)]
                weight = POISSON_27[z == 0][3 * (y + 1) + x + 1] if points == 27 else POISSON[points][kind]
                if weight:
                    found.append(((z * p + y) * p + x, float(weight)))
    return found


def poisson(spark: SparkSession, p: int, points: int = 7) -> DataFrame:
    """Matrix of the Poisson problem on p^3 unknowns."""
    n = p**3
    table = F.broadcast(spark.createDataFrame(poisson_stencil(p, points), "offset long, v double"))
    rows = spark.range(n).select(F.col("id").alias("i")).crossJoin(table)
    return rows.select("i", (F.col("i") + F.col("offset")).alias("j"), "v").where((F.col("j") >= 0) & (F.col("j") < n)).groupBy("i", "j").agg(F.sum("v").alias("v"))


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """``absolute, relative``: norms of A x - b."""
    both = b.withColumnRenamed("x", "b").join(times_vector(a, x).withColumnRenamed("x", "ax"), "i", "left")
    d = F.coalesce("ax", F.lit(0.0)) - F.col("b")
    return both.agg(F.sqrt(F.sum(d * d)).alias("absolute"), F.sqrt(F.sum(d * d) / F.sum(F.col("b") * F.col("b"))).alias("relative"))


def _product(a: DataFrame, state: DataFrame, column: str, name: str) -> DataFrame:
    """``state`` with A times one of its columns."""
    product = times_vector(a, state.select("i", F.col(column).alias("x"))).withColumnRenamed("x", name)
    return state.drop(name).join(product, "i", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def _sum(state: DataFrame, *pairs: tuple[str, str]) -> tuple[float, ...]:
    return tuple(float(v or 0.0) for v in state.agg(*(F.sum(F.col(a) * F.col(b)) for a, b in pairs)).first())


def block_jacobi(a: DataFrame, r: DataFrame, block: int) -> DataFrame:
    """``i, z``: the residual ``i, x`` solved against the diagonal blocks of A, each by its factor."""
    ship(a.sparkSession)
    inside = a.where(F.expr(f"i div {block} = j div {block}"))
    entries = inside.select(F.expr(f"i div {block}").alias("g"), "i", "j", "v")
    rhs = r.select(F.expr(f"i div {block}").alias("g"), "i", F.lit(-1).cast("long").alias("j"), F.col("x").alias("v"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        right = rows[rows.j < 0].sort_values("i")
        at = {i: k for k, i in enumerate(right.i)}
        part = rows[rows.j >= 0]
        matrix = np.zeros((len(at), len(at)))
        matrix[part.i.map(at), part.j.map(at)] = part.v
        lower = np.linalg.cholesky(matrix)
        return pd.DataFrame({"i": right.i, "z": np.linalg.solve(lower.T, np.linalg.solve(lower, right.v.to_numpy()))})

    return entries.unionByName(rhs).groupBy("g").applyInPandas(solve, "i long, z double")


def conjugate_gradient(
    a: DataFrame,
    b: DataFrame,
    steps: int | None = None,
    threshold: float = 1e-10,
    refresh_every: int = 50,
    block: int | None = None,
    check_every: int = 1,
) -> tuple[DataFrame, int]:
    """``i, x`` and the steps made, from x = 0.

    Stops at a squared residual of threshold^2 times that of b, tested every
    ``check_every`` steps, after ten steps for each unknown, or after
    ``steps`` exactly. The residual is computed afresh every
    ``refresh_every`` steps. With ``block``, the residual is preconditioned
    by the diagonal blocks.
    """
    state = cut(b.select("i", F.lit(0.0).alias("x"), F.col("x").alias("r"), F.lit(0.0).alias("p"), F.col("x").alias("b")))
    limit = threshold**2 * _sum(state, ("b", "b"))[0]
    most, before = steps or 10 * state.count(), None
    for done in range(1, most + 1):
        if block:
            z = block_jacobi(a, state.select("i", F.col("r").alias("x")), block)
            state = cut(state.drop("z").join(z, "i"))
        else:
            state = state.withColumn("z", F.col("r"))
        rz, rr = _sum(state, ("r", "z"), ("r", "r"))
        if rr == 0 or (steps is None and (done - 1) % check_every == 0 and rr <= limit):
            return state.select("i", "x"), done - 1
        beta = rz / before if before else 0.0
        state = cut(_product(a, state.withColumn("p", F.col("z") + beta * F.col("p")), "p", "q"))
        alpha, before = rz / _sum(state, ("p", "q"))[0], rz
        state = state.withColumn("x", F.col("x") + alpha * F.col("p"))
        if done % refresh_every == 0:
            state = _product(a, state, "x", "ax").withColumn("r", F.col("b") - F.col("ax")).drop("ax")
        else:
            state = state.withColumn("r", F.col("r") - alpha * F.col("q"))
        state = cut(state.select("i", "x", "r", "p", "b"))
    return state.select("i", "x"), most


def one_reduction_gradient(
    a: DataFrame, b: DataFrame, steps: int | None, pipelined: bool = False, threshold: float = 1e-10, check_every: int = 1
) -> DataFrame:
    """``i, x`` by the forms with one reduction a step.

    Makes ``steps`` steps exactly, or else stops at a squared residual of
    threshold^2 times that of b, tested every ``check_every`` steps as fused
    iterations do, and after ten steps for each unknown.

    Both scalars come from one pass over r, w = A r. The pipelined form keeps
    A p and A s by recurrences, so its product is ready before the scalars.
    """
    state = b.select("i", F.lit(0.0).alias("x"), F.col("x").alias("r"), *(F.lit(0.0).alias(c) for c in ("p", "s", "z")))
    state = cut(_product(a, state, "r", "w"))
    before = alpha = None
    limit = threshold**2 * _sum(state, ("r", "r"))[0]
    for done in range(steps or 10 * state.count()):
        gamma, delta = _sum(state, ("r", "r"), ("w", "r"))
        if gamma == 0 or (steps is None and done % check_every == 0 and gamma <= limit):
            break
        beta = gamma / before if before else 0.0
        alpha = gamma / (delta - beta * gamma / alpha) if before else gamma / delta
        if pipelined:
            state = _product(a, state, "w", "m").withColumn("z", F.col("m") + beta * F.col("z"))
        state = state.withColumns({"p": F.col("r") + beta * F.col("p"), "s": F.col("w") + beta * F.col("s")})
        state = state.withColumns({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("s")})
        if pipelined:
            state = state.withColumn("w", F.col("w") - alpha * F.col("z"))
        else:
            state = _product(a, state, "r", "w")
        state, before = cut(state.select("i", "x", "r", "p", "s", "z", "w")), gamma
    return state.select("i", "x")


def gropp_gradient(a: DataFrame, b: DataFrame, steps: int) -> DataFrame:
    """``i, x`` by the form whose two reductions each overlap a product: A p is kept by a recurrence on A r."""
    state = b.select("i", F.lit(0.0).alias("x"), F.col("x").alias("r"), F.col("x").alias("p"))
    state = cut(_product(a, state, "p", "s"))
    gamma = _sum(state, ("r", "r"))[0]
    for _ in range(steps):
        if gamma == 0:
            break
        alpha = gamma / _sum(state, ("p", "s"))[0]
        state = state.withColumns({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("s")})
        state = cut(_product(a, state, "r", "w"))
        after = _sum(state, ("r", "r"))[0]
        beta, gamma = after / gamma, after
        state = state.withColumns({"p": F.col("r") + beta * F.col("p"), "s": F.col("w") + beta * F.col("s")}).drop("w")
    return state.select("i", "x")
