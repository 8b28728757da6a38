"""Spectral elements: points ``elem, p`` (p = 25 z + 5 y + x) shared through ``iglob`` with nodes ``iglob, ux.., vx.., ax..``."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.shipping import ship

AXES = ("x", "y", "z")
POINTS = 5
#: Density, frequency and delay of the source.
DENSITY, FREQUENCY = 4500.0, 1.0 / 50.0
DELAY = 1.2 / FREQUENCY


def predict(nodes: DataFrame, dt: float) -> DataFrame:
    """Displacement a step on, velocity half a step on, acceleration zero."""
    return nodes.withColumns(
        {
            **{f"u{a}": F.col(f"u{a}") + dt * F.col(f"v{a}") + (dt * dt / 2) * F.col(f"a{a}") for a in AXES},
            **{f"v{a}": F.col(f"v{a}") + (dt / 2) * F.col(f"a{a}") for a in AXES},
            **{f"a{a}": F.lit(0.0) for a in AXES},
        }
    )


def gather(bridge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Displacements at the points of each element."""
    return bridge.join(nodes.select("iglob", *(f"u{a}" for a in AXES)), "iglob").select("elem", "p", *(f"u{a}" for a in AXES))


def scatter(bridge: DataFrame, values: DataFrame) -> DataFrame:
    """Sums at the nodes of ``elem, p, fx, fy, fz``."""
    met = bridge.join(values, ["elem", "p"])
    return met.groupBy("iglob").agg(*(F.sum(f"f{a}").alias(f"f{a}") for a in AXES))


def lobatto() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Five Gauss-Lobatto-Legendre points, weights and the derivative matrix h[i, j] = l_j'(x_i)."""
    x = np.array([-1.0, -math.sqrt(3 / 7), 0.0, math.sqrt(3 / 7), 1.0])
    legendre = np.polynomial.legendre.legval(x, [0, 0, 0, 0, 1])
    weights = 2 / (POINTS * (POINTS - 1) * legendre**2)
    h = np.zeros((POINTS, POINTS))
    for i in range(POINTS):
        for j in range(POINTS):
            if i != j:
                h[i, j] = legendre[i] / (legendre[j] * (x[i] - x[j]))
    h[0, 0], h[-1, -1] = -POINTS * (POINTS - 1) / 4, POINTS * (POINTS - 1) / 4
    return x, weights, h


def element_forces(u: np.ndarray, bulk: float, shear: float, size: float) -> np.ndarray:
    """Elastic forces of a cube of edge ``size`` at its 5 x 5 x 5 points, from displacements of shape (3, z, y, x).

    The weak form on the reference cube: strain by the derivative matrix,
    isotropic stress, and the transposed derivatives weighted by quadrature.
    """
    _, w, h = lobatto()
    scale = 2 / size
    gradient = scale * np.stack([np.einsum("il,czyl->czyi", h, u), np.einsum("jl,czlx->czjx", h, u), np.einsum("kl,clyx->ckyx", h, u)], axis=1)
    strain = (gradient + gradient.transpose(1, 0, 2, 3, 4)) / 2
    trace = np.einsum("iizyx->zyx", strain)
    stress = 2 * shear * strain
    for i in range(3):
        stress[i, i] += (bulk - 2 * shear / 3) * trace
    weight = w[:, None, None] * w[None, :, None] * w[None, None, :] * (size / 2) ** 3
    flux = stress * weight * scale
    return -(np.einsum("li,czyl->czyi", h, flux[:, 0]) + np.einsum("lj,czlx->czjx", h, flux[:, 1]) + np.einsum("lk,clyx->ckyx", h, flux[:, 2]))


def stress(points: DataFrame, bulk: float, shear: float, size: float) -> DataFrame:
    """``elem, p, fx, fy, fz`` from ``elem, p, ux, uy, uz``, one element in a task's step."""
    ship(points.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p")
        u = rows[["ux", "uy", "uz"]].to_numpy().T.reshape(3, POINTS, POINTS, POINTS)
        f = element_forces(u, bulk, shear, size).reshape(3, -1)
        return pd.DataFrame({"elem": rows.elem, "p": rows.p, "fx": f[0], "fy": f[1], "fz": f[2]})

    return points.groupBy("elem").applyInPandas(run, "elem long, p long, fx double, fy double, fz double")


def mapped_forces(u: np.ndarray, jacobian: np.ndarray, kappa: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Forces of one element of any shape: ``jacobian[a, i]`` is the derivative of its own axis a by direction i at each point."""
    _, w, h = lobatto()
    own = np.stack([np.einsum("il,czyl->czyi", h, u), np.einsum("jl,czlx->czjx", h, u), np.einsum("kl,clyx->ckyx", h, u)], axis=1)
    gradient = np.einsum("cazyx,aizyx->cizyx", own, jacobian)
    strain = (gradient + gradient.transpose(1, 0, 2, 3, 4)) / 2
    trace = np.einsum("iizyx->zyx", strain)
    stress = 2 * mu * strain
    for i in range(3):
        stress[i, i] += (kappa - 2 * mu / 3) * trace
    volume = 1 / np.abs(np.linalg.det(np.moveaxis(jacobian, (0, 1), (-2, -1))))
    flux = np.einsum("cizyx,aizyx->cazyx", stress, jacobian) * w[:, None, None] * w[None, :, None] * w[None, None, :] * volume
    return -(np.einsum("li,czyl->czyi", h, flux[:, 0]) + np.einsum("lj,czlx->czjx", h, flux[:, 1]) + np.einsum("lk,clyx->ckyx", h, flux[:, 2]))


def stress_mapped(points: DataFrame) -> DataFrame:
    """``elem, p, fx, fy, fz`` from ``elem, p, ux, uy, uz, jacobian, kappa, mu``: shape and material of each point as a mesh has them."""
    ship(points.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p")
        cube = (POINTS, POINTS, POINTS)
        u = rows[["ux", "uy", "uz"]].to_numpy().T.reshape(3, *cube)
        jacobian = np.stack(rows.jacobian.to_numpy()).T.reshape(3, 3, *cube)
        f = mapped_forces(u, jacobian, rows.kappa.to_numpy().reshape(cube), rows.mu.to_numpy().reshape(cube)).reshape(3, -1)
        return pd.DataFrame({"elem": rows.elem, "p": rows.p, "fx": f[0], "fy": f[1], "fz": f[2]})

    return points.groupBy("elem").applyInPandas(run, "elem long, p long, fx double, fy double, fz double")


def source_term(time: float) -> float:
    """Vertical force of the source at a time, before the mass is divided out."""
    a, tau = (math.pi * FREQUENCY) ** 2, time - DELAY
    return 1e4 * (1 - 2 * a * tau * tau) * math.exp(-a * tau * tau) / DENSITY


def correct(nodes: DataFrame, forces: DataFrame, dt: float, source: int, time: float) -> DataFrame:
    """Accelerations from forces and inverse masses ``rmass``, and velocities completed; the source pushes one node upwards."""
    met = nodes.join(forces, "iglob", "left")
    out = {}
    for a in AXES:
        force = F.coalesce(f"f{a}", F.lit(0.0))
        pushed = F.when(F.col("iglob") == source, force + F.lit(source_term(time)) / F.col("rmass")).otherwise(force) if a == "z" else force
        out[f"a{a}"] = pushed * F.col("rmass")
    met = met.withColumns(out)
    return met.withColumns({f"v{a}": F.col(f"v{a}") + (dt / 2) * F.col(f"a{a}") for a in AXES}).drop(*(f"f{a}" for a in AXES))


def largest_displacement(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.max(F.sqrt(sum((F.col(f"u{a}") * F.col(f"u{a}") for a in AXES), F.lit(0.0)))).alias("norm"))


def guard(norm: float, most: float = 1e25) -> None:
    if not 0 <= norm < most:
        raise ArithmeticError(f"the simulation blew up: displacement {norm}")


def trace(nodes: DataFrame, stations: Sequence[int]) -> DataFrame:
    return nodes.where(F.col("iglob").isin(list(stations))).select("iglob", *(f"u{a}" for a in AXES))


def connectivity(bridge: DataFrame, elements: int, nodes: int) -> DataFrame:
    """``zone, part, n``: points that groups of elements have in groups of nodes."""
    return bridge.groupBy(F.expr(f"elem div {elements}").alias("zone"), F.expr(f"iglob div {nodes}").alias("part")).agg(F.count(F.lit(1)).alias("n"))
