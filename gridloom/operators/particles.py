"""Molecular dynamics on rows ``id, m, x, y, z, vx, vy, vz``.

Particles are dealt into cells at least as wide as the cutoff; a particle
meets those of its own and the 26 cells around it by an equi-join on the
cell, so the force step never pairs particles far apart.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.durable import cut

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Box:
    """Edges of the box from ``low``, periodic or fixed along each axis, and the interaction's range."""

    low: tuple[float, float, float]
    size: tuple[float, float, float]
    periodic: tuple[bool, bool, bool]
    cutoff: float

    def cells(self) -> tuple[int, ...]:
        """Cells along each axis: as many as are at least a cutoff wide; one at least."""
        return tuple(max(1, math.floor(s / self.cutoff * (1 + 1e-12))) for s in self.size)


def with_cells(atoms: DataFrame, box: Box) -> DataFrame:
    """Particles with ``cx, cy, cz``: wrapped where periodic; null cells outside a fixed box."""
    columns = {}
    for axis, low, size, periodic, n in zip(AXES, box.low, box.size, box.periodic, box.cells(), strict=True):
        cell = F.floor((F.col(axis) - low) * (n / size)).cast("long")
        columns[f"c{axis}"] = F.pmod(cell, F.lit(n)) if periodic else F.when(cell.between(0, n - 1), cell)
    return atoms.withColumns(columns)


def _offset(i: int, box: Box, other: Column, own: Column) -> Column:
    """Distance along an axis, to the nearest image where periodic."""
    d = own - other
    return d - box.size[i] * F.round(d / box.size[i]) if box.periodic[i] else d


def neighbour_pairs(atoms: DataFrame, box: Box) -> DataFrame:
    """``id, other, dx, dy, dz, d2`` of ordered pairs within the cutoff."""
    placed = with_cells(atoms.select("id", *AXES), box)
    spark, n = atoms.sparkSession, box.cells()
    around = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    offsets = F.broadcast(spark.createDataFrame(around, "ox int, oy int, oz int"))
    reach = placed.crossJoin(offsets)
    target = {}
    for i, axis in enumerate(AXES):
        cell = F.col(f"c{axis}") + F.col(f"o{axis}")
        target[f"t{axis}"] = F.pmod(cell, F.lit(n[i])) if box.periodic[i] else cell
    reach = reach.withColumns(target).select("id", *AXES, "tx", "ty", "tz").distinct()
    others = placed.select(F.col("id").alias("other"), *(F.col(a).alias(f"other_{a}") for a in AXES), *(F.col(f"c{a}").alias(f"t{a}") for a in AXES))
    met = reach.join(others, ["tx", "ty", "tz"]).where("id <> other")
    met = met.select("id", "other", *(_offset(i, box, F.col(f"other_{a}"), F.col(a)).alias(f"d{a}") for i, a in enumerate(AXES)))
    met = met.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return met.where(F.col("d2") <= box.cutoff**2).dropDuplicates(["id", "other"])


def forces(atoms: DataFrame, box: Box, sigma: float = 1.0, epsilon: float = 1.0) -> DataFrame:
    """``id, fx, fy, fz, pe`` by the Lennard-Jones potential; each of a pair has half its energy."""
    pairs = neighbour_pairs(atoms, box)
    s2 = F.lit(sigma * sigma) / F.col("d2")
    s6 = s2 * s2 * s2
    strength = 24 * epsilon * s6 * (2 * s6 - 1) / F.col("d2")
    sums = [F.sum(strength * F.col(f"d{a}")).alias(f"f{a}") for a in AXES]
    found = pairs.groupBy("id").agg(*sums, F.sum(2 * epsilon * s6 * (s6 - 1)).alias("pe"))
    filled = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("fx", "fy", "fz", "pe")]
    return atoms.select("id").join(found, "id", "left").select("id", *filled)


def kick(atoms: DataFrame, dt: float) -> DataFrame:
    """Half a step of velocities from ``fx, fy, fz``, and the kinetic energy ``ke``."""
    moved = atoms.withColumns({f"v{a}": F.col(f"v{a}") + (dt / 2) * F.col(f"f{a}") / F.col("m") for a in AXES})
    speed2 = sum((F.col(f"v{a}") * F.col(f"v{a}") for a in AXES), F.lit(0.0))
    return moved.withColumn("ke", F.col("m") * speed2 / 2)


def drift(atoms: DataFrame, dt: float, box: Box) -> DataFrame:
    """A step of positions, wrapped into the box where periodic."""
    moved = {}
    for a, low, size, periodic in zip(AXES, box.low, box.size, box.periodic, strict=True):
        x = F.col(a) + dt * F.col(f"v{a}")
        moved[a] = x - size * F.floor((x - low) / size) if periodic else x
    return atoms.withColumns(moved)


def energies(atoms: DataFrame) -> DataFrame:
    return atoms.agg(F.sum("ke").alias("kinetic"), F.sum("pe").alias("potential"))


def largest_force(atoms: DataFrame) -> DataFrame:
    """``id`` and norm of the greatest force, and the sum of all."""
    norm = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy") + F.col("fz") * F.col("fz"))
    sums = [F.sum(f"f{a}").alias(f"sum_f{a}") for a in AXES]
    return atoms.agg(F.max_by("id", F.struct(norm, -F.col("id"))).alias("id"), F.max(norm).alias("norm"), *sums)


def verlet(atoms: DataFrame, box: Box, dt: float, steps: int, sigma: float = 1.0, epsilon: float = 1.0) -> DataFrame:
    """State after ``steps`` + 1 passes of velocity Verlet; the first closing half kick has no length."""
    state = atoms
    for done in range(steps + 1):
        state = cut(state.drop("fx", "fy", "fz", "pe").join(forces(state, box, sigma, epsilon), "id"))
        state = kick(state, dt if done else 0.0)
        if done < steps:
            state = drift(kick(state, dt).drop("ke"), dt, box)
    return state
