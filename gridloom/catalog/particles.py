"""Particle queries: 512 atoms on a jittered lattice in a periodic box."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import particles as p

BOX = p.Box((0.0, 0.0, 0.0), (9.6, 9.6, 9.6), (True, True, True), 2.5)
OPEN_BOX = p.Box((0.0, 0.0, 0.0), (8.0, 9.6, 9.6), (False, False, False), 2.5)
DT = 0.001
JITTER = {"x": 37, "y": 53, "z": 29}


def _atoms(spark):
    ids = spark.range(512)
    place = {"x": F.expr("id div 64"), "y": F.expr("id div 8 % 8"), "z": F.col("id") % 8}
    at = [(place[a] * 1.2 + ((F.col("id") * JITTER[a]) % 11) / 100.0).alias(a) for a in p.AXES]
    speed = [(((F.col("id") * k) % 7 - 3) / 10.0).alias(f"v{a}") for a, k in JITTER.items()]
    return ids.select("id", F.lit(1.0).alias("m"), *at, *speed)


def _rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


def particle_cells(spark, sf_dir):
    return p.with_cells(_atoms(spark), OPEN_BOX).select("id", "cx", "cy", "cz")


def neighbour_counts(spark, sf_dir):
    return p.neighbour_pairs(_atoms(spark), BOX).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def lennard_jones(spark, sf_dir):
    return _rounded(p.forces(_atoms(spark), BOX), "fx", "fy", "fz", "pe", places=5)


def lennard_jones_open(spark, sf_dir):
    inside = p.Box((0.0, 0.0, 0.0), (9.6, 9.6, 9.6), (False, False, False), 2.5)
    return _rounded(p.forces(_atoms(spark), inside), "fx", "fy", "fz", "pe", places=5)


def kick_drift(spark, sf_dir):
    pushed = _atoms(spark).withColumns({"fx": F.col("x") - 4, "fy": F.col("y") - 4, "fz": F.col("z") - 4})
    moved = p.drift(p.kick(pushed, 0.5), 0.5, BOX)
    return _rounded(moved.select("id", "x", "y", "z", "vx", "vy", "vz", "ke"), "x", "y", "z", "vx", "vy", "vz", "ke")


def verlet_energies(spark, sf_dir):
    return _rounded(p.energies(p.verlet(_atoms(spark), BOX, DT, 0)), "kinetic", "potential", places=4)


def verlet_steps(spark, sf_dir):
    """Total energy changes by less than a thousandth over five steps."""
    first = p.energies(p.verlet(_atoms(spark), BOX, DT, 0)).first()
    last = p.energies(p.verlet(_atoms(spark), BOX, DT, 5)).first()
    drift = abs(sum(last) - sum(first)) / abs(sum(first))
    return spark.range(1).select(F.lit(drift < 1e-3).alias("ok"))


def force_reductions(spark, sf_dir):
    return _rounded(p.largest_force(p.forces(_atoms(spark), BOX)), "norm", "sum_fx", "sum_fy", "sum_fz", places=4)


def box_cells(spark, sf_dir):
    return spark.createDataFrame([BOX.cells()], "nx int, ny int, nz int")


QUERIES = {
    f.__name__: f
    for f in (particle_cells, neighbour_counts, lennard_jones, lennard_jones_open, kick_drift, verlet_energies, verlet_steps, force_reductions, box_cells)
}

_ATOMS = """a AS (SELECT id, CAST(id // 64 * 1.2 + ((id * 37) % 11) / 100.0 AS DOUBLE) AS x, CAST(id // 8 % 8 * 1.2 + ((id * 53) % 11) / 100.0 AS DOUBLE) AS y,
  CAST(id % 8 * 1.2 + ((id * 29) % 11) / 100.0 AS DOUBLE) AS z, CAST(((id * 37) % 7 - 3) / 10.0 AS DOUBLE) AS vx, CAST(((id * 53) % 7 - 3) / 10.0 AS DOUBLE) AS vy,
  CAST(((id * 29) % 7 - 3) / 10.0 AS DOUBLE) AS vz FROM range(512) t(id))"""


def _near(periodic: bool) -> str:
    def d(c: str) -> str:
        plain = f"(p.{c} - q.{c})"
        return f"{plain} - 9.6::DOUBLE * round({plain} / 9.6::DOUBLE)" if periodic else plain

    return f"""n AS (SELECT p.id, {d('x')} AS dx, {d('y')} AS dy, {d('z')} AS dz FROM a p JOIN a q ON p.id <> q.id),
w AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM n WHERE dx * dx + dy * dy + dz * dz <= 6.25),
s AS (SELECT *, 1 / d2 / d2 / d2 AS s6 FROM w),
f AS (SELECT id, sum(24 * s6 * (2 * s6 - 1) / d2 * dx) AS fx, sum(24 * s6 * (2 * s6 - 1) / d2 * dy) AS fy,
  sum(24 * s6 * (2 * s6 - 1) / d2 * dz) AS fz, sum(2 * s6 * (s6 - 1)) AS pe FROM s GROUP BY id)"""


_FORCES = "SELECT id, round(fx, 5) + 0.0 AS fx, round(fy, 5) + 0.0 AS fy, round(fz, 5) + 0.0 AS fz, round(pe, 5) + 0.0 AS pe FROM f"

ORACLE_SQL = {
    "particle_cells": f"""WITH {_ATOMS} SELECT id, CASE WHEN floor(x * (3 / 8.0::DOUBLE)) BETWEEN 0 AND 2 THEN CAST(floor(x * (3 / 8.0::DOUBLE)) AS BIGINT) END AS cx,
CASE WHEN floor(y * (3 / 9.6::DOUBLE)) BETWEEN 0 AND 2 THEN CAST(floor(y * (3 / 9.6::DOUBLE)) AS BIGINT) END AS cy,
CASE WHEN floor(z * (3 / 9.6::DOUBLE)) BETWEEN 0 AND 2 THEN CAST(floor(z * (3 / 9.6::DOUBLE)) AS BIGINT) END AS cz FROM a""",
    "neighbour_counts": f"WITH {_ATOMS}, {_near(True)} SELECT id, count(*) AS n FROM w GROUP BY id",
    "lennard_jones": f"WITH {_ATOMS}, {_near(True)} {_FORCES}",
    "lennard_jones_open": f"WITH {_ATOMS}, {_near(False)} {_FORCES}",
    "kick_drift": f"""WITH {_ATOMS}, k AS (SELECT id, x, y, z, vx + 0.25 * (x - 4) AS vx, vy + 0.25 * (y - 4) AS vy, vz + 0.25 * (z - 4) AS vz FROM a),
m AS (SELECT *, x + 0.5 * vx AS mx, y + 0.5 * vy AS my, z + 0.5 * vz AS mz FROM k)
SELECT id, round(mx - 9.6 * floor(mx / 9.6), 6) + 0.0 AS x, round(my - 9.6 * floor(my / 9.6), 6) + 0.0 AS y, round(mz - 9.6 * floor(mz / 9.6), 6) + 0.0 AS z,
round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy, round(vz, 6) + 0.0 AS vz, round((vx * vx + vy * vy + vz * vz) / 2, 6) + 0.0 AS ke FROM m""",
    "verlet_energies": f"""WITH {_ATOMS}, {_near(True)}
SELECT round((SELECT sum((vx * vx + vy * vy + vz * vz) / 2) FROM a), 4) + 0.0 AS kinetic, round((SELECT sum(pe) FROM f), 4) + 0.0 AS potential""",
    "verlet_steps": "SELECT true AS ok",
    "force_reductions": f"""WITH {_ATOMS}, {_near(True)}
SELECT arg_max(id, (sqrt(fx * fx + fy * fy + fz * fz), -id)) AS id, round(max(sqrt(fx * fx + fy * fy + fz * fz)), 4) + 0.0 AS norm,
round(sum(fx), 4) + 0.0 AS sum_fx, round(sum(fy), 4) + 0.0 AS sum_fy, round(sum(fz), 4) + 0.0 AS sum_fz FROM f""",
    "box_cells": "SELECT 3 AS nx, 3 AS ny, 3 AS nz",
}
