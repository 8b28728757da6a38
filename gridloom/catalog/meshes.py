"""Adaptive mesh and spectral element queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.tables import table
from gridloom.operators import amr
from gridloom.operators import meshes as m

MESH = amr.Mesh((4, 2, 2), 2)
NX, NY, NZ = (b * amr.SIDE for b in MESH.blocks)
BALL = [(2, True, 0.3, 0.4, 0.5, 0.1, -0.2, 0.3, 0.25, 0.3, 0.35, 0.01, 0.02, -0.01)]
OBJECTS = BALL + [(k, False, 0.6, 0.5, 0.4, 0.5, 0.1, 0.0, 0.2, 0.3, 0.25, 0.0, 0.0, 0.0) for k in (0, 1, 3)]
COLUMNS = "kind int, bounce boolean, cx double, cy double, cz double, mx double, my double, mz double, sx double, sy double, sz double, ix double, iy double, iz double"


def _cells(spark):
    return amr.first_cells(spark, MESH, lambda i: (i * 37 % 101) / 101.0)


def _rounded(df, *columns, places=9):
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


def amr_cells(spark, sf_dir):
    return _rounded(_cells(spark), "v")


def amr_mean7(spark, sf_dir):
    return _rounded(amr.smooth(_cells(spark), MESH, 7), "v")


def amr_mean27(spark, sf_dir):
    return _rounded(amr.smooth(_cells(spark), MESH, 27), "v")


#: Order keys to a cell along x of the mesh of order lines; cells along y and z.
KEYS, WIDE = 512, 8
#: Blocks along x of that mesh to a task of its means.
LENGTH = 256


def _line_mesh(spark, sf_dir):
    """Quantities of all order lines by order, part and supplier; blocks with more than the mean are split."""
    items = table(spark, sf_dir, "lineitem")
    last = items.agg(F.max("l_orderkey")).first()[0] or 0
    mesh = amr.Mesh((last // (KEYS * amr.SIDE) + 1, WIDE // amr.SIDE, WIDE // amr.SIDE), 1)
    at = F.expr(f"l_orderkey div {KEYS}").alias("x"), (F.col("l_partkey") % WIDE).alias("y"), (F.col("l_suppkey") % WIDE).alias("z")
    sums = items.groupBy(*at).agg(F.sum("l_quantity").cast("double").alias("q"))
    cells = amr.first_cells(spark, mesh, lambda i: F.lit(0.0)).join(sums, [*amr.AXES], "left")
    cells = amr.cut(cells.select("level", *amr.AXES, F.coalesce("q", "v").alias("v")))
    totals = cells.groupBy("level", *(F.expr(f"{a} div {amr.SIDE}").alias(f"b{a}") for a in amr.AXES)).agg(F.sum("v").alias("q"))
    mean = totals.agg(F.sum("q").alias("all"), F.count(F.lit(1)).alias("n"))
    marked = totals.crossJoin(F.broadcast(mean)).select("level", "bx", "by", "bz", (F.col("q") * F.col("n") > F.col("all")).cast("int").alias("mark"))
    # as many tasks as the length of the mesh asks for, so that one's share does not grow with it
    tasks = max(spark.sparkContext.defaultParallelism, mesh.blocks[0] // LENGTH)
    return amr.cut(amr.remeshed(cells, marked).repartition(tasks)), mesh


def amr_mean7_lines(spark, sf_dir):
    """Means over faces on the mesh of all order lines, of two levels."""
    return _rounded(amr.smooth(*_line_mesh(spark, sf_dir), 7), "v")


def amr_mean27_lines(spark, sf_dir):
    """Means over all directions on the mesh of all order lines, of two levels."""
    return _rounded(amr.smooth(*_line_mesh(spark, sf_dir), 27), "v")


def amr_checksum(spark, sf_dir):
    return _rounded(amr.checksum(_cells(spark)), "total", places=6)


def amr_split(spark, sf_dir):
    return _rounded(amr.split(_cells(spark)), "v")


def amr_consolidate(spark, sf_dir):
    return _rounded(amr.consolidate(_cells(spark)), "v")


def _mixed(spark):
    """The lower half along x split, the rest as it is."""
    cells = _cells(spark)
    return amr.split(cells.where(F.col("x") < NX // 2)).unionByName(cells.where(F.col("x") >= NX // 2))


def amr_ghosts(spark, sf_dir):
    return _rounded(amr.face_ghosts(_mixed(spark), MESH), "ghost")


def amr_ghosts_uniform(spark, sf_dir):
    return _rounded(amr.face_ghosts(_cells(spark), MESH), "ghost")


def amr_object_motion(spark, sf_dir):
    return _rounded(amr.move(spark.createDataFrame(OBJECTS, COLUMNS)), *(f"{p}{a}" for p in "cms" for a in "xyz"))


def amr_touched(spark, sf_dir):
    parts = None
    for kind in (0, 1, 2, 3):
        one = spark.createDataFrame([o for o in OBJECTS if o[0] == kind], COLUMNS)
        found = amr.touched_blocks(amr.blocks_of(_mixed(spark)), one, MESH).withColumn("kind", F.lit(kind))
        parts = found if parts is None else parts.unionByName(found)
    return parts


def amr_refined(spark, sf_dir):
    """Two rounds around a ball: the sum of all values stays."""
    ball = spark.createDataFrame(BALL, COLUMNS)
    cells = _cells(spark)
    for _ in range(2):
        cells = amr.refine(cells, ball, MESH)
    before, after = amr.checksum(_cells(spark)).first()[0], amr.checksum(cells).first()[0]
    blocks = amr.blocks_of(cells).groupBy("level").agg(F.count(F.lit(1)).alias("blocks"))
    return blocks.withColumn("kept", F.lit(not amr.drifted(before, after, 8)))


def _variables(spark):
    """Three variables on the mixed mesh."""
    return _mixed(spark).crossJoin(F.broadcast(spark.range(3).select(F.col("id").alias("var")))).withColumn("v", F.col("v") * (F.col("var") + 1.0))


def amr_mean7_mixed(spark, sf_dir):
    return _rounded(amr.smooth(_mixed(spark), MESH, 7), "v")


def amr_variables(spark, sf_dir):
    """Sums of each variable after a smoothing of all."""
    return _rounded(amr.checksum(amr.smooth(_variables(spark), MESH, 7, ("var",)), ("var",)), "total", places=6)


def amr_block_counts(spark, sf_dir):
    return amr.block_counts(_mixed(spark))


def amr_touched_round(spark, sf_dir):
    """Half spheroids and cylinders, surfaces and solids."""
    parts = None
    for kind in (*range(4, 16), *range(20, 26)):
        one = spark.createDataFrame([(kind, False, 0.45, 0.55, 0.4, 0.0, 0.0, 0.0, 0.3, 0.35, 0.25, 0.0, 0.0, 0.0)], COLUMNS)
        found = amr.touched_blocks(amr.blocks_of(_mixed(spark)), one, MESH).withColumn("kind", F.lit(kind))
        parts = found if parts is None else parts.unionByName(found)
    return parts


def _bridge(spark):
    """Two by two by two elements that share faces: nodes on a 9 x 9 x 9 grid."""
    points = spark.range(8 * 125).select(F.expr("id div 125").alias("elem"), (F.col("id") % 125).alias("p"))
    place = {
        "x": F.expr("elem % 2 * 4 + p % 5"), "y": F.expr("elem div 2 % 2 * 4 + p div 5 % 5"), "z": F.expr("elem div 4 * 4 + p div 25"),
    }
    return points.select("elem", "p", (place["z"] * 81 + place["y"] * 9 + place["x"]).alias("iglob"))


def _nodes(spark):
    i = F.col("id")
    fields = {f"{k}{a}": (i * step % 7) / scale for k, scale in (("u", 7.0), ("v", 70.0), ("a", 700.0)) for a, step in (("x", 3), ("y", 5), ("z", 2))}
    return spark.range(729).select(i.alias("iglob"), F.lit(0.5).alias("rmass"), *(c.alias(n) for n, c in fields.items()))


def mesh_predictor(spark, sf_dir):
    return _rounded(m.predict(_nodes(spark), 0.5).drop("rmass"), *(f"{k}{a}" for k in "uva" for a in "xyz"))


def mesh_gather(spark, sf_dir):
    return _rounded(m.gather(_bridge(spark), _nodes(spark)), "ux", "uy", "uz")


def mesh_scatter(spark, sf_dir):
    bridge = _bridge(spark)
    values = bridge.select("elem", "p", (F.col("p") * 1.0).alias("fx"), (F.col("elem") * 1.0).alias("fy"), F.lit(1.0).alias("fz"))
    return m.scatter(bridge, values)


def mesh_stress(spark, sf_dir):
    """A rigid shift makes no forces, a stretch ones that add up to nothing."""
    bridge = _bridge(spark)
    made = m.stress(bridge.select("elem", "p", (F.col("p") % 5 * 0.1).alias("ux"), F.lit(2.0).alias("uy"), F.lit(0.0).alias("uz")), 3.0, 1.0, 2.0)
    sums = made.groupBy("elem").agg(*(F.sum(f"f{a}").alias(f"f{a}") for a in "xyz"))
    return _rounded(sums, "fx", "fy", "fz", places=6)


def mesh_stress_mapped(spark, sf_dir):
    """Elements of half the size by their own jacobian: the forces of plain cubes."""
    bridge = _bridge(spark)
    shift = bridge.select("elem", "p", (F.col("p") % 5 * 0.1).alias("ux"), (F.col("p") % 7 * 0.2).alias("uy"), (F.col("elem") * 0.3 * (F.col("p") % 3)).alias("uz"))
    jacobian = F.array(*(F.lit(4.0 if k % 4 == 0 else 0.0) for k in range(9)))
    mapped = m.stress_mapped(shift.withColumns({"jacobian": jacobian, "kappa": F.lit(3.0), "mu": F.lit(1.0)}))
    plain = m.stress(shift, 3.0, 1.0, 0.5).withColumnsRenamed({f"f{a}": f"g{a}" for a in "xyz"})
    off = sum((F.abs(F.col(f"f{a}") - F.col(f"g{a}")) for a in "xyz"), F.lit(0.0))
    return mapped.join(plain, ["elem", "p"]).groupBy("elem").agg((F.max(off) < 1e-9).alias("ok"), F.count(F.lit(1)).alias("points"))


def mesh_step(spark, sf_dir):
    """One whole step: the largest displacement."""
    bridge, nodes = _bridge(spark), m.predict(_nodes(spark), 0.01)
    forces = m.scatter(bridge, m.stress(m.gather(bridge, nodes), 3.0, 1.0, 2.0))
    stepped = m.correct(nodes, forces, 0.01, 364, 0.01)
    m.guard(m.largest_displacement(stepped).first()[0])
    return _rounded(m.trace(stepped, [0, 364, 728]), "ux", "uy", "uz", places=6)


def mesh_corrector(spark, sf_dir):
    forces = _nodes(spark).select("iglob", F.col("ux").alias("fx"), F.col("uy").alias("fy"), F.col("uz").alias("fz"))
    return _rounded(m.correct(_nodes(spark), forces, 0.5, 10, 55.0).select("iglob", "vx", "vy", "vz", "ax", "ay", "az"), "vx", "vy", "vz", "ax", "ay", "az", places=6)


def mesh_largest(spark, sf_dir):
    return _rounded(m.largest_displacement(_nodes(spark)), "norm")


def mesh_connectivity(spark, sf_dir):
    return m.connectivity(_bridge(spark), 2, 100)


QUERIES = {
    f.__name__: f
    for f in (
        amr_cells, amr_mean7, amr_mean27, amr_mean7_lines, amr_mean27_lines, amr_checksum, amr_split, amr_consolidate, amr_ghosts, amr_ghosts_uniform, amr_object_motion, amr_touched,
        amr_refined, amr_mean7_mixed, amr_variables, amr_block_counts, amr_touched_round, mesh_predictor, mesh_gather, mesh_scatter, mesh_stress, mesh_stress_mapped, mesh_step, mesh_corrector, mesh_largest, mesh_connectivity,
    )
}

_CELLS = f"""c AS (SELECT 0 AS level, x, y, z, CAST(((x * {NY * NZ} + y * {NZ} + z) * 37 % 101) / 101.0 AS DOUBLE) AS v
FROM range({NX}) a(x), range({NY}) b(y), range({NZ}) d(z))"""


def _mean_sql(points: int) -> str:
    near = "abs(o.x) + abs(o.y) + abs(o.z) <= 1" if points == 7 else "true"
    return f"""WITH {_CELLS}, o AS (SELECT x, y, z FROM range(-1, 2) a(x), range(-1, 2) b(y), range(-1, 2) d(z))
SELECT c.level, c.x, c.y, c.z, round(sum(n.v) / {points}, 9) + 0.0 AS v FROM c JOIN o ON {near}
JOIN c n ON n.x = least(greatest(c.x + o.x, 0), {NX - 1}) AND n.y = least(greatest(c.y + o.y, 0), {NY - 1}) AND n.z = least(greatest(c.z + o.z, 0), {NZ - 1})
GROUP BY c.level, c.x, c.y, c.z"""


def _lines_sql(points: int) -> str:
    """Every direction's neighbour by level: itself, a share of a coarser one, the finer ones at the border of the block."""
    near = "abs(i) + abs(j) + abs(k) <= 1" if points == 7 else "true"
    wide = {"x": "nx * 4", "y": f"{WIDE}", "z": f"{WIDE}"}
    target = ", ".join(f"least(greatest({a} + {o}, 0), {wide[a]} * (1 << level) - 1) AS t{a}" for a, o in zip("xyz", "ijk", strict=True))
    along = " + ".join(f"CAST(f.t{a} // 4 = f.{a} // 4 AS INTEGER)" for a in "xyz")
    border = " AND ".join(f"CASE WHEN f.t{a} // 4 > f.{a} // 4 THEN n.{a} % 2 = 0 WHEN f.t{a} // 4 < f.{a} // 4 THEN n.{a} % 2 = 1 ELSE true END" for a in "xyz")
    return f"""WITH w AS (SELECT max(l_orderkey) // {4 * KEYS} + 1 AS nx FROM lineitem),
q AS (SELECT l_orderkey // {KEYS} AS x, l_partkey % {WIDE} AS y, l_suppkey % {WIDE} AS z, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT a.x, b.y, d.z, coalesce(q, 0) AS v FROM (SELECT unnest(range(nx * 4)) AS x FROM w) a CROSS JOIN range({WIDE}) b(y) CROSS JOIN range({WIDE}) d(z)
  LEFT JOIN q ON q.x = a.x AND q.y = b.y AND q.z = d.z),
b AS (SELECT x // 4 AS bx, y // 4 AS by_, z // 4 AS bz, sum(v) AS total FROM c GROUP BY 1, 2, 3),
s AS (SELECT c.*, total * (SELECT count(*) FROM b) > (SELECT sum(total) FROM b) AS busy FROM c JOIN b ON bx = x // 4 AND by_ = y // 4 AND bz = z // 4),
m AS (SELECT 0 AS level, x, y, z, v FROM s WHERE NOT busy
  UNION ALL SELECT 1, x * 2 + i, y * 2 + j, z * 2 + k, v / 8 FROM s, range(2) o(i), range(2) p(j), range(2) r(k) WHERE busy),
f AS (SELECT level, x, y, z, {target} FROM m, w, range(-1, 2) o(i), range(-1, 2) p(j), range(-1, 2) r(k) WHERE {near}),
g AS (SELECT f.*, n.v AS seen FROM f JOIN m n ON n.level = f.level AND n.x = tx AND n.y = ty AND n.z = tz
  UNION ALL SELECT f.*, n.v / pow(2, {along}) FROM f JOIN m n ON f.level = 1 AND n.level = 0 AND n.x = tx // 2 AND n.y = ty // 2 AND n.z = tz // 2
  UNION ALL SELECT f.*, n.v FROM f JOIN m n ON f.level = 0 AND n.level = 1 AND n.x // 2 = tx AND n.y // 2 = ty AND n.z // 2 = tz AND {border})
SELECT level, x, y, z, round(sum(seen) / {points}, 9) + 0.0 AS v FROM g GROUP BY 1, 2, 3, 4"""


_MIXED = f"""{_CELLS}, m AS (SELECT level, x, y, z, v FROM c WHERE x >= {NX // 2}
UNION ALL SELECT 1, x * 2 + i, y * 2 + j, z * 2 + k, v / 8 FROM c, range(2) o(i), range(2) p(j), range(2) q(k) WHERE x < {NX // 2}),
o AS (SELECT CAST(x AS INTEGER) AS ox, CAST(y AS INTEGER) AS oy, CAST(z AS INTEGER) AS oz FROM range(-1, 2) a(x), range(-1, 2) b(y), range(-1, 2) d(z) WHERE abs(x) + abs(y) + abs(z) = 1),
f AS (SELECT m.*, ox, oy, oz, x + ox AS tx, y + oy AS ty, z + oz AS tz, x + ox BETWEEN 0 AND {NX} * (1 << level) - 1 AND y + oy BETWEEN 0 AND {NY} * (1 << level) - 1
  AND z + oz BETWEEN 0 AND {NZ} * (1 << level) - 1 AS inside FROM m, o),
g AS (SELECT level, x, y, z, ox, oy, oz, v AS ghost FROM f WHERE NOT inside
UNION ALL SELECT f.level, f.x, f.y, f.z, ox, oy, oz, n.v FROM f JOIN m n ON n.level = f.level AND n.x = tx AND n.y = ty AND n.z = tz WHERE inside
UNION ALL SELECT f.level, f.x, f.y, f.z, ox, oy, oz, n.v / 4 FROM f JOIN m n ON n.level = f.level - 1 AND n.x = tx // 2 AND n.y = ty // 2 AND n.z = tz // 2 WHERE inside
UNION ALL SELECT f.level, f.x, f.y, f.z, ox, oy, oz, sum(n.v) FROM f JOIN m n ON n.level = f.level + 1
  AND CASE WHEN ox = 1 THEN n.x = 2 * tx WHEN ox = -1 THEN n.x = 2 * tx + 1 ELSE n.x // 2 = tx END
  AND CASE WHEN oy = 1 THEN n.y = 2 * ty WHEN oy = -1 THEN n.y = 2 * ty + 1 ELSE n.y // 2 = ty END
  AND CASE WHEN oz = 1 THEN n.z = 2 * tz WHEN oz = -1 THEN n.z = 2 * tz + 1 ELSE n.z // 2 = tz END
  WHERE inside GROUP BY ALL)"""
_BLOCKS = f"bl AS (SELECT DISTINCT level, x // {amr.SIDE} AS bx, y // {amr.SIDE} AS by, z // {amr.SIDE} AS bz FROM m)"


def _touched_sql(objects: list) -> str:
    """Blocks and objects by their distances, scaled by the object's size along each axis."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = ", ".join("(" + ", ".join(str(v) if isinstance(v, (bool, int)) else f"{v}::DOUBLE" for v in r) + ")" for r in objects)
    box = ", ".join(f"bl.b{a} / ({n} * (1 << level))::DOUBLE AS l{a}, (bl.b{a} + 1) / ({n} * (1 << level))::DOUBLE AS h{a}" for a, n in zip("xyz", MESH.blocks, strict=True))
    near = ", ".join(f"greatest(0, l{a} - c{a}, c{a} - h{a}) / s{a} AS n{a}, greatest(abs(l{a} - c{a}), abs(h{a} - c{a})) / s{a} AS f{a}" for a in "xyz")
    shapes = ["WHEN kind IN (0, 1) THEN {0}x <= 1 AND {0}y <= 1 AND {0}z <= 1", "WHEN kind IN (2, 3) THEN {0}x * {0}x + {0}y * {0}y + {0}z * {0}z {1} 1"]
    cases = {"n": [], "f": []}
    for p, less in (("n", "<="), ("f", "<")):
        cases[p] += [t.format(p, less) for t in shapes]
        for half in range(6):
            a, upper = "xyz"[half // 2], half % 2 == 1
            side = (f"h{a} >= c{a}" if upper else f"l{a} <= c{a}") if p == "n" else (f"l{a} > c{a}" if upper else f"h{a} < c{a}")
            cases[p].append(f"WHEN kind IN ({4 + 2 * half}, {5 + 2 * half}) THEN {p}x * {p}x + {p}y * {p}y + {p}z * {p}z {less} 1 AND {side}")
        for k, a in enumerate("xyz"):
            u, w = (o for o in "xyz" if o != a)
            cases[p].append(f"WHEN kind IN ({20 + 2 * k}, {21 + 2 * k}) THEN {p}{a} <= 1 AND {p}{u} * {p}{u} + {p}{w} * {p}{w} {less} 1")
    solid, inside = (f"CASE {' '.join(cases[p])} END" for p in "nf")
    return f"""WITH {_MIXED}, {_BLOCKS}, ob({', '.join(names)}) AS (VALUES {rows}), bo AS (SELECT *, {box} FROM bl, ob), di AS (SELECT *, {near} FROM bo)
SELECT level, bx, di.by, bz, CASE WHEN kind % 2 = 1 THEN {solid} ELSE {solid} AND NOT ({inside}) END AS touched, kind FROM di"""


def _moved_sql(objects: list) -> str:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = ", ".join("(" + ", ".join(str(v) if isinstance(v, (bool, int)) else f"{v}::DOUBLE" for v in r) + ")" for r in objects)
    parts = []
    for a in "xyz":
        hit = f"bounce AND ((c{a} + m{a} + s{a} > 1 AND m{a} > 0) OR (c{a} + m{a} - s{a} < 0 AND m{a} < 0))"
        parts += [f"round(c{a} + m{a}, 9) + 0.0 AS c{a}", f"round(CASE WHEN {hit} THEN -m{a} ELSE m{a} END, 9) + 0.0 AS m{a}", f"round(s{a} + i{a}, 9) + 0.0 AS s{a}", f"i{a}"]
    return f"WITH ob({', '.join(names)}) AS (VALUES {rows}) SELECT kind, bounce, {', '.join(parts)} FROM ob"


_ROUND = [(k, False, 0.45, 0.55, 0.4, 0.0, 0.0, 0.0, 0.3, 0.35, 0.25, 0.0, 0.0, 0.0) for k in (*range(4, 16), *range(20, 26))]
_PUSH = f"1e4::DOUBLE * (1 - 2 * a * tau * tau) * exp(-a * tau * tau) / {m.DENSITY}"


def _corrected() -> str:
    source = f"(SELECT {_PUSH} FROM (SELECT pow(pi() * {m.FREQUENCY!r}::DOUBLE, 2) AS a, 55.0::DOUBLE - {m.DELAY!r}::DOUBLE AS tau))"
    new = {a: f"0.5 * (u{a} + CASE WHEN iglob = 10 THEN {source} / 0.5 ELSE 0 END)" if a == "z" else f"0.5 * u{a}" for a in "xyz"}
    parts = ", ".join(f"round(v{a} + 0.25 * ({new[a]}), 6) + 0.0 AS v{a}, round({new[a]}, 6) + 0.0 AS a{a}" for a in "xyz")
    return f"WITH {_NODES} SELECT iglob, {parts} FROM no"


_BRIDGE = """br AS (SELECT elem, p, (elem // 4 * 4 + p // 25) * 81 + (elem // 2 % 2 * 4 + p // 5 % 5) * 9 + elem % 2 * 4 + p % 5 AS iglob FROM range(8) a(elem), range(125) b(p))"""
_NODES = "no AS (SELECT iglob, " + ", ".join(
    f"CAST((iglob * {step} % 7) / {scale} AS DOUBLE) AS {k}{a}" for k, scale in (("u", 7.0), ("v", 70.0), ("a", 700.0)) for a, step in (("x", 3), ("y", 5), ("z", 2))
) + " FROM range(729) t(iglob))"

ORACLE_SQL = {
    "amr_cells": f"WITH {_CELLS} SELECT level, x, y, z, round(v, 9) + 0.0 AS v FROM c",
    "amr_mean7": _mean_sql(7),
    "amr_mean27": _mean_sql(27),
    "amr_mean7_lines": _lines_sql(7),
    "amr_mean27_lines": _lines_sql(27),
    "amr_checksum": f"WITH {_CELLS} SELECT round(sum(v), 6) + 0.0 AS total FROM c",
    "amr_split": f"""WITH {_CELLS} SELECT 1 AS level, x * 2 + i AS x, y * 2 + j AS y, z * 2 + k AS z, round(v / 8, 9) + 0.0 AS v
FROM c, range(2) o(i), range(2) p(j), range(2) q(k)""",
    "amr_consolidate": f"WITH {_CELLS} SELECT -1 AS level, x // 2 AS x, y // 2 AS y, z // 2 AS z, round(sum(v), 9) + 0.0 AS v FROM c GROUP BY 1, 2, 3, 4",
    "amr_ghosts_uniform": f"""WITH {_CELLS}, o AS (SELECT CAST(x AS INTEGER) AS ox, CAST(y AS INTEGER) AS oy, CAST(z AS INTEGER) AS oz
  FROM range(-1, 2) a(x), range(-1, 2) b(y), range(-1, 2) d(z) WHERE abs(x) + abs(y) + abs(z) = 1)
SELECT c.level, c.x, c.y, c.z, ox, oy, oz, round(coalesce(n.v, c.v), 9) + 0.0 AS ghost FROM c CROSS JOIN o
LEFT JOIN c n ON n.x = c.x + ox AND n.y = c.y + oy AND n.z = c.z + oz""",
    "amr_ghosts": f"WITH {_MIXED} SELECT level, x, y, z, ox, oy, oz, round(ghost, 9) + 0.0 AS ghost FROM g",
    "amr_mean7_mixed": f"""WITH {_MIXED} SELECT level, x, y, z, round((v + s) / 7, 9) + 0.0 AS v FROM m JOIN (SELECT level, x, y, z, sum(ghost) AS s FROM g GROUP BY ALL) USING (level, x, y, z)""",
    "amr_variables": f"""WITH {_MIXED}, t AS (SELECT ((SELECT sum(v) FROM m) + (SELECT sum(ghost) FROM g)) / 7 AS total)
SELECT var, round(total * (var + 1), 6) + 0.0 AS total FROM t, range(3) r(var)""",
    "amr_block_counts": f"WITH {_MIXED}, {_BLOCKS} SELECT level, count(*) AS blocks FROM bl GROUP BY level",
    "amr_object_motion": _moved_sql(OBJECTS),
    "amr_touched": _touched_sql(OBJECTS),
    "amr_touched_round": _touched_sql(_ROUND),
    "mesh_corrector": _corrected(),
    "mesh_predictor": f"""WITH {_NODES} SELECT iglob, {', '.join(f'round(u{a} + 0.5 * v{a} + 0.125 * a{a}, 9) + 0.0 AS u{a}, round(v{a} + 0.25 * a{a}, 9) + 0.0 AS v{a}, CAST(0 AS DOUBLE) AS a{a}' for a in 'xyz')} FROM no""",
    "mesh_gather": f"WITH {_BRIDGE}, {_NODES} SELECT elem, p, round(ux, 9) + 0.0 AS ux, round(uy, 9) + 0.0 AS uy, round(uz, 9) + 0.0 AS uz FROM br JOIN no USING (iglob)",
    "mesh_scatter": f"WITH {_BRIDGE} SELECT iglob, CAST(sum(p) AS DOUBLE) AS fx, CAST(sum(elem) AS DOUBLE) AS fy, CAST(count(*) AS DOUBLE) AS fz FROM br GROUP BY iglob",
    "mesh_stress": "SELECT elem, CAST(0 AS DOUBLE) AS fx, CAST(0 AS DOUBLE) AS fy, CAST(0 AS DOUBLE) AS fz FROM range(8) t(elem)",
    "mesh_stress_mapped": "SELECT elem, true AS ok, CAST(125 AS BIGINT) AS points FROM range(8) t(elem)",
    "mesh_largest": f"WITH {_NODES} SELECT round(max(sqrt(ux * ux + uy * uy + uz * uz)), 9) + 0.0 AS norm FROM no",
    "mesh_connectivity": f"WITH {_BRIDGE} SELECT elem // 2 AS zone, iglob // 100 AS part, count(*) AS n FROM br GROUP BY 1, 2",
}
