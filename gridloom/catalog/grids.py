"""Queries on grids, streams of numbers and integral histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.tables import table
from gridloom.operators import grids as g

N, SWEEPS, STAR_N = 16, 3, 24
SOURCES = [(0.0, 0.0, 1.0, 2.5), (0.5, 1.0, 1.0, 2.5)]


def _start(spark, n=N):
    sources = spark.createDataFrame(SOURCES, "x double, y double, radius double, temperature double")
    return g.zero_cells(spark, n).unionByName(g.heat_borders(sources, n))


def _swept(spark, sweep=g.jacobi_sweep):
    grid = _start(spark)
    for _ in range(SWEEPS):
        grid = sweep(grid, N)
    return grid


def _rounded(grid, column="u", places=6):
    return grid.withColumn(column, F.round(column, places) + 0.0)


def _ramp_grid(spark):
    return g.zero_cells(spark, STAR_N).select("i", "j", (F.col("i") + F.col("j")).cast("double").alias("u"))


def heat_borders(spark, sf_dir):
    sources = spark.createDataFrame(SOURCES, "x double, y double, radius double, temperature double")
    return _rounded(g.heat_borders(sources, N))


def heat_jacobi(spark, sf_dir):
    return _rounded(_swept(spark))


def heat_residual(spark, sf_dir):
    grid = _swept(spark)
    return _rounded(g.squared_change(g.jacobi_sweep(grid, N), grid), "residual")


def heat_gauss_seidel(spark, sf_dir):
    return _rounded(_swept(spark, lambda grid, n: g.gauss_seidel_sweep(grid, n, 8)))


def heat_red_black(spark, sf_dir):
    return _rounded(_swept(spark, g.red_black_sweep(4)))


def heat_relaxed(spark, sf_dir):
    grid, _ = g.relax(_start(spark, 8), 8, 60, check_every=20)
    return _rounded(grid, places=3)


def heat_raster(spark, sf_dir):
    return g.coloured(g.raster(_swept(spark)), g.heat_palette(spark))


def star_stencil(spark, sf_dir):
    return _rounded(g.repeated_stencil(_ramp_grid(spark), g.star_weights(), STAR_N, 2), "out")


def compact_stencil(spark, sf_dir):
    return _rounded(g.stencil(_ramp_grid(spark), g.compact_weights(), STAR_N), "out")


def star_norm(spark, sf_dir):
    return _rounded(g.mean_abs(g.repeated_stencil(_ramp_grid(spark), g.star_weights(), STAR_N, 2)), "norm")


def _numbers(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))


def stream_kernels(spark, sf_dir):
    made = g.stream(_numbers(spark, sf_dir), "a", "b", 3.0)
    return made.agg(*(F.round(F.sum(c), 2).alias(c) for c in ("copy", "scale", "add", "triad")))


def stream_recurrence(spark, sf_dir):
    """Sums of what ten rounds make, which are whole numbers: added up as decimals, as sums of doubles depend on the order."""
    start = _numbers(spark, sf_dir).select("id", F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), F.lit(0.0).alias("c"))
    sums = g.stream_rounds(start, 3.0, 10).agg(*(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("a", "b", "c")))
    return sums.select(*(F.expr(f"{c} div 1000000000").cast("long").alias(c) for c in ("a", "b", "c")))


def vector_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.sum("l_orderkey").alias("total"), F.count(F.lit(1)).alias("n"))


def _pixels(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.select((F.col("l_orderkey") % 16).alias("r"), (F.col("l_partkey") % 16).alias("c"), F.col("l_quantity").alias("value"))


def integral_histogram(spark, sf_dir):
    return g.integral_histogram(_pixels(spark, sf_dir), 16, 16, 5, 10.0)


def region_histogram(spark, sf_dir):
    regions = spark.createDataFrame([(1, 2, 3, 9, 12), (2, 0, 0, 15, 15), (3, 5, 5, 5, 5)], "region long, top long, left long, bottom long, right long")
    return g.region_histogram(g.integral_histogram(_pixels(spark, sf_dir), 16, 16, 5, 10.0), regions)


def image_histogram(spark, sf_dir):
    return g.cell_histogram(_pixels(spark, sf_dir), 5, 10.0, ())


def integral_histograms(spark, sf_dir):
    """One of each image: those of the line numbers."""
    items = table(spark, sf_dir, "lineitem")
    pixels = items.select(
        F.col("l_linenumber").cast("long").alias("image"), (F.col("l_orderkey") % 8).alias("r"), (F.col("l_partkey") % 8).alias("c"), F.col("l_quantity").alias("value")
    )
    return g.integral_histogram(pixels, 8, 8, 5, 10.0, "image")


QUERIES = {
    f.__name__: f
    for f in (
        heat_borders, heat_jacobi, heat_residual, heat_gauss_seidel, heat_red_black, heat_relaxed, heat_raster, star_stencil, compact_stencil,
        star_norm, stream_kernels, stream_recurrence, vector_sum, integral_histogram, region_histogram, image_histogram, integral_histograms,
    )
}

_SRC = "src(x, y, radius, temperature) AS (VALUES " + ", ".join("(" + ", ".join(f"{v}::DOUBLE" for v in s) + ")" for s in SOURCES) + ")"


def _borders(n: int) -> str:
    def side(i: str, j: str, along: str, away: str) -> str:
        d = f"sqrt((pt / {n - 1}::DOUBLE - {along}) * (pt / {n - 1}::DOUBLE - {along}) + ({away}) * ({away}))"
        return f"SELECT {i} AS i, {j} AS j, CASE WHEN {d} <= radius THEN (radius - {d}) / radius * temperature ELSE 0 END AS h FROM range({n}) t(pt), src"

    parts = [side("-1", "pt", "x", "y"), side(str(n), "pt", "x", "1 - y"), side("pt", "-1", "y", "x"), side("pt", str(n), "y", "1 - x")]
    return f"{_SRC}, bo AS (SELECT i, j, sum(h) AS u FROM ({' UNION ALL '.join(parts)}) GROUP BY i, j)"


def _sweeps(n: int, count: int) -> str:
    steps = [_borders(n), f"g0 AS (SELECT a.i, b.j, CAST(0 AS DOUBLE) AS u FROM range({n}) a(i), range({n}) b(j) UNION ALL SELECT i, j, u FROM bo)"]
    for k in range(count):
        steps.append(
            f"""g{k + 1} AS (SELECT c.i, c.j, CASE WHEN c.i BETWEEN 0 AND {n - 1} AND c.j BETWEEN 0 AND {n - 1}
  THEN 0.25 * ((l.u + r.u) + (t.u + d.u)) ELSE c.u END AS u FROM g{k} c
  LEFT JOIN g{k} l ON l.i = c.i AND l.j = c.j - 1 LEFT JOIN g{k} r ON r.i = c.i AND r.j = c.j + 1
  LEFT JOIN g{k} t ON t.i = c.i - 1 AND t.j = c.j LEFT JOIN g{k} d ON d.i = c.i + 1 AND d.j = c.j)"""
        )
    return ", ".join(steps)


_NEIGHBOURS = """LEFT JOIN {g} l ON l.i = c.i AND l.j = c.j - 1 LEFT JOIN {g} r ON r.i = c.i AND r.j = c.j + 1
  LEFT JOIN {g} t ON t.i = c.i - 1 AND t.j = c.j LEFT JOIN {g} d ON d.i = c.i + 1 AND d.j = c.j"""


def _steps(n: int, conditions: list[str]) -> str:
    """Grids g0, g1, ...: each has new values in the cells that its condition names, of the grid before."""
    start = f"SELECT a.i, b.j, CAST(0 AS DOUBLE) AS u FROM range({n}) a(i), range({n}) b(j) UNION ALL SELECT i, j, u FROM bo"
    steps = [_borders(n), f"g0 AS MATERIALIZED ({start})"]
    for k, condition in enumerate(conditions):
        inside = f"c.i BETWEEN 0 AND {n - 1} AND c.j BETWEEN 0 AND {n - 1} AND {condition}"
        mean = f"CASE WHEN {inside} THEN 0.25 * ((l.u + r.u) + (t.u + d.u)) ELSE c.u END"
        steps.append(f"g{k + 1} AS MATERIALIZED (SELECT c.i, c.j, {mean} AS u FROM g{k} c {_NEIGHBOURS.format(g=f'g{k}')})")
    return ", ".join(steps)


def _relaxed_sql(n: int, most: int, every: int) -> str:
    """The first grid of a tested sweep whose squared change is small, or the last."""
    changes = " UNION ALL ".join(f"SELECT {k} AS k, sum((x.u - y.u) * (x.u - y.u)) AS s FROM g{k} x JOIN g{k - 1} y USING (i, j)" for k in range(every, most + 1, every))
    grids = " UNION ALL ".join(f"SELECT {k} AS k, i, j, u FROM g{k}" for k in range(every, most + 1, every))
    chosen = f"SELECT coalesce(min(k) FILTER (WHERE s < {g.STOP}), {most}) FROM ({changes})"
    return f"WITH {_steps(n, ['true'] * most)} SELECT i, j, round(u, 3) + 0.0 AS u FROM ({grids}) WHERE k = ({chosen})"


_IN_ORDER = [f"c.i + c.j = {d}" for d in range(2 * N - 1)]
_BY_COLOUR = [f"(c.i // 4 + c.j // 4) % 2 = {colour} AND c.i % 4 + c.j % 4 = {d}" for colour in (0, 1) for d in range(7)]


def _stencil_sql(weights: list, times: int) -> str:
    values = ", ".join(f"({di}, {dj}, {w!r}::DOUBLE)" for di, dj, w in weights)
    return f"""SELECT c.i, c.j, sum(w.w * (c.i + w.di + c.j + w.dj + t.k)) AS out
FROM (SELECT a.i, b.j FROM range(2, {STAR_N - 2}) a(i), range(2, {STAR_N - 2}) b(j)) c, (VALUES {values}) w(di, dj, w), range({times}) t(k)
GROUP BY c.i, c.j"""


def _rounds_sql(rounds: int) -> str:
    inner = "SELECT CAST(1 AS DOUBLE) AS a, CAST(2 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c FROM lineitem"
    for _ in range(rounds):
        inner = f"SELECT 3.0 * a + 3.0 * (a + 3.0 * a) AS a, 3.0 * a AS b, a + 3.0 * a AS c FROM ({inner})"
    return inner


_PIX = "SELECT l_orderkey % 16 AS r, l_partkey % 16 AS c, CAST(floor(l_quantity / 10) AS BIGINT) AS bin FROM lineitem"
_INT = f"""px AS ({_PIX}), ct AS (SELECT r, c, bin, count(*) AS n FROM px WHERE bin BETWEEN 0 AND 4 GROUP BY r, c, bin),
h AS (SELECT a.r, b.c, k.bin, CAST(coalesce(sum(ct.n), 0) AS BIGINT) AS n
  FROM range(16) a(r), range(16) b(c), range(5) k(bin) LEFT JOIN ct ON ct.r <= a.r AND ct.c <= b.c AND ct.bin = k.bin GROUP BY a.r, b.c, k.bin)"""

ORACLE_SQL = {
    "heat_borders": f"WITH {_borders(N)} SELECT i, j, round(u, 6) + 0.0 AS u FROM bo",
    "heat_jacobi": f"WITH {_sweeps(N, SWEEPS)} SELECT i, j, round(u, 6) + 0.0 AS u FROM g{SWEEPS}",
    "heat_residual": f"WITH {_sweeps(N, SWEEPS + 1)} SELECT round(sum((x.u - y.u) * (x.u - y.u)), 6) + 0.0 AS residual FROM g{SWEEPS + 1} x JOIN g{SWEEPS} y USING (i, j)",
    "heat_gauss_seidel": f"WITH {_steps(N, _IN_ORDER * SWEEPS)} SELECT i, j, round(u, 6) + 0.0 AS u FROM g{len(_IN_ORDER) * SWEEPS}",
    "heat_red_black": f"WITH {_steps(N, _BY_COLOUR * SWEEPS)} SELECT i, j, round(u, 6) + 0.0 AS u FROM g{len(_BY_COLOUR) * SWEEPS}",
    "heat_relaxed": _relaxed_sql(8, 60, 20),
    "integral_histograms": """WITH px AS (SELECT CAST(l_linenumber AS BIGINT) AS image, l_orderkey % 8 AS r, l_partkey % 8 AS c, CAST(floor(l_quantity / 10) AS BIGINT) AS bin FROM lineitem),
ct AS (SELECT image, r, c, bin, count(*) AS n FROM px WHERE bin BETWEEN 0 AND 4 GROUP BY ALL)
SELECT m.image, a.r, b.c, k.bin, CAST(coalesce(sum(ct.n), 0) AS BIGINT) AS n
FROM (SELECT DISTINCT image FROM px) m, range(8) a(r), range(8) b(c), range(5) k(bin)
LEFT JOIN ct ON ct.image = m.image AND ct.r <= a.r AND ct.c <= b.c AND ct.bin = k.bin GROUP BY ALL""",
    "heat_raster": f"""WITH {_sweeps(N, SWEEPS)}, e AS (SELECT min(u) AS low, max(u) AS high FROM g{SWEEPS}),
l AS (SELECT i, j, CAST(floor(255 * (u - low) / (high - low)) AS INTEGER) AS level FROM g{SWEEPS}, e)
SELECT i, j, level,
  CASE WHEN level < 128 THEN 0 WHEN level < 192 THEN level % 64 * 4 ELSE 255 END AS red,
  CASE WHEN level < 64 THEN 0 WHEN level < 128 THEN level % 64 * 4 WHEN level < 192 THEN 255 ELSE 255 - level % 64 * 4 END AS green,
  CASE WHEN level < 64 THEN level % 64 * 4 WHEN level < 128 THEN 255 - level % 64 * 4 ELSE 0 END AS blue FROM l""",
    "star_stencil": f"SELECT i, j, round(out, 6) + 0.0 AS out FROM ({_stencil_sql(g.star_weights(), 3)})",
    "compact_stencil": f"SELECT i, j, round(out, 6) + 0.0 AS out FROM ({_stencil_sql(g.compact_weights(), 1)})",
    "star_norm": "SELECT CAST(6 AS DOUBLE) AS norm",
    "stream_kernels": """SELECT round(sum(l_quantity), 2) AS copy, round(sum(3.0 * l_quantity), 2) AS scale,
round(sum(l_quantity + l_extendedprice), 2) AS add, round(sum(l_quantity + 3.0 * l_extendedprice), 2) AS triad FROM lineitem""",
    "stream_recurrence": f"SELECT CAST(trunc(sum(a) / 1e9) AS BIGINT) AS a, CAST(trunc(sum(b) / 1e9) AS BIGINT) AS b, CAST(trunc(sum(c) / 1e9) AS BIGINT) AS c FROM ({_rounds_sql(10)})",
    "vector_sum": "SELECT CAST(sum(l_orderkey) AS BIGINT) AS total, count(*) AS n FROM lineitem",
    "integral_histogram": f"WITH {_INT} SELECT r, c, bin, n FROM h",
    "region_histogram": f"""WITH px AS ({_PIX}), g(region, t, l, b, r) AS (VALUES (1, 2, 3, 9, 12), (2, 0, 0, 15, 15), (3, 5, 5, 5, 5)),
k AS (SELECT region, bin FROM g, range(5) x(bin) WHERE t > 0 OR true)
SELECT CAST(k.region AS BIGINT) AS region, k.bin, count(px.bin) AS n FROM k JOIN g USING (region)
LEFT JOIN px ON px.bin = k.bin AND px.r BETWEEN g.t AND g.b AND px.c BETWEEN g.l AND g.r GROUP BY k.region, k.bin""",
    "image_histogram": f"SELECT bin, count(*) AS n FROM ({_PIX}) WHERE bin BETWEEN 0 AND 4 GROUP BY bin",
}
