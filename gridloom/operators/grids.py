"""Structured grids as rows ``i, j, u``: sweeps, stencils, borders, rasters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.plans.bounded import broadcast_if_small
from gridloom.plans.durable import cut
from gridloom.plans.shipping import ship

#: Sum of squared changes below which relaxation stops, and the sweeps between two tests.
STOP, CHECK_EVERY = 5e-5, 1000
#: Cells along the side of a block that one task sweeps in order.
BLOCK = 1024


def heat_borders(sources: DataFrame, n: int) -> DataFrame:
    """``i, j, u`` of the four border lines (index -1 or n) around n x n cells.

    Each source ``x, y, radius, temperature`` heats border points within its radius by
    the share of the radius that is left, times its temperature.
    """
    spark = sources.sparkSession
    t = spark.range(n).select(F.col("id").alias("at"), (F.col("id") / (n - 1)).alias("t"))
    sides = {
        "top": (F.lit(-1), F.col("at"), F.col("x"), F.col("y")),
        "bottom": (F.lit(n), F.col("at"), F.col("x"), 1 - F.col("y")),
        "left": (F.col("at"), F.lit(-1), F.col("y"), F.col("x")),
        "right": (F.col("at"), F.lit(n), F.col("y"), 1 - F.col("x")),
    }
    points = t.crossJoin(broadcast_if_small(sources))
    parts = []
    for i, j, along, away in sides.values():
        distance = F.sqrt((F.col("t") - along) * (F.col("t") - along) + away * away)
        heat = F.when(distance <= F.col("radius"), (F.col("radius") - distance) / F.col("radius") * F.col("temperature")).otherwise(0.0)
        parts.append(points.select(i.cast("long").alias("i"), j.cast("long").alias("j"), heat.alias("heat")))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return whole.groupBy("i", "j").agg(F.sum("heat").alias("u"))


def zero_cells(spark: SparkSession, n: int) -> DataFrame:
    cells = spark.range(n * n)
    return cells.select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j"), F.lit(0.0).alias("u"))


def jacobi_sweep(grid: DataFrame, n: int) -> DataFrame:
    """Every cell becomes the mean of its four neighbours' old values; border lines stay.

    Neighbours come from one window along rows and one along columns, so a
    task needs one line at a time.
    """
    row, column = Window.partitionBy("i").orderBy("j"), Window.partitionBy("j").orderBy("i")
    near = grid.withColumns({"left": F.lag("u").over(row), "right": F.lead("u").over(row)})
    near = near.withColumns({"top": F.lag("u").over(column), "bottom": F.lead("u").over(column)})
    inside = F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1)
    mean = F.lit(0.25) * ((F.col("left") + F.col("right")) + (F.col("top") + F.col("bottom")))
    return near.select("i", "j", F.when(inside, mean).otherwise(F.col("u")).alias("u"))


def squared_change(new: DataFrame, old: DataFrame) -> DataFrame:
    both = new.join(old.withColumnRenamed("u", "before"), ["i", "j"])
    d = F.col("u") - F.col("before")
    return both.agg(F.sum(d * d).alias("residual"))


def relax(grid: DataFrame, n: int, most: int, sweep=jacobi_sweep, check_every: int = CHECK_EVERY) -> tuple[DataFrame, int]:
    """Sweep until the squared change of a tested sweep is below STOP, or ``most`` times."""
    for done in range(1, most + 1):
        new = cut(sweep(grid, n))
        tested = done % check_every == 0 or done == most
        if tested and (squared_change(new, grid).first()[0] or 0.0) < STOP:
            return new, done
        grid = new
    return grid, most


def _swept_blocks(cells: DataFrame, n: int, block: int, chosen: Column) -> DataFrame:
    """New ``i, j, u`` of the blocks ``bi, bj`` that are ``chosen``, each swept in order with the lines around it as they are in ``cells``."""
    ship(cells.sparkSession)
    reach = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    near = F.array(*(F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j")) for di, dj in reach))
    inside = F.filter(near, lambda c: c["i"].between(0, n - 1) & c["j"].between(0, n - 1))
    blocks = F.array_distinct(F.transform(inside, lambda c: F.struct(F.floor(c["i"] / block).alias("bi"), F.floor(c["j"] / block).alias("bj"))))
    sent = cells.select("i", "j", "u", F.explode(blocks).alias("b")).select("i", "j", "u", "b.bi", "b.bj").where(chosen)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        top, left = int(rows.bi.iloc[0]) * block, int(rows.bj.iloc[0]) * block
        height, width = min(block, n - top), min(block, n - left)
        i, j = rows.i.to_numpy() - top + 1, rows.j.to_numpy() - left + 1
        u = np.zeros((height + 2, width + 2))
        u[i, j] = rows.u.to_numpy()
        sweep_in_order(u, 1, 1, height, width)
        own = (i >= 1) & (i <= height) & (j >= 1) & (j <= width)
        return pd.DataFrame({"i": rows.i[own], "j": rows.j[own], "u": u[i[own], j[own]]})

    return sent.groupBy("bi", "bj").applyInPandas(run, "i long, j long, u double")


def sweep_in_order(u: np.ndarray, top: int, left: int, height: int, width: int) -> None:
    """Row-major sweep over cells that uses new values above and to the left.

    Cells of an anti-diagonal do not depend on each other, so each is one
    vector operation; the order of all results is that of the row-major walk.
    """
    for d in range(height + width - 1):
        i = np.arange(max(0, d - width + 1), min(height, d + 1))
        r, c = top + i, left + d - i
        u[r, c] = 0.25 * ((u[r, c - 1] + u[r, c + 1]) + (u[r - 1, c] + u[r + 1, c]))


def gauss_seidel_sweep(grid: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """A row-major sweep in which each cell sees the new values above and to the left.

    Blocks of an anti-diagonal do not depend on each other, so they are swept
    side by side, one job for each anti-diagonal; a job reads the blocks of
    three anti-diagonals. All results are those of the row-major walk.
    """
    side = -(-n // block)
    own = F.floor(F.col("i") / block) + F.floor(F.col("j") / block)
    inside = F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1)
    border = cut(grid.where(~inside))
    parts = [grid.where(inside & (own == d)) for d in range(2 * side - 1)]
    for d in range(2 * side - 1):
        around = border
        for part in parts[max(0, d - 1) : d + 2]:
            around = around.unionByName(part)
        parts[d] = cut(_swept_blocks(around, n, block, F.col("bi") + F.col("bj") == d))
    for part in parts:
        border = border.unionByName(part)
    return border


def red_black_sweep(block: int):
    """Sweeps first over the blocks of even, then of odd colour, each colour in one job; inside a block in order."""

    def sweep(grid: DataFrame, n: int) -> DataFrame:
        inside = F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1)
        own = (F.floor(F.col("i") / block) + F.floor(F.col("j") / block)) % 2
        for colour in (0, 1):
            swept = _swept_blocks(grid, n, block, (F.col("bi") + F.col("bj")) % 2 == colour)
            grid = cut(grid.where(~inside | (own != colour)).unionByName(swept))
        return grid

    return sweep


def raster(grid: DataFrame, levels: int = 256) -> DataFrame:
    """``i, j, level``: values scaled from the least to the greatest to 0 .. levels - 1; a flat grid is 0."""
    ends = grid.agg(F.min("u").alias("low"), F.max("u").alias("high"))
    scaled = F.floor((levels - 1) * (F.col("u") - F.col("low")) / (F.col("high") - F.col("low")))
    return grid.crossJoin(F.broadcast(ends)).select("i", "j", F.when(F.col("high") > F.col("low"), scaled).otherwise(0).cast("int").alias("level"))


def heat_colour(level: Column) -> tuple[Column, Column, Column]:
    """Red, green, blue of a level: black over blue, green and yellow to red in four ramps."""
    part, ramp = F.floor(level / 64), (level % 64) * 4
    red = F.when(part < 2, 0).when(part == 2, ramp).otherwise(255)
    green = F.when(part == 0, 0).when(part == 1, ramp).when(part == 2, 255).otherwise(255 - ramp)
    blue = F.when(part == 0, ramp).when(part == 1, 255 - ramp).otherwise(0)
    return red.cast("int"), green.cast("int"), blue.cast("int")


def heat_palette(spark: SparkSession, levels: int = 256) -> DataFrame:
    """``level, red, green, blue``: the colours of all levels, as a table to look them up in."""
    red, green, blue = heat_colour(F.col("level"))
    table = spark.range(levels).select(F.col("id").cast("int").alias("level"))
    return table.select("level", red.alias("red"), green.alias("green"), blue.alias("blue"))


def coloured(levels: DataFrame, palette: DataFrame) -> DataFrame:
    """``i, j, level`` with the colour that the palette has for each level."""
    return levels.join(F.broadcast(palette), "level").select("i", "j", "level", "red", "green", "blue")


def star_weights(radius: int = 2) -> list[tuple[int, int, float]]:
    """Offsets and weights of a discrete divergence along the axes."""
    found = []
    for k in range(1, radius + 1):
        w = 1 / (2 * k * radius)
        found += [(0, k, w), (k, 0, w), (0, -k, -w), (-k, 0, -w)]
    return found


def compact_weights(radius: int = 2) -> list[tuple[int, int, float]]:
    """Offsets and weights of a divergence over the whole square: each ring shares what the star gives its axes."""
    found = []
    for k in range(1, radius + 1):
        side, corner = 1 / (4 * k * (2 * k - 1) * radius), 1 / (4 * k * radius)
        for m in range(1 - k, k):
            found += [(m, k, side), (m, -k, -side), (k, m, side), (-k, m, -side)]
        found += [(k, k, corner), (-k, -k, -corner)]
    return found


def stencil(grid: DataFrame, weights: list[tuple[int, int, float]], n: int, radius: int = 2) -> DataFrame:
    """``i, j, out``: weighted sums over neighbours, for cells at least ``radius`` from the edge.

    Each cell sends its value to the cells that need it; sums are combined
    before the shuffle.
    """
    table = F.broadcast(grid.sparkSession.createDataFrame(weights, "di long, dj long, w double"))
    sent = grid.crossJoin(table).select((F.col("i") - F.col("di")).alias("i"), (F.col("j") - F.col("dj")).alias("j"), (F.col("w") * F.col("u")).alias("x"))
    inside = F.col("i").between(radius, n - 1 - radius) & F.col("j").between(radius, n - 1 - radius)
    return sent.where(inside).groupBy("i", "j").agg(F.sum("x").alias("out"))


def repeated_stencil(grid: DataFrame, weights: list[tuple[int, int, float]], n: int, iterations: int, radius: int = 2) -> DataFrame:
    """Sum of ``iterations`` + 1 stencils, each cell growing by 1 between two of them."""
    out = None
    for _ in range(iterations + 1):
        new = stencil(grid, weights, n, radius)
        out = cut(new if out is None else out.unionByName(new).groupBy("i", "j").agg(F.sum("out").alias("out")))
        grid = cut(grid.withColumn("u", F.col("u") + 1.0))
    return out


def mean_abs(out: DataFrame) -> DataFrame:
    return out.agg(F.avg(F.abs("out")).alias("norm"))


def stream(table: DataFrame, a: str, b: str, scalar: float) -> DataFrame:
    """``id`` with copy, scale, add and triad of two columns; one pass, no shuffle."""
    x, y = F.col(a), F.col(b)
    return table.select("id", x.alias("copy"), (scalar * x).alias("scale"), (x + y).alias("add"), (x + scalar * y).alias("triad"))


def stream_rounds(table: DataFrame, scalar: float, rounds: int = 10) -> DataFrame:
    """``id, a, b, c`` after so many rounds of copy, scale, add, triad in place."""
    for _ in range(rounds):
        table = table.withColumn("c", F.col("a")).withColumn("b", scalar * F.col("c"))
        table = table.withColumn("c", F.col("a") + F.col("b")).withColumn("a", F.col("b") + scalar * F.col("c"))
    return table


def cell_histogram(pixels: DataFrame, bins: int, bin_width: float, by: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """``*by, bin, n`` of values; values beyond the last bin are counted nowhere."""
    counted = pixels.withColumn("bin", F.floor(F.col("value") / bin_width)).where(F.col("bin").between(0, bins - 1))
    return counted.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def integral_histogram(pixels: DataFrame, height: int, width: int, bins: int, bin_width: float, image: str | None = None) -> DataFrame:
    """``r, c, bin, n`` of ``r, c, value``: pixels of the bin above and to the left, inclusive, for every cell.

    With the name of a column ``image`` those of each of its images. Values
    beyond the last bin are counted nowhere. Scans run along rows, then along
    columns, each line in a partition of its own.
    """
    spark, by = pixels.sparkSession, [image] if image else []
    counted = cell_histogram(pixels, bins, bin_width, (*by, "r", "c"))
    cells = spark.range(height * width * bins).select(
        F.expr(f"id div {width * bins}").alias("r"), F.expr(f"id div {bins} % {width}").alias("c"), (F.col("id") % bins).alias("bin")
    )
    if image:
        cells = cells.crossJoin(broadcast_if_small(pixels.select(image).distinct()))
    full = cells.join(counted, [*by, "r", "c", "bin"], "left").select(*by, "r", "c", "bin", F.coalesce("n", F.lit(0)).alias("n"))
    along = Window.partitionBy(*by, "r", "bin").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, "c", "bin").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("n", F.sum("n").over(along)).withColumn("n", F.sum("n").over(down))


def region_histogram(integral: DataFrame, regions: DataFrame) -> DataFrame:
    """``region, bin, n`` of ``region, top, left, bottom, right`` (inclusive) from four corners of the integral."""
    corners = regions.select(
        "region",
        F.explode(
            F.array(
                F.struct(F.col("bottom").alias("r"), F.col("right").alias("c"), F.lit(1).alias("sign")),
                F.struct((F.col("top") - 1).alias("r"), F.col("right").alias("c"), F.lit(-1).alias("sign")),
                F.struct(F.col("bottom").alias("r"), (F.col("left") - 1).alias("c"), F.lit(-1).alias("sign")),
                F.struct((F.col("top") - 1).alias("r"), (F.col("left") - 1).alias("c"), F.lit(1).alias("sign")),
            )
        ).alias("k"),
    ).select("region", "k.*")
    return integral.join(corners, ["r", "c"]).groupBy("region", "bin").agg(F.sum(F.col("n") * F.col("sign")).alias("n"))
