"""Adaptive meshes: cells ``level, x, y, z, v`` with coordinates on the grid of their level, blocks of SIDE^3 cells.

Block ``level, bx, by, bz`` holds the cells whose coordinates divided by SIDE
are its own; a block is refined or coarsened as a whole.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.bounded import broadcast_if_small
from gridloom.plans.durable import cut

AXES = ("x", "y", "z")
SIDE = 4


@dataclass(frozen=True)
class Mesh:
    """Blocks along each axis at level 0, and the deepest level."""

    blocks: tuple[int, int, int]
    deepest: int

    def cells(self, axis: int, level: Column) -> Column:
        return F.call_function("shiftleft", F.lit(self.blocks[axis] * SIDE).cast("long"), level)


def first_cells(spark: SparkSession, mesh: Mesh, value) -> DataFrame:
    """Level 0; ``value`` makes a cell's value of its number."""
    nx, ny, nz = (b * SIDE for b in mesh.blocks)
    cells = spark.range(nx * ny * nz)
    at = [F.expr(f"id div {ny * nz}").alias("x"), F.expr(f"id div {nz} % {ny}").alias("y"), (F.col("id") % nz).alias("z")]
    return cells.select(F.lit(0).alias("level"), *at, value(F.col("id")).alias("v"))


def blocks_of(cells: DataFrame) -> DataFrame:
    return cells.select("level", *(F.expr(f"{a} div {SIDE}").alias(f"b{a}") for a in AXES)).distinct()


def _offsets(spark: SparkSession, faces_only: bool) -> DataFrame:
    found = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    if faces_only:
        found = [o for o in found if sum(map(abs, o)) <= 1]
    return F.broadcast(spark.createDataFrame(found, "ox int, oy int, oz int"))


def smooth(cells: DataFrame, mesh: Mesh, points: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of 7 or 27 values around each cell, for each value of ``by`` (variables), whatever the levels around it.

    Seven values are the cell's and what it sees over its faces; 27 those of
    all directions (:func:`seen_around`). The sum is always divided by ``points``.
    """
    seen = seen_over_faces(cells, mesh, by) if points == 7 else seen_around(cells, mesh, by)
    return cells.join(seen, ["level", *by, *AXES]).select("level", *by, *AXES, ((F.col("v") + F.col("s")) / points).alias("v"))


def _across(own: dict[str, Column]) -> dict[str, Column]:
    """-1, 0 or 1 along each axis: whether ``own`` and what lies at its offset are in different blocks."""
    return {a: ((own[a] + F.col(f"o{a}") + SIDE) / SIDE).cast("long") - ((own[a] + SIDE) / SIDE).cast("long") for a in AXES}


def _times(own: dict[str, Column], level: Column, mesh: Mesh) -> Column:
    """How many of the 27 directions end at this offset: beyond the domain the nearest value inside stands in."""
    times = F.lit(1)
    for i, a in enumerate(AXES):
        at_walls = (own[a] == 0).cast("int") + (own[a] == mesh.cells(i, level) - 1).cast("int")
        times = times * F.when(F.col(f"o{a}") == 0, 1 + at_walls).otherwise(1)
    return times


def seen_around(cells: DataFrame, mesh: Mesh, by: tuple[str, ...] = ()) -> DataFrame:
    """``level, *by, x, y, z, s``: the sum of what each cell sees in 26 directions.

    A neighbour of the same level is seen as it is. Others are seen across a
    face, an edge or a corner of the cell's block: with ``z`` axes along which
    that does not leave the block (2, 1, 0) and ``d`` levels between, a coarser
    cell is seen as one part of 2^(z d), and of finer ones the sum of the
    2^(z d) that are next to the face, edge or corner. Blocks that meet in an edge or
    corner may be any number of levels apart.

    Equal and finer cells send their value to where they would be seen, which
    is summed before the shuffle; only cells at a block's border ask for
    coarser ones. What is sent to places without a cell is not returned.
    """
    keys = ["level", *by, *AXES]
    away = _offsets(cells.sparkSession, False).where("ox <> 0 or oy <> 0 or oz <> 0")
    own = {a: F.col(a) for a in AXES}
    at_border = functools.reduce(operator.or_, ((F.col(a) % SIDE).isin(0, SIDE - 1) for a in AXES))

    # a cell, or its ancestor d levels up, is seen from there against the offset
    sent = []
    for d in range(mesh.deepest + 1):
        viewer = {a: F.shiftright(a, d) - F.col(f"o{a}") for a in AXES}
        level = F.col("level") - d
        pairs = cells.crossJoin(away)
        if d:
            next_to = F.lit(True)
            for a, c in _across(viewer).items():
                next_to = next_to & ((c == 0) | (F.col(a) % (1 << d) == F.when(c > 0, 0).otherwise((1 << d) - 1)))
            pairs = cells.where((F.col("level") >= d) & at_border).crossJoin(away).where(next_to)
        sent.append(pairs.select(level.alias("level"), *by, *(viewer[a].alias(a) for a in AXES), (F.col("v") * _times(viewer, level, mesh)).alias("s")))

    across, inside = _across(own), F.lit(True)
    for i, a in enumerate(AXES):
        there = F.col(a) + F.col(f"o{a}")
        inside = inside & (there >= 0) & (there < mesh.cells(i, F.col("level")))
    along = sum((across[a] == 0).cast("int") for a in AXES)
    asking = cells.where((F.col("level") > 0) & at_border).crossJoin(away).where(inside & (along < 3))
    for d in range(1, mesh.deepest + 1):
        share = _times(own, F.col("level"), mesh) / F.call_function("shiftleft", F.lit(1), along * d)
        beyond = (F.shiftright(F.col(a) + F.col(f"o{a}"), d).alias(f"u{a}") for a in AXES)
        asked = asking.where(F.col("level") >= d).select(*keys, share.alias("share"), (F.col("level") - d).alias("up"), *beyond)
        coarse = cells.select(F.col("level").alias("up"), *by, *(F.col(a).alias(f"u{a}") for a in AXES), "v")
        sent.append(asked.join(coarse, ["up", *by, "ux", "uy", "uz"]).select(*keys, (F.col("v") * F.col("share")).alias("s")))

    # the directions that end at the cell itself
    none = {f"o{a}": F.lit(0) for a in AXES}
    walls = cells.withColumns(none).select(*keys, (F.col("v") * (_times(own, F.col("level"), mesh) - 1)).alias("s"))
    total = functools.reduce(DataFrame.unionByName, sent, walls).groupBy(*keys).agg(F.sum("s").alias("s"))
    return total.join(cells.select(*keys), keys, "left_semi")


def seen_over_faces(cells: DataFrame, mesh: Mesh, by: tuple[str, ...] = ()) -> DataFrame:
    """``level, *by, x, y, z, s``: the sum of the six :func:`face_ghosts` of each cell.

    Each cell sends its value over its faces to cells of its own level and, as
    one of four, to those of the level above it, where values are summed before
    the shuffle; only cells at a block's border ask for a coarser one. What is
    sent to places without a cell is not returned.
    """
    keys = ["level", *by, *AXES]
    pairs = cells.crossJoin(_offsets(cells.sparkSession, True)).where("ox <> 0 or oy <> 0 or oz <> 0")
    outside, near, leaves = F.lit(False), F.lit(True), F.lit(False)
    for i, a in enumerate(AXES):
        there, o = F.col(a) + F.col(f"o{a}"), F.col(f"o{a}")
        outside = outside | (there < 0) | (there >= mesh.cells(i, F.col("level")))
        # of finer cells those at the face: against the offset, as they send
        near = near & F.when(o == 0, True).otherwise(F.col(a) % 2 == F.when(o > 0, 0).otherwise(1))
        leaves = leaves | ((o > 0) & (F.col(a) % SIDE == SIDE - 1)) | ((o < 0) & (F.col(a) % SIDE == 0))
    edge = pairs.where(outside).select(*keys, F.col("v").alias("s"))
    same = pairs.select("level", *by, *((F.col(a) - F.col(f"o{a}")).alias(a) for a in AXES), F.col("v").alias("s"))
    fine = pairs.where((F.col("level") > 0) & near).select((F.col("level") - 1).alias("level"), *by, *((F.expr(f"{a} div 2") - F.col(f"o{a}")).alias(a) for a in AXES), F.col("v").alias("s"))
    asked = pairs.where((F.col("level") > 0) & leaves & ~outside).select(*keys, (F.col("level") - 1).alias("up"), *(F.expr(f"({a} + o{a}) div 2").alias(f"u{a}") for a in AXES))
    above = cells.select(F.col("level").alias("up"), *by, *(F.col(a).alias(f"u{a}") for a in AXES), (F.col("v") / 4).alias("s"))
    coarse = asked.join(above, ["up", *by, "ux", "uy", "uz"]).select(*keys, "s")
    total = edge.unionByName(same).unionByName(fine).unionByName(coarse).groupBy(*keys).agg(F.sum("s").alias("s"))
    return total.join(cells.select(*keys), keys, "left_semi")


def face_ghosts(cells: DataFrame, mesh: Mesh, by: tuple[str, ...] = ()) -> DataFrame:
    """``level, *by, x, y, z, ox, oy, oz, ghost``: what each cell sees over each face.

    A cell of the same level as it is, a coarser one a quarter of its value,
    finer ones the sum of the four at the face, and nothing beyond the domain
    but the cell itself.
    """
    faces = cells.crossJoin(_offsets(cells.sparkSession, True)).where("ox <> 0 or oy <> 0 or oz <> 0")
    keys = ["level", *by, *AXES, "ox", "oy", "oz"]
    beyond = [F.col(a) + F.col(f"o{a}") for a in AXES]
    outside = F.lit(False)
    for i, b in enumerate(beyond):
        outside = outside | (b < 0) | (b >= mesh.cells(i, F.col("level")))
    seen = cut(faces.select(*keys, "v", *(b.alias(f"t{a}") for a, b in zip(AXES, beyond, strict=True)), outside.alias("outside")))
    there = [F.col(a).alias(f"t{a}") for a in AXES]
    inner = seen.where(~F.col("outside")).drop("v")
    same = inner.join(cells.select("level", *by, *there, F.col("v").alias("ghost")), ["level", *by, "tx", "ty", "tz"])
    coarse = inner.withColumn("up", F.col("level") - 1).withColumns({f"u{a}": F.expr(f"t{a} div 2") for a in AXES})
    coarse = coarse.join(cells.select(F.col("level").alias("up"), *by, *(F.col(a).alias(f"u{a}") for a in AXES), (F.col("v") / 4).alias("ghost")), ["up", *by, "ux", "uy", "uz"])
    # a finer neighbour's cells at the face: along the face's axis the near one of two, along the others both
    fine = cells.where("level > 0").crossJoin(_offsets(cells.sparkSession, True)).where("ox <> 0 or oy <> 0 or oz <> 0")
    near = F.lit(True)
    for a in AXES:
        near = near & F.when(F.col(f"o{a}") == 0, True).otherwise(F.col(a) % 2 == F.when(F.col(f"o{a}") > 0, 0).otherwise(1))
    parents = fine.where(near).select((F.col("level") - 1).alias("level"), *by, *((F.expr(f"{a} div 2") - F.col(f"o{a}")).alias(a) for a in AXES), "ox", "oy", "oz", "v")
    finer = parents.groupBy(*keys).agg(F.sum("v").alias("ghost")).join(cells.select("level", *by, *AXES), ["level", *by, *AXES])
    edge = seen.where("outside").select(*keys, F.col("v").alias("ghost"))
    return same.select(*keys, "ghost").unionByName(coarse.select(*keys, "ghost")).unionByName(finer.select(*keys, "ghost")).unionByName(edge)


def split(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Eight children of each cell, each with an eighth of its value."""
    spark = cells.sparkSession
    child = F.broadcast(spark.createDataFrame([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], "ox int, oy int, oz int"))
    return cells.crossJoin(child).select(
        (F.col("level") + 1).alias("level"), *by, *((F.col(a) * 2 + F.col(f"o{a}")).alias(a) for a in AXES), (F.col("v") / 8).alias("v")
    )


def consolidate(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One parent of eight children, with their sum."""
    return cells.groupBy((F.col("level") - 1).alias("level"), *by, *(F.expr(f"{a} div 2").alias(a) for a in AXES)).agg(F.sum("v").alias("v"))


def checksum(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``*by, total``: the sum of all values, of each variable."""
    return cells.groupBy(*by).agg(F.sum("v").alias("total"))


def drifted(before: float, after: float, digits: int) -> bool:
    """Has the sum changed by more than 10^-digits of itself?"""
    return abs(after - before) > 10.0**-digits * abs(before)


def move(objects: DataFrame) -> DataFrame:
    """Objects ``kind, bounce, cx.., mx.., sx.., ix..`` after a step: moved, turned back at the walls of the unit box if they bounce, grown."""
    for a in AXES:
        centre = F.col(f"c{a}") + F.col(f"m{a}")
        hits = F.col("bounce") & (((centre + F.col(f"s{a}") > 1) & (F.col(f"m{a}") > 0)) | ((centre - F.col(f"s{a}") < 0) & (F.col(f"m{a}") < 0)))
        objects = objects.withColumns(
            {f"c{a}": centre, f"m{a}": F.when(hits, -F.col(f"m{a}")).otherwise(F.col(f"m{a}")), f"s{a}": F.col(f"s{a}") + F.col(f"i{a}")}
        )
    return objects


def _nearest(a: str, low: Column, high: Column) -> Column:
    """Scaled distance from an object's centre to the interval along an axis."""
    outside = F.greatest(F.lit(0.0), low - F.col(f"c{a}"), F.col(f"c{a}") - high)
    return outside / F.col(f"s{a}")


def _farthest(a: str, low: Column, high: Column) -> Column:
    return F.greatest(F.abs(low - F.col(f"c{a}")), F.abs(high - F.col(f"c{a}"))) / F.col(f"s{a}")


def _squares(columns: list[Column]) -> Column:
    return sum((c * c for c in columns), F.lit(0.0))


def touches(lows: dict[str, Column], highs: dict[str, Column], kinds: set[int]) -> Column:
    """Does an object ``kind, c., s.`` meet the box? Even kinds are surfaces, odd ones solids.

    0 and 1 are boxes, 2 and 3 spheroids, 4 to 15 spheroids cut in half (by
    pairs: the part towards -x, +x, -y, +y, -z, +z), 20 to 25 cylinders along x, y and z. A
    negative size switches an object off. Only the tests of ``kinds`` are made.
    """
    kind, on = F.col("kind"), F.lit(True)
    for a in AXES:
        on = on & (F.col(f"s{a}") >= 0)
    near = {a: _nearest(a, lows[a], highs[a]) for a in AXES}
    far = {a: _farthest(a, lows[a], highs[a]) for a in AXES}
    overlap, within = F.lit(True), F.lit(True)
    for a in AXES:
        overlap, within = overlap & (near[a] <= 1), within & (far[a] <= 1)
    round_near, round_far = _squares([*near.values()]), _squares([*far.values()])
    solid, inside = F.when(kind.isin(0, 1), overlap), F.when(kind.isin(0, 1), within)
    if kinds & {2, 3}:
        solid, inside = solid.when(kind.isin(2, 3), round_near <= 1), inside.when(kind.isin(2, 3), round_far < 1)
    for half in range(6):
        a, upper = AXES[half // 2], half % 2 == 1
        side = highs[a] >= F.col(f"c{a}") if upper else lows[a] <= F.col(f"c{a}")
        whole = lows[a] > F.col(f"c{a}") if upper else highs[a] < F.col(f"c{a}")
        if not kinds & {4 + 2 * half, 5 + 2 * half}:
            continue
        these = kind.isin(4 + 2 * half, 5 + 2 * half)
        solid, inside = solid.when(these, (round_near <= 1) & side), inside.when(these, (round_far < 1) & whole)
    for i, a in enumerate(AXES):
        others = [o for o in AXES if o != a]
        if not kinds & {20 + 2 * i, 21 + 2 * i}:
            continue
        these = kind.isin(20 + 2 * i, 21 + 2 * i)
        solid = solid.when(these, (near[a] <= 1) & (_squares([near[o] for o in others]) <= 1))
        inside = inside.when(these, (far[a] <= 1) & (_squares([far[o] for o in others]) < 1))
    return on & F.when(kind % 2 == 1, solid).otherwise(solid & ~inside)


def touched_blocks(blocks: DataFrame, objects: DataFrame, mesh: Mesh) -> DataFrame:
    """Blocks with ``touched``: does any object meet them? Coordinates run from 0 to 1 along each axis."""
    lows, highs = {}, {}
    for i, a in enumerate(AXES):
        n = F.lit(mesh.blocks[i]) * F.pow(F.lit(2.0), F.col("level"))
        lows[a], highs[a] = F.col(f"b{a}") / n, (F.col(f"b{a}") + 1) / n
    keys = ["level", *(f"b{a}" for a in AXES)]
    kinds = [r[0] for r in objects.select("kind").distinct().collect()]  # 22 kinds at most
    met = blocks.limit(0)
    for kind in kinds:
        one = broadcast_if_small(objects.where(F.col("kind") == kind))
        met = met.union(blocks.join(one, touches(lows, highs, {kind}), "left_semi"))
    met = met.distinct().withColumn("touched", F.lit(True))
    return blocks.join(met, keys, "left").select(*keys, F.coalesce("touched", F.lit(False)).alias("touched"))


def marks(touched: DataFrame, mesh: Mesh) -> DataFrame:
    """Blocks with ``mark``: 1 to refine, -1 to coarsen (all eight siblings wish it), 0 to stay."""
    wish = touched.withColumn("wish", F.when(F.col("touched") & (F.col("level") < mesh.deepest), 1).when(~F.col("touched") & (F.col("level") > 0), -1).otherwise(0))
    parent = [F.expr(f"b{a} div 2").alias(f"p{a}") for a in AXES]
    families = wish.groupBy("level", *parent).agg((F.sum(F.when(F.col("wish") == -1, 1).otherwise(0)) == 8).alias("agree"))
    placed = wish.withColumns({f"p{a}": F.expr(f"b{a} div 2") for a in AXES}).join(families, ["level", "px", "py", "pz"])
    mark = F.when((F.col("wish") == -1) & ~F.col("agree"), 0).otherwise(F.col("wish"))
    return placed.select("level", *(f"b{a}" for a in AXES), mark.alias("mark"))


def balanced(marked: DataFrame) -> DataFrame:
    """Marks changed until neighbours over a face differ by one level at most.

    What a block will be is sent over its faces, to blocks of its own level
    and of the levels beside it; a block that would be two below rises, and
    its family no longer coarsens. Levels only rise, so this ends.
    """
    keys = ["level", "bx", "by", "bz"]
    state = cut(marked.withColumn("goal", F.col("level") + F.col("mark")))
    faces = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    offsets = F.broadcast(state.sparkSession.createDataFrame(faces, "ox int, oy int, oz int"))
    while True:
        sent = state.crossJoin(offsets).select("level", *((F.col(f"b{a}") + F.col(f"o{a}")).alias(f"b{a}") for a in AXES), "goal")
        up = sent.select((F.col("level") - 1).alias("level"), *(F.expr(f"b{a} div 2").alias(f"b{a}") for a in AXES), "goal")
        needed = sent.unionByName(up).groupBy(*keys).agg((F.max("goal") - 1).alias("least"))
        raised = state.join(needed, keys, "left").withColumn("new", F.greatest("goal", F.coalesce("least", F.col("goal"))))
        parent = [F.expr(f"b{a} div 2") for a in AXES]
        family = raised.groupBy("level", *(p.alias(f"p{a}") for p, a in zip(parent, AXES, strict=True))).agg((F.min("new") == F.max("new")).alias("one"))
        placed = raised.withColumns({f"p{a}": p for p, a in zip(parent, AXES, strict=True)}).join(family, ["level", "px", "py", "pz"])
        new = F.when((F.col("new") < F.col("level")) & ~F.col("one"), F.col("level")).otherwise(F.col("new"))
        after = cut(placed.select(*keys, "goal", new.alias("new")))
        done = after.where("new <> goal").isEmpty()
        state = after.select(*keys, F.col("new").alias("goal"))
        if done:
            return state.select(*keys, (F.col("goal") - F.col("level")).alias("mark"))


def aimed(marked: DataFrame, least: int, most: int, mesh: Mesh) -> DataFrame:
    """Marks changed so that the number of blocks afterwards is between the two, as far as single splits and joins allow.

    Too few: further blocks that stay are split, the coarsest first. Too
    many: blocks to be split stay, the finest first, then whole families
    are joined. Ties go by place; each change is worth seven blocks.
    """
    keys = ["level", "bx", "by", "bz"]
    blocks = marked.agg(F.sum(F.when(F.col("mark") == 1, 8.0).when(F.col("mark") == -1, 0.125).otherwise(1.0))).first()[0] or 0
    if blocks < least:
        more = marked.where((F.col("mark") == 0) & (F.col("level") < mesh.deepest)).orderBy(*keys).limit(-(-int(least - blocks) // 7)).select(*keys, F.lit(1).alias("new"))
        return marked.join(broadcast_if_small(cut(more)), keys, "left").select(*keys, F.coalesce("new", "mark").alias("mark"))
    if blocks <= most:
        return marked
    surplus = -(-int(blocks - most) // 7)
    fewer = cut(marked.where("mark = 1").orderBy(F.desc("level"), *keys[1:]).limit(surplus).select(*keys, F.lit(0).alias("new")))
    kept = marked.join(broadcast_if_small(fewer), keys, "left").select(*keys, F.coalesce("new", "mark").alias("mark"))
    surplus -= fewer.count()
    if surplus <= 0:
        return kept
    family = ["level", *(F.expr(f"b{a} div 2").alias(f"p{a}") for a in AXES)]
    idle = kept.where("level > 0").groupBy(*family).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("mark")).alias("most")).where("n = 8 and most = 0")
    joined = idle.orderBy(F.desc("level"), "px", "py", "pz").limit(surplus).select("level", "px", "py", "pz", F.lit(-1).alias("new"))
    placed = kept.withColumns({f"p{a}": F.expr(f"b{a} div 2") for a in AXES}).join(broadcast_if_small(cut(joined)), ["level", "px", "py", "pz"], "left")
    return placed.select(*keys, F.coalesce("new", "mark").alias("mark"))


def block_counts(cells: DataFrame) -> DataFrame:
    """``level, blocks``: how many blocks each level has."""
    return blocks_of(cells).groupBy("level").agg(F.count(F.lit(1)).alias("blocks"))


def remeshed(cells: DataFrame, marked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells after the marks: blocks split, kept or joined with their siblings."""
    placed = cells.withColumns({f"b{a}": F.expr(f"{a} div {SIDE}") for a in AXES}).join(marked, ["level", "bx", "by", "bz"])
    own = ["level", *by, *AXES, "v"]
    parts = split(placed.where("mark = 1").select(own), by), placed.where("mark = 0").select(own), consolidate(placed.where("mark = -1").select(own), by)
    return parts[0].select(own).unionByName(parts[1]).unionByName(parts[2].select(own))


def refine(cells: DataFrame, objects: DataFrame, mesh: Mesh, least: int = 0, most: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells after one round of marks; with ``least`` or ``most`` the number of blocks is brought towards them before the balance."""
    wanted = marks(touched_blocks(blocks_of(cells), objects, mesh), mesh)
    if least or most is not None:
        wanted = aimed(cut(wanted), least, most if most is not None else 1 << 60, mesh)
    return cut(remeshed(cells, balanced(wanted), by))
