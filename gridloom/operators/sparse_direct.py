"""Direct methods on one large sparse symmetric or triangular matrix ``i, j, v``, all of them frames.

Indices are any numbers; their order is the order of elimination. Small
subtrees of the elimination tree do not depend on each other, so the columns of
each are eliminated where they lie, many subtrees to a task; what they leave for
the columns above is a smaller matrix that is dealt with alike. For the rest
every step is a join or an aggregate over the entries that it concerns, so no
task holds a matrix, a tree or a front, and steps that depend on each other
follow the levels of the elimination tree: a chain of ``n`` columns needs ``n``
steps, a tree of a few levels as many, which is what :mod:`fill_order` is for.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from gridloom.plans.components import connected_components
from gridloom.plans.durable import cut, written
from gridloom.plans.ordering import dense_order
from gridloom.plans.shipping import ship

Keep = Callable[[DataFrame], DataFrame]
#: Rounds take columns or leaves off while that is one of so many or more of what is left.
SHARE = 8
#: Rows in a row that are summed together.
BLOCK = 4096
#: Tables of rows that wait for their level, before those that still do are written together.
TABLES = 8
#: Entries of a subtree that one task takes whole, and of a bucket of such subtrees, about.
PART, BUCKET = 512, 50_000
#: A task with a bucket looks at so many updates at once.
UPDATES = 1 << 21


def factor_pattern(a: DataFrame) -> DataFrame:
    """``i, j`` with ``i > j``: the entries of the Cholesky factor below its diagonal, fill-in among them.

    A column that is no row of another has all its rows; it hands those below
    its first on to the first one's column and is put aside, so that a round
    moves only what is left. Where too few columns are ready (a chain), all of
    the rest hand theirs on until nothing is new.
    """
    with written(a.sparkSession) as keep:
        return cut(_pattern(a, keep).select("i", "j"))


def _pattern(a: DataFrame, keep: Keep) -> DataFrame:
    """``i, j, round``: the round in which a column was put aside, null for those that no round has."""
    ends = F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j")
    raw = keep(a.where("i <> j").select(*ends).distinct())
    done = raw.where("false").select("i", "j", F.lit(0).alias("round"))
    for number in itertools.count():
        rows = raw.select(F.col("i").alias("j"), F.lit(True).alias("waits")).distinct()
        first = F.min("i").over(Window.partitionBy("j")).alias("first")
        marked = keep(raw.distinct().join(rows, "j", "left").select("i", "j", first, F.col("waits").isNotNull().alias("waits")))
        total, ready = marked.agg(F.count(F.lit(1)), F.count_if(~F.col("waits"))).first()
        if ready * SHARE < total:
            return done.union(_handed_on(marked.select("i", "j"), keep).select("i", "j", F.lit(None).cast("int")))
        if total == 0:
            return done
        done = done.union(marked.where("NOT waits").select("i", "j", F.lit(number)))
        raw = marked.where("waits").select("i", "j").union(marked.where("NOT waits AND i > first").select("i", F.col("first").alias("j")))


def _handed_on(known: DataFrame, keep: Keep) -> DataFrame:
    grown = known
    while not grown.isEmpty():
        columns = known.join(grown.select("j").distinct(), "j", "left_semi")
        handed = columns.withColumn("first", F.min("i").over(Window.partitionBy("j"))).where("i > first").select("i", F.col("first").alias("j"))
        grown = keep(handed.join(known, ["i", "j"], "left_anti").distinct())
        known = known.union(grown)
    return known


def elimination_parents(a: DataFrame, pattern: DataFrame) -> DataFrame:
    """``node, parent, count``: the tree of the columns, and how many entries each has in the factor."""
    nodes = a.select(F.col("i").alias("node")).union(a.select(F.col("j").alias("node"))).distinct()
    columns = pattern.groupBy(F.col("j").alias("node")).agg(F.min("i").alias("parent"), F.count(F.lit(1)).alias("below"))
    return nodes.join(columns, "node", "left").select("node", "parent", (F.coalesce("below", F.lit(0)) + 1).alias("count"))


def tour_ranks(forest: DataFrame) -> DataFrame:
    """``node, post, depth`` of a forest ``node, parent``: children by number, roots too.

    Leaves are taken off in rounds and add their sizes to their parents, so a
    round moves only what is left; where too few are leaves (a chain), the
    sizes of the rest come from its Euler tour. A running sum over all
    siblings tells how many nodes are in the trees of earlier ones; from the
    roots down, that and where the parent's tree begins is where a node's does.
    """
    with written(forest.sparkSession) as keep:
        return cut(_tour_ranks(forest, keep))


def _tour_ranks(forest: DataFrame, keep: Keep) -> DataFrame:
    inner = forest.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    left = forest.join(inner, "node", "left").select("node", "parent", F.lit(1).cast("long").alias("size"), F.col("inner").isNull().alias("leaf"))
    sized, rounds = [], 0
    while True:
        left = keep(left)
        total, leaves = left.agg(F.count(F.lit(1)), F.count_if("leaf")).first()
        if leaves * SHARE < total:
            sized.append(left.join(_tour_sizes(left, keep), "node").select("node", "parent", "total", F.lit(None).cast("int").alias("round")))
        if leaves * SHARE < total or total == 0:
            break
        sized.append(left.where("leaf").select("node", "parent", "size", F.lit(rounds).alias("round")))
        come = left.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sum(F.when(F.col("leaf"), F.col("size")).otherwise(0)).alias("more"), F.every("leaf").alias("bare"))
        left = left.where("NOT leaf").join(come, "node").select("node", "parent", (F.col("size") + F.col("more")).alias("size"), F.col("bare").alias("leaf"))
        rounds += 1
    if not sized:
        return left.select("node", F.col("size").alias("post"), F.col("size").alias("depth"))
    placed = _sums_before(functools.reduce(DataFrame.union, sized), keep)
    # where the tree of a node's first child begins is base before that of the sum
    firsts = placed.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.min("before").alias("base"))
    placed = keep(placed.join(firsts, "node", "left"))
    core = placed.where("round IS NULL")
    bases = core.select(F.col("node").alias("parent"), F.col("base").alias("less"))
    known = core.join(bases, "parent", "left").select("node", F.col("parent").alias("up"), "size", "base", (F.col("before") - F.coalesce("less", F.lit(0))).alias("start"), F.col("parent").isNotNull().cast("long").alias("depth"))
    known = keep(known)
    while not known.where("up IS NOT NULL").isEmpty():
        above = known.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("start").alias("begins"), F.col("depth").alias("more"))
        jumped = known.where("up IS NOT NULL").join(above, "up").select("node", F.col("further").alias("up"), "size", "base", (F.col("start") + F.col("begins")).alias("start"), (F.col("depth") + F.col("more")).alias("depth"))
        known = keep(known.where("up IS NULL").union(jumped))
    known = known.select("node", "size", "base", "start", "depth")
    for number in range(rounds - 1, -1, -1):
        above = known.where("base IS NOT NULL").select(F.col("node").alias("parent"), (F.col("start") - F.col("base")).alias("shift"), F.col("depth").alias("more"))
        here = placed.where(F.col("round") == number).join(above, "parent", "left")
        here = here.select("node", "size", "base", (F.col("before") + F.coalesce("shift", F.lit(0))).alias("start"), F.coalesce(F.col("more") + 1, F.lit(0)).alias("depth"))
        known = known.union(keep(here))
    return known.select("node", (F.col("start") + F.col("size") - 1).alias("post"), "depth")


def _sums_before(sized: DataFrame, keep: Keep) -> DataFrame:
    """``node, parent, size, round, before``: the sum of the sizes of all before, by parent, then by number, roots first."""
    numbered = dense_order(sized.toDF("node", "parent", "size", "round"), [F.col("parent").asc_nulls_first(), "node"], "at")
    numbered = numbered.withColumn("block", F.expr(f"at div {BLOCK}"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = numbered.groupBy("block").agg(F.sum("size").alias("s")).select("block", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    summed = numbered.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return keep(summed.join(blocks, "block").select("node", "parent", "size", "round", (F.col("inside") + F.col("shift")).alias("before")))


def _tour_sizes(forest: DataFrame, keep: Keep) -> DataFrame:
    """``node, total``: the sizes in the tree of each node of ``node, parent, size``.

    The Euler tour goes down to and up from every node. Each place of the tour
    knows its next; in every round it adds what its next has counted and
    skips to where that one points, so a tour of ``2 n`` places is ranked
    after ``log2(2 n)`` joins.
    """
    numbered = keep(dense_order(forest.select("node", "parent", "size"), [F.col("parent").asc_nulls_last(), "node"], "at"))
    firsts = numbered.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.min("at").alias("child"))
    after = numbered.select((F.col("at") - 1).alias("at"), F.col("parent").alias("next_parent"), F.lit(True).alias("has_next"))
    above = numbered.select(F.col("node").alias("parent"), F.col("at").alias("above"))
    known = numbered.join(firsts, "node", "left").join(after, "at", "left").join(above, "parent", "left")
    sibling = F.col("has_next") & F.col("parent").eqNullSafe(F.col("next_parent"))
    down = known.select((2 * F.col("at")).alias("place"), F.coalesce(2 * F.col("child"), 2 * F.col("at") + 1).alias("next"), F.lit(0).cast("long").alias("ups"))
    up = known.select((2 * F.col("at") + 1).alias("place"), F.when(sibling, 2 * F.col("at") + 2).otherwise(2 * F.col("above") + 1).alias("next"), F.col("size").alias("ups"))
    # the sizes of this place and those after it that go up
    tour = keep(down.union(up))
    while not tour.where("next IS NOT NULL").isEmpty():
        ahead = tour.select(F.col("place").alias("next"), F.col("next").alias("later"), F.col("ups").alias("ups_"))
        jumped = tour.where("next IS NOT NULL").join(ahead, "next").select("place", F.col("later").alias("next"), (F.col("ups") + F.col("ups_")).alias("ups"))
        tour = keep(tour.where("next IS NULL").union(jumped))
    # from going down to going up: all of the tree but the node itself
    sign = F.when(F.col("place") % 2 == 0, F.col("ups")).otherwise(-F.col("ups"))
    trees = tour.groupBy(F.expr("place div 2").alias("at")).agg(F.sum(sign).alias("below"))
    return numbered.join(trees, "at").select("node", (F.col("below") + F.col("size")).alias("total"))


def elimination_forest(a: DataFrame) -> DataFrame:
    """``node, parent, post, count`` of a symmetric matrix: elimination tree, postorder, and the entries of each column of its factor."""
    tree = cut(elimination_parents(a, factor_pattern(a)))
    return tree.join(tour_ranks(tree), "node").select("node", "parent", "post", "count")


def tree_depths(tree: DataFrame) -> DataFrame:
    """``node, parent, depth`` by jumping from parent to parent."""
    with written(tree.sparkSession) as keep:
        return cut(_depths(tree, keep))


def _depths(tree: DataFrame, keep: Keep) -> DataFrame:
    known = keep(tree.select("node", "parent", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while not known.where("up IS NOT NULL").isEmpty():
        above = known.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        jumped = known.where("up IS NOT NULL").join(above, "up").select("node", "parent", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        known = keep(known.where("up IS NULL").union(jumped))
    return known.select("node", "parent", "depth")


def _levels(lower: DataFrame, pattern: DataFrame, keep: Keep) -> DataFrame:
    """``node, level``: columns in an order in which all that a column needs have a lower level."""
    nodes = lower.select(F.col("i").alias("node")).union(lower.select(F.col("j").alias("node"))).distinct()
    columns = pattern.groupBy(F.col("j").alias("node")).agg(F.min("i").alias("parent"), F.max("round").alias("round"))
    tree = keep(nodes.join(columns, "node", "left"))
    rounds = tree.agg(F.coalesce(F.max("round") + 1, F.lit(0))).first()[0]
    core = keep(_depths(tree.where("round IS NULL"), keep))
    deepest = core.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    level = (F.lit(rounds + deepest) - F.col("depth")).cast("int").alias("level")
    return tree.where("round IS NOT NULL").select("node", F.col("round").alias("level")).union(core.select("node", level))


def _both_levels(entries: DataFrame, levels: DataFrame) -> DataFrame:
    """``i, j, v, level, row_level``: entries with the levels of their columns and rows."""
    column = levels.select(F.col("node").alias("j"), "level")
    row = levels.select(F.col("node").alias("i"), F.col("level").alias("row_level"))
    return entries.join(column, "j").join(row, "i").select("i", "j", "v", "level", "row_level")


class _Later:
    """Rows that wait for their level: written once, read again when it has come."""

    def __init__(self, keep: Keep, column: str):
        self.keep, self.column, self.tables = keep, column, []

    def add(self, rows: DataFrame, level: int) -> None:
        """More rows, all for levels beyond ``level``."""
        self.tables.append(self.keep(rows))
        if len(self.tables) > TABLES:
            self.tables = [self.keep(functools.reduce(DataFrame.union, self.tables).where(F.col(self.column) > level))]

    def of(self, level: int) -> DataFrame | None:
        rows = [t.where(F.col(self.column) == level) for t in self.tables]
        return functools.reduce(DataFrame.union, rows) if rows else None


def _dealt(entries: DataFrame, keep: Keep) -> DataFrame:
    """``i, j, v, bucket``: entries with ``i >= j``, or no ``i`` for a right side, with the bucket of their column.

    Columns of a subtree with at most PART entries are in one bucket, columns
    above such subtrees in none. What hangs together among columns below a
    number is a subtree of the elimination tree. So the last columns are taken
    out, and of what still hangs together in too many entries twice as large a
    share in each round.
    """
    total = entries.where("i IS NOT NULL").count()
    if total <= PART:
        return entries.select("i", "j", "v", F.lit(0).alias("bucket"))
    bucket = F.pmod(F.xxhash64("name"), F.lit(-(-total // BUCKET))).cast("int").alias("bucket")
    done, share, left = [], total**-0.5, entries.select("i", "j", "v", F.lit(0).alias("name"))
    while True:
        limit = F.percentile_approx("j", F.lit(1 - share), F.lit(int(4 / share))).alias("limit")
        limits = keep(left.where("i = j").groupBy("name").agg(limit))
        cut_off = left.join(limits, "name", "left")
        done.append(cut_off.where("NOT coalesce(j < limit, false)").select("i", "j", "v", F.lit(None).cast("int").alias("bucket")))
        low, inside = cut_off.where("j < limit"), F.col("i") < F.col("limit")
        # named after the last column it is tied to: in a tree with a hub, that is all
        last = F.max(F.when(inside, F.col("i"))).over(Window.partitionBy("j"))
        named = keep(low.select("i", "j", "v", inside.alias("inside"), F.coalesce(last, F.col("j")).alias("name")))
        other = named.where("i = j").select("i", F.col("name").alias("other")).distinct()
        tied = named.where("inside AND i > j").select("i", "name").join(other, "i", "left")
        apart = keep(tied.select("name", F.coalesce("other", "i").alias("other")).where("name <> other").distinct())
        if not apart.isEmpty():
            found = keep(connected_components(apart, "name", "other").withColumnRenamed("node", "name"))
            named = named.join(found, "name", "left").select("i", "j", "v", F.coalesce("component", "name").alias("name"))
        large = keep(named.groupBy("name").agg(F.count("i").alias("entries")).where(F.col("entries") > PART).select("name"))
        done.append(named.join(large, "name", "left_anti").select("i", "j", "v", bucket))
        if large.isEmpty():
            return functools.reduce(DataFrame.union, done)
        left = keep(named.join(large, "name", "left_semi").select("i", "j", "v", "name"))
        share = min(2 * share, 0.5)


def _numbered(table: pa.Table) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a bucket's own columns and then of its other rows, how many are its own, and rows, columns and values by places in them; the right side comes last."""
    right = table["i"].is_null().to_numpy()
    columns, rows = table["j"].to_numpy(), table["i"].filter(pa.array(~right)).to_numpy()
    numbers, at = np.unique(np.concatenate([columns, rows]), return_inverse=True)
    own = np.zeros(len(numbers), dtype=bool)
    own[at[: len(columns)]] = True
    count = own.sum()
    at = np.where(own, np.cumsum(own) - 1, count + np.cumsum(~own) - 1)[at]
    place = np.full(len(right), len(numbers))
    place[~right] = at[len(columns) :]
    return np.concatenate([numbers[own], numbers[~own]]), int(count), place, at[: len(columns)], table["v"].to_numpy()


def _summed(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by column and row, those of one place added up."""
    places = columns * width + rows
    order = np.argsort(places)
    places = places[order]
    firsts = np.flatnonzero(np.diff(places, prepend=-1))
    columns, rows = np.divmod(places[firsts], width)
    return rows, columns, np.add.reduceat(values[order], firsts) if len(firsts) else values


def _eliminated(own: int, width: int, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[list, tuple] | None:
    """Columns of the factor in the order of elimination, all that are ready at once, and what they leave for rows from ``own`` on; none if a pivot is not positive."""
    found, above = [], [(rows[:0], rows[:0], values[:0])]
    while len(columns):
        waits = np.zeros(width, dtype=bool)
        waits[rows[rows > columns]] = True
        ready = ~waits[columns]
        r, c, v = _summed(rows[ready], columns[ready], values[ready], width)
        begins = np.flatnonzero(np.diff(c, prepend=-1))
        if not ((r[begins] == c[begins]) & (v[begins] > 0)).all():
            return None
        begin = np.repeat(begins, np.diff(begins, append=len(c)))
        v = v / np.sqrt(v[begin])
        found.append((r, c, v, begins))
        rest = [(rows[~ready], columns[~ready], values[~ready])]
        # each row of a column with those up to it
        pairs = np.arange(len(c)) - begin
        ends = np.cumsum(pairs)
        for some in np.split(np.arange(len(c)), np.searchsorted(ends, np.arange(UPDATES, ends[-1], UPDATES))):
            one = np.repeat(some, pairs[some])
            other = one - np.arange(len(one)) + np.repeat(np.cumsum(pairs[some]) - pairs[some], pairs[some])
            left = r[one], r[other], -v[one] * v[other]
            for mask, where in ((left[1] < own, rest), ((left[1] >= own) & (left[1] < width - 1), above)):
                where.append(tuple(x[mask] for x in left))
        rows, columns, values = (np.concatenate(x) for x in zip(*rest, strict=True))
    return found, _summed(*(np.concatenate(x) for x in zip(*above, strict=True)), width)


def _entries(numbers: np.ndarray, own: int, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, kind: pa.DataType) -> list[pa.Array]:
    right = rows == len(numbers)
    at = np.where(right, 0, rows)
    return [pa.array(numbers[at], kind, mask=right), pa.array(numbers[columns], kind), pa.array(values)]


def _entry_schema(entries: DataFrame, *more: StructField) -> StructType:
    ship(entries.sparkSession)
    return StructType([StructField(c, entries.schema[c].dataType) for c in ("i", "j")] + [StructField("v", DoubleType()), *more])


def _refused(table: pa.Table) -> list[pa.Array]:
    """An entry without a value: the matrix is not positive definite."""
    return [pa.nulls(1, table["i"].type), pa.nulls(1, table["j"].type), pa.nulls(1, pa.float64())]


def _check(made: DataFrame) -> None:
    if not made.where("v IS NULL").isEmpty():
        raise ValueError("the matrix is not positive definite")


def _above(dealt: DataFrame, left: DataFrame, keep: Keep) -> tuple[DataFrame, int, bool]:
    """The entries of columns in no bucket with what those in buckets leave for them, how many are on the diagonal, and whether these are few."""
    above = dealt.where("bucket IS NULL").select("i", "j", "v").union(left.select("i", "j", "v"))
    above = keep(above.groupBy("i", "j").agg(F.sum("v").alias("v")))
    before, now = (f.where("i = j").count() for f in (dealt, above))
    none = above.isEmpty()
    if not (now or none):
        raise ValueError("the matrix is not positive definite")
    return above, none, 2 * now <= before


def cholesky(a: DataFrame) -> DataFrame:
    """``i, j, v``: the factor L of a positive definite A = L L' of which the lower half is read; repeated entries are summed."""
    with written(a.sparkSession) as keep:
        lower = keep(a.where("i >= j").groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("v")))
        return cut(_factor(lower, keep))


def _factor(lower: DataFrame, keep: Keep) -> DataFrame:
    """Subtrees where they lie, then the matrix that they leave for the columns above."""
    schema = _entry_schema(lower, StructField("done", BooleanType()))

    def eliminate(table: pa.Table) -> pa.Table:
        numbers, own, *entries = _numbered(table)
        result = _eliminated(own, len(numbers) + 1, *entries)
        if result is None:
            return pa.table([*_refused(table), pa.array([True])], names=schema.names)
        found, above = result
        parts = [(x[:3], True) for x in found] + [(above, False)]
        tables = [pa.table([*_entries(numbers, own, *x, table["j"].type), pa.array(np.full(len(x[0]), done))], names=schema.names) for x, done in parts]
        return pa.concat_tables(tables)

    dealt = _dealt(lower, keep)
    made = keep(dealt.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(eliminate, schema))
    _check(made)
    above, none, few = _above(dealt, made.where("NOT done"), keep)
    factor = made.where("done").select("i", "j", "v")
    return factor if none else factor.union(_factor(above, keep) if few else _factor_by_levels(above, keep))


def _factor_by_levels(lower: DataFrame, keep: Keep) -> DataFrame:
    """Right-looking: all columns of a level are summed from the entries of A and
    from what earlier columns have left for them, and scaled. What the pairs
    of a column's rows take off goes straight to its place, which waits for
    the level of its column, so it is moved once, however far up the
    elimination tree that is. Sums begin before the shuffle, so a hub's many
    updates are spread over tasks.
    """
    levels = keep(_levels(lower, _pattern(lower, keep), keep))
    own = keep(_both_levels(lower, levels))
    last = levels.agg(F.max("level")).first()[0]
    parts, later = [], _Later(keep, "level")
    for level in range(0 if last is None else last + 1):
        here, left = own.where(F.col("level") == level), later.of(level)
        summed = (here if left is None else here.union(left)).groupBy("i", "j", "row_level").agg(F.sum("v").alias("v"))
        pivot = F.max(F.when(F.col("i") == F.col("j"), F.col("v"))).over(Window.partitionBy("j")).alias("pivot")
        front = keep(summed.select("i", "j", "row_level", "v", pivot))
        if not front.where("pivot IS NULL OR NOT pivot > 0").isEmpty():
            raise ValueError("the matrix is not positive definite")
        scaled = front.select("i", "j", "row_level", (F.col("v") / F.sqrt("pivot")).alias("v"))
        parts.append(scaled.select("i", "j", "v"))
        below = scaled.where("i > j")
        other = below.select("j", F.col("i").alias("k"), F.col("row_level").alias("level"), F.col("v").alias("w"))
        pairs = below.join(other, "j").where("i >= k")
        later.add(pairs.select("i", F.col("k").alias("j"), (-F.col("v") * F.col("w")).alias("v"), "level", "row_level"), level)
    factor = lower.where("false").select("i", "j", "v")
    for part in parts:
        factor = factor.union(part)
    return factor


def positive_solve(a: DataFrame, b: DataFrame) -> DataFrame:
    """``i, x`` of A x = b for a positive definite A of which the lower half is read; unknowns not returned are zero. Repeated entries are summed.

    The right side is a last row of the matrix: its row of the factor solves
    L y = b. Subtrees are factored twice, for what they leave for the columns
    above and, once the unknowns of those are known, for their own, so no factor is moved.
    """
    with written(a.sparkSession) as keep:
        lower = a.where("i >= j").select("i", "j", F.col("v").cast("double").alias("v"))
        right = b.select(F.lit(None).cast(lower.schema["i"].dataType).alias("i"), F.col("i").alias("j"), F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("v"))
        return cut(_solved(keep(lower.union(right)), keep))


def _solved(system: DataFrame, keep: Keep) -> DataFrame:
    schema = _entry_schema(system)
    solution = StructType([StructField("i", schema["j"].dataType), StructField("x", DoubleType())])

    def eliminate(table: pa.Table) -> pa.Table:
        numbers, own, *entries = _numbered(table)
        result = _eliminated(own, len(numbers) + 1, *entries)
        return pa.table(_refused(table) if result is None else _entries(numbers, own, *result[1], table["j"].type), names=schema.names)

    def solve(table: pa.Table) -> pa.Table:
        numbers, own, rows, columns, values = _numbered(table)
        last = rows == len(numbers)
        inside = last | (rows < own)
        rows = np.where(last, own, rows)
        x = np.zeros(own + 1)
        x[own] = -1.0
        found, _ = _eliminated(own, own + 1, rows[inside], columns[inside], values[inside])
        for r, c, v, begins in reversed(found):
            terms = v * x[r]
            terms[begins] = 0.0
            x[c[begins]] = -np.add.reduceat(terms, begins) / v[begins]
        return pa.table([pa.array(numbers[:own], table["j"].type), pa.array(x[:own])], names=solution.names)

    dealt = _dealt(system, keep)
    inside = dealt.where("bucket IS NOT NULL")
    left = keep(inside.groupBy("bucket").applyInArrow(eliminate, schema))
    _check(left)
    above, none, few = _above(dealt, left, keep)
    if none:
        return keep(inside.groupBy("bucket").applyInArrow(solve, solution))
    if few:
        known = _solved(above, keep)
    else:
        right = above.where("i IS NULL").select(F.col("j").alias("i"), F.col("v").alias("x"))
        known = keep(cholesky_solve(_factor_by_levels(above.where("i IS NOT NULL"), keep), right))
    come = inside.join(known, "i").select(F.lit(None).cast(schema["i"].dataType).alias("i"), "j", (-F.col("v") * F.col("x")).alias("v"), "bucket")
    return known.union(keep(inside.union(come).groupBy("bucket").applyInArrow(solve, solution)))


def column_reach(t: DataFrame, start: DataFrame) -> DataFrame:
    """``i``: what may differ from zero in the solution if the right side has entries at ``start``'s ``i``."""
    with written(t.sparkSession) as keep:
        return cut(_reach(t, start, keep))


def _reach(t: DataFrame, start: DataFrame, keep: Keep) -> DataFrame:
    edges = keep(t.where("i <> j").select("i", "j"))
    seen = front = keep(start.select("i").distinct())
    while not front.isEmpty():
        front = keep(edges.join(front.withColumnRenamed("i", "j"), "j").select("i").distinct().join(seen, "i", "left_anti"))
        seen = seen.union(front)
    return seen


def triangular_solve(t: DataFrame, b: DataFrame) -> DataFrame:
    """``i, x`` of T x = b for a triangular ``i, j, v``, lower or upper, and a sparse right side ``i, x``.

    Only the reach of the right side is touched. An unknown is ready when all
    that its row needs are; all that are ready are divided, multiplied and
    summed at once, so there are as many steps as levels of the pattern.
    Repeated entries of ``t`` and ``b`` are summed; unknowns outside of the
    reach are zero and not returned.
    """
    with written(t.sparkSession) as keep:
        right = keep(b.groupBy("i").agg(F.sum(F.col("x").cast("double")).alias("x")))
        whole = t.groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("v"))
        reach = keep(_reach(whole, right, keep))
        inside = keep(whole.join(reach, "i", "left_semi").join(reach.withColumnRenamed("i", "j"), "j", "left_semi"))
        strict = inside.where("i <> j")
        diagonal = inside.where("i = j").select("i", F.col("v").alias("d"))
        needs = strict.groupBy("i").agg(F.count(F.lit(1)).alias("needs"))
        start = reach.join(right, "i", "left").join(needs, "i", "left").join(diagonal, "i", "left")
        waiting = keep(start.select("i", "d", F.coalesce("needs", F.lit(0)).alias("needs"), F.coalesce("x", F.lit(0.0)).alias("x")))
        if not waiting.where("d IS NULL OR d = 0").isEmpty():
            raise ValueError("the matrix is singular")
        parts = [waiting.where("needs = 0").select("i", (F.col("x") / F.col("d")).alias("x"))]
        while not waiting.where("needs > 0").isEmpty():
            ready = parts[-1].select(F.col("i").alias("j"), F.col("x").alias("known"))
            come = strict.join(ready, "j").groupBy("i").agg(F.count(F.lit(1)).alias("came"), F.sum(F.col("v") * F.col("known")).alias("sum"))
            waiting = waiting.where("needs > 0").join(come, "i", "left")
            waiting = keep(waiting.select("i", "d", (F.col("needs") - F.coalesce("came", F.lit(0))).alias("needs"), (F.col("x") - F.coalesce("sum", F.lit(0.0))).alias("x")))
            parts.append(waiting.where("needs = 0").select("i", (F.col("x") / F.col("d")).alias("x")))
            if parts[-1].isEmpty():
                raise ValueError("the matrix is not triangular")
        solved = parts[0]
        for part in parts[1:]:
            solved = solved.union(part)
        return cut(solved)


def cholesky_solve(factor: DataFrame, b: DataFrame) -> DataFrame:
    """``i, x`` of L L' x = b."""
    forward = triangular_solve(factor, b)
    return triangular_solve(factor.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), forward)
