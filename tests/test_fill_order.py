"""Elimination orders: permutations with little fill-in, against the order of one group."""

from pyspark.sql import functions as F

from gridloom.operators import fill_order, toolkit


def fill(pairs, order):
    """Entries of the factor below its diagonal, by eliminating."""
    near = {}
    for i, j in pairs:
        if i != j:
            near.setdefault(i, set()).add(j)
            near.setdefault(j, set()).add(i)
    total = 0
    for node in sorted(order, key=order.get):
        others = near.pop(node, set())
        total += len(others)
        for k in others:
            near[k] |= others
            near[k] -= {k, node}
    return total


def grid(side):
    at = lambda x, y: x * side + y
    pairs = [(at(x, y), at(x, y)) for x in range(side) for y in range(side)]
    pairs += [(at(x + 1, y), at(x, y)) for x in range(side - 1) for y in range(side)]
    return pairs + [(at(x, y + 1), at(x, y)) for x in range(side) for y in range(side - 1)]


def test_fill_of_a_grid(spark):
    pairs = grid(9)
    frame = spark.createDataFrame([(i, j, 1.0) for i, j in pairs], "i long, j long, v double").repartition(3)
    got = {r.old: r.new for r in fill_order.fill_reducing_order(frame).collect()}
    assert sorted(got) == sorted(got.values()) == list(range(81))
    single = {r.old: r.new for r in toolkit.minimum_degree(frame.select(F.lit(0).cast("long").alias("g"), "i", "j", "v")).collect()}
    assert fill(pairs, got) <= 1.25 * fill(pairs, single) < fill(pairs, {k: k for k in range(81)})
    moved = fill_order.reordered(frame, spark.createDataFrame(list(got.items()), "old long, new long"))
    assert {(r.i, r.j) for r in moved.collect()} == {(max(got[i], got[j]), min(got[i], got[j])) for i, j in pairs}


def test_order_of_a_star_and_of_lone_nodes(spark):
    """The middle of a star goes last or next to last, which leaves no fill-in; a lone node has a place too."""
    pairs = [(100, k) for k in range(40)] + [(200, 200)]
    frame = spark.createDataFrame(pairs, "i long, j long")
    got = {r.old: r.new for r in fill_order.fill_reducing_order(frame).collect()}
    assert sorted(got.values()) == list(range(42)) and fill(pairs, got) == 40
    assert fill_order.fill_reducing_order(frame.limit(0)).count() == 0
