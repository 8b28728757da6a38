"""Matchings and block decompositions in frames against plain Python on one matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import matching as m
from gridloom.operators import toolkit


def pattern(seed, rows, columns, entries):
    draw = np.random.default_rng(seed)
    found = {(int(draw.integers(0, rows)), int(draw.integers(0, columns))) for _ in range(entries)}
    return sorted(found | {(i, i) for i in range(3)} | {(20, 20), (21, 21), (20, 21), (21, 20), (22, 22), (22, 20)})


def blocks_by_hand(pairs, matched):
    """Square blocks: columns that reach each other."""
    partner = dict(matched)
    nodes = set(partner.values())
    reach = {c: {c} for c in nodes}
    for _ in nodes:
        for i, j in pairs:
            if j in nodes and i in partner:
                for c in nodes:
                    if j in reach[c]:
                        reach[c].add(partner[i])
    return {c: min(d for d in nodes if d in reach[c] and c in reach[d]) for c in nodes}


@pytest.mark.parametrize("seed,rows,columns,entries", [(1, 16, 20, 24), (2, 24, 14, 26), (3, 18, 18, 60)])
def test_blocks_against_one_group(spark, seed, rows, columns, entries):
    pairs = pattern(seed, rows, columns, entries)
    frame = spark.createDataFrame(pairs + pairs[:3] + [(None, 1)], "i long, j long").repartition(3)
    got = {(r.side, r.node): r for r in m.dulmage_mendelsohn(frame).collect()}
    single = frame.where("i IS NOT NULL").select(F.lit(0).cast("long").alias("g"), "i", "j", F.lit(1.0).alias("v"))
    want = {(r.side, r.node): r.part for r in toolkit.coarse_blocks(single).collect()}
    assert all(r.part == want[key] for key, r in got.items())
    matched = [(r.i, r.j) for r in m.maximum_matching(frame).collect()]
    assert set(matched) <= set(pairs) and len({i for i, _ in matched}) == len({j for _, j in matched}) == len(matched)
    assert len(matched) == toolkit.maximum_matching(single).count()
    square = {node for (side, node), r in got.items() if side == "row" and r.part == "square"}
    inner = [(i, j) for i, j in matched if i in square]
    blocks = blocks_by_hand([(i, j) for i, j in pairs if i in square], inner)
    assert {node: r.block for (side, node), r in got.items() if side == "column" and r.part == "square"} == blocks
    assert all(got["row", i].block == blocks[j] for i, j in inner)
    assert all(r.block is None for r in got.values() if r.part != "square")


def test_matching_of_long_paths(spark):
    """A path whose greedy choice may be wrong everywhere."""
    pairs = [(k, k) for k in range(30)] + [(k + 1, k) for k in range(29)]
    assert m.maximum_matching(spark.createDataFrame(pairs, "i long, j long").repartition(4)).count() == 30
    assert m.maximum_matching(spark.createDataFrame([], "i long, j long")).count() == 0
    assert m.dulmage_mendelsohn(spark.createDataFrame([], "i long, j long")).count() == 0
