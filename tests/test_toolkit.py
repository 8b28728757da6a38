"""Direct methods against numpy and brute force."""

import itertools

import numpy as np
import pytest
from test_tiles import entries, whole

from gridloom.operators import toolkit as k
from gridloom.sources import numbers, simulations
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(22)


def grouped(frame, g=0):
    return frame.withColumn("g", F.lit(g).cast("long"))


def side(spark, x):
    return grouped(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double"))


def test_solves(spark, rng):
    a = rng.random((8, 8)) - 0.5
    spd, b = a @ a.T + np.eye(8), rng.random(8)
    wanted = {"lu": (a, np.linalg.solve(a, b)), "cholesky": (spd, np.linalg.solve(spd, b)), "qr": (a, np.linalg.solve(a, b)), "lower": (spd, np.linalg.solve(np.tril(spd), b))}
    wanted |= {"upper": (spd, np.linalg.solve(np.triu(spd), b)), "lower_transposed": (spd, np.linalg.solve(np.tril(spd).T, b)), "upper_transposed": (spd, np.linalg.solve(np.triu(spd).T, b))}
    for method, (matrix, x) in wanted.items():
        got = k.solve(grouped(entries(spark, matrix)), side(spark, b), method).orderBy("i").collect()
        assert np.allclose([r.x for r in got], x), method
    tall, b = rng.random((9, 4)), rng.random(9)
    got = k.solve(grouped(entries(spark, tall)), side(spark, b), "qr").orderBy("i").collect()
    assert np.allclose([r.x for r in got], np.linalg.lstsq(tall, b, rcond=None)[0])


def test_reflectors(spark, rng):
    for x in (rng.random(5), -rng.random(5), np.array([3.0, 0, 0]), np.array([-3.0, 0]), np.zeros(3)):
        rows = k.reflectors(side(spark, x)).orderBy("i").collect()
        v, beta, norm = np.array([r.v for r in rows]), rows[0].beta, rows[0].norm
        assert np.allclose(x - beta * v * (v @ x), norm * np.eye(len(x))[0])


def test_factors(spark, rng):
    pattern = (rng.random((9, 9)) < 0.4) | np.eye(9, dtype=bool)
    a = np.where(pattern, rng.random((9, 9)), 0) + 9 * np.eye(9)
    lu = whole(k.incomplete_lu(grouped(entries(spark, a))), 9, 9)
    product = (np.tril(lu, -1) + np.eye(9)) @ np.triu(lu)
    assert np.allclose(product[pattern], a[pattern]) and not lu[~pattern].any()
    spd, w = a @ a.T, rng.random(9)
    lower = np.linalg.cholesky(spd)
    for sign in (1, -1):
        got = whole(k.updated_factor(grouped(entries(spark, lower)), side(spark, w), sign), 9, 9)
        assert np.allclose(got @ got.T, spd + sign * np.outer(w, w))


def symbolic(pattern):
    filled = pattern.copy()
    for c in range(len(filled)):
        below = np.flatnonzero(filled[c + 1 :, c]) + c + 1
        filled[np.ix_(below, below)] = True
    return np.tril(filled)


def test_symbolic_analysis(spark, rng):
    for _ in range(3):
        pattern = rng.random((12, 12)) < 0.2
        pattern = pattern | pattern.T | np.eye(12, dtype=bool)
        factor = symbolic(pattern)
        got = k.elimination_tree(grouped(entries(spark, pattern.astype(float)))).orderBy("node").collect()
        parents = [next((r for r in range(c + 1, 12) if factor[r, c]), -1) for c in range(12)]
        assert [r.parent for r in got] == parents and [r.entries for r in got] == factor.sum(axis=0).tolist()
        order = {r.old: r.new for r in k.minimum_degree(grouped(entries(spark, pattern.astype(float)))).collect()}
        assert sorted(order) == sorted(order.values()) == list(range(12))
        p = spark.createDataFrame(sorted(order.items()), "old long, new long")
        moved = whole(k.permuted_symmetric(entries(spark, pattern.astype(float)), p), 12, 12)
        old = [o for o, _ in sorted(order.items(), key=lambda x: x[1])]
        assert np.array_equal(moved, np.triu(pattern[np.ix_(old, old)].astype(float)))
    star = np.eye(8)
    star[0, :] = star[:, 0] = 1
    order = {r.old: r.new for r in k.minimum_degree(grouped(entries(spark, star))).collect()}
    assert order[0] >= 6


def test_matching_and_parts(spark, rng):
    for _ in range(4):
        pattern = rng.random((6, 6)) < 0.25
        pattern[5, 5] = True
        frame = grouped(entries(spark, pattern.astype(float)))
        pairs = k.maximum_matching(frame).collect()
        assert all(pattern[r.i, r.j] for r in pairs) and len({r.i for r in pairs}) == len({r.j for r in pairs}) == len(pairs)
        best = max(sum(pattern[i, p[i]] for i in range(6)) for p in itertools.permutations(range(6)))
        assert len(pairs) == best
        parts = {(r.side, r.node): r.part for r in k.coarse_blocks(frame).collect()}
        count = lambda s, p: sum(parts[s, x] == p for x in range(6))
        assert count("row", "square") == count("column", "square")
        assert count("column", "under") - count("row", "under") == 6 - best == count("row", "over") - count("column", "over")
        for i, j in zip(*np.nonzero(pattern), strict=True):  # block triangular
            rank = {"under": 0, "square": 1, "over": 2}
            assert rank[parts["row", i]] <= rank[parts["column", j]]


def test_column_reach(spark):
    lower = spark.createDataFrame([(0, 0, 1.0), (2, 0, 1.0), (3, 2, 1.0), (1, 1, 1.0), (4, 1, 1.0)], "i long, j long, v double")
    assert {r.node for r in k.column_reach(lower, [0]).collect()} == {0, 2, 3}


def test_writers(spark, rng, tmp_path):
    a = np.round(rng.random((5, 4)) * (rng.random((5, 4)) < 0.6), 6)
    numbers.write_boeing(entries(spark, a), f"{tmp_path}/b.rua", 5, 4, "a title")
    assert np.allclose(whole(numbers.read_boeing(spark, f"{tmp_path}/b.rua"), 5, 4), a)
    vector = spark.createDataFrame([(i, float(x)) for i, x in enumerate(a[:, 0])], "i long, x double")
    numbers.write_vector(vector, f"{tmp_path}/x.txt")
    assert [r.x for r in numbers.read_vector(spark, f"{tmp_path}/x.txt").orderBy("i").collect()] == a[:, 0].tolist()
    numbers.write_sized(entries(spark, a), f"{tmp_path}/q.txt", 5, 4)
    assert np.allclose(whole(numbers.read_sized(spark, f"{tmp_path}/q.txt"), 5, 4), a)
    digests = spark.createDataFrame([(2, "bb"), (1, "aa")], "doc_id long, md5 string")
    numbers.write_digests(digests, f"{tmp_path}/md5")
    assert "".join(p.read_text() for p in sorted((tmp_path / "md5").glob("part-*"))) == "aa\nbb\n"
    log = spark.createDataFrame([(1, 0.5), (0, 1.0)], "step long, residual double")
    numbers.write_log(log, f"{tmp_path}/log")
    assert "".join(p.read_text() for p in sorted((tmp_path / "log").glob("part-*"))) == "0 1.0\n1 0.5\n"


def test_simulation_script(spark, tmp_path):
    (tmp_path / "in.lj").write_text("# melt\nunits lj\npair_style lj/cut 2.5\npair_coeff 1 1 1.0 1.5 2.5\n  read_dump  start.dump 0 x y z  # begin\ntimestep 0.005\nrun 100\n")
    got = simulations.read_script(spark, f"{tmp_path}/in.lj")
    assert got == {"cutoff": 2.5, "run": 100, "timestep": 0.005, "dump": "start.dump", "pair_coeff": (1.0, 1.5)}


def test_mesh_files(spark, tmp_path):
    numbers_ = [*range(1500), *(10 * x for x in range(7)), *(x / 4 for x in range(25))]
    (tmp_path / "mesh").write_text("\n".join(f" {a} " for a in map(str, numbers_)))
    points, masses = simulations.read_mesh(spark, f"{tmp_path}/mesh", 1, 7)
    first = points.where("p = 1").first()
    assert list(first.jacobian) == [float(x) for x in range(12, 21)] and (first.kappa, first.mu, first.iglob) == (21.0, 22.0, 22)
    assert points.count() == 125 and {r.iglob: r.rmass for r in masses.collect()} == {x: 10.0 * x for x in range(7)}
    h = simulations.read_derivatives(spark, f"{tmp_path}/mesh", 1, 7)
    assert {(r.i, r.j): r.v for r in h.collect()} == {(x // 5, x % 5): x / 4 for x in range(25)}
    blocks = spark.createDataFrame([(1, 2, 3, 4), (0, 5, 6, 7)], "level int, bx long, by long, bz long")
    simulations.write_blocks(blocks, f"{tmp_path}/blocks")
    assert "".join(p.read_text() for p in sorted((tmp_path / "blocks").glob("part-*"))) == "2\n0 5 6 7\n1 2 3 4\n"
