"""Operators without SQL, against numpy or brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.catalog import dense, meshes
from gridloom.operators import amr, factorise, grids
from gridloom.operators import matrices as m
from gridloom.plans.components import connected_components


def to_numpy(frame, n):
    out = np.zeros((n, n))
    for r in frame.collect():
        out[r.i, r.j] = r.v
    return out


def test_cholesky_and_inverse(spark):
    a = dense.positive_matrix(spark)
    full = to_numpy(a, 16)
    assert np.allclose(to_numpy(factorise.tiled_cholesky(a, 16, 4), 16), np.linalg.cholesky(full))
    grouped = a.withColumn("g", F.lit(0).cast("long"))
    assert np.allclose(to_numpy(factorise.per_group(grouped, factorise.positive_inverse), 16), np.linalg.inv(full))


def test_triangular_solves():
    rng = np.random.default_rng(1)
    lower, right = np.tril(rng.random((9, 9))) + 9 * np.eye(9), rng.random((9, 3))
    assert np.allclose(factorise.solve_lower(lower, right), np.linalg.solve(lower, right))
    assert np.allclose(factorise.solve_upper(lower.T, right), np.linalg.solve(lower.T, right))
    lu = factorise.unit_lu(lower @ lower.T)
    assert np.allclose((np.tril(lu, -1) + np.eye(9)) @ np.triu(lu), lower @ lower.T)


def test_qr(spark):
    rng = np.random.default_rng(2)
    matrix = rng.random((50, 4))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(matrix)], "id long, vec array<double>")
    q, r = factorise.tall_qr(frame, 4, parts=3)
    q = np.stack([np.array(x.q) for x in q.orderBy("id").collect()])
    assert np.allclose(q @ to_numpy(r, 4), matrix)
    assert np.allclose(q.T @ q, np.eye(4))


def plain_sweep(u, top, left, height, width):
    for i in range(top, top + height):
        for j in range(left, left + width):
            u[i, j] = 0.25 * ((u[i, j - 1] + u[i, j + 1]) + (u[i - 1, j] + u[i + 1, j]))


def test_ordered_sweep():
    u = np.random.default_rng(3).random((9, 12))
    v = u.copy()
    grids.sweep_in_order(u, 1, 1, 7, 10)
    plain_sweep(v, 1, 1, 7, 10)
    assert np.array_equal(u, v)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_red_black(spark, block):
    n = 8
    start = np.random.default_rng(4).random((n + 2, n + 2))
    cells = [(i - 1, j - 1, float(start[i, j])) for i in range(n + 2) for j in range(n + 2)]
    grid = spark.createDataFrame(cells, "i long, j long, u double")
    for colour in (0, 1):
        for bi in range(-(-n // block)):
            for bj in range(-(-n // block)):
                if (bi + bj) % 2 == colour:
                    plain_sweep(start, bi * block + 1, bj * block + 1, min(block, n - bi * block), min(block, n - bj * block))
    got = np.zeros_like(start)
    for r in grids.red_black_sweep(block)(grid, n).collect():
        got[r.i + 1, r.j + 1] = r.u
    assert np.allclose(got, start)


def test_refinement_keeps_the_sum_and_the_balance(spark):
    ball = spark.createDataFrame(meshes.BALL, meshes.COLUMNS)
    cells = meshes._cells(spark)
    before = amr.checksum(cells).first()[0]
    for _ in range(2):
        cells = amr.refine(cells, ball, meshes.MESH)
    assert not amr.drifted(before, amr.checksum(cells).first()[0], 8)
    assert amr.drifted(1.0, 1.1, 2)
    levels = {(r.level, r.bx, r.by, r.bz) for r in amr.blocks_of(cells).collect()}
    assert max(level for level, *_ in levels) == 2
    for level, *at in levels:
        for axis in range(3):
            for step in (-1, 1):
                beyond = [a + step * (i == axis) for i, a in enumerate(at)]
                up = [b // 4 for b in beyond]
                assert (level - 2, *up) not in levels


def test_ghosts_between_levels(spark):
    """A value of one everywhere: a quarter from the coarser side, four from the finer."""
    cells = meshes._mixed(spark).withColumn("v", F.lit(1.0))
    seen = {(r.level, r.ghost) for r in amr.face_ghosts(cells, meshes.MESH).select("level", "ghost").distinct().collect()}
    assert seen == {(0, 1.0), (1, 1.0), (0, 4.0), (1, 0.25)}
    assert amr.face_ghosts(cells, meshes.MESH).count() == 6 * cells.count()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(frame, "a", "b").collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in range(100, 140)}, 7: 7}


def test_empty_matrices(spark):
    empty = spark.createDataFrame([], "i long, j long, v double")
    assert m.multiply(empty, empty).count() == 0
    assert m.row_norm(empty).first()[0] == 0.0
    assert m.running_sum(spark.createDataFrame([], "i long, x double")).count() == 0


def test_blocks_follow_a_target(spark):
    mesh = meshes.MESH
    ball = spark.createDataFrame(meshes.BALL, meshes.COLUMNS)
    cells = meshes._cells(spark)
    marked = amr.marks(amr.touched_blocks(amr.blocks_of(cells), ball, mesh), mesh)
    start = marked.count()
    split = marked.where("mark = 1").count()

    def after(frame):
        return sum({1: 8.0, 0: 1.0, -1: 1 / 8}[r.mark] for r in frame.collect())

    plain = after(marked)
    assert plain == start + 7 * split
    assert 0 <= after(amr.aimed(marked, int(plain) + 20, 1 << 40, mesh)) - (plain + 20) < 7
    assert 0 <= (plain - 10) - after(amr.aimed(marked, 0, int(plain) - 10, mesh)) < 7
    assert after(amr.aimed(marked, 0, 1 << 40, mesh)) == plain
    fine = amr.marks(amr.touched_blocks(amr.blocks_of(amr.split(cells)), ball, mesh), mesh).selectExpr("level", "bx", "by", "bz", "0 AS mark")
    assert after(amr.aimed(fine, 0, fine.count() - 14, mesh)) == fine.count() - 14
    refined = amr.refine(cells, ball, mesh, least=int(plain) + 20)
    assert amr.block_counts(refined).agg(F.sum("blocks")).first()[0] >= plain + 14


def plain_seen(values, wide, cell):
    """What a cell of ``values`` (level, x, y, z) -> v sees in 26 directions, looked up one by one."""
    level, *at = cell
    total = 0.0
    for o in itertools.product((-1, 0, 1), repeat=3):
        if o == (0, 0, 0):
            continue
        to = [min(max(p + q, 0), (w << level) - 1) for p, q, w in zip(at, o, wide, strict=True)]
        if (level, *to) in values:
            total += values[level, *to]
            continue
        out = [p // amr.SIDE - q // amr.SIDE for p, q in zip(to, at, strict=True)]
        for d in range(1, level + 1):
            total += values.get((level - d, *(p >> d for p in to)), 0.0) / 2 ** (d * out.count(0))
        for d in range(1, 3):
            n = 1 << d
            ranges = [range(p * n, p * n + n) if c == 0 else [p * n if c > 0 else p * n + n - 1] for p, c in zip(to, out, strict=True)]
            total += sum(values.get((level + d, *f), 0.0) for f in itertools.product(*ranges))
    return total


def test_means_of_27_across_levels(spark):
    """Four blocks of three levels, of which two meet in an edge two levels apart; two variables."""
    mesh = amr.Mesh((2, 2, 1), 2)
    cells = amr.first_cells(spark, mesh, lambda i: (i * 37 % 101) / 101.0)
    low = (F.col("x") < 4) & (F.col("y") < 4)
    high = (F.col("x") >= 4) & (F.col("y") >= 4)
    mixed = cells.where(low).unionByName(amr.split(cells.where(~low & ~high))).unionByName(amr.split(amr.split(cells.where(high))))
    both = mixed.withColumn("var", F.lit(0)).unionByName(mixed.withColumn("var", F.lit(1)).withColumn("v", F.col("v") * -2))
    got = {(r["var"], r.level, r.x, r.y, r.z): r.v for r in amr.smooth(both, mesh, 27, ("var",)).collect()}
    values = {(r.level, r.x, r.y, r.z): r.v for r in mixed.collect()}
    assert len(got) == 2 * len(values)
    wide = [b * amr.SIDE for b in mesh.blocks]
    for cell, v in values.items():
        mean = (v + plain_seen(values, wide, cell)) / 27
        assert got[0, *cell] == pytest.approx(mean, abs=1e-12)
        assert got[1, *cell] == pytest.approx(-2 * mean, abs=1e-12)


def test_means_of_no_cells(spark):
    none = meshes._cells(spark).where("false")
    assert amr.smooth(none, meshes.MESH, 27).count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    from gridloom.operators import points

    rng = np.random.default_rng(9)
    vectors = rng.integers(0, 4, (90, 3)).astype(float)
    frame = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(vectors)], "id long, vec array<double>, label int")
    whole = {(r.query, r.train, r.rank) for r in points.nearest(frame.where("id < 20"), frame, 6).collect()}
    monkeypatch.setattr(points, "BLOCK", 25)
    assert {(r.query, r.train, r.rank) for r in points.nearest(frame.where("id < 20"), frame, 6).collect()} == whole
    centres = frame.where("id < 5").selectExpr("id AS cid", "vec AS centre")
    near = {(r.id, r.cid, r.distance) for r in points.assign(frame, centres).collect()}
    monkeypatch.setattr(points, "MANY_CENTRES", 2)
    assert {(r.id, r.cid, r.distance) for r in points.assign(frame, centres).collect()} == near


@pytest.mark.parametrize(("n", "block"), [(7, 3), (8, 8), (5, 2)])
def test_gauss_seidel_by_blocks(spark, n, block):
    start = np.random.default_rng(13).random((n + 2, n + 2))
    cells = [(i - 1, j - 1, float(start[i, j])) for i in range(n + 2) for j in range(n + 2)]
    grid = grids.gauss_seidel_sweep(spark.createDataFrame(cells, "i long, j long, u double"), n, block)
    plain_sweep(start, 1, 1, n, n)
    got = {(r.i, r.j): r.u for r in grid.collect()}
    assert all(got[i - 1, j - 1] == start[i, j] for i in range(n + 2) for j in range(n + 2))


def test_numeric_operators_on_nothing(spark):
    from gridloom.operators import tiles

    none = spark.createDataFrame([], "i long, j long, v double")
    assert m.multiply(none, none).count() == 0 and m.row_norm(none).first().norm == 0.0
    assert tiles.to_tiles(none, 4).count() == 0 and tiles.product(tiles.to_tiles(none, 4), tiles.to_tiles(none, 4), 4).count() == 0
    assert m.sum_duplicates(spark.createDataFrame([(1, 1, None), (1, 1, 2.0)], none.schema)).first().v == 2.0


def test_distances_move_few_rows(spark, monkeypatch):
    """720,000 vectors in blocks of 1024 and 2048 move 69,000,000 rows; the result does not depend on groups and pieces."""
    from gridloom.operators import points

    queries, train = 72_000, 648_000
    qbs, tbs = points._group_counts(queries, train)
    assert queries * tbs + train * qbs < 10_000_000 and train / tbs <= points.ROWS and queries / qbs <= points.ROWS
    assert points._group_counts(0, 0) == (1, 1) and points._group_counts(1, 10**9)[1] >= 10**9 / points.ROWS
    rng = np.random.default_rng(22)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(rng.random((90, 3)))] + [(90, None, 1), (91, [1.0], 1), (92, [0.5, None, 0.5], 2)]
    frame = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    for name, value in (("GROUPS", 12), ("FEW_PAIRS", 4), ("CELLS", 20), ("RETURNED", 50)):
        monkeypatch.setattr(points, name, value)
    assert math.prod(points._group_counts(20, 93)) >= 12
    got = points.distances(frame.where("id < 17 OR id >= 90"), frame).collect()
    assert len(got) == 20 * 93 == len({(r.query, r.train) for r in got})
    for r in got:
        a, b = rows[r.query][1], rows[r.train][1]
        known = a is not None and b is not None and len(a) == len(b) and None not in a + b
        assert r.label == r.train % 3 or r.train >= 90
        assert r.distance == (round(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)), 9) if known else None)
    assert points.distances(frame.where("false"), frame).count() == 0


def test_nearest_rules_out_only_what_is_far(spark, monkeypatch):
    """Blocks of both sides, copies, and vectors that are missing, shorter or have a missing number, against brute force."""
    from gridloom.operators import points

    rng = np.random.default_rng(21)
    vectors = np.repeat(rng.random((120, 5)), 2, axis=0) + rng.integers(0, 2, (240, 1)) * 1e-11
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(vectors)] + [(240, None, 1), (241, [1.0, 2.0], 1), (242, [0.5, None, 0.5, 0.5, 0.5], 2)]
    frame = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    monkeypatch.setattr(points, "BLOCK", 60)
    monkeypatch.setattr(points, "QUERY_BLOCK", 7)
    monkeypatch.setattr(points, "ROUGH_CELLS", 150)

    def measured(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        return round(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)), 9)

    queries, known = [*rows[:20], *rows[240:]], {(q[0], t[0]): measured(q[1], t[1]) for q in rows for t in rows}
    both = frame.where("id < 20 OR id >= 240"), frame
    assert {(r.query, r.train): r.distance for r in points.distances(*both).collect()} == {(q[0], t[0]): known[q[0], t[0]] for q in queries for t in rows}
    expected = set()
    for q in queries:
        order = sorted(rows, key=lambda t: (known[q[0], t[0]] is None, known[q[0], t[0]] or 0.0, t[0]))
        expected |= {(q[0], t[0], rank, known[q[0], t[0]]) for rank, t in enumerate(order[:4], 1)}
    assert {(r.query, r.train, r.rank, r.distance) for r in points.nearest(*both, 4).collect()} == expected


def test_nearest_leaves_pairs_to_matrix_products():
    """Of 2,000 pairs a query a few are measured exactly."""
    from gridloom.operators import points

    rng = np.random.default_rng(22)
    a, b = rng.random((8, 20)), rng.random((8, 2000))
    left, right = points._near_pairs(a, b, 5)
    exact = points._squares(a[:, :, None], b[:, None, :])
    assert len(left) < 20 * 200
    assert all(set(np.argsort(exact[i])[:5]) <= set(right[left == i]) for i in range(20))


def test_qr_of_empty_partitions(spark):
    matrix = np.random.default_rng(23).random((6, 3))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(matrix)], "id long, vec array<double>")
    q, r = factorise.tall_qr(frame.repartitionByRange(20, "id").union(frame.where("id > 99")), 3)
    q = np.stack([np.array(x.q) for x in q.orderBy("id").collect()])
    assert np.allclose(q @ to_numpy(r, 3), matrix)


def test_stream_sums_do_not_depend_on_the_order(spark, monkeypatch):
    """The sum of 15^10 over 36 million rows is past 2^53: added up as doubles it would be off."""
    from gridloom.catalog import grids as queries

    monkeypatch.setattr(queries, "_numbers", lambda spark, sf_dir: spark.range(36_000_000))
    got = queries.stream_recurrence(spark, "").first()
    assert tuple(got) == tuple(36_000_000 * v // 10**9 for v in (15**10, 3 * 15**9, 4 * 15**9))


def test_sums_over_faces_are_those_of_the_ghosts(spark):
    cells = meshes._mixed(spark).select("level", F.lit(3).alias("var"), *amr.AXES, "v")
    keys = ["level", "var", *amr.AXES]
    ghosts = amr.face_ghosts(cells, meshes.MESH, ("var",)).groupBy(*keys).agg(F.sum("ghost").alias("s"))
    expected = {tuple(r)[:5]: r.s for r in ghosts.select(*keys, "s").collect()}
    got = {tuple(r)[:5]: r.s for r in amr.seen_over_faces(cells, meshes.MESH, ("var",)).select(*keys, "s").collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_tasks_of_the_line_mesh_grow_with_it(spark, monkeypatch):
    from conftest import SF

    assert meshes._line_mesh(spark, SF)[0].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(meshes, "KEYS", 8)
    monkeypatch.setattr(meshes, "LENGTH", 1)
    assert meshes._line_mesh(spark, SF)[0].rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_transforms_of_many_lines_in_one_call(spark):
    from gridloom.operators import images

    rng = np.random.default_rng(24)
    lines = {i: rng.random((5 + i % 3, 2)) for i in range(12)}
    points = [(i, j, float(p[0]), float(p[1])) for i, rows in lines.items() for j, p in enumerate(rows)]
    rng.shuffle(points)
    signal = spark.createDataFrame([(int(a), int(b), c, d) for a, b, c, d in points], "line long, i long, re double, im double")
    for inverse in (False, True):
        out = images.fft_lines(signal, "line", "i", inverse)
        assert "MapInArrow" in out._jdf.queryExecution().toString()
        got = {(r.line, r.i): complex(r.re, r.im) for r in out.collect()}
        for i, rows in lines.items():
            values = rows[:, 0] + 1j * rows[:, 1]
            expected = np.fft.ifft(values) * len(values) if inverse else np.fft.fft(values)
            assert np.allclose([got[i, j] for j in range(len(rows))], expected)
