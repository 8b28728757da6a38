"""Sparse direct methods in frames against dense numpy and plain Python."""

from contextlib import contextmanager

import numpy as np
import pytest

from gridloom.operators import sparse_direct as m
from gridloom.operators.toolkit import elimination_parents
from gridloom.plans.ordering import dense_order


def random_spd(seed, n, ties):
    draw = np.random.default_rng(seed)
    a = np.zeros((n, n))
    for _ in range(ties):
        i, j = draw.integers(0, n, 2)
        if i != j:
            a[i, j] = a[j, i] = draw.normal()
    a[np.arange(n), np.arange(n)] = np.abs(a).sum(axis=1) + 1
    return a


def entries(spark, a, lower=True):
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True) if i >= j or not lower]
    return spark.createDataFrame(rows, "i long, j long, v double").repartition(3)


def dense(frame, n):
    out = np.zeros((n, n))
    for r in frame.collect():
        out[r.i, r.j] += r.v
    return out


@pytest.fixture(scope="module")
def matrix():
    a = random_spd(4, 24, 30)
    a[20], a[:, 20] = 0, 0  # a node without ties is a root of its own
    a[20, 20] = 2.0
    return a


def test_forest(spark, matrix):
    n = len(matrix)
    above = [sorted(np.flatnonzero(matrix[:j, j]).tolist()) for j in range(n)]
    parents = elimination_parents(above)
    factor = np.linalg.cholesky(matrix)
    order, stack = [], [(None, False)]
    while stack:
        node, left = stack.pop()
        if left:
            order.append(node)
        else:
            stack += [(node, True)] if node is not None else []
            stack += [(c, False) for c in range(n - 1, -1, -1) if parents[c] == (-1 if node is None else node)]
    got = {r.node: r for r in m.elimination_forest(entries(spark, matrix)).collect()}
    assert [got[k].parent for k in range(n)] == [None if p < 0 else p for p in parents]
    assert [got[k].post for k in order] == list(range(n))
    assert [got[k]["count"] for k in range(n)] == [(np.abs(factor[:, k]) > 1e-14).sum() for k in range(n)]


def test_cholesky_and_solve(spark, matrix):
    n, a = len(matrix), entries(spark, matrix)
    factor = m.cholesky(a)
    assert np.allclose(dense(factor, n), np.linalg.cholesky(matrix))
    b = np.arange(n) % 5 - 1.0
    right = spark.createDataFrame([(i, float(x)) for i, x in enumerate(b) if x], "i long, x double")
    x = {r.i: r.x for r in m.cholesky_solve(factor, right).collect()}
    assert np.allclose([x.get(i, 0.0) for i in range(n)], np.linalg.solve(matrix, b))


@pytest.mark.parametrize("part, bucket, updates", [(512, 50_000, 1 << 21), (24, 8, 4)])
def test_subtrees_and_what_is_above(spark, matrix, monkeypatch, part, bucket, updates):
    """The factor and the solution do not depend on how much one task takes."""
    for name, value in (("PART", part), ("BUCKET", bucket), ("UPDATES", updates)):
        monkeypatch.setattr(m, name, value)
    n, a = len(matrix), entries(spark, matrix, lower=False)
    got = m.cholesky(a)
    assert np.allclose(dense(got, n), np.linalg.cholesky(matrix))
    assert got.count() == got.select("i", "j").distinct().count() == (np.abs(np.linalg.cholesky(matrix)) > 1e-14).sum()
    b = np.arange(n) % 5 - 1.0
    right = spark.createDataFrame([(i, float(x) / 2) for i, x in enumerate(b) if x] * 2 + [(3, None)], "i long, x double")
    x = {r.i: r.x for r in m.positive_solve(a, right).collect()}
    assert np.allclose([x.get(i, 0.0) for i in range(n)], np.linalg.solve(matrix, b))


def test_solve_refuses_and_is_empty(spark):
    right = spark.createDataFrame([(0, 1.0), (1, 1.0)], "i long, x double")
    for rows in ([(0, 0, 1.0), (1, 0, 2.0), (1, 1, 1.0)], [(1, 0, 1.0), (1, 1, 3.0)], [(1, 0, 1.0), (0, 0, 1.0)], [(0, 0, 1.0)]):
        with pytest.raises(ValueError, match="positive definite"):
            m.positive_solve(spark.createDataFrame(rows, "i long, j long, v double"), right)
    none = spark.createDataFrame([], "i long, j long, v double")
    assert m.positive_solve(none, right.where("false")).count() == 0


def test_chains_take_no_step_a_column(spark, monkeypatch):
    """40 chains of 12 columns, each tied to the one before: by levels these are twelve steps of some tables each."""
    n, tables, made = 480, [], m.written

    @contextmanager
    def counted(session):
        with made(session) as keep:
            yield lambda frame: tables.append(1) or keep(frame)

    monkeypatch.setattr(m, "written", counted)
    a = np.diag(np.full(n, 3.0))
    for k in range(40, n):
        a[k, k - 40] = a[k - 40, k] = -1.0
    assert np.allclose(dense(m.cholesky(entries(spark, a)), n), np.linalg.cholesky(a))
    assert len(tables) < 20


def test_cholesky_refuses_and_is_empty(spark):
    a = np.array([[1.0, 2.0], [2.0, 1.0]])
    with pytest.raises(ValueError, match="positive definite"):
        m.cholesky(entries(spark, a))
    assert m.cholesky(entries(spark, np.eye(2)).where("false")).count() == 0


def test_cholesky_refuses_a_column_without_diagonal(spark):
    with pytest.raises(ValueError, match="positive definite"):
        m.cholesky(spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0)], "i long, j long, v double"))


@pytest.mark.parametrize("upper", [False, True])
def test_triangular_solve_touches_the_reach(spark, upper):
    t = np.tril(random_spd(9, 20, 25))
    t = t.T if upper else t
    start = [12, 15]
    right = spark.createDataFrame([(start[0], 2.0), (start[1], -1.0), (start[1], 0.5)], "i long, x double")
    b = np.zeros(20)
    b[start] = 2.0, -0.5
    got = {r.i: r.x for r in m.triangular_solve(entries(spark, t, lower=False), right).collect()}
    want = np.linalg.solve(t, b)
    assert set(np.flatnonzero(want)) <= set(got) and len(got) < 20
    assert np.allclose([got.get(i, 0.0) for i in range(20)], want)


def test_triangular_solve_refuses(spark):
    right = spark.createDataFrame([(0, 1.0)], "i long, x double")
    with pytest.raises(ValueError, match="singular"):
        m.triangular_solve(spark.createDataFrame([(1, 0, 1.0), (0, 0, 1.0)], "i long, j long, v double"), right)
    both = [(0, 0, 1.0), (1, 1, 1.0), (0, 1, 1.0), (1, 0, 1.0)]
    with pytest.raises(ValueError, match="triangular"):
        m.triangular_solve(spark.createDataFrame(both, "i long, j long, v double"), right)


def test_tour_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1 if k < 39 else None) for k in range(40)]
    star = [(100 + k, 200) for k in range(30)] + [(200, None)]
    got = {r.node: (r.post, r.depth) for r in m.tour_ranks(spark.createDataFrame(chain + star, "node long, parent long")).collect()}
    assert all(got[k] == (k, 39 - k) for k in range(40))
    assert all(got[100 + k] == (40 + k, 1) for k in range(30)) and got[200] == (70, 0)


def test_tour_moves_what_is_left(spark, monkeypatch):
    """Rounds that carry all nodes along write 2 n rows each; here all of them together write a few n."""
    n, draw, rows, made = 300, np.random.default_rng(5), [], m.written

    @contextmanager
    def counted(session):
        with made(session) as keep:

            def keep_counted(frame):
                kept = keep(frame)
                rows.append(kept.count())
                return kept

            yield keep_counted

    monkeypatch.setattr(m, "written", counted)
    parents = [int(draw.integers(k + 1, n)) if k < n - 1 else None for k in range(n)]
    got = {r.node: (r.post, r.depth) for r in m.tour_ranks(spark.createDataFrame(list(enumerate(parents)), "node long, parent long")).collect()}
    order, stack = [], [(n - 1, 0, False)]
    while stack:
        node, depth, left = stack.pop()
        if left:
            order.append((node, depth))
        else:
            stack += [(node, depth, True)] + [(c, depth + 1, False) for c in range(n - 1, -1, -1) if parents[c] == node]
    assert [got[node] for node, _ in order] == [(k, depth) for k, (_, depth) in enumerate(order)]
    assert sum(rows) < 10 * n


def test_dense_order(spark):
    frame = spark.range(1000).selectExpr("id * 7919 % 1000 AS v", "id").repartition(7)
    got = dense_order(frame, ["v"], "at").collect()
    assert all(r["at"] == r.v for r in got) and len(got) == 1000
