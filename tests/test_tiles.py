"""Block algebra against numpy, with sizes that are no multiples of the tile."""

import numpy as np
import pytest

from gridloom.operators import tiles as t


def entries(spark, matrix):
    rows = [(int(i), int(j), float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix), strict=True)]
    return spark.createDataFrame(rows, "i long, j long, v double")


def whole(frame, rows, columns):
    out = np.zeros((rows, columns))
    for r in frame.collect():
        out[r.i, r.j] = r.v
    return out


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(21)


def test_product_and_layout(spark, rng):
    a, b = rng.random((9, 7)) * (rng.random((9, 7)) < 0.5), rng.random((7, 5))
    x, y = t.to_tiles(entries(spark, a), 4), t.to_tiles(entries(spark, b), 4)
    assert np.allclose(whole(t.from_tiles(x, 4), 9, 7), a)
    assert np.allclose(whole(t.from_tiles(t.product(x, y, 4), 4), 9, 5), a @ b)


def test_block_lu_of_a_sparse_pattern(spark, rng):
    a = rng.random((10, 10)) * (rng.random((10, 10)) < 0.3) + 10 * np.eye(10)
    a[:3, 6:] = a[6:, :3] = 0
    lu = whole(t.block_lu(entries(spark, a), 10, 3), 10, 10)
    assert np.allclose((np.tril(lu, -1) + np.eye(10)) @ np.triu(lu), a)


@pytest.mark.parametrize(("side", "lower", "trans", "unit"), [("left", True, False, False), ("left", False, False, True), ("left", True, True, False), ("right", True, False, False), ("right", False, True, False)])
def test_triangles(spark, rng, side, lower, trans, unit):
    a = rng.random((7, 7)) + 5 * np.eye(7)
    part = np.tril(a) if lower else np.triu(a)
    if unit:
        np.fill_diagonal(part, 1)
    op = part.T if trans else part
    b = rng.random((7, 5)) if side == "left" else rng.random((5, 7))
    b[:2] = 0
    flags = {"side": side, "lower": lower, "trans": trans, "unit": unit}
    made = op @ b if side == "left" else b @ op
    assert np.allclose(whole(t.triangular_product(entries(spark, a), entries(spark, b), 1.0, **flags), *b.shape), made)
    solved = whole(t.triangular_solve(entries(spark, a), entries(spark, b), 7, 5, tile=3, **flags), *b.shape)
    assert np.allclose(op @ solved if side == "left" else solved @ op, b)


def test_inverse_and_updates(spark, rng):
    a = rng.random((10, 10))
    a = a @ a.T + 10 * np.eye(10)
    frame = entries(spark, a)
    assert np.allclose(whole(t.positive_inverse(frame, 10, 4), 10, 10), np.linalg.inv(a))
    assert np.allclose(whole(t.gram(entries(spark, np.tril(a)), 10, 4), 10, 10), np.tril(a).T @ np.tril(a))
    made = whole(t.general_product(frame, frame, frame, 2.0, -1.0, True, False), 10, 10)
    assert np.allclose(made, 2 * a.T @ a - a)
    assert np.allclose(whole(t.symmetric_update(frame, frame, 1.0, 0.5), 10, 10), np.tril(a @ a.T + 0.5 * a))


@pytest.mark.parametrize("shape", [(12, 7), (8, 8)])
def test_block_qr(spark, rng, shape):
    a = rng.random(shape)
    q, r = t.block_qr(entries(spark, a), *shape, tile=3)
    q, r = whole(q, *shape), whole(r, shape[1], shape[1])
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(shape[1])) and np.allclose(r, np.triu(r))
