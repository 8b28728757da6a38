"""Direct methods on sparse matrices ``g, i, j, v``: solves, orderings, symbolic analysis.

These walk a matrix in an order that each step sets for the next, so one
matrix (``g``) is one task; many matrices run side by side. What has no such
order (products, sums, permutations, norms) is in :mod:`matrices`, what is
too large for a task in :mod:`tiles`.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.factorise import solve_lower, solve_upper
from gridloom.plans.shipping import ship


def _each(a: DataFrame, fn, schema: str) -> DataFrame:
    """Rows that ``fn`` makes of each matrix, given as size and entries; ``g`` is put before them."""
    ship(a.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(max(rows.i.max(), rows.j.max())) + 1
        made = fn(n, rows)
        made.insert(0, "g", rows.g.iloc[0])
        return made

    return a.groupBy("g").applyInPandas(run, f"g long, {schema}")


def _dense(n: int, rows: pd.DataFrame) -> np.ndarray:
    out = np.zeros((n, n))
    np.add.at(out, (rows.i.to_numpy(), rows.j.to_numpy()), rows.v.to_numpy())
    return out


def solve(a: DataFrame, b: DataFrame, method: str) -> DataFrame:
    """``g, i, x`` of A x = b for each matrix and right side ``g, i, x``.

    ``lu`` pivots by rows, ``cholesky`` reads a positive definite matrix,
    ``qr`` gives the least squares solution, also of more rows than columns;
    ``lower``, ``upper``, ``lower_transposed`` and ``upper_transposed`` read
    one triangle. Rows that ``b`` lacks are zero.
    """
    ship(a.sparkSession)

    def run(matrix: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(matrix):
            return pd.DataFrame({"g": [], "i": [], "x": []})
        rows, columns = int(matrix.i.max()) + 1, int(matrix.j.max()) + 1
        if method != "qr":
            rows = columns = max(rows, columns)
        full = np.zeros((rows, columns))
        np.add.at(full, (matrix.i.to_numpy(), matrix.j.to_numpy()), matrix.v.to_numpy())
        side = np.zeros(rows)
        side[right["at"].to_numpy()] = right.value.to_numpy()
        x = SOLVERS[method](full, side)
        return pd.DataFrame({"g": matrix.g.iloc[0], "i": range(len(x)), "x": x})

    return a.groupBy("g").cogroup(_renamed(b)).applyInPandas(run, "g long, i long, x double")


def _renamed(b: DataFrame):
    """A right side by matrix, with names of its own, as both sides may come from one frame."""
    return b.select(F.col("g").alias("of"), F.col("i").alias("at"), F.col("x").alias("value")).groupBy("of")


def _pivoted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.copy(), b.copy()
    for k in range(len(a)):
        p = k + int(np.argmax(np.abs(a[k:, k])))
        a[[k, p]], b[[k, p]] = a[[p, k]], b[[p, k]]
        factors = a[k + 1 :, k] / a[k, k]
        a[k + 1 :] -= np.outer(factors, a[k])
        b[k + 1 :] -= factors * b[k]
    return solve_upper(a, b)


def _by_cholesky(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lower = np.linalg.cholesky(a)
    return solve_upper(lower.T, solve_lower(lower, b))


def _by_qr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.copy(), b.copy()
    for k in range(a.shape[1]):
        v, beta, norm = reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        b[k:] -= beta * v * (v @ b[k:])
        a[k, k] = norm
    n = a.shape[1]
    return solve_upper(np.triu(a[:n]), b[:n])


SOLVERS = {
    "lu": _pivoted,
    "cholesky": _by_cholesky,
    "qr": _by_qr,
    "lower": lambda a, b: solve_lower(np.tril(a), b),
    "upper": lambda a, b: solve_upper(np.triu(a), b),
    "lower_transposed": lambda a, b: solve_upper(np.tril(a).T, b),
    "upper_transposed": lambda a, b: solve_lower(np.triu(a).T, b),
}


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v, beta and s such that (I - beta v v') x is s times the first unit vector; v begins with 1 unless x is zero."""
    rest, norm = float(x[1:] @ x[1:]), float(np.linalg.norm(x))
    v = np.array(x, dtype=np.float64)
    if rest == 0:
        v[0] = 1.0
        return v, (0.0 if x[0] >= 0 else 2.0), abs(float(x[0]))
    lead = -rest / (x[0] + norm) if x[0] > 0 else x[0] - norm
    v = v / lead
    v[0] = 1.0
    return v, 2 * lead * lead / (rest + lead * lead), norm


def reflectors(x: DataFrame) -> DataFrame:
    """``g, i, v, beta, norm`` of vectors ``g, i, x``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        v, beta, norm = reflector(rows.x.to_numpy())
        return pd.DataFrame({"g": rows.g, "i": rows.i, "v": v, "beta": beta, "norm": norm})

    ship(x.sparkSession)
    return x.groupBy("g").applyInPandas(run, "g long, i long, v double, beta double, norm double")


def incomplete_lu(a: DataFrame) -> DataFrame:
    """``g, i, j, v``: the combined factor without fill-in, on the entries of A only."""

    def factor(n: int, rows: pd.DataFrame) -> pd.DataFrame:
        lines: list[dict[int, float]] = [{} for _ in range(n)]
        for i, j, v in zip(rows.i, rows.j, rows.v, strict=True):
            lines[i][j] = lines[i].get(j, 0.0) + v
        for i in range(n):
            for k in sorted(c for c in lines[i] if c < i):
                lines[i][k] /= lines[k][k]
                for j, u in lines[k].items():
                    if j > k and j in lines[i]:
                        lines[i][j] -= lines[i][k] * u
        return pd.DataFrame([(i, j, v) for i in range(n) for j, v in sorted(lines[i].items())], columns=["i", "j", "v"])

    return _each(a, factor, "i long, j long, v double")


def updated_factor(lower: DataFrame, w: DataFrame, sign: int = 1) -> DataFrame:
    """``g, i, j, v``: the lower factor of L L' + sign w w', with ``g, i, x`` as w; a downdate has to stay positive definite."""
    ship(lower.sparkSession)

    def run(rows: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n = int(rows.i.max()) + 1
        factor, x = np.tril(_dense(n, rows)), np.zeros(n)
        x[right["at"].to_numpy()] = right.value.to_numpy()
        for k in range(n):
            square = factor[k, k] ** 2 + sign * x[k] ** 2
            if square <= 0:
                raise ArithmeticError("the matrix is no longer positive definite")
            r = math.sqrt(square)
            c, s = r / factor[k, k], x[k] / factor[k, k]
            factor[k, k] = r
            factor[k + 1 :, k] = (factor[k + 1 :, k] + sign * s * x[k + 1 :]) / c
            x[k + 1 :] = c * x[k + 1 :] - s * factor[k + 1 :, k]
        i, j = np.tril_indices(n)
        return pd.DataFrame({"g": rows.g.iloc[0], "i": i, "j": j, "v": factor[i, j]})

    return lower.groupBy("g").cogroup(_renamed(w)).applyInPandas(run, "g long, i long, j long, v double")


def _above(n: int, rows: pd.DataFrame) -> list[list[int]]:
    """For each column the rows above the diagonal that have an entry."""
    found: list[set[int]] = [set() for _ in range(n)]
    for i, j in zip(rows.i, rows.j, strict=True):
        if i < j:
            found[j].add(int(i))
    return [sorted(f) for f in found]


def elimination_parents(above: list[list[int]]) -> list[int]:
    """The parent of each column in the elimination tree, -1 for a root; paths are shortened as they are walked."""
    parents, highest = [-1] * len(above), list(range(len(above)))
    for column, rows in enumerate(above):
        for node in rows:
            while node != column:
                up, highest[node] = highest[node], column
                if up == node:
                    parents[node] = column
                    break
                node = up
    return parents


def elimination_tree(a: DataFrame) -> DataFrame:
    """``g, node, parent, entries``: the tree of a symmetric matrix (its upper half is read) and the size of each column of its factor."""

    def tree(n: int, rows: pd.DataFrame) -> pd.DataFrame:
        above = _above(n, rows)
        parents, sizes, seen = elimination_parents(above), [1] * n, [-1] * n
        for row in range(n):
            seen[row] = row
            for node in above[row]:
                while seen[node] != row:
                    sizes[node] += 1
                    seen[node] = row
                    node = parents[node]
        return pd.DataFrame({"node": range(n), "parent": parents, "entries": sizes})

    return _each(a, tree, "node long, parent long, entries long")


def minimum_degree(a: DataFrame) -> DataFrame:
    """``g, old, new``: an elimination order of a symmetric pattern that takes the node with the fewest neighbours first, ties by number."""

    def order(n: int, rows: pd.DataFrame) -> pd.DataFrame:
        near: list[set[int]] = [set() for _ in range(n)]
        for i, j in zip(rows.i, rows.j, strict=True):
            if i != j:
                near[i].add(int(j))
                near[j].add(int(i))
        left, taken = set(range(n)), []
        while left:
            node = min(left, key=lambda k: (len(near[k]), k))
            left.remove(node)
            taken.append(node)
            for k in near[node]:
                near[k] |= near[node]
                near[k] -= {k, node}
        return pd.DataFrame({"old": taken, "new": range(n)})

    return _each(a, order, "old long, new long")


def _matched(n: int, rows: pd.DataFrame) -> tuple[list[list[int]], list[int], list[int]]:
    """Rows of each column, and a largest matching as the row of each column and the column of each row."""
    of_column: list[list[int]] = [[] for _ in range(n)]
    for i, j in sorted(set(zip(rows.i.tolist(), rows.j.tolist(), strict=True))):
        of_column[j].append(i)
    row_of, column_of = [-1] * n, [-1] * n
    for start in range(n):
        before, queue, end = {}, deque([start]), -1
        while queue and end < 0:
            column = queue.popleft()
            for row in of_column[column]:
                if row not in before:
                    before[row] = column
                    if column_of[row] < 0:
                        end = row
                        break
                    queue.append(column_of[row])
        while end >= 0:
            column = before[end]
            column_of[end], row_of[column], end = column, end, row_of[column]
    return of_column, row_of, column_of


def maximum_matching(a: DataFrame) -> DataFrame:
    """``g, i, j``: entries of which each row and each column has one at most, as many as can be."""

    def match(n: int, rows: pd.DataFrame) -> pd.DataFrame:
        pairs = [(row, column) for column, row in enumerate(_matched(n, rows)[1]) if row >= 0]
        return pd.DataFrame(pairs, columns=["i", "j"]).astype("int64")

    return _each(a, match, "i long, j long")


def coarse_blocks(a: DataFrame) -> DataFrame:
    """``g, side, node, part``: rows and columns in the wide (``under``), square and tall (``over``) part of a matrix.

    Columns without a partner and what alternating paths from them reach are
    under-determined, rows without one and what reaches them over-determined.
    """

    def decompose(n: int, rows: pd.DataFrame) -> pd.DataFrame:
        of_column, row_of, column_of = _matched(n, rows)
        of_row: list[list[int]] = [[] for _ in range(n)]
        for column, found in enumerate(of_column):
            for row in found:
                of_row[row].append(column)

        def reached(free: list[int], across: list[list[int]], back: list[int]) -> tuple[set[int], set[int]]:
            own, other, queue = set(free), set(), deque(free)
            while queue:
                for node in across[queue.popleft()]:
                    if node not in other:
                        other.add(node)
                        if back[node] >= 0 and back[node] not in own:
                            own.add(back[node])
                            queue.append(back[node])
            return own, other

        wide_columns, wide_rows = reached([c for c in range(n) if row_of[c] < 0], of_column, column_of)
        tall_rows, tall_columns = reached([r for r in range(n) if column_of[r] < 0], of_row, row_of)
        out = [("row", r, "under" if r in wide_rows else "over" if r in tall_rows else "square") for r in range(n)]
        out += [("column", c, "under" if c in wide_columns else "over" if c in tall_columns else "square") for c in range(n)]
        return pd.DataFrame(out, columns=["side", "node", "part"])

    return _each(a, decompose, "side string, node long, part string")


def permuted_symmetric(a: DataFrame, p: DataFrame) -> DataFrame:
    """``i, j, v``: the upper half of P A P' for a symmetric A of which the upper half is stored, and ``old, new``."""
    upper = a.where("i <= j")
    moved = upper.join(p.select(F.col("old").alias("i"), F.col("new").alias("x")), "i").join(p.select(F.col("old").alias("j"), F.col("new").alias("y")), "j")
    return moved.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "v")


def column_reach(lower: DataFrame, columns: list[int]) -> DataFrame:
    """``node``: the unknowns that may differ from zero in L x = b if ``columns`` are those of b's entries."""
    from gridloom.operators.graphs import breadth_first

    return breadth_first(lower.where("i > j"), columns).select("node")
