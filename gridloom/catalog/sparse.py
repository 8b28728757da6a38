"""Sparse direct methods on the network of all orders.

Nodes are orders, customers, nations and regions; an order is tied to its
customer and to the customer's order before it, a customer to its nation, a
nation to its region. The matrix is the network's Laplacian plus one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.catalog.tables import table
from gridloom.operators import matching
from gridloom.operators import sparse_direct as m
from gridloom.plans.durable import cut, written

CUSTOMERS, NATIONS, REGIONS = 10**15, 2 * 10**15, 3 * 10**15


def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``i, j``: each tie once, the smaller node as ``j``."""
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    ties = orders.select(F.col("o_orderkey").alias("x"), before.alias("y")).where("y IS NOT NULL")
    ties = ties.union(orders.select("o_orderkey", F.col("o_custkey") + CUSTOMERS))
    ties = ties.union(customers.select(F.col("c_custkey") + CUSTOMERS, F.col("c_nationkey") + F.lit(NATIONS)))
    ties = ties.union(nations.select(F.col("n_nationkey") + F.lit(NATIONS), F.col("n_regionkey") + F.lit(REGIONS)))
    return ties.select(F.greatest("x", "y").alias("i"), F.least("x", "y").alias("j")).distinct()


def network_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower half: -1 for each tie, one more than its ties for each node."""
    edges = network_edges(spark, sf_dir)
    ends = edges.select("i").union(edges.select(F.col("j").alias("i")))
    diagonal = ends.groupBy("i").agg((F.count(F.lit(1)) + 1).cast("double").alias("v"))
    return edges.select("i", "j", F.lit(-1.0).alias("v")).union(diagonal.select("i", F.col("i").alias("j"), "v"))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("x"))


def _rounded(column: str, digits: int):
    return (F.round(column, digits) + F.lit(0.0)).alias(column)


def sparse_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elimination tree, postorder and column counts of the network's matrix."""
    return m.elimination_forest(network_matrix(spark, sf_dir))


def sparse_factor_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L L' at every entry of the factor: the matrix, and zero where L has filled in."""
    factor = m.cholesky(network_matrix(spark, sf_dir))
    other = factor.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))
    product = factor.join(other, "j").where("i >= k").groupBy("i", F.col("k").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return product.select("i", "j", _rounded("v", 6))


def sparse_cholesky_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A x for the solution x of A x = b, b being the prices of the orders."""
    with written(spark) as keep:
        matrix = keep(network_matrix(spark, sf_dir))
        x = m.positive_solve(matrix, _prices(spark, sf_dir)).select(F.col("i").alias("j"), "x")
        full = matrix.union(matrix.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
        return cut(full.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("b")).select("i", _rounded("b", 4)))


def sparse_lower_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solution with the lower half of the matrix and the roots of the prices of orders in progress as right side."""
    partial = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("i"), F.sqrt("o_totalprice").alias("x"))
    return m.triangular_solve(network_matrix(spark, sf_dir), partial).select("i", _rounded("x", 4))


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse and fine blocks of the pattern of orders (rows) and their customers (columns)."""
    return matching.dulmage_mendelsohn(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("j")))


QUERIES = {q.__name__: q for q in (sparse_forest, sparse_factor_product, sparse_cholesky_solve, sparse_lower_solve, order_blocks)}

_EDGES = f"""ties AS (
  SELECT o_orderkey AS x, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS y FROM orders
  UNION ALL SELECT o_orderkey, o_custkey + {CUSTOMERS} FROM orders
  UNION ALL SELECT c_custkey + {CUSTOMERS}, c_nationkey + {NATIONS} FROM customer
  UNION ALL SELECT n_nationkey + {NATIONS}, n_regionkey + {REGIONS} FROM nation),
edges AS (SELECT DISTINCT greatest(x, y) AS i, least(x, y) AS j FROM ties WHERE y IS NOT NULL),
diagonal AS (SELECT i, count(*) + 1.0 AS v FROM (SELECT i FROM edges UNION ALL SELECT j FROM edges) GROUP BY i)"""

#: The factor has an entry where a path leads from its column to its row through nodes before the column.
_FILLED = f"""WITH RECURSIVE {_EDGES},
sides AS MATERIALIZED (SELECT i AS a, j AS b FROM edges UNION ALL SELECT j, i FROM edges),
walks(j, here) AS (
  SELECT a, b FROM sides UNION SELECT walks.j, sides.b FROM walks JOIN sides ON sides.a = walks.here WHERE walks.here < walks.j),
filled AS (SELECT here AS i, j FROM walks WHERE here > j)"""

ORACLE_SQL = {
    "sparse_forest": f"""{_FILLED},
tree AS (
  SELECT d.i AS node, min(f.i) AS parent, count(f.i) + 1 AS count FROM diagonal d LEFT JOIN filled f ON f.j = d.i GROUP BY d.i),
up(node, above) AS (SELECT node, node FROM tree UNION ALL SELECT up.node, tree.parent FROM up JOIN tree ON tree.node = up.above WHERE tree.parent IS NOT NULL),
sizes AS (SELECT above AS node, count(*) AS size FROM up GROUP BY above),
older AS (
  SELECT node, coalesce(sum(size) OVER (PARTITION BY parent ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM tree JOIN sizes USING (node)),
shift AS (SELECT up.node, sum(before) AS before FROM up JOIN older ON older.node = up.above GROUP BY up.node)
SELECT node, parent, CAST(size - 1 + before AS BIGINT) AS post, count FROM tree JOIN sizes USING (node) JOIN shift USING (node)""",
    "sparse_factor_product": f"""{_FILLED}
SELECT filled.i, filled.j, CASE WHEN edges.i IS NULL THEN 0.0 ELSE -1.0 END::DOUBLE AS v
FROM filled LEFT JOIN edges ON edges.i = filled.i AND edges.j = filled.j
UNION ALL SELECT i, i, v::DOUBLE FROM diagonal""",
    "sparse_cholesky_solve": f"""WITH {_EDGES}
SELECT i, round(coalesce(o_totalprice, 0.0), 4) AS b FROM diagonal LEFT JOIN orders ON o_orderkey = i""",
    "sparse_lower_solve": f"""WITH RECURSIVE {_EDGES},
terms(step, i, x) AS (
  SELECT 0, i, sqrt(o_totalprice) / v FROM orders JOIN diagonal ON i = o_orderkey WHERE o_orderstatus = 'P'
  UNION ALL
  SELECT step + 1, edges.i, sum(x / v) FROM terms JOIN edges ON edges.j = terms.i JOIN diagonal ON diagonal.i = edges.i GROUP BY step, edges.i)
SELECT i, round(sum(x), 4) AS x FROM terms GROUP BY i""",
    # a customer of one order is a block of its own, one of several has more rows than columns
    "order_blocks": """WITH t AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1)
SELECT 'column' AS side, c AS node, CASE n WHEN 1 THEN 'square' ELSE 'over' END AS part, CASE n WHEN 1 THEN c END AS block FROM t
UNION ALL SELECT 'row', o_orderkey, CASE n WHEN 1 THEN 'square' ELSE 'over' END, CASE n WHEN 1 THEN c END FROM orders JOIN t ON c = o_custkey""",
}
