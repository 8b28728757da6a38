"""Inputs of the queries, derived from the driver's tables by formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def square(spark: SparkSession, n: int) -> DataFrame:
    """All ``i, j`` below ``n``."""
    cells = spark.range(n * n)
    return cells.select((F.col("id") / n).cast("long").alias("i"), (F.col("id") % n).alias("j"))


def quantity_matrix(spark: SparkSession, sf_dir: str, n: int = 40) -> DataFrame:
    """``i, j, v`` of the order and supplier keys modulo ``n``."""
    items = table(spark, sf_dir, "lineitem")
    keys = (F.col("l_orderkey") % n).alias("i"), (F.col("l_suppkey") % n).alias("j")
    return items.groupBy(*keys).agg(F.sum("l_quantity").alias("v"))


#: The same in SQL.
QUANTITY_MATRIX = "SELECT l_orderkey % 40 AS i, l_suppkey % 40 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"


def ramp(spark: SparkSession, n: int = 40) -> DataFrame:
    """Vector ``i, x`` = 1 + i % 7."""
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(1.0) + F.col("id") % 7).alias("x"))


RAMP = "SELECT i, 1.0 + i % 7 AS x FROM range(40) t(i)"


def square_sql(n: int) -> str:
    return f"SELECT a.i, b.j FROM range({n}) a(i), range({n}) b(j)"
