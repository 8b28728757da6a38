"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the narrow numeric frames here that are broadcast without second thought (some tens of MB).
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if a bounded count finds no more than ``rows`` rows; else let the planner choose."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
