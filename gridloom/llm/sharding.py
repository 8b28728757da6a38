"""Sharding by minimax contiguous partition.

Documents of equal text form one atomic group; groups are ordered by digest.
The smallest shard capacity for which a greedy walk needs no more than the
wanted number of shards is found by binary search, and the cuts of that walk
are the shard borders. The driver never sees the groups: it walks over a
digest trie of group sizes, and only nodes in which some walk would have to
cut are opened further, so its memory depends on the number of shards and
search steps and not on the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import numbered
from gridloom.plans.durable import cut

#: Hex digits of the trie's first level (4: 65,536 nodes) and of each further one.
FIRST_DIGITS, STEP_DIGITS = 4, 2
#: What a row costs besides its text, in bytes.
ROW_BYTES = 8


def greedy_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """First atoms of the shards after the first one, or None if ``shards`` do not suffice.

    ``ends[i]`` is the size of the atoms up to and including ``i``.
    """
    cuts, start, base = [], 0, 0
    for _ in range(shards):
        stop = int(np.searchsorted(ends, base + capacity, side="right"))
        if stop == len(ends):
            return cuts
        if stop == start:
            return None
        cuts.append(stop)
        start, base = stop, int(ends[stop - 1])
    return None


def blocking(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Atoms that a greedy walk with this capacity could not place where it stood."""
    found, start, base = [], 0, 0
    for _ in range(shards):
        stop = int(np.searchsorted(ends, base + capacity, side="right"))
        if stop == len(ends):
            break
        found.append(stop)
        if stop == start:
            break
        start, base = stop, int(ends[stop - 1])
    return found


def minimax_borders(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Digest prefixes at which shards 1, 2, ... begin, and the smallest capacity.

    ``groups`` has ``digest`` (hex) and ``size``, one row per atomic group.
    """

    def nodes(of: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        got = of.groupBy(F.substring("digest", 1, digits).alias("p")).agg(F.sum("size"), F.count(F.lit(1)))
        return [tuple(row) for row in got.collect()]

    atoms = sorted(nodes(groups, FIRST_DIGITS))
    if not atoms:
        return [], 0
    while True:
        ends = np.cumsum(np.array([a[1] for a in atoms], dtype=np.int64))
        total = int(ends[-1])
        low, high, opened = -(-total // shards), total, set()
        while low < high:
            middle = (low + high) // 2
            opened.update(i for i in blocking(ends, middle, shards) if atoms[i][2] > 1)
            if greedy_cuts(ends, middle, shards) is None:
                low = middle + 1
            else:
                high = middle
        opened.update(i for i in blocking(ends, low, shards) if atoms[i][2] > 1)
        if not opened:
            return [atoms[i][0] for i in greedy_cuts(ends, low, shards) or []], low
        by_length: dict[int, list[str]] = {}
        for i in opened:
            by_length.setdefault(len(atoms[i][0]), []).append(atoms[i][0])
        atoms = [a for i, a in enumerate(atoms) if i not in opened]
        for digits, prefixes in by_length.items():
            inside = groups.where(F.substring("digest", 1, digits).isin(prefixes))
            atoms += nodes(inside, digits + STEP_DIGITS)
        atoms.sort()


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES
) -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal bytes.

    Returns ``<id_col>, size, text_crc32, law, shard, slot, grown_shard``.
    Rows of equal text (null counts as empty) share a shard, even if such a
    group is larger than a shard's fair part. Slots are gapless from 0 in
    each shard; ties in id and text may swap slots. The law is by bytes, so
    ``grown_shard`` is null. Null ids are rows like any other. An empty table
    gives an empty result, and with fewer groups than shards the last shards
    stay empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.substring(F.sha2(text.cast("binary"), 256), 1, 32).alias("digest"),
        )
    )
    groups = cut(sized.groupBy("digest").agg(F.sum("size").alias("size")))
    borders, _ = minimax_borders(groups, shards)
    passed = [(F.col("digest") >= b).cast("int") for b in borders]
    placed = sized.withColumn("shard", sum(passed, F.lit(0)).cast("int"))
    largest = placed.groupBy("shard").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    return numbered(placed, ["shard"], ["id", "digest"], "slot", largest).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
