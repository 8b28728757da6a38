"""Prefix tries of conversations.

Equal conversations are one path from the start, with a count. Paths are dealt
by a hash of their first turn, and each bucket of rows becomes pointer tries in
Python dictionaries. A first turn below which there are too many rows for one
bucket is no bucket's business: the turns that all of its paths share become a
chain of nodes by aggregates, and its paths are dealt again by the turn that
follows, as often as needed. Sums over subtrees then rise from the buckets
through the chains to the root.

A conversation is never one row or one group: its turns are numbered by ranges
of a sort, so one with very many turns is spread as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import map_arrow
from gridloom.plans.durable import cut, tidy
from gridloom.plans.shipping import ship

#: Rows (turns of different conversations) that one bucket holds, about; a subtrie of more is dealt again.
BUCKET_ROWS = 50_000
#: Ids in one piece of the text that a node's digest is made of.
CHUNK_IDS = 8192

KEYS = ["k0", "k1", "k2", "k3"]
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv, pos, digest, chars``: turns numbered from 1 by turn (null first), role and text; rows without a conversation are left out.

    The digest is 128 bits of SHA-256 over role and text, nulls being empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    ranged = cut(
        rows.where("conv IS NOT NULL")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "conv",
            F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("digest"),
            F.char_length("text").cast("long").alias("chars"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    heads = ranged.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    numbered = ranged.join(heads, ["conv", "part"])
    return cut(numbered.select("conv", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "digest", "chars"))


def with_shared_openings(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The conversations and turns of a rebuilt table: each begins with the first turns of its block's first conversation.

    As many as CRC-32 of the decimal id modulo ``most``; its own turns after
    that many follow. Returns ``conv`` with ``n_turns`` and the turns.
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    taken = F.crc32(F.col("conv").cast("string")) % most
    convs = sizes.select("conv", "n", taken.alias("h"), (F.col("conv") - F.col("conv") % block).alias("base"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = cut(convs.join(bases, "base", "left").withColumn("take", F.least("h", F.coalesce("base_n", F.lit(0)))))
    own = turns.join(convs.select("conv", "h", "take"), "conv").where("pos > h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("take")).alias("pos"), "digest", "chars")
    opening = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base")
    opening = opening.join(convs.select("conv", "base", "take"), "base").where("pos <= take").select("conv", "pos", "digest", "chars")
    n_turns = F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return convs.select("conv", n_turns.alias("n_turns")), own.union(opening)


def joined_digests(members: DataFrame) -> DataFrame:
    """``rep, ends`` of ``rep, conv``: SHA-256 of the decimal ids, ascending and comma-joined, read as a stream."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, ids, done = None, [], ([], [], [])

        def close() -> None:
            if ids:
                for column, value in zip(done, (rep, ids[0], ",".join(map(str, ids))), strict=True):
                    column.append(value)
                ids.clear()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], ["rep", "first", "ids"])
            for column in done:
                column.clear()
            return batch

        for batch in batches:
            for now, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != rep or len(ids) >= CHUNK_IDS:
                    close()
                    rep = now
                ids.append(conv)
            if len(done[0]) >= 64:
                yield rows()
        close()
        yield rows()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, None
        for batch in batches:
            reps, ends = [], []
            for now, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if now != rep:
                    if rep is not None:
                        reps.append(rep)
                        ends.append(state.hexdigest())
                    rep, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(ends, pa.string())], ["rep", "ends"])
        if rep is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], ["rep", "ends"])

    ordered = members.select("rep", "conv").repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv")
    pieces = map_arrow(ordered, chunks, "rep long, first long, ids string")
    return map_arrow(pieces.repartition("rep").sortWithinPartitions("rep", "first"), digests, "rep long, ends string")


def distinct_paths(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``rep, n_turns, first, mult, ends``: one row for all equal conversations, named by the smallest id; ``first`` is the first turn's digest.

    Conversations are equal if 256 bits over all positions and turns are.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "pos", "digest")).alias(k) for i, k in enumerate(KEYS)]
    first = F.max(F.when(F.col("pos") == 1, F.col("digest"))).alias("first")
    known = cut(convs.join(turns.groupBy("conv").agg(*marks, first), "conv", "left"))
    classes = known.groupBy("n_turns", *KEYS).agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("mult"), F.min("first").alias("first"))
    classes = cut(classes)
    several = classes.where("mult > 1").select("n_turns", *(F.col(k).alias(f"{k}_") for k in KEYS), "rep").withColumnRenamed("n_turns", "n_")
    same = [known["n_turns"] == F.col("n_"), *(known[k].eqNullSafe(F.col(f"{k}_")) for k in KEYS)]
    ends = joined_digests(known.join(several, same).select("rep", "conv"))
    alone = F.sha2(F.col("rep").cast("string"), 256)
    return cut(classes.join(ends, "rep", "left").select("rep", "n_turns", "first", "mult", F.coalesce("ends", alone).alias("ends")))


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the subtries of one bucket, each subtrie's top marked."""
    rows = rows.iloc[np.lexsort((rows["pos"].to_numpy(), rows["conv"].to_numpy()))]
    child: dict[tuple, int] = {}  # from a node, or from the name of a subtrie, by the next turn
    parent, conv, depth, n_convs, chars, ends, unit, above = ([] for _ in range(8))
    last, at = None, -1
    columns = (rows[c].tolist() for c in ("unit", "conv", "mult", "pos", "digest", "chars", "ends", "above"))
    for name, c, mult, pos, digest, size, end, over in zip(*columns, strict=True):
        if c != last:
            last, at = c, -1
        key = (at if at >= 0 else name, digest)
        node = child.get(key)
        if node is None:
            node = child[key] = len(parent)
            # conversations come by id, so the first that passes is the smallest
            for column, value in zip((parent, conv, depth, n_convs, chars, ends, unit, above), (at, c, pos, 0, size, None, name, over), strict=True):
                column.append(value)
        n_convs[node] += mult
        if isinstance(end, str):
            ends[node] = end
        at = node
    saved = [(n - 1) * size for n, size in zip(n_convs, chars, strict=True)]
    children, leaves = [0] * len(parent), [0] * len(parent)
    for node in range(len(parent) - 1, -1, -1):  # children are made after their parents: backwards is a postorder
        leaves[node] = leaves[node] or 1
        if (up := parent[node]) >= 0:
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    return pd.DataFrame({
        "unit": unit, "top": [up < 0 for up in parent], "conv_id": conv, "depth": depth,
        "parent_conv_id": [over if up < 0 else conv[up] for up, over in zip(parent, above, strict=True)],
        "n_convs": n_convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends,
    })


def _shared_chains(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The turns that all paths of a subtrie share, what follows as subtries of their own, and which belongs to which.

    Chains are ``unit, conv_id, depth, parent_conv_id, n_convs, chars, ends, last``.
    """
    ends = F.max("ends").alias("ends")
    by_pos = rows.groupBy("unit", "above", "pos").agg(
        F.count(F.lit(1)).alias("paths"), F.min("digest").alias("x"), F.max("digest").alias("y"), F.sum("mult").alias("n_convs"),
        F.min("conv").alias("conv_id"), F.min("chars").alias("chars"), ends,
    )
    by_pos = cut(by_pos)
    tops = by_pos.groupBy("unit").agg(F.min_by("paths", "pos").alias("all"), F.max("pos").alias("deepest"), F.min("pos").alias("top"))
    parted = by_pos.join(tops, "unit").where("paths < all OR x <> y").groupBy("unit").agg(F.min("pos").alias("parted"))
    tops = tops.join(parted, "unit", "left").select("unit", "top", F.coalesce(F.col("parted") - 1, "deepest").alias("last"))
    chains = cut(
        by_pos.join(tops, "unit").where("pos <= last").select(
            "unit", "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("top"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            "n_convs", "chars", "ends", "last",
        )
    )
    foot = chains.where("depth = last").select("unit", F.col("conv_id").alias("foot"), "last")
    rest = rows.join(foot, "unit").where("pos > last")
    following = rest.where(F.col("pos") == F.col("last") + 1).select("conv", F.unhex(F.md5(F.concat("unit", "digest"))).alias("next"))
    rest = cut(rest.join(following, "conv").select(F.col("next").alias("unit"), F.col("foot").alias("above"), "conv", "mult", "pos", "digest", "chars", "ends", F.col("unit").alias("over")))
    return chains, rest.drop("over"), cut(rest.select("unit", "over").distinct())


def _raised(chains: DataFrame, below: DataFrame, totals: DataFrame) -> DataFrame:
    """Nodes of chains with the sums over their subtrees."""
    sums = below.join(totals, "unit").groupBy(F.col("over").alias("unit")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    upward = Window.partitionBy("unit").orderBy(F.col("depth").desc())
    own = F.sum((F.col("n_convs") - 1) * F.col("chars")).over(upward)
    none = F.lit(0).cast("long")
    return chains.join(sums, "unit", "left").select(
        "unit", (F.row_number().over(Window.partitionBy("unit").orderBy("depth")) == 1).alias("top"), "conv_id", "depth", "parent_conv_id", "n_convs",
        F.when(F.col("depth") < F.col("last"), F.lit(1)).otherwise(F.coalesce("children", none)).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), (own + F.coalesce("saved", none)).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def _totals(nodes: DataFrame) -> DataFrame:
    return nodes.where("top").select("unit", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))


def _nodes(convs: DataFrame, turns: DataFrame, bucket_rows: int) -> DataFrame:
    paths = distinct_paths(convs, turns)
    whole = paths.agg(F.min("rep").alias("rep"), F.sum("mult").alias("mult"), F.min(F.when(F.col("n_turns") == 0, F.col("ends"))).alias("ends")).first()
    spark = convs.sparkSession
    ship(spark)
    if whole["rep"] is None:
        return spark.createDataFrame([], NODE)
    last_turn = F.when(F.col("pos") == F.col("n_turns"), F.col("ends")).alias("ends")
    rows = cut(
        turns.join(paths.withColumnRenamed("rep", "conv"), "conv").select(
            F.col("first").alias("unit"), F.lit(whole["rep"]).cast("long").alias("above"), "conv", "mult", "pos", "digest", "chars", last_turn
        )
    )
    fields = T.StructType([T.StructField("unit", T.BinaryType()), T.StructField("top", T.BooleanType()), *T._parse_datatype_string(NODE).fields])
    built, levels = [], []
    while True:
        sizes = cut(rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")))
        large = sizes.where(F.col("n") > bucket_rows).select("unit")
        total = sizes.where(F.col("n") <= bucket_rows).agg(F.sum("n")).first()[0] or 0
        if total:
            buckets = max(1, -(-total // bucket_rows) * 2)
            bucket = F.pmod(F.xxhash64("unit"), F.lit(buckets)).alias("bucket")
            small = rows.join(large, "unit", "left_anti").select("*", bucket)
            built.append(cut(small.groupBy("bucket").applyInPandas(_tries, fields)))
        if large.isEmpty():
            break
        chains, rows, below = _shared_chains(rows.join(large, "unit", "left_semi"))
        levels.append((chains, below))
    nodes = spark.createDataFrame([], fields)
    for part in built:
        nodes = nodes.union(part)
    for chains, below in reversed(levels):
        nodes = nodes.union(cut(_raised(chains, below, _totals(nodes))))
    firsts = nodes.where("top AND depth = 1").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved")
    )
    null = F.lit(None).cast("long")
    root = firsts.select(
        F.lit(whole["rep"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), null.alias("parent_conv_id"), F.lit(whole["mult"]).cast("long").alias("n_convs"),
        F.col("n").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("saved").cast("long").alias("saved_tokens"),
        F.lit(whole["ends"]).cast("string").alias("ends_sha256"),
    )
    every = root.union(nodes.select(root.columns))
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


@tidy
def prefix_trie(conversations: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The trie of all conversations of ``conv_id, turn, role, text``, a row for each node.

    A node is a distinct sequence of first turns (role and text): ``conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``; it is named by the smallest conversation that begins with
    it. ``saved_tokens`` are the code points of the texts in its subtree that
    need not be stored again, ``ends_sha256`` tells which conversations end at
    it. Turns go by ``turn`` (null first), ties by role and text, so repeated
    rows are further turns. Null roles and texts are empty; rows with a null
    conv_id belong to no conversation and are left out. An empty table has no
    node, not even the root. Further columns are ignored.
    """
    turns = numbered_turns(conversations)
    return _nodes(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns")), turns, bucket_rows)


@tidy
def shared_opening_trie(conversations: DataFrame, block: int = 100, most: int = 6, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """:func:`prefix_trie` of the conversations that :func:`with_shared_openings` makes; one may have no turn and then ends at the root."""
    convs, turns = with_shared_openings(numbered_turns(conversations), block, most)
    return _nodes(convs, cut(turns), bucket_rows)
