"""Exact deduplication with a heavy-hitter split.

Each text becomes a digest next to the scan. A Misra-Gries summary per task
finds the digests that may hold a large share of all rows; at most
``counters`` survive the merge, so their exactly counted winners are broadcast
and rows of such groups are decided where they are. All other digests are
dealt out by an ordinary shuffle, in which no group is large.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower, map_arrow
from gridloom.plans.durable import cut

#: Counters of a Misra-Gries summary: digests on more than 2/(COUNTERS+1) of all rows are found for certain.
COUNTERS = 4096


def normal_form(text: Column) -> Column:
    """The text that is compared: A-Z lower-cased, null as empty.

    ``lower`` has a fast path and agrees with the A-Z rule on ASCII texts.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))


def misra_gries(counts: Counter, counters: int) -> Counter:
    """Shrink exact counts to ``counters`` entries by the rule of mergeable summaries."""
    if len(counts) <= counters:
        return counts
    cutoff = sorted(counts.values(), reverse=True)[counters]
    return Counter({key: n - cutoff for key, n in counts.items() if n > cutoff})


def frequent_candidates(keys: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` values of a binary column, among them every value on more than 2/(counters+1) of the rows.

    A summary undercounts by at most n/(counters+1) of its n rows and the
    estimates of all values sum to no more than the row count, so the
    threshold n/(counters+1) passes at most ``counters`` values and loses
    none that is twice as frequent. Nulls are not counted; an empty table has
    no candidates.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        rows = 0
        for batch in batches:
            values = [v for v in batch.column(0).to_pylist() if v is not None]
            rows += len(values)
            kept.update(values)
            if len(kept) > 4 * counters:
                kept = misra_gries(kept, counters)
        kept = misra_gries(kept, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *kept], pa.binary()), pa.array([rows, *kept.values()], pa.int64())], ["key", "n"]
        )

    merged = cut(
        map_arrow(keys.select(column), summarise, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    )
    total = merged.where(F.col("key").isNull()).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return merged.where(F.col("key").isNotNull() & (F.col("n") > total / (counters + 1))).select(F.col("key").alias(column))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: which row of its group of equal texts stays.

    Returns ``<id_col>, keep_id, group_size, kept, text_sha256``. Nulls and
    empty texts are equal to each other. The largest id of a group stays; a
    null id loses against any other and a group with null ids only keeps
    nothing by id (``keep_id`` null, ``kept`` false). Rows that repeat the
    winning id are all marked as kept and all counted. Further columns of the
    input are ignored; an empty table gives an empty result.
    """
    hashed = cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(normal_form(F.col(text_col)).cast("binary"), 256)).alias("digest"),
        )
    )
    candidates = frequent_candidates(hashed, "digest", counters)
    winners = cut(
        hashed.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.lit(True).alias("heavy"))
    )
    marked = hashed.join(F.broadcast(winners), "digest", "left")
    group = Window.partitionBy("digest")
    light = (
        marked.where(F.col("heavy").isNull())
        .select("id", "digest")
        .select("*", F.max("id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"))
    )
    heavy = marked.where(F.col("heavy").isNotNull()).select("id", "digest", "keep_id", "group_size")
    return heavy.unionByName(light).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
