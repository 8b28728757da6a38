"""Packing token streams into fixed-length sequences by minimum bin slack.

Documents are tokenised next to the scan and cut into pieces of at most one
sequence; ids never leave the task, only lengths and checksums do. The bins
are filled from the histogram of piece lengths, which has at most one entry
per length: each step seeds a bin with the longest length left and fills the
window that remains as closely as possible with a bitset subset-sum over the
other lengths and their counts; the multiset found is used as often as its
counts allow. Pieces then look up their bin by their number among pieces of
equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import default_tokenizer, map_arrow, numbered
from gridloom.llm.tokens import load, worker_encoder
from gridloom.plans.durable import cut

SEQUENCE = 4096
END_ID = 2
RANK_BITS = 44


def closest_fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as close to ``capacity`` as can be without passing it.

    Bit s of ``reach`` says that s is a sum of the lengths so far. Lengths are
    taken up in the given order and the search ends when the window is full.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in lengths:
        most = min(counts[length], capacity // length) if length <= capacity else 0
        if most <= 0:
            continue
        steps.append((length, most, reach))
        left, part = most, 1
        while left:
            take = min(part, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            part *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        for n in range(most + 1):
            if total >= n * length and before >> (total - n * length) & 1:
                break
        if n:
            chosen[length] = n
            total -= n * length
    return chosen


def fill_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how often, pieces of each length); every piece of the histogram is used once."""
    left = {k: n for k, n in counts.items() if n > 0}
    lengths, bins = sorted(left, reverse=True), []
    while lengths:
        seed = lengths[0]
        left[seed] -= 1
        chosen = closest_fill(lengths, left, capacity - seed)
        left[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        bins.append((times, chosen))
        for k, n in chosen.items():
            left[k] -= times * n
        lengths = [k for k in lengths if left[k]]
    return bins


def slots(bins: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """One row per bin kind and length: key, pieces of that length in the bin, first sequence, first offset.

    The key orders by length, then by the first piece number that goes there.
    """
    rows, used, first = [], {}, 0
    for times, chosen in bins:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rank = used.get(length, 0)
            rows.append((length << RANK_BITS | rank, rank, n, first, offset))
            used[length] = rank + times * n
            offset += n * length
        first += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of each document's ids: id, start, length, ids_crc32, doc_tokens."""
    blob, kind = load(tokenizer)
    file = docs.sparkSession.sparkContext.broadcast(blob)
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(file.value, kind)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = (encoder.id_bytes(text) if text else b"") + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    row.append(i)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                names,
            )

    names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([source.schema["id"], *(T.StructField(x, T.LongType()) for x in names[1:])])
    return map_arrow(source, pieces, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = SEQUENCE,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Place every id of every document, each followed by ``end_id``, into sequences of at most ``capacity``.

    Returns one row per piece: ``<id_col>, start, length, ids_crc32,
    doc_tokens, sequence_id, offset``. A null or empty text is the end id
    alone. Rows with equal or null ids are placed like any other rows. An
    empty table gives an empty result.
    """
    pieces = cut(token_pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, id_col, text_col))
    histogram = {int(k): int(n) for k, n in pieces.groupBy("length").count().collect()}
    places = docs.sparkSession.sparkContext.broadcast(slots(fill_bins(histogram, capacity)))
    ranked = numbered(pieces, ["length"], ["id", "start", "ids_crc32"], "rank", max(histogram.values(), default=0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = table[np.searchsorted(table[:, 0], length << RANK_BITS | rank, side="right") - 1]
            among = rank - at[:, 1]
            sequence, offset = at[:, 3] + among // at[:, 2], at[:, 4] + among % at[:, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names[:5]), pa.array(sequence), pa.array(offset)], names
            )

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([*pieces.schema.fields, *(T.StructField(x, T.LongType()) for x in names[5:])])
    return map_arrow(ranked.select(*names[:5], "rank"), place, schema).withColumnRenamed("id", id_col)
