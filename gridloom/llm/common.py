"""What several of the text operators share."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.durable import cut
from gridloom.plans.shipping import ship

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: Rows that are put in order together to get gapless numbers, about.
CELL_ROWS = 2_000

#: Rows and bytes in one Arrow batch sent to a Python worker, at most; a larger row is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with batches small enough for very long texts.

    The batch sizes are session settings read when the plan is made into a
    physical one, by whoever runs it, so they stay at the small values.
    """
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(fn, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string or binary column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """Word bytes to a signed 64-bit hash, with a bounded memory of words seen."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        value -= (value >> 63) << 64
        self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


_MIX_A = np.uint64(0x9E3779B97F4A7C15)
_MIX_B = np.uint64(0xBF58476D1CE4E5B9)
_MIX_C = np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the SplitMix finalizer)."""
    x = values.view(np.uint64) + _MIX_A
    x = (x ^ (x >> np.uint64(30))) * _MIX_B
    x = (x ^ (x >> np.uint64(27))) * _MIX_C
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` consecutive words (uint64)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    value = mixed(words[:count])
    for k in range(1, n):
        value = mixed(value ^ (words[k : k + count].view(np.uint64) * np.uint64(2 * k + 1)))
    return value


_SPACE = np.isin(np.arange(256), [*b"\t\n\x0b\x0c\r "])
#: Words of more bytes are hashed one by one.
LONG_WORD = 128
_BYTES = mixed(np.arange(256, dtype=np.int64))
_PLACES = mixed(np.arange(256, 256 + LONG_WORD, dtype=np.int64)) | np.uint64(1)
#: Texts of so many bytes are cut into words together, about.
CHUNK_BYTES = 256 << 10


def _chunk_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts``, A-Z in lower case, and how many words each text has: sums of random factors of a byte and its place."""
    joined = b" ".join(texts).lower()
    raw = np.frombuffer(joined, dtype=np.uint8)
    solid = np.zeros(len(raw) + 2, dtype=np.int8)
    np.logical_not(_SPACE[raw], out=solid[1:-1].view(bool))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, begins))
    if not len(starts):
        return np.empty(0, dtype=np.uint64), counts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    value = _BYTES[raw[solid[1:-1].view(bool)]] * _PLACES[np.minimum(place, LONG_WORD - 1)]
    hashes = mixed(np.add.reduceat(value, first).view(np.int64))
    for at in np.flatnonzero(sizes > LONG_WORD):
        hashes[at] = xxhash.xxh3_64_intdigest(joined[starts[at] : starts[at] + sizes[at]])
    return hashes, counts


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles; shorter texts are one shingle, texts without words none.

    A-Z is lower-cased and words end at ASCII white space. Texts are dealt
    with in chunks, as most are too short for numpy alone.
    """
    found: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        chunk, size = [], 0
        while at < len(texts) and (not chunk or size + len(texts[at] or b"") <= CHUNK_BYTES):
            chunk.append(texts[at] or b"")
            size += len(chunk[-1])
            at += 1
        hashes, counts = _chunk_words(chunk)
        grams = gram_hashes(hashes.view(np.int64), words)
        begin = 0
        for n in counts.tolist():
            own = grams[begin : begin + n - words + 1].copy() if n >= words else gram_hashes(hashes[begin : begin + n].view(np.int64), n) if n else grams[:0]
            own.sort()
            found.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if n > words else own)
            begin += n
    return found


def numbered(df: DataFrame, within: list[str], order: list[str], name: str, largest: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add ``name``: gapless numbers from 0 within each value of ``within``, of which the most frequent has ``largest`` rows.

    A window over ``within`` alone puts a hot value into one task. Here rows
    are dealt by hash of ``order`` into cells of some ``cell_rows`` rows; a
    cell's first number comes from counts of the cells, so only one cell's
    rows are ordered together. Rows that agree in all of ``order`` may swap
    numbers.
    """
    from pyspark.sql import Window

    cell, cells = f"{name}__cell", max(1, -(-largest // cell_rows))
    dealt = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = dealt.groupBy(*within, cell).agg(F.count(F.lit(1)).alias(f"{name}__n"))
    before = Window.partitionBy(*within).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*within, cell, F.coalesce(F.sum(f"{name}__n").over(before), F.lit(0)).alias(f"{name}__first"))
    inside = Window.partitionBy(*within, cell).orderBy(*order)
    ranked = dealt.withColumn(f"{name}__in", F.row_number().over(inside) - 1)
    return (
        ranked.join(first, [*within, cell])
        .withColumn(name, (F.col(f"{name}__first") + F.col(f"{name}__in")).cast("long"))
        .drop(cell, f"{name}__in", f"{name}__first")
    )


def default_tokenizer() -> str:
    """The word-level BPE of the public tokenizer files; any path can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids``; rows with a null id stay.

    The ids are broadcast if there are few, else joined by a shuffle.
    """
    gone = cut(ids.select(id_col).where(F.col(id_col).isNotNull()).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, id_col, "left_anti").select(docs.columns)
