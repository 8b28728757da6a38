"""Benchmark decontamination by winnowing.

Of every ``WINDOW - GRAM + 1`` consecutive word k-grams the one with the
least hash is a fingerprint, so any shared span of ``WINDOW`` words has a
fingerprint in common, at the same place of the span, on both sides.
Fingerprints of the test items are joined with those of the documents; where
they meet, the hit is extended to both sides as far as the words themselves
agree, and counts if ``WINDOW`` words or more do. Items shorter than a window
are found by their first words and compared as a whole. Hashes only say
where to look, so no two of them that are equal by chance change a result.

Test items of no more than ``broadcast_bytes`` of text are broadcast and
everything happens next to the scan. Above that size fingerprints meet in a
shuffle and texts are fetched for those that do; the results are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import WordHashes, as_bytes, gram_hashes, map_arrow
from gridloom.plans.durable import cut

WINDOW, GRAM = 13, 7
#: Test items with no more text than this (bytes) are broadcast.
BROADCAST_BYTES = 16 << 20
#: Fingerprints of test items, and rows of results, that may be broadcast (32 MB).
BROADCAST_PRINTS, BROADCAST_ROWS = 4_000_000, 200_000
#: Words by which shorter items are found, if they have so many.
START = 3

#: Word characters are 0-9, letters and everything beyond ASCII; A-Z is lower-cased.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_HASHES = WordHashes()


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """Places of the least hash, the first of equal ones, in each run of ``span`` hashes."""
    count = len(grams) - span + 1
    if count <= 0:
        return np.empty(0, dtype=np.int64)
    least, place = grams[:count].copy(), np.arange(count)
    for k in range(1, span):
        less = grams[k : k + count] < least
        least[less] = grams[k : k + count][less]
        place[less] = np.flatnonzero(less) + k
    return np.unique(place)


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table) or not len(values):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


class Shape(NamedTuple):
    """Words of a window and of a k-gram, and the bits of a k-gram's hash."""

    window: int = WINDOW
    gram: int = GRAM
    bits: int = 64

    def grams(self, hashes: np.ndarray, n: int) -> np.ndarray:
        return gram_hashes(hashes, n) >> np.uint64(64 - self.bits)


def anchors(hashes: np.ndarray, shape: Shape, starts: Iterable[int] | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(words, hashes, places) by which a text is found: 0 words stands for fingerprints.

    Without ``starts``, those of a test item: its fingerprints or, of a
    shorter one, its first words. With them, those of a document: its
    fingerprints and all its runs of these numbers of words.
    """
    found = []
    if len(hashes) >= shape.window:
        grams = shape.grams(hashes, shape.gram)
        places = winnow(grams, shape.window - shape.gram + 1)
        found.append((0, grams[places], places))
    if starts is None:
        starts = () if len(hashes) >= shape.window else (min(len(hashes), START),)
        return found + [(n, shape.grams(hashes, n)[:1], np.zeros(1, dtype=np.int64)) for n in starts if n]
    runs = ((n, shape.grams(hashes, n)) for n in starts)
    return found + [(n, grams, np.arange(len(grams))) for n, grams in runs if len(grams)]


def extended(words: list[bytes], p: int, item: list[bytes], q: int, window: int) -> tuple[int, int]:
    """The run of words around ``p`` that agree with those of the item around ``q``; empty where too few do."""
    if len(item) < window:
        return (p - q, p - q + len(item)) if p >= q and words[p - q : p - q + len(item)] == item else (p, p)
    low, high = 0, 0
    while low < min(p, q) and words[p - low - 1] == item[q - low - 1]:
        low += 1
    while p + high < len(words) and q + high < len(item) and words[p + high] == item[q + high]:
        high += 1
    return (p - low, p + high) if low + high >= window else (p, p)


def spans_of(words: list[bytes], item: list[bytes], hits: Iterable[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Runs of a document's words in windows of one item, from places that met; each run once."""
    spans: list[tuple[int, int]] = []
    done: dict[int, int] = {}
    for p, q in sorted(hits):
        if p < done.get(p - q, 0):
            continue
        low, high = extended(words, p, item, q, window)
        done[p - q] = max(high, p + 1)
        if high > low:
            spans.append((low, high))
    return spans


def covered(spans: Iterable[tuple[int, int]]) -> int:
    """How many places the spans cover."""
    total, end = 0, 0
    for low, high in sorted(spans):
        total += max(0, high - max(low, end))
        end = max(end, high)
    return total


@dataclass
class TestItems:
    """The words of all test items, and where each anchor of theirs is."""

    ids: list
    words: list[list[bytes]]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple], shape: Shape) -> TestItems:
        items = cls([r[0] for r in rows], [words_of(r[1]) for r in rows])
        found: dict[int, list[tuple]] = {}
        for number, words in enumerate(items.words):
            for n, hashes, places in anchors(_HASHES.array(words), shape):
                found.setdefault(n, []).append((hashes, np.full(len(hashes), number), places))
        for n, parts in found.items():
            hashes, owners, places = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            items.tables[n] = hashes[order], owners[order], places[order]
        return items

    def hits(self, words: list[bytes], shape: Shape) -> tuple[int, set]:
        """Words inside any occurrence of a window, and the items with such windows."""
        met: dict[int, list[tuple[int, int]]] = {}
        for n, hashes, places in anchors(_HASHES.array(words), shape, [n for n in self.tables if n]):
            if n not in self.tables:
                continue
            table, owners, offsets = self.tables[n]
            there = among(hashes, table)
            for value, p in zip(hashes[there].tolist(), places[there].tolist(), strict=True):
                low, high = np.searchsorted(table, value), np.searchsorted(table, value, side="right")
                for item, q in zip(owners[low:high].tolist(), offsets[low:high].tolist(), strict=True):
                    met.setdefault(item, []).append((p, q))
        spans, items = [], set()
        for item, places in met.items():
            own = spans_of(words, self.words[item], places, shape.window)
            if own:
                spans += own
                items.add(self.ids[item])
        return covered(spans), items


def items_digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items)).encode()).hexdigest()


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    known = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    return known.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()


def _small(items: DataFrame, broadcast_bytes: int) -> bool:
    return items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0] <= broadcast_bytes


def _is_contaminated(n_hit, n_words):
    """At least a twentieth of the words, and not none; of numbers or of columns."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    hash_bits: int = 64,
    broadcast_bytes: int = BROADCAST_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Which words of each document lie in windows of the test items.

    Returns ``<id_col>, n_words, n_hit, n_items, items_sha256, contaminated``,
    one row per input row, whatever ids it repeats or lacks. A null text has
    no words; items with a null id or text are ignored; repeated items count
    once. A document is contaminated if at least a twentieth of its words,
    and not none, are hit. Without any items nothing is. Further columns are
    ignored. ``hash_bits`` changes the work, not the result.
    """
    items, shape = _items(benchmark, item_col, item_text_col), Shape(window, gram, hash_bits)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if _small(items, broadcast_bytes):
        found = _by_broadcast(source, items, shape)
    else:
        found = _by_shuffle(source, "text", items, shape).select("id", *(F.col(f"decontaminate__{c}").alias(c) for c in [*_COUNTS, "items_sha256"]))
    return found.select(
        F.col("id").alias(id_col), *_COUNTS, "items_sha256", _is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    hash_bits: int = 64,
    broadcast_bytes: int = BROADCAST_BYTES,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated; each is judged by its own text, not by an id."""
    items, shape = _items(benchmark, item_col, item_text_col), Shape(window, gram, hash_bits)
    if not _small(items, broadcast_bytes):
        found = _by_shuffle(docs, text_col, items, shape)
        stays = ~_is_contaminated(F.col("decontaminate__n_hit"), F.col("decontaminate__n_words"))
        return found.where(stays).select(*(F.col(f"`{c}`") for c in docs.columns))
    shared, at = _shared(docs, items, shape), docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for text in as_bytes(batch.column(at)):
                words = words_of(text)
                stays.append(not _is_contaminated(shared.value.hits(words, shape)[0], len(words)))
            yield batch.filter(pa.array(stays, pa.bool_()))

    return map_arrow(docs, scan, docs.schema)


_COUNTS = ["n_words", "n_hit", "n_items"]


def _shared(docs: DataFrame, items: DataFrame, shape: Shape):
    rows = [(r[0], r[1].encode()) for r in items.collect()]  # no more than broadcast_bytes
    return docs.sparkSession.sparkContext.broadcast(TestItems.of(rows, shape))


def _by_broadcast(source: DataFrame, items: DataFrame, shape: Shape) -> DataFrame:
    shared = _shared(source, items, shape)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, none = shared.value, items_digest(set())
        for batch in batches:
            n_words, n_hit, n_items, digests = [], [], [], []
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                hit, found = tests.hits(words, shape)
                n_words.append(len(words))
                n_hit.append(hit)
                n_items.append(len(found))
                digests.append(items_digest(found) if found else none)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_hit, n_items)), pa.array(digests, pa.string())],
                ["id", *_COUNTS, "items_sha256"],
            )

    fields = [source.schema["id"], *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("items_sha256", T.StringType())]
    return map_arrow(source, scan, T.StructType(fields))


def _anchor_rows(texts: DataFrame, shape: Shape, starts, wanted) -> DataFrame:
    """``owner, words, place, hash`` of ``owner, text``; of documents those in ``wanted`` only, if that is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value if wanted is not None else None
        for batch in batches:
            for row, text in enumerate(as_bytes(batch.column(1))):
                for n, hashes, places in anchors(_HASHES.array(words_of(text)), shape, starts):
                    if known is not None:
                        there = among(hashes, known)
                        hashes, places = hashes[there], places[there]
                    if len(hashes):
                        owners = batch.column(0).take(pa.array(np.full(len(hashes), row)))
                        arrays = [owners, pa.array(np.full(len(hashes), n, np.int32)), pa.array(places.astype(np.int32)), pa.array(hashes.view(np.int64))]
                        yield pa.RecordBatch.from_arrays(arrays, ["owner", "words", "place", "hash"])

    ints = [T.StructField(c, T.IntegerType()) for c in ("words", "place")]
    return map_arrow(texts, run, T.StructType([texts.schema["owner"], *ints, T.StructField("hash", T.LongType())]))


def _n_words(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def _by_shuffle(docs: DataFrame, text_col: str, items: DataFrame, shape: Shape) -> DataFrame:
    """``docs`` with the counts as ``decontaminate__...``; equal texts are looked at once, by their digest."""
    context = docs.sparkSession.sparkContext
    keyed = docs.withColumn("decontaminate__key", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    texts = keyed.groupBy(F.col("decontaminate__key").alias("owner")).agg(F.first(F.col(text_col)).alias("text"))

    ours = cut(_anchor_rows(items.select(F.col("item").alias("owner"), "text"), shape, None, None).withColumnsRenamed({"owner": "item", "place": "q"}))
    starts = sorted(r[0] for r in ours.where("words > 0").select("words").distinct().collect())  # START numbers at most
    prints, wanted = ours.select("hash").distinct(), None
    if prints.limit(BROADCAST_PRINTS + 1).count() <= BROADCAST_PRINTS:
        known = prints.toArrow().column(0).to_numpy().view(np.uint64)  # of the test items, no more than BROADCAST_PRINTS
        wanted = context.broadcast(np.sort(known))
    theirs = _anchor_rows(texts, shape, starts, wanted)
    met = theirs.join(ours, ["words", "hash"]).groupBy("owner", "item").agg(F.collect_set(F.struct(F.col("place").alias("p"), "q")).alias("hits"))
    pairs = met.join(items.select("item", F.col("text").alias("item_text")), "item").join(texts, "owner")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for hits, item, text in zip(batch.column(2).to_pylist(), as_bytes(batch.column(3)), as_bytes(batch.column(4)), strict=True):
                spans.append(spans_of(words_of(text), words_of(item), [(h["p"], h["q"]) for h in hits], shape.window))
            flat = pa.array([[x for s in one for x in s] for one in spans], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], ["owner", "item", "spans"])

    flat = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("owner", T.StringType()), T.StructField("item", T.StringType()), T.StructField("spans", flat)])
    rows = pairs.select("owner", F.col("item").cast("string").alias("item"), "hits", "item_text", "text")
    # an item that several texts make is one item, though its spans come in several rows
    by_text = map_arrow(rows, extend, schema).where(F.size("spans") > 0).groupBy("owner").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.collect_set("item")).alias("names")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [covered(zip(s[::2], s[1::2], strict=True)) for s in batch.column(1).to_pylist()]
            names = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hits, pa.int64()), pa.array(map(len, names), pa.int64()), pa.array(map(items_digest, names), pa.string())],
                [f.name for f in counted.fields],
            )

    counted = T.StructType(
        [
            T.StructField("decontaminate__key", T.StringType()),
            *(T.StructField(f"decontaminate__{c}", T.LongType()) for c in _COUNTS[1:]),
            T.StructField("decontaminate__items_sha256", T.StringType()),
        ]
    )
    found = cut(map_arrow(by_text, count, counted))
    joined = keyed.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "decontaminate__key", "left")
    return joined.withColumns(
        {
            "decontaminate__n_words": _n_words(F.col(text_col)),
            **{f"decontaminate__{c}": F.coalesce(f"decontaminate__{c}", F.lit(0)).cast("long") for c in _COUNTS[1:]},
            "decontaminate__items_sha256": F.coalesce("decontaminate__items_sha256", F.lit(items_digest(set()))),
        }
    )
