"""Collocations by suffix counting.

Every word begins a suffix of its piece, cut after ``max_n`` words. Suffixes are
shuffled by language and first word, in blocks that each task has already
counted; in a bucket they are sorted in reverse order, and one pass with a
stack of open prefixes counts all phrases at once. A first word that is too
frequent for one bucket is dealt by its second word too, which leaves only its
own count in parts; they are added up afterwards, when phrases meet the counts
of their parts.

Suffixes travel as 64-bit hashes of words. All words of a language are compared
where they share a hash, and should two differ, hashes of another seed are
taken, so the counts are exact.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import ASCII_LOWER, ASCII_UPPER, as_bytes, map_arrow, mixed
from gridloom.plans.durable import cut, tidy

#: Words of a task that are counted together before they are sent, and that a bucket receives, about.
BLOCK_WORDS, BUCKET_WORDS = 1_000_000, 1_000_000
#: Bytes of text taken apart at once, and different words remembered before they are sent.
SLICE_BYTES, MEMORY_WORDS = 1 << 20, 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[list(ASCII_UPPER.encode())] = list(ASCII_LOWER.encode())
#: 1: ends a word, 2: ends a piece and its last word.
_ENDS = np.zeros(256, dtype=np.uint8)
_ENDS[list(b" \t")] = 1
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = 2


def _slices(text: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a text that end after a word, of SLICE_BYTES unless a word is longer."""
    at = 0
    while at < len(text):
        length = SLICE_BYTES
        while at + length < len(text):
            ends = np.flatnonzero(_ENDS[text[at : at + length]])
            if len(ends):
                length = int(ends[-1]) + 1
                break
            length *= 2
        yield text[at : at + length]
        at += length


def words_of(text: bytes, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The words of parts of a text: hashes, numbers of their pieces, the lower-case part, and the words' starts and ends in it.

    A hash is the sum of scrambled values of each byte at its place.
    """
    pieces = 0
    for part in _slices(np.frombuffer(text, dtype=np.uint8)):
        part = _LOWER[part]
        ends = _ENDS[part]
        inside = np.concatenate(([False], ends == 0, [False]))
        starts = np.flatnonzero(~inside[:-1] & inside[1:])
        stops = np.flatnonzero(inside[:-1] & ~inside[1:])
        closed = np.cumsum(ends == 2)
        if len(starts):
            length = stops - starts
            total = np.concatenate(([0], np.cumsum(length)))
            place = np.arange(total[-1]) - np.repeat(total[:-1], length)
            letters = part[ends == 0].astype(np.int64)
            values = mixed((place << 8 | letters) ^ np.int64(seed))
            yield mixed(np.add.reduceat(values, total[:-1]).view(np.int64)).view(np.int64), closed[starts] + pieces, part, starts, stops
        pieces += int(closed[-1])


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of each language, with an end of a piece between them."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
        if text:
            texts.setdefault(lang, []).append(text)
    for lang, those in texts.items():
        yield lang, b"\n".join(those)


def _unlike(part: np.ndarray, starts: np.ndarray, stops: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The first word, if any, that differs from the word ``same`` that has its hash."""
    length = stops - starts
    found = np.flatnonzero(length != length[same])
    if not len(found):
        shift = np.repeat(starts[same] - starts, length)
        at = np.arange(len(shift)) + np.repeat(starts - np.concatenate(([0], np.cumsum(length)[:-1])), length)
        found = np.repeat(np.arange(len(starts)), length)[part[at] != part[at + shift]]
    return found[:1]


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """``lang, h, word, other, n``: how often each word occurs; ``other`` is not ``word`` if two words share a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], list] = {}

        def rows() -> pa.RecordBatch:
            langs, hashes = [k[0] for k in known], [k[1] for k in known]
            words, counts = [v[0] for v in known.values()], [v[1] for v in known.values()]
            known.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
                ["lang", "h", "word", "n"],
            )

        for batch in batches:
            for lang, text in _by_language(batch):
                for hashes, _, part, starts, stops in words_of(text, seed):
                    first, group, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)[1:]
                    for at in _unlike(part, starts, stops, first[group]):
                        yield pa.RecordBatch.from_pydict({"lang": [lang], "h": [int(hashes[at])], "word": [part[starts[at] : stops[at]].tobytes().decode()], "n": [0]})
                    whole = part.tobytes()
                    for h, s, e, count in zip(hashes[first].tolist(), starts[first].tolist(), stops[first].tolist(), n.tolist(), strict=True):
                        entry = known.get((lang, h))
                        if entry is None:
                            known[lang, h] = [whole[s:e], count]
                        else:
                            entry[1] += count
                if len(known) >= MEMORY_WORDS:
                    yield rows()
        yield rows()

    found = map_arrow(texts, run, "lang string, h long, word string, n long")
    return found.groupBy("lang", "h").agg(F.min("word").alias("word"), F.max("word").alias("other"), F.sum("n").alias("n"))


def _counted(words: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of words sorted in reverse, equal ones added up."""
    order = np.lexsort(words[::-1])[::-1]
    words, counts = [w[order] for w in words], counts[order]
    new = functools.reduce(np.logical_or, (w[1:] != w[:-1] for w in words), np.zeros(max(0, len(counts) - 1), dtype=bool))
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(counts)), dtype=bool), new)))
    return [w[first] for w in words], np.add.reduceat(counts, first) if len(first) else counts


def suffix_blocks(texts: DataFrame, seed: int, max_n: int, buckets: int, heavy: dict[tuple[str, int], int]) -> DataFrame:
    """``lang, bucket, block``: counted suffixes of up to ``max_n`` words, zeros after the end of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list] = {}
        split: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang in {k[0] for k in heavy}:
            those = sorted((h, parts) for (where, h), parts in heavy.items() if where == lang)
            split[lang] = np.array([h for h, _ in those], dtype=np.int64), np.array([p for _, p in those], dtype=np.int64)
        size = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            while waiting:
                lang, parts = waiting.popitem()
                hashes, pieces = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                parts.clear()
                # a word's rank in the block is short enough to sort suffixes as one number
                known, rank = np.unique(hashes, return_inverse=True)
                columns = []
                for k in range(max_n):
                    follows = np.zeros(len(hashes), dtype=np.int64)
                    if k < len(hashes):
                        here = pieces[k:] == pieces[: len(pieces) - k]
                        follows[: len(hashes) - k] = np.where(here, rank[k:] + 1, 0)
                    columns.append(follows)
                bits = int(len(known)).bit_length()
                if bits * max_n <= 63:
                    packed, counts = np.unique(functools.reduce(lambda x, y: x << bits | y, columns), return_counts=True)
                    columns = [packed >> bits * (max_n - 1 - k) & (1 << bits) - 1 for k in range(max_n)]
                else:
                    columns, counts = _counted(columns, np.ones(len(hashes), dtype=np.int64))
                words = [np.concatenate(([0], known))[c] for c in columns]
                del hashes, pieces, rank, columns
                by = mixed(words[0])
                names, shares = split.get(lang, (np.empty(0, dtype=np.int64),) * 2)
                if len(names):
                    at = np.minimum(np.searchsorted(names, words[0]), len(names) - 1)
                    share = np.where(names[at] == words[0], shares[at], 1)
                    by = by + (mixed(words[1]) % share.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                bucket = (mixed(by.view(np.int64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                table = np.column_stack([*(w[order] for w in words), counts[order]]).astype("<i8", copy=False)
                del words, by
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                ends = np.append(edges[1:], len(order))
                names_ = bucket[order][edges]
                for low in range(0, len(edges), 256):
                    part = slice(low, low + 256)
                    block = [table[s:e].tobytes() for s, e in zip(edges[part], ends[part], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(block), pa.string()), pa.array(names_[part]), pa.array(block, pa.binary())], ["lang", "bucket", "block"]
                    )

        for batch in batches:
            for lang, text in _by_language(batch):
                base = 0
                for hashes, pieces, *_ in words_of(text + b"\n", seed):
                    held = waiting.setdefault(lang, [])
                    offset = held[-1][1][-1] + 1 if held and not base else base
                    base = offset or 0
                    held.append((hashes, pieces + offset))
                    size += len(hashes)
            if size >= BLOCK_WORDS:
                yield from blocks()
                size = 0
        yield from blocks()

    return map_arrow(texts, run, "lang string, bucket long, block binary")


def phrases_of(words: list[np.ndarray], counts: np.ndarray) -> Iterator[tuple[list[int], int]]:
    """Every prefix of the suffixes with its count, in one pass over them in reverse order.

    The stack holds the words of the last suffix, and beside each the count of
    the prefix that ends with it as far as it is known.
    """
    stack: list[int] = []
    held: list[int] = []

    def close(to: int) -> Iterator[tuple[list[int], int]]:
        while len(stack) > to:
            count = held.pop()
            yield stack.copy(), count
            stack.pop()
            if held:
                held[-1] += count

    for row in zip(*(w.tolist() for w in words), counts.tolist(), strict=True):
        *suffix, count = row
        while suffix and not suffix[-1]:
            suffix.pop()
        common = 0
        while common < len(stack) and common < len(suffix) and stack[common] == suffix[common]:
            common += 1
        yield from close(common)
        for word in suffix[common:]:
            stack.append(word)
            held.append(0)
        held[-1] += count
    yield from close(0)


def phrase_counts(blocks: DataFrame, max_n: int, least: int, heavy: dict[tuple[str, int], int]) -> DataFrame:
    """``lang, words, f`` of all words and phrases that occur ``least`` times or more."""

    def run(group: pa.Table) -> pa.Table:
        lang = group.column("lang")[0].as_py()
        rows = np.concatenate([np.frombuffer(b, dtype="<i8").reshape(-1, max_n + 1) for b in group.column("block").to_pylist()])
        words, counts = _counted([np.ascontiguousarray(rows[:, k]) for k in range(max_n)], rows[:, max_n].copy())
        # only suffixes of first words that are frequent enough can give a result
        starts = np.flatnonzero(np.diff(words[0], prepend=~words[0][:1]))
        enough = np.repeat(np.add.reduceat(counts, starts) >= least, np.diff(np.append(starts, len(counts))))
        parted = [h for where, h in heavy if where == lang]
        enough |= np.isin(words[0], np.array(parted, dtype=np.int64))
        parts = set(parted)
        found, totals = [], []
        for phrase, count in phrases_of([w[enough] for w in words], counts[enough]):
            if count >= least or (len(phrase) == 1 and phrase[0] in parts):
                found.append(phrase)
                totals.append(count)
        return pa.table([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.list_(pa.int64())), pa.array(totals, pa.int64())], ["lang", "words", "f"])

    counted = blocks.groupBy("lang", "bucket").applyInArrow(run, "lang string, words array<long>, f long")
    return counted.groupBy("lang", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _exact(column: str):
    return F.col(column).cast("decimal(19,0)")


def scored(counts: DataFrame, contained_percent: int) -> DataFrame:
    """``lang, words, a, l, r, score`` of phrases that no longer one stands for."""
    known = counts.select("lang", "words", "f")
    phrases = cut(known.where(F.size("words") > 1).withColumnRenamed("f", "a"))
    n = F.size("words")
    cuts = phrases.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, n).alias("right"))
    left, right = (known.select("lang", F.col("words").alias(side), F.col("f").alias(c)) for side, c in (("left", "l"), ("right", "r")))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    product = _exact("a") * _exact("a") * F.lit(1_000_000).cast("decimal(7,0)")
    score = F.call_function("div", product, _exact("l") * _exact("r"))
    worst = cuts.select("lang", "words", "a", "l", "r", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    worst = worst.groupBy("lang", "words", "a").agg(F.min("cut").alias("cut")).select("lang", "words", "a", "cut.l", "cut.r", "cut.score")
    # contiguous parts of two words or more, shorter than the phrase itself
    lengths = F.explode(F.sequence(F.lit(2), n - 1)).alias("m")
    parts = phrases.where(n > 2).select("lang", "words", "a", lengths)
    parts = parts.select("lang", "words", "a", "m", F.explode(F.sequence(F.lit(1), n - F.col("m") + 1)).alias("at"))
    longer = parts.groupBy("lang", F.slice("words", F.col("at"), F.col("m")).alias("words")).agg(F.max("a").alias("longer"))
    stays = F.col("longer").isNull() | (100 * F.col("longer") < contained_percent * F.col("a"))
    return worst.join(longer, ["lang", "words"], "left").where(stays).drop("longer")


@tidy
def collocations(
    docs: DataFrame, max_n: int = 3, least: int = 10, contained_percent: int = 50, top: int = 2000,
    lang_col: str = "lang", text_col: str = "text", bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """The phrases of each language that occur together more than their parts would suggest.

    ``lang, rank, phrase, a, l, r, n, score``: a phrase of two to ``max_n``
    words that occurs ``a`` times (``least`` or more), its parts at the worst
    cut ``l`` and ``r`` times, out of ``n`` words; ``score`` is
    ``10^6 a^2 / (l r)`` rounded down, in exact arithmetic for counts below
    10^16. Phrases inside a longer one that occurs ``contained_percent`` as
    often are left out; of the rest the first ``top`` by score, count and
    phrase are returned, ``rank`` from 1. Pieces end at ``.,;:!?`` and line
    ends, words at blanks and tabs; A-Z is lower-cased. A null language is
    ``und``; null and empty texts have no words, repeated rows count again,
    further columns are ignored. An empty table gives no phrase.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    for seed in range(8):
        words = cut(word_counts(texts, mixed_seed(seed)))
        if words.where("word <> other").isEmpty():
            break
    else:
        raise RuntimeError("different words share a hash under every seed")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // bucket_words))
    # words that would fill much of a bucket alone: at most eight for each bucket
    many = bucket_words // 8
    heavy = {(r.lang, r.h): -(-r.n // many) for r in words.where(F.col("n") > many).select("lang", "h", "n").collect()}
    counts = cut(phrase_counts(suffix_blocks(texts, mixed_seed(seed), max_n, buckets, heavy), max_n, least, heavy))
    order = [F.col("score").desc(), F.col("a").desc()]
    near = scored(counts, contained_percent).withColumn("near", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("near") <= top)
    near = cut(near.drop("near"))
    named = near.select("lang", "words", F.posexplode("words").alias("at", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    named = named.groupBy("lang", "words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = named.select("lang", "words", F.array_join(F.col("w.word"), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    ranked = near.join(named, ["lang", "words"]).withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(cut(sizes)), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mixed_seed(seed: int) -> int:
    return int(mixed(np.array([seed], dtype=np.int64)).view(np.int64)[0])
