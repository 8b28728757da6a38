"""Near-duplicate line removal by an exact set-similarity join, all in DataFrame operations.

Distinct lines (lower-cased) are sets of words. Words are ordered by
rarity, so that the first few of each line - as many as a partner cannot miss
all of - are rare. Lines that share such a prefix word and pass the length and
position filters are candidates; their Jaccard similarity is computed on the
words themselves. A line goes if a similar or equal one comes before it.

A line's place (the order of its row, then its place in the text) is its name
as well, so every pair is known in its order: only pairs whose later line is
not known to go yet are met. Lines of long word lists first meet a few
random lines of each list. Lists in which that finds many pairs hold a cluster of
lines alike; these meet sixteen times as many in each further round, those that
go being left out, until all of the list is met. So a line finds a few similar
ones at a time however large its cluster is. All other lists are met whole. A
bitmap of each line's words travels along, in hot lists the hashes of all of
them, and rules out nearly all other pairs before their texts are fetched; it
never rules out a similar one.

Where candidates are sought words are told apart by the rarity and 58 bits of
their hash.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import numbered
from gridloom.plans.durable import cut, scratch, tidy

#: Similarity as a fraction: 4/5.
NUMERATOR, DENOMINATOR = 4, 5
#: Hash buckets of the word frequencies; their levels travel as so many bytes.
BUCKETS = 1 << 20
#: Levels of buckets that travel in one number to the driver, five bits each.
PACKED = 12
#: The level from which on words may be in many prefixes: in 32 lines or more.
LONG_LEVEL = 6
#: Lines drawn from each long list at first, at most, about.
DRAWN = 4
#: A word list in which they make so many pairs is met in rounds.
HOT_PAIRS = 16
#: In each round a line meets so many times as many lines of a list.
GROWTH = 16
#: Ids that may be broadcast to filter by.
BROADCAST_ROWS = 1_000_000
#: The words are dealt with in so many parts, so that only one part's exchange is on disk at a time.
WORD_PARTS = 2
#: Lines of more words have a bitmap of two parts, 64 bits each; that of others is the two added up.
SHORT_LINE = 90
#: What is told about each text besides its lines.
COUNTS = ("n_lines", "n_removed")
_HASH_BITS = 58
#: White space in a line besides the blank.
_ODD_SPACE = "\t\x0b\x0c\r"
_PLACE_BITS = 31


def _spaced(line: Column) -> Column:
    """``line`` with all white space as blanks."""
    odd = functools.reduce(lambda a, b: a | b, (F.contains(line, F.lit(c)) for c in _ODD_SPACE))
    return F.when(odd, F.translate(line, _ODD_SPACE, " " * len(_ODD_SPACE))).otherwise(line)


def line_words(line: Column) -> Column:
    """The words of a line, which may repeat; they end at blanks."""
    return F.array_remove(F.split(line, " "), "")


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(f" {_ODD_SPACE}")) == ""


def _bucket(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(BUCKETS - 1))


def rarity_levels(lines: DataFrame) -> bytes:
    """For each bucket of hashes, the logarithm of how often its words occur in ``line``.

    The number of buckets is fixed, so the table that tells rare words from
    common ones does not grow with the vocabulary; words that share a bucket
    with a common one only seem more common than they are.
    """
    words = lines.select(F.explode(line_words(F.col("line"))).alias("word"))
    counts = words.select(_bucket(F.col("word")).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.lit(31), F.floor(F.log2("n") + F.lit(1e-9)) + 1).cast("long")
    bits = F.call_function("shiftleft", level, (F.col("b") % PACKED * 5).cast("int"))
    packed = counts.groupBy(F.floor(F.col("b") / PACKED).alias("at")).agg(F.bit_or(bits).alias("bits"))
    levels = bytearray(BUCKETS + PACKED)
    for at, value in packed.collect():  # BUCKETS / PACKED rows at most
        levels[at * PACKED : (at + 1) * PACKED] = bytes(value >> shift & 31 for shift in range(0, 5 * PACKED, 5))
    return bytes(levels[:BUCKETS])


def _hashes(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda word: F.xxhash64(word)))


def rarest_first(words: Column, levels: bytes) -> Column:
    """The different words as numbers that sort by rarity level, then by hash."""

    def number(hashed: Column) -> Column:
        at = (hashed.bitwiseAND(F.lit(BUCKETS - 1)) + 1).cast("int")
        level = F.ascii(F.substring(F.lit(levels), at, F.lit(1)).cast("string"))
        return F.shiftleft(level.cast("long"), _HASH_BITS).bitwiseOR(F.shiftrightunsigned(hashed, 64 - _HASH_BITS))

    return F.sort_array(F.transform(_hashes(words), number))


def _bitmaps(words: Column) -> list[Column]:
    """The columns of a line's bitmap: a word turns over the bit of its last six of the hash, in the part of the one before; short lines have one part only."""
    none, long = F.lit(0).cast("long"), F.size(words) > SHORT_LINE

    def turned(seen: Column, word: Column) -> Column:
        return seen.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), word.bitwiseAND(F.lit(63)).cast("int")))

    def of(part: int) -> Column:
        return F.aggregate(words, none, lambda seen, w: F.when(w.bitwiseAND(F.lit(64)) == part << 6, turned(seen, w)).otherwise(seen))

    return [F.when(long, of(0)).otherwise(F.aggregate(words, none, turned)).alias("bits"), F.when(long, of(1)).alias("more")]


def _apart(a: str, b: str) -> Column:
    """How many bits of the bitmaps differ: no more than words do, as a word not in common turns over one."""
    bits, more = (F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in ("bits", "more"))
    whole = (F.col(f"{side}.bits").bitwiseXOR(F.coalesce(F.col(f"{side}.more"), F.lit(0).cast("long"))) for side in (a, b))
    return F.when(more.isNotNull(), F.bit_count(bits) + F.bit_count(more)).otherwise(F.bit_count(functools.reduce(Column.bitwiseXOR, whole)))


def _prefix(words: Column) -> Column:
    """The words of which a partner has at least one; so few that partners have equal sets are one word together."""
    n = F.size(words)
    equal = n * (DENOMINATOR - NUMERATOR) < NUMERATOR  # one word more or less is below the threshold
    length = n - F.ceil(n * F.lit(NUMERATOR) / F.lit(DENOMINATOR)).cast("int") + 1
    return F.when(equal, F.array(F.xxhash64(words))).otherwise(F.slice(words, F.lit(1), length))


def _enough(common: Column, a: str, b: str) -> Column:
    """Whether so many words in common may be NUMERATOR / DENOMINATOR of those of both sides."""
    return common * (NUMERATOR + DENOMINATOR) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * NUMERATOR


def _candidate(a: str, b: str) -> Column:
    """``a`` before ``b``, length filter, positional filter for a first word in common, and the bitmaps' bound on the words not in common."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    before = (F.col(f"{a}.o") < F.col(f"{b}.o")) | ((F.col(f"{a}.o") == F.col(f"{b}.o")) & (F.col(f"{a}.x") < F.col(f"{b}.x")))
    in_size = (n_a * DENOMINATOR >= n_b * NUMERATOR) & (n_b * DENOMINATOR >= n_a * NUMERATOR)
    ahead = _enough(F.least(n_a - F.col(f"{a}.at"), n_b - F.col(f"{b}.at")), a, b)
    few_apart = _apart(a, b) * (NUMERATOR + DENOMINATOR) <= (n_a + n_b) * (DENOMINATOR - NUMERATOR)
    return before & in_size & ahead & few_apart


def _broadcast_if_few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _index(prefixes: DataFrame, *more: str) -> DataFrame:
    return prefixes.select("o", "x", "n", "bits", "more", *more, F.posexplode("prefix").alias("at", "word"))


def _met() -> list[Column]:
    return [F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in "ox"]


def _level(word: Column) -> Column:
    return F.shiftrightunsigned(word, _HASH_BITS).cast("int")


def _drawn(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Of each word's list those ``low`` to ``high`` of a random order, about: a list has no more rows than its level says."""
    drawn = F.shiftrightunsigned(F.xxhash64("word", "o", "x"), 33)

    def below(count: int) -> Column:
        return drawn < F.call_function("shiftright", F.lit(count << 31).cast("long"), _level(F.col("word")))

    return rows.where(below(high) & ~below(low))


def _same_short(prefixes: DataFrame) -> DataFrame:
    """Lines so short that similar ones have equal sets of words, with the first one of their set."""
    rows = _index(prefixes.where(F.col("n") < NUMERATOR))
    first = rows.groupBy("word").agg(F.min(F.struct("o", "x", "n", "at", "bits", "more")).alias("f")).select("word", "f.*")
    return rows.alias("b").join(first.alias("a"), (F.col("a.word") == F.col("b.word")) & _candidate("a", "b")).select(*_met())


def _clustered(prefixes: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``o, x`` of lines that go for a line of the same set or of a hot word list, and the hot words, none of whose pairs is left to meet."""
    long = _index(prefixes.where(F.col("n") >= NUMERATOR)).where(_level(F.col("word")) >= LONG_LEVEL)
    meets = (F.col("a.word") == F.col("b.word")) & _candidate("a", "b")
    met = cut(long.alias("b").join(_broadcast_if_few(_drawn(long, 0, DRAWN)).alias("a"), meets).select("b.word", *_met()))

    def often(rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy("word").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") >= HOT_PAIRS).select("word"))

    # what the lines of a hot list often have besides is as hot, though nothing may have been drawn from its list
    inside = met.join(_broadcast_if_few(often(met)), "word", "left_semi").select(F.col("o_b").alias("o"), F.col("x_b").alias("x"))
    hot = often(long.join(_broadcast_if_few(cut(inside.distinct())), ["o", "x"], "left_semi"))
    removed = _removed(met.drop("word").union(_same_short(prefixes)).distinct(), lines)
    highest = hot.agg(F.max(_level(F.col("word")))).first()[0]
    if highest is None:
        return removed, None
    long = cut(long.join(_broadcast_if_few(hot), "word", "left_semi"))
    inside = lines.join(_broadcast_if_few(cut(long.select("o", "x").distinct())), ["o", "x"], "left_semi")
    long = cut(long.join(inside.select("o", "x", _hashes(line_words(F.col("line"))).alias("words")), ["o", "x"]))
    meets &= _enough(F.size(F.array_intersect("a.words", "b.words")), "a", "b")
    count = DRAWN
    while count < 1 << highest:
        drawn = _drawn(long, count, min(count * GROWTH, 1 << highest))
        stay = long.join(_broadcast_if_few(removed), ["o", "x"], "left_anti")
        met = stay.alias("b").join(drawn.alias("a"), meets).select(*_met()).distinct()
        removed = cut(removed.union(_removed(met, lines)).distinct())
        count *= GROWTH
    return removed, hot


def _other_pairs(prefixes: DataFrame, removed: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Pairs that share a prefix word that is not hot and whose later line is not removed yet, a part of the words at a time."""
    marked = prefixes.join(_broadcast_if_few(removed).withColumn("gone", F.lit(1)), ["o", "x"], "left").fillna(0, "gone")
    parts = []
    for part in range(WORD_PARTS):
        rows = _index(marked, "gone").where(F.pmod("word", F.lit(WORD_PARTS)) == part)
        rows = rows if hot is None else rows.join(_broadcast_if_few(hot), "word", "left_anti")
        # true where b stays; as it names both sides it is not pushed below the join, whose sides are then one exchange
        stays = F.col("a.n") + F.col("a.gone") > F.col("b.gone") * F.lit((1 << 31) - 1)
        pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.word") == F.col("b.word")) & stays & _candidate("a", "b"))
        parts.append(cut(pairs.select(*_met()).distinct()))
    return functools.reduce(DataFrame.union, parts).distinct()


def _removed(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``o, x`` of lines that come after a line they are similar to, among candidate pairs."""
    pairs = cut(pairs)
    ends = [pairs.select(*(F.col(f"{c}_{side}").alias(c) for c in "ox")) for side in "ab"]
    needed = cut(ends[0].union(ends[1]).distinct())
    texts = lines.join(_broadcast_if_few(needed), ["o", "x"], "left_semi").select("o", "x", "line")
    a, b = (texts.select(*(F.col(c).alias(f"{c}_{side}") for c in texts.columns)) for side in "ab")
    one, two = (line_words(F.col(f"line_{side}")) for side in "ab")
    union = F.size(F.array_union(one, two))
    # the words in common are those of both sides less the union; they are NUMERATOR / DENOMINATOR of it or more
    enough = (F.size(F.array_distinct(one)) + F.size(F.array_distinct(two)) - union) * DENOMINATOR >= union * NUMERATOR
    similar = pairs.join(a, ["o_a", "x_a"]).join(b, ["o_b", "x_b"]).where(enough)
    return cut(similar.select(F.col("o_b").alias("o"), F.col("x_b").alias("x")).distinct())


def _ordered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``o``, a number that grows with ``d``, null first."""
    if isinstance(docs.schema["d"].dataType, T.IntegralType):
        return docs.withColumn("o", F.coalesce(F.col("d").cast("long"), F.lit(-(1 << 63))))
    known = docs.select("d").distinct().orderBy(F.col("d").asc_nulls_first())
    numbers = cut(known.withColumn("o", F.monotonically_increasing_id())).withColumnRenamed("d", "d2")
    return docs.join(numbers, F.col("d").eqNullSafe(F.col("d2"))).drop("d2")


def _told_apart(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` of ``o`` with ``h``: 0, or where several rows share ``o`` a number of their own for each text, in the order of its digest."""
    several = rows.groupBy("o").agg(F.count(F.lit(1)).alias("line_dedup__n")).where("line_dedup__n > 1")
    several = cut(several)
    largest = several.agg(F.max("line_dedup__n")).first()[0]
    alone = F.lit(0).cast("long").alias("h")
    if largest is None:
        return rows.select("*", alone)
    digest = F.sha2(F.coalesce(text, F.lit("")), 256).alias("line_dedup__digest")
    shared = rows.join(_broadcast_if_few(several.select("o")), "o", "left_semi").select("*", digest)
    numbers = numbered(cut(shared.select("o", "line_dedup__digest").distinct()), ["o"], ["line_dedup__digest"], "h", largest)
    told = shared.join(cut(numbers), ["o", "line_dedup__digest"]).select(*rows.columns, "h")
    return rows.join(_broadcast_if_few(several.select("o")), "o", "left_anti").select(*rows.columns, alone).union(told)


@tidy
def kept_lines(docs: DataFrame) -> DataFrame:
    """``o, h, kept`` of ``o, h, text``: in order, the places of the lines with words that stay."""
    spark: SparkSession = docs.sparkSession
    with scratch(spark) as folder:

        def stored(df: DataFrame, name: str) -> DataFrame:
            df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
            return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        split = docs.select("o", "h", F.posexplode(F.split(F.lower("text"), "\n")).alias("at", "line")).where(~_blank(F.col("line")))
        place = F.call_function("shiftleft", F.col("h"), F.lit(_PLACE_BITS)).bitwiseOR(F.col("at").cast("long"))
        named = split.select("o", place.alias("x"), "line", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))
        # lines whose 128 bits are equal count as equal
        classes = named.groupBy("k1", "k2").agg(F.min(F.struct("o", "x")).alias("first"), F.first("line").alias("line"))
        lines = stored(classes.select("first.o", "first.x", _spaced(F.col("line")).alias("line")), "lines")

        ordered = lines.select("o", "x", rarest_first(line_words(F.col("line")), rarity_levels(lines)).alias("w"))
        prefixes = stored(ordered.select("o", "x", F.size("w").alias("n"), *_bitmaps(F.col("w")), _prefix(F.col("w")).alias("prefix")), "prefixes")

        first, hot = _clustered(prefixes, lines)
        removed = cut(first.union(_removed(_other_pairs(prefixes, first, hot), lines)).distinct())
        stay = prefixes.select("o", "x").join(_broadcast_if_few(removed), ["o", "x"], "left_anti")
        at = F.col("x").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
        return cut(stay.groupBy("o", F.shiftright("x", _PLACE_BITS).alias("h")).agg(F.collect_list(at).alias("kept")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with near-duplicate lines taken out of the text, and ``n_lines, n_removed``.

    Lines end at newlines. A line goes if an equal or similar one (4/5 of the
    words of both in common) comes before it, in an earlier row by id or
    earlier in the same text, whether that one stays or not. Lines without
    words always stay. Rows that share an id are ordered by digests of their
    texts, rows equal in both count as one. Null ids come first. A null text
    stays null and has no lines; an empty text is one empty line. A text that
    loses all lines becomes empty. Columns named like the two counts give way
    to them; :func:`without_repeated_lines` returns the columns as they were.
    """
    counted = _cleaned(docs, [c for c in docs.columns if c not in COUNTS], id_col, text_col)
    return counted.withColumnsRenamed({f"line_dedup__{c}": c for c in COUNTS})


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with texts as :func:`dedup_lines` leaves them."""
    return _cleaned(docs, docs.columns, id_col, text_col).drop(*(f"line_dedup__{c}" for c in COUNTS))


def _cleaned(docs: DataFrame, own: list[str], id_col: str, text_col: str) -> DataFrame:
    """The columns ``own`` and the counts as ``line_dedup__...``."""
    text = F.col("row").getField(text_col)
    keyed = _told_apart(_ordered(docs.select(F.col(id_col).alias("d"), F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"))), text)
    kept = kept_lines(keyed.select("o", "h", text.alias("text")))
    lines = F.split(text, "\n")
    blanks = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda at: _blank(F.get("line_dedup", at)))
    marked = keyed.join(kept.hint("shuffle_hash"), ["o", "h"], "left").withColumn("line_dedup", lines)
    places = F.sort_array(F.concat(F.coalesce("kept", F.array().cast("array<int>")), blanks))
    marked = marked.withColumn("left", F.transform(places, lambda at: F.get("line_dedup", at)))
    out = [F.array_join("left", "\n").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in own]
    n = F.when(text.isNotNull(), F.size("line_dedup")).otherwise(0)
    removed = F.when(text.isNotNull(), n - F.size("left")).otherwise(0)
    return marked.select(*out, n.alias("line_dedup__n_lines"), removed.alias("line_dedup__n_removed"))
