"""Exact similarity join of word shingles in the metric space of Jaccard distances.

Distances between unrelated documents are all 1, so one Voronoi diagram of the
whole table would say nothing. Space is first cut where distances tell
something: documents that are similar share one of the rarest shingles of
their sets (the prefix that a partner cannot miss all of), and the documents of
such a shingle are a list. Each list has pivots of its own: the distance of
every document to them is measured on full sets, and a document's cell is that
of its nearest pivot. With ``e`` the largest distance of a link:

* a document within ``e`` of its cell's pivot is linked to it and is of the
  cell's core;
* by the triangle inequality a link from the core of ``p`` ends within ``2 e``
  of ``p``, and no further from it than ``2 e`` beyond the distance to the
  partner's own pivot: documents in that window are replicated to the cell,
  where they meet the core documents whose distance to ``p`` differs by ``e``
  at most, unless both are in one component by then; a few of each core come
  first, as what they link spares the rest, and bitmaps, sizes and places of
  shingles rule pairs out before they are made;
* the documents of no core stay, and the list without pivots and cores is
  joined the same way again. What is left of lists after ``LEVELS`` rounds is
  joined by pairs across components, with filters by size and position.

For a link in any list it shares, at the level where the first of its ends
leaves the list, it was measured (a pivot), implied (two documents of one core)
or met in a window; else it is among the pairs at the end. So components are
exact, whatever pivots are chosen. Equal sets are one document from the start.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.llm.common import as_bytes, map_arrow, shingle_sets
from gridloom.llm.minhash import BUCKETS, _buckets
from gridloom.plans.components import connected_components
from gridloom.plans.durable import cut, scratch, tidy

#: Pivots of a list at each level, and levels before pairs are taken.
PIVOTS, LEVELS = 2, 3
#: Members of a core that the others meet before all do.
HUBS = 4
#: Numbers of 64 bits in the bitmaps of equal size by which pairs are ruled out where cores meet windows.
FOLD = 16
#: Ids of documents that may be broadcast (some MB).
BROADCAST_IDS = 500_000
#: Distances are fractions of whole numbers; windows are wider by so much than the rounding of two of them.
SLACK = 1e-9


def bitmap(shingles: np.ndarray, size: int | None = None) -> bytes:
    """For each of ``size`` parts of the hashes, or two parts or more for each shingle, whether an odd number of shingles falls into it."""
    size = size or 1 << max(6, (2 * len(shingles) - 1).bit_length())
    parity = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """How many bits of two bitmaps differ, the larger folded to the size of the smaller: no more than shingles do."""
    one, two = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
    if len(one) < len(two):
        one, two = two, one
    while len(one) > len(two):
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    return int(np.bitwise_count(one ^ two).sum())


def set_keys(source: DataFrame, words: int) -> DataFrame:
    """``id, n_shingles, set_key, bits, fold, counts`` of ``id, text``: a 128-bit hash, a bitmap and one of FOLD numbers of the set, null for an empty one.

    Each task adds a row of its own, whose ``counts`` say how many shingles of
    its texts fall into each bucket of their hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * BUCKETS, dtype=np.int64)
        names = ["id", "n_shingles", "set_key", "bits", "fold", "counts"]
        for batch in batches:
            sets = shingle_sets(as_bytes(batch.column(1)), words)
            for bucket in _buckets(np.concatenate(sets)) if sets else ():
                counts += np.bincount(bucket, minlength=2 * BUCKETS)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            bits = [bitmap(s) if len(s) else None for s in sets]
            folds = pa.array([np.frombuffer(bitmap(s, 64 * FOLD), dtype="<i8") if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary()), pa.array(bits, pa.binary()), folds, pa.nulls(len(sets), pa.binary())], names
            )
        own = [pa.array([None], source_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())), pa.array([zlib.compress(counts.astype("<i8").tobytes(), 1)])]
        yield pa.RecordBatch.from_arrays(own, names)

    source_type = to_arrow_type(source.schema["id"].dataType)
    key, bits, counts = (T.StructField(c, T.BinaryType()) for c in ("set_key", "bits", "counts"))
    fold = T.StructField("fold", T.ArrayType(T.LongType()))
    return map_arrow(source, run, T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("n_shingles", T.LongType()), key, bits, fold, counts]))


def rarity_levels(keyed: DataFrame) -> np.ndarray:
    """For the buckets of both parts of a hash, the logarithm of how often their shingles occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, dtype=np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(counts), dtype="<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["b", "n"])

    levels = np.zeros(2 * BUCKETS, dtype=np.uint8)
    counted = map_arrow(keyed.where("counts IS NOT NULL").select("counts"), run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n"))
    for b, n in counted.collect():  # at most twice BUCKETS rows
        levels[b] = int(n).bit_length()
    return levels


def rare_prefixes(texts: DataFrame, levels: np.ndarray, words: int, percent: int) -> DataFrame:
    """``id, n, at, token``: of each set the rarest shingles, as many as a similar set cannot miss all of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, sizes, tokens = [], [], [np.empty(0, dtype=np.uint64)]
            for shingles in shingle_sets(as_bytes(batch.column(1)), words):
                n = len(shingles)
                one, two = _buckets(shingles)
                lengths.append(n - -(-percent * n // 100) + 1 if n else 0)
                sizes.append(n)
                # in order already, so a stable order by level is one by level and hash
                tokens.append(shingles[np.argsort(np.minimum(levels[one], levels[two]), kind="stable")[: lengths[-1]]])
            length = np.array(lengths, dtype=np.int64)
            row = np.repeat(np.arange(len(lengths)), length)
            at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(np.array(sizes, dtype=np.int32)[row]), pa.array(at.astype(np.int32)), pa.array(np.concatenate(tokens).view(np.int64))],
                ["id", "n", "at", "token"],
            )

    fields = [T.StructField("n", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("token", T.LongType())]
    return map_arrow(texts, run, T.StructType([texts.schema["id"], *fields]))


def not_ruled_out(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of which the bitmaps ``id, n_shingles, bits`` allow a similarity of ``percent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)
            keep = pa.array([apart(x, y) * (100 + percent) <= (100 - percent) * n for x, y, n in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    one, two = (sketches.select(F.col("id").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n_shingles").alias(f"n_{c}")) for c in "ab")
    joined = pairs.join(two, "b").join(one, "a").select("a", "b", "bits_a", "bits_b", (F.col("n_a") + F.col("n_b")).alias("n"))
    return cut(map_arrow(joined, run, T.StructType([pairs.schema["a"], pairs.schema["b"]])))


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def distances(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``a, b, common, total`` of pairs ``a, b``: sizes of the intersection and the union of their full sets."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    needed = texts.join(_few(cut(ends)), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, total = [], []
            ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts_of = dict(zip(ids[0] + ids[1], as_bytes(batch.column(2)) + as_bytes(batch.column(3)), strict=True))
            sets = dict(zip(texts_of, shingle_sets(list(texts_of.values()), words), strict=True))
            for a, b in zip(*ids, strict=True):
                one, two = sets[a], sets[b]
                at = np.searchsorted(two, one)
                at[at == len(two)] = 0
                both = int((two[at] == one).sum())
                common.append(both)
                total.append(len(one) + len(two) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])

    one, two = (needed.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}")) for side in "ab")
    joined = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    fields = [pairs.schema["a"], pairs.schema["b"], T.StructField("common", T.LongType()), T.StructField("total", T.LongType())]
    return cut(map_arrow(joined, run, T.StructType(fields)))


def _in_size(one: str, two: str, percent: int) -> F.Column:
    """Whether sets of sizes ``n`` can have a similarity of ``percent``."""
    n_a, n_b = F.col(f"{one}.n"), F.col(f"{two}.n")
    return (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a)


def _not_apart(one: str, two: str, percent: int) -> F.Column:
    """Whether the bitmaps ``fold`` allow a similarity of ``percent``."""
    bits = [F.bit_count(F.get(f"{one}.fold", F.lit(k)).bitwiseXOR(F.get(f"{two}.fold", F.lit(k)))) for k in range(FOLD)]
    return functools.reduce(lambda a, b: a + b, bits) * (100 + percent) <= (F.col(f"{one}.n") + F.col(f"{two}.n")) * (100 - percent)


def _in_place(one: str, two: str, percent: int) -> F.Column:
    """The same for rows ``n, at`` of a shingle in common, by its places."""
    n_a, n_b = F.col(f"{one}.n"), F.col(f"{two}.n")
    return F.least(n_a - F.col(f"{one}.at"), n_b - F.col(f"{two}.at")) * (100 + percent) >= (n_a + n_b) * percent


def _several(rows: DataFrame) -> DataFrame:
    """Rows of shingles in two documents or more, with the pivots of their lists: the first by hash of each of PIVOTS parts."""
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    shared = rows.join(shared.hint("shuffle_hash"), "token", "left_semi")
    first = F.min(F.struct(F.xxhash64("id").alias("by"), "id", "n", "at")).alias("pivot")
    part = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(PIVOTS))
    shared = cut(shared)
    pivots = shared.groupBy("token", part.alias("part")).agg(first)
    return shared.join(pivots.groupBy("token").agg(F.collect_list(F.col("pivot").dropFields("by")).alias("pivots")), "token")


def _level(listed: DataFrame, texts: DataFrame, sketches: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Links to pivots, cores and windows of the cells of lists, and the rows that are left."""
    far = 2 * (100 - percent)
    met = listed.select("token", "id", "n", "at", F.explode("pivots").alias("p"))
    own = met.where("id = p.id").select("token", "id")
    # whether a shingle is the first of a pair's is not known here, so all before it may be shared too
    shared = F.least("at", "p.at") + F.least(F.col("n") - F.col("at"), F.col("p.n") - F.col("p.at"))
    near = shared * (200 - far) >= (F.col("n") + F.col("p.n")) * (100 - far)
    met = met.where((F.col("id") != F.col("p.id")) & near).select("token", "id", "n", "at", F.col("p.id").alias("p"))
    pairs = cut(met.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct())
    known = distances(not_ruled_out(pairs, sketches, 100 - far), texts, words)
    links = known.where(100 * F.col("common") >= percent * F.col("total")).select("a", "b")
    d = (1 - F.col("common") / F.col("total")).alias("d")
    is_link = (100 * F.col("common") >= percent * F.col("total")).alias("is_link")
    both = known.select("a", "b", d, is_link)
    both = both.union(known.select(F.col("b").alias("a"), F.col("a").alias("b"), d, is_link)).select(F.col("a").alias("id"), F.col("b").alias("p"), "d", "is_link")
    reach = far / 100 + SLACK
    seen = met.join(both, ["id", "p"]).where(F.col("d") <= reach)
    cells = seen.groupBy("token", "id").agg(F.min(F.struct("d", "p", "is_link")).alias("home"), F.collect_list(F.struct("p", "d")).alias("pivots"), F.first("n").alias("n"), F.first("at").alias("at"))
    # a pivot is no document of another's cell: all of its pairs are measured
    cells = cut(cells.join(own, ["token", "id"], "left_anti"))
    cores = cells.where("home.is_link").select("token", "home.p", "id", "n", "at", "home.d")
    window = cells.select("id", "n", "at", "home", F.explode("pivots").alias("w")).where(F.col("w.d") <= F.col("home.d") + reach)
    window = window.where(~(F.col("home.is_link") & (F.col("home.p") == F.col("w.p")))).select("w.p", "id", "n", "at", "w.d")
    gone = cores.select("token", "id").union(own)
    # the distance to a pivot is that of all lists it is in, so its cells of all lists are one
    return links, cores.drop("token"), window, listed.drop("pivots").join(gone, ["token", "id"], "left_anti")


def _hubs(rows: DataFrame, key: str) -> DataFrame:
    """A few rows of each ``key``: the first by hash of each of HUBS parts."""
    part = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(HUBS))
    return rows.groupBy(key, part.alias("part")).agg(F.min(F.struct(F.xxhash64("id").alias("by"), *(c for c in rows.columns if c != key))).alias("hub")).select(key, "hub.*").drop("by")


def _crossing(left: DataFrame, right: DataFrame, key: str, groups: DataFrame, percent: int, more: F.Column) -> DataFrame:
    """Distinct pairs of rows that agree in ``key``, are in different components and pass the filters."""
    x, y = (
        side.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id")).alias(name) for side, name in ((left, "x"), (right, "y"))
    )
    joined = x.join(y, [F.col(f"x.{key}") == F.col(f"y.{key}"), F.col("x.component") != F.col("y.component"), _in_size("x", "y", percent), more])
    return cut(joined.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``id, component`` after more links; only components that these join are looked at."""
    ends = [groups.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}")) for side in "ab"]
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left")
    between = cut(between.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct())
    if between.isEmpty():
        return groups
    joined = connected_components(between, "a", "b")
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("new"))
    old = groups.join(moved, "component", "left").select("id", F.coalesce("new", "component").alias("component"))
    fresh = joined.select(F.col("node").alias("id"), "component").join(groups.select("id"), "id", "left_anti")
    return cut(old.union(fresh))


def _groups(texts: DataFrame, sketches: DataFrame, levels: np.ndarray, words: int, percent: int) -> DataFrame:
    """``id, component`` of what similar sets join; ``texts`` and ``sketches`` have different ids and sets."""
    with scratch(texts.sparkSession) as folder:
        rare_prefixes(texts, levels, words, percent).write.option("compression", "zstd").parquet(f"{folder}/prefixes")
        listed = cut(_several(texts.sparkSession.read.parquet(f"{folder}/prefixes")))
    links = [texts.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")]
    cores, windows = [], []
    for _ in range(LEVELS):
        if listed.isEmpty():
            break
        found, core, window, rest = _level(listed, texts, sketches, words, percent)
        links.append(found)
        cores.append(core)
        windows.append(window)
        listed = cut(_several(rest))

    def joined(parts: list[DataFrame]) -> DataFrame:
        return cut(functools.reduce(DataFrame.union, parts))

    def confirmed(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return links[0]
        return distances(not_ruled_out(pairs, sketches, percent), texts, words).where(100 * F.col("common") >= percent * F.col("total")).select("a", "b")

    groups = cut(connected_components(joined(links), "a", "b").withColumnRenamed("node", "id"))
    if cores:
        # a pivot's cells of all levels and lists meet; each pair that only some of them have to tell is told once
        folds = sketches.select("id", "fold")

        def told_once(parts: list[DataFrame]) -> DataFrame:
            # the place of the first shingle in common is no lower than the least place of all lists
            rows = joined(parts).groupBy("p", "id").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("d").alias("d"))
            return cut(rows.join(folds, "id"))

        inside, around = told_once(cores), told_once(windows)
        within = (F.col("x.d") + (100 - percent) / 100 + SLACK >= F.col("y.d")) & _in_place("x", "y", percent) & _not_apart("x", "y", percent)
        # a few of each core first: what they link needs no more pairs
        for core in (_hubs(inside, "p"), inside):
            groups = merged(groups, confirmed(_crossing(core, around, "p", groups, percent, within)))
    if not listed.isEmpty():
        left = listed.drop("pivots")
        groups = merged(groups, confirmed(_crossing(left, left, "token", groups, percent, _in_place("x", "y", percent) & (F.col("x.id") < F.col("y.id")))))
    return groups


@tidy
def similarity_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents that Jaccard similarity of word shingles links, exactly.

    ``<id_col>, n_shingles, component_id`` for every row: the number of
    different shingles, and the smallest id reachable by links. A-Z is
    lower-cased and words end at ASCII white space; a text of fewer words is
    one shingle. Null texts and texts without words have no shingles and no
    links. A null id has no links and no component. Rows that repeat an id are
    one document with the links of all its rows. Further columns are ignored;
    an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known, number = source.where("id IS NOT NULL"), None
    if not known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        number = cut(known.withColumn("row", F.monotonically_increasing_id()))
        known = number.select(F.col("row").alias("id"), "text")
    keyed = cut(set_keys(known, words))
    sets = keyed.where("counts IS NULL").drop("counts")
    classes = cut(sets.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("rep")))
    reps = _few(classes.select(F.col("rep").alias("id")))
    sketches = sets.select("id", "n_shingles", "bits", "fold").join(reps, "id", "left_semi")
    groups = _groups(known.join(reps, "id", "left_semi"), sketches, rarity_levels(keyed), words, percent)
    # equal sets have the group of their smallest id, which is the smallest of the group if that one is
    of_rep = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    placed = sets.join(of_rep, "set_key", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    nameless = set_keys(source.where("id IS NULL"), words).where("counts IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    if number is not None:
        names = number.select("row", F.col("id").alias("name"))
        edges = placed.join(names, F.col("id") == F.col("row")).select(F.col("name").alias("a"), "component_id", "n_shingles")
        edges = cut(edges.join(names, F.col("component_id") == F.col("row")).select("a", F.col("name").alias("b"), "n_shingles"))
        joined = connected_components(edges, "a", "b")
        placed = edges.join(joined.withColumnRenamed("node", "a"), "a").select(F.col("a").alias("id"), "n_shingles", F.col("component").alias("component_id"))
    return placed.union(nameless).select(F.col("id").alias(id_col), "n_shingles", "component_id")
