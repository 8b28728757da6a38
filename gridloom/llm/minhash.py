"""Near-duplicate groups by an LSH forest over MinHash signatures.

A signature is read in ``TREES`` orders, each starting at its own components.
Documents that share the first components of an order form a region; a small
region gives all its pairs as candidates, a larger one is read deeper, so
candidates are the neighbours with the longest common prefix and the depth
adapts to the region. Equal sets are one node from the start. Candidates are
screened by their signatures and confirmed on the full shingle sets.

Regions that are large at first go in rounds, so that links found early spare
the comparisons inside a group: each member with the least one of its deep
region, then with those members of the large region that have most confirmed
links, then with all of its deep regions; the last two only where the two
sides are not yet in one group. The members of large regions that still hold
several groups are joined exactly, by the rarest shingles of their sets, so
that no link across groups is left there.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import WordHashes, as_bytes, gram_hashes, map_arrow, mixed, without_ids
from gridloom.plans.components import connected_components
from gridloom.plans.durable import cut, tidy

#: Orders, own components of each, bytes of a component in the signature.
TREES, OWN, WIDTH = 24, 8, 2
HASHES = TREES * OWN
#: Components in common before two documents are candidates, and the depths at which larger regions are read again.
DEPTHS = (4, 6, 8, 12, 16, 24)
#: The largest region whose pairs are all candidates.
SMALL = 17
#: Members with most links, one of each of so many parts, that all of a large region are compared with.
HUBS = 8
#: Orders whose deep regions are used in the first round.
FIRST_TREES = 8
#: Standard deviations of the estimate that a candidate may lie below the threshold.
SLACK = 4.5
#: Ids of documents to confirm that may be broadcast.
BROADCAST_IDS = 1_000_000

#: Hash buckets of the shingle frequencies, counted by two parts of the hash.
BUCKETS = 1 << 16

_HASHES = WordHashes()
_FACTORS = mixed(np.arange(HASHES, dtype=np.int64)) | np.uint64(1)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; shorter texts are one shingle, texts without words none."""
    split = text.lower().split() if text else []
    if not split:
        return np.empty(0, dtype=np.uint64)
    return np.unique(gram_hashes(_HASHES.array(split), min(words, len(split))))


def signature(shingles: np.ndarray) -> bytes:
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * _FACTORS).min(axis=0), out=least)
    return mixed(least.view(np.int64)).astype("<u2").tobytes()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if not len(a) or not len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def signatures(source: DataFrame, words: int) -> DataFrame:
    """``id, n_shingles, set_key, sig`` of ``id, text``; the last two null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in as_bytes(batch.column(1)):
                shingles = shingle_set(text, words)
                sizes.append(len(shingles))
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                sigs.append(signature(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                ["id", "n_shingles", "set_key", "sig"],
            )

    schema = T.StructType(
        [
            source.schema["id"],
            T.StructField("n_shingles", T.LongType()),
            T.StructField("set_key", T.BinaryType()),
            T.StructField("sig", T.BinaryType()),
        ]
    )
    return map_arrow(source, run, schema)


def _path(length: int):
    """The first components of order ``t``, read on past the end of the signature."""
    return F.concat("sig", "sig").substr(F.col("t") * (OWN * WIDTH) + 1, F.lit(length * WIDTH))


def _pairs(regions: DataFrame) -> DataFrame:
    """All pairs a < b of regions with at most SMALL members."""
    members = regions.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    first = members.select("ids", F.posexplode("ids").alias("at", "a"))
    return first.select("a", F.explode(F.slice("ids", F.col("at") + 2, F.lit(SMALL))).alias("b"))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a key, as those of small regions (two to SMALL members) and those of larger ones."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = cut(rows.join(sizes, "key"))
    return sized.where(F.col("n") <= SMALL).drop("n"), sized.where(F.col("n") > SMALL).drop("n")


def forest_regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions of ``id, sig`` as rows ``key, id``: small at the first depth, large there, and the deep ones of the large.

    Deep regions also have ``t`` and are small unless nothing tells their members apart.
    """
    planted = nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t"), "sig")
    small, large = _split(planted.select("id", "t", F.xxhash64("t", _path(DEPTHS[0])).alias("key")))
    deep = large.where("false").select("key", "id", "t")
    if large.isEmpty():
        return small.select("key", "id"), large.select("key", "id"), deep
    rest = cut(large.select("id", "t").join(nodes, "id").select("id", "t", _path(DEPTHS[-1]).alias("path")))
    for depth in DEPTHS[1:]:
        part, rest = _split(rest.select("id", "t", "path", F.xxhash64("t", F.col("path").substr(1, depth * WIDTH)).alias("key")))
        deep = deep.union(part.select("key", "id", "t"))
    return small.select("key", "id"), large.select("key", "id"), cut(deep.union(rest.select("key", "id", "t")))


def _stars(regions: DataFrame) -> DataFrame:
    """Each member of a region with its least one."""
    least = regions.groupBy("key").agg(F.min("id").alias("a"))
    return regions.join(least, "key").where("a < id").select("a", F.col("id").alias("b")).distinct()


def _screened(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures do not rule out the threshold."""
    p = percent / 100
    least = int(HASHES * (p - SLACK * (p * (1 - p) / HASHES) ** 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, HASHES) for c in (2, 3)
            )
            keep = pa.array((one == two).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left = nodes.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    right = nodes.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b")
    return map_arrow(joined, run, T.StructType([pairs.schema["a"], pairs.schema["b"]]))


def _confirmed(pairs: DataFrame, source: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets meet the threshold."""
    pairs = cut(pairs)
    needed = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    small = needed.count() <= BROADCAST_IDS
    texts = source.join(F.broadcast(needed) if small else needed, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: OrderedDict = OrderedDict()

        def of(key, text: bytes) -> np.ndarray:
            if (key, len(text)) not in sets:
                if len(sets) >= 64:
                    sets.popitem(last=False)
                sets[key, len(text)] = shingle_set(text, words)
            return sets[key, len(text)]

        for batch in batches:
            left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            one, two = as_bytes(batch.column(2)), as_bytes(batch.column(3))
            keep = pa.array(
                [similar(of(a, x), of(b, y), percent) for a, b, x, y in zip(left, right, one, two, strict=True)], pa.bool_()
            )
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    joined = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
        .where("text_a IS NOT NULL AND text_b IS NOT NULL")
    )
    return cut(map_arrow(joined, run, T.StructType([pairs.schema["a"], pairs.schema["b"]])).distinct())


def _grouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """``key, id, component, degree`` of regions whose members are not all in one group."""
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "id")
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id")))
    degrees = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    known = cut(
        members.select("key", "id")
        .join(groups.join(degrees, "id", "left"), "id", "left")
        .select("key", "id", F.coalesce("component", "id").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
    )
    mixed_keys = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return known.join(mixed_keys.select("key"), "key", "left_semi")


def _hub_pairs(grouped: DataFrame) -> DataFrame:
    """Members of regions with the best linked ones there that another group holds."""
    hubs = (
        grouped.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(HUBS)).alias("part"))
        .agg(F.max(F.struct("degree", "id", "component")).alias("hub"))
        .select("key", F.col("hub.id").alias("hub"), F.col("hub.component").alias("hub_component"))
    )
    met = grouped.join(hubs, (grouped["key"] == hubs["key"]) & (F.col("component") != F.col("hub_component")))
    return met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _rest_pairs(grouped: DataFrame) -> DataFrame:
    """Pairs of deep regions across groups; regions that stayed large give those with their hubs."""
    sizes = grouped.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sized = cut(grouped.join(sizes, "key"))
    members = (
        sized.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("id", "component"))).alias("m"))
    )
    first = members.select("m", F.posexplode("m").alias("at", "one"))
    later = F.filter(F.slice("m", F.col("at") + 2, F.lit(SMALL)), lambda x: x["component"] != F.col("one.component"))
    pairs = first.select(F.col("one.id").alias("a"), F.explode(later).alias("b")).select("a", F.col("b.id").alias("b"))
    return pairs.union(_hub_pairs(sized.where(F.col("n") > SMALL).drop("n"))).distinct()


def _buckets(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (shingles & np.uint64(BUCKETS - 1)).astype(np.int64), ((shingles >> np.uint64(32)) & np.uint64(BUCKETS - 1)).astype(np.int64) + BUCKETS


def _rarity_levels(texts: DataFrame, words: int) -> np.ndarray:
    """For the buckets of both parts of the hash, the logarithm of how often their shingles occur in ``id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(1)):
                for b in _buckets(shingle_set(text, words)):
                    counts += np.bincount(b, minlength=2 * BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["b", "n"])

    levels = np.zeros(2 * BUCKETS, dtype=np.uint8)
    for b, n in map_arrow(texts, run, "b long, n long").groupBy("b").agg(F.sum("n")).collect():  # at most twice BUCKETS rows
        levels[b] = int(n).bit_length()
    return levels


def _prefixes(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``id, n, at, token``: of each set the rarest shingles, as many as a similar set cannot miss all of."""
    levels = _rarity_levels(texts, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, sizes, places, tokens = [], [], [], [np.empty(0, dtype=np.uint64)]
            for row, text in enumerate(as_bytes(batch.column(1))):
                shingles = shingle_set(text, words)
                n = len(shingles)
                length = n - -(-percent * n // 100) + 1 if n else 0
                one, two = _buckets(shingles)
                tokens.append(shingles[np.lexsort((shingles, np.minimum(levels[one], levels[two])))[:length]])
                taken += [row] * length
                sizes += [n] * length
                places += range(length)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(taken, pa.int64())), pa.array(sizes, pa.int64()), pa.array(places, pa.int64()), pa.array(np.concatenate(tokens).view(np.int64))],
                ["id", "n", "at", "token"],
            )

    schema = T.StructType([texts.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n", "at", "token"))])
    return map_arrow(texts, run, schema)


def _exact_pairs(grouped: DataFrame, source: DataFrame, words: int, percent: int) -> DataFrame:
    """All pairs across groups, among the members of regions, that their sizes and rarest shingles do not rule out."""
    members = cut(grouped.select("id", "component").distinct())
    small = members.count() <= BROADCAST_IDS
    texts = cut(source.join(F.broadcast(members) if small else members, "id", "left_semi").select("id", "text"))
    index = _prefixes(texts, words, percent).distinct().join(F.broadcast(members) if small else members, "id")
    # the members of a group with a word stay together, so that pairs inside a group are never made
    bounds = F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("at")).alias("left")
    lists = index.groupBy("token", "component").agg(F.collect_list(F.struct("id", "n", "at")).alias("m"), *bounds)
    several = lists.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("token")
    lists = cut(lists.join(several, "token", "left_semi"))
    one, two = (lists.select("token", *(F.col(c).alias(f"{c}_{x}") for c in lists.columns if c != "token")) for x in "xy")
    # what no pair of two lists can meet is left out before they are dealt out
    may = (
        (F.col("component_x") < F.col("component_y"))
        & (100 * F.col("most_x") >= percent * F.col("least_y"))
        & (100 * F.col("most_y") >= percent * F.col("least_x"))
        & (F.least("left_x", "left_y") * (100 + percent) >= (F.col("least_x") + F.col("least_y")) * percent)
    )
    met = one.alias("one").join(two.alias("two"), (F.col("one.token") == F.col("two.token")) & may)
    met = met.select(F.explode("m_x").alias("x"), "m_y").select("x", F.explode("m_y").alias("y"))
    n_x, n_y = F.col("x.n"), F.col("y.n")
    in_size = (100 * n_x >= percent * n_y) & (100 * n_y >= percent * n_x)
    ahead = F.least(n_x - F.col("x.at"), n_y - F.col("y.at")) * (100 + percent) >= (n_x + n_y) * percent
    return met.where(in_size & ahead).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


@tidy
def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of word shingles.

    Returns ``<id_col>, n_shingles, component_id, kept`` for every row: the
    smallest id reachable by links, and whether it is the row's own. A-Z is
    lower-cased and words end at ASCII white space. Null texts and texts
    without words have no shingles and no links; a null id has no links, no
    component and is kept. Rows that repeat an id are one node with the links
    of all its rows. Further columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = cut(signatures(source, words))
    classes = cut(
        signed.where("set_key IS NOT NULL AND id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("id").alias("rep"), F.min_by("sig", "id").alias("sig"))
    )
    nodes = classes.select(F.col("rep").alias("id"), "sig")
    copies = signed.join(classes.select("set_key", "rep"), "set_key").where("rep <> id").select(
        F.col("rep").alias("a"), F.col("id").alias("b")
    )
    small, large, deep = forest_regions(nodes)
    first = _pairs(small).union(_stars(deep.where(F.col("t") < FIRST_TREES))).distinct()
    links = _confirmed(_screened(first, nodes, percent), source, words, percent)
    if not large.isEmpty():
        for pairs_of, members in ((_hub_pairs, large), (_rest_pairs, deep)):
            pairs = pairs_of(_grouped(members, links))
            links = cut(links.union(_confirmed(_screened(pairs, nodes, percent), source, words, percent)))
        mixed_regions = cut(_grouped(large, links))
        if not mixed_regions.isEmpty():
            links = cut(links.union(_confirmed(_exact_pairs(mixed_regions, source, words, percent), source, words, percent)))
    groups = connected_components(links.union(copies), "a", "b")
    return signed.join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("component", "id").eqNullSafe(F.col("id"))).alias("kept"),
    )


def distinct_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each group of near duplicates is left: that with the smallest id.

    Every row is a document of its own, also where ids are missing (they come
    last) or repeated (then one of the rows stays). Rows without words, null
    texts among them, are copies of each other: one of them stays. An empty
    table gives an empty result.
    """
    odd = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
    number, rows = id_col, docs
    if not odd.isEmpty():
        # numbers that grow with the ids; they are fixed once the rows are cut
        number = "distinct_documents__row"
        rows = cut(docs.orderBy(F.col(id_col).asc_nulls_last()).withColumn(number, F.monotonically_increasing_id()))
    judged = cut(near_duplicates(rows, words, percent, number, text_col))
    wordless = F.col("n_shingles") == 0
    first = judged.where(wordless).agg(F.min(number)).first()[0]
    gone = judged.where(~F.col("kept") | (wordless & (F.col(number) > F.lit(first))))
    return without_ids(rows, gone, number).select(*(F.col(f"`{c}`") for c in docs.columns))
