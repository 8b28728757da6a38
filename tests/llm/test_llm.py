"""Text operators: edge cases, brute force, exact round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF, assert_same
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import common, decontaminate, exact_dedup, html_extract, line_dedup, minhash, packing, queries, sharding, tokens, toxicity, warc
from gridloom.llm.common import default_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} of{i}" for i in range(6000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog\nand then it sleeps until noon", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "The quick brown fox jumps over the lazy dog\nand then it sleeps until noon", "en", "b", 1),
    (4, "The quick brown fox jumps over the lazy dog\nand then it sleeps until noon", "en", "b", 1),
    (None, "no id here but some more words\n\n \t\n", "fr", None, 5),
    (6, LONG, "de", "c", len(LONG)),
    (7, LONG + " tail", "de", "c", len(LONG)),
    (8, "ünïcödé ÉTÉ <|endoftext|> it's  ½ 漢字 \U0001f600 é", "fr", "d", 9),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(name, spark, duck):
    assert_same(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, duck)


def test_exact_dedup(spark, odd, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(odd.withColumn("digest", F.lit(1))).collect()}
    assert len(got) == 8
    assert (got[1].keep_id, got[1].group_size, got[1].kept) == (4, 3, False)
    assert (got[2].keep_id, got[3].keep_id, got[3].group_size) == (3, 3, 2)
    assert (got[None].keep_id, got[None].kept) == (None, False)
    assert got[3].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_misra_gries_finds_the_frequent(spark):
    values = [b"a"] * 300 + [b"b"] * 200 + [str(i).encode() for i in range(500)]
    frame = spark.createDataFrame([(bytearray(v),) for v in values], "key binary").repartition(5)
    found = {bytes(r.key) for r in exact_dedup.frequent_candidates(frame, "key", counters=12).collect()}
    assert {b"a", b"b"} <= found and len(found) <= 12


def minimax(sizes, shards):
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        middle, used, fill = (low + high) // 2, 1, 0
        for s in sizes:
            if fill + s > middle:
                used, fill = used + 1, 0
            fill += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_sharding_is_minimax(spark, shards):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shard_documents(docs, shards).toPandas()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    groups = Counter()
    for doc, size in zip(got.doc_id, got["size"], strict=True):
        groups[hashlib.sha256(text[doc].encode()).hexdigest()] += size
    assert got.groupby("shard")["size"].sum().max() == minimax([groups[k] for k in sorted(groups)], shards)
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    assert (got.text_crc32 == [zlib.crc32(text[d].encode()) for d in got.doc_id]).all()
    assert all(len(set(g)) == 1 for _, g in got.groupby(got.doc_id.map(text)).shard)


def test_sharding_edges(odd, empty):
    got = sharding.shard_documents(odd, 4).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if r.doc_id in (2, 3)} == {8}
    assert sharding.shard_documents(empty).count() == 0


def reference_ids(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(default_tokenizer())
    return [model.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pretokens_give_the_library_ids():
    encoder = tokens.Encoder(*tokens.load(default_tokenizer()))
    texts = [t for _, t, *_ in ODD if t] + ["don't I'LL we've ...,;:--x_y", "a b\x1cc ŒUVRE Straße 12³45", "İstanbul ΣΑΣ ’quoted’"]
    for text, ids in zip(texts, reference_ids(texts), strict=True):
        assert np.frombuffer(encoder.id_bytes(text), dtype="<u4").tolist() == ids


def test_token_counts(odd, empty):
    got = tokens.token_counts(odd, limit=10).collect()
    expected = Counter((i, len(ids)) for (i, *_), ids in zip(ODD, reference_ids([r[1] for r in ODD]), strict=True))
    assert Counter((r.doc_id, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 10) for r in got)
    assert tokens.token_counts(empty).count() == 0


def test_packing_places_every_id(odd, empty):
    got = packing.pack_documents(odd).toPandas()
    ids = {r[0]: np.array(i + [2], dtype="<u4") for r, i in zip(ODD, reference_ids([r[1] for r in ODD]), strict=True)}
    for piece in got.itertuples():
        whole = ids[None if piece.doc_id != piece.doc_id else int(piece.doc_id)]
        assert zlib.crc32(whole[piece.start : piece.start + piece.length].tobytes()) == piece.ids_crc32
        assert len(whole) == piece.doc_tokens
    assert got.length.sum() == sum(len(ids[r[0]]) for r in ODD)
    for _, sequence in got.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert sequence.offset.tolist() == [0, *np.cumsum(sequence.length)[:-1]] and sequence.length.sum() <= 4096
    assert packing.pack_documents(empty).count() == 0


def test_packing_pads_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    used = packing.pack_documents(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()
    assert len(used) == -(-int(used.n.sum()) // 4096)  # no packing has fewer sequences


@pytest.mark.parametrize("cell_rows", [1, 7, 10_000])
def test_numbers_are_gapless(spark, cell_rows):
    frame = spark.range(500).selectExpr("id", "cast(if(id % 3 = 0, 0, id % 40) as int) as g", "id % 60 as o").repartition(5)
    got = common.numbered(frame, ["g"], ["o"], "nr", 180, cell_rows).toPandas()
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("g").nr) and len(got) == 500


def test_token_counts_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    expected = Counter((r.doc_id, len(ids)) for r, ids in zip(rows, reference_ids([r.text for r in rows]), strict=True))
    assert Counter((r.doc_id, r.n_tokens) for r in tokens.token_counts(docs).collect()) == expected


def test_closest_fill_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        counts = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 40), 5, replace=False), rng.integers(1, 4, 5), strict=True)}
        capacity = int(rng.integers(1, 90))
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= capacity}
        chosen = packing.closest_fill(sorted(counts, reverse=True), counts, capacity)
        assert sum(k * n for k, n in chosen.items()) == max(sums)
        assert all(n <= counts[k] for k, n in chosen.items())
        used = Counter()
        for times, pieces in packing.fill_bins(counts, 40):
            assert sum(k * n for k, n in pieces.items()) <= 40
            used.update({k: times * n for k, n in pieces.items()})
        assert used == Counter(counts)


def test_decontamination_paths_agree(spark, odd):
    items = [(1, "brown fox JUMPS over the lazy"), (2, None), (3, ""), (None, "fox"), (5, " ".join(f"word{i % 977} of{i}" for i in range(40, 80))), (5, "noon")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    by_broadcast = decontaminate.decontaminate(odd, benchmark).collect()
    by_shuffle = decontaminate.decontaminate(odd, benchmark, broadcast_bytes=0).collect()
    assert Counter(map(tuple, by_broadcast)) == Counter(map(tuple, by_shuffle))
    got = {r.doc_id: r for r in by_broadcast}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (15, 7, 2, True)
    assert (got[2].n_words, got[2].n_hit, got[2].contaminated) == (0, 0, False)
    assert (got[6].n_hit, got[6].contaminated) == (80, False)
    assert got[1].items_sha256 == hashlib.sha256(b"1,5").hexdigest()


def plain_decontamination(docs, items, window=13):
    """By all windows of all items, as the contract has it."""
    out = []
    windows = {}
    for item, text in items:
        words = decontaminate.words_of(text.encode()) if text is not None and item is not None else []
        n = min(window, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            windows.setdefault(n, {}).setdefault(tuple(words[at : at + n]), set()).add(item)
    for doc, text in docs:
        words, hit, found = decontaminate.words_of(text.encode() if text else None), set(), set()
        for n, grams in windows.items():
            for at in range(len(words) - n + 1):
                got = grams.get(tuple(words[at : at + n]))
                if got:
                    found |= got
                    hit.update(range(at, at + n))
        out.append((doc, len(words), len(hit), len(found), decontaminate.items_digest(found), bool(hit) and 20 * len(hit) >= len(words)))
    return Counter(out)


@pytest.mark.parametrize("hash_bits", [2, 64])  # of two bits most hashes are equal by chance
@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 24])
def test_decontamination_against_brute_force(spark, hash_bits, broadcast_bytes):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(25)] + [(3, "w1 w2"), (90, None), (91, ""), (None, "w1")]
    docs = [(i, " ".join([*rng.choice(words, rng.integers(0, 60)), *(items[i % 25][1].split()[: rng.integers(1, 30)]), *rng.choice(words, rng.integers(0, 9))])) for i in range(60)]
    docs += [(1, docs[4][1]), (None, docs[5][1]), (70, None), (71, " .. ")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, decontaminate__n string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = plain_decontamination(docs, items)
    got = Counter(tuple(r) for r in decontaminate.decontaminate(frame, benchmark, hash_bits=hash_bits, broadcast_bytes=broadcast_bytes).collect())
    assert got == expected
    clean = decontaminate.clean_documents(frame, benchmark, hash_bits=hash_bits, broadcast_bytes=broadcast_bytes)
    texts = dict(docs)
    assert clean.columns == frame.columns
    verdicts = {(d, t): [r for r in plain_decontamination([(d, t)], items)][0][-1] for d, t in docs}
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(k for k in docs if not verdicts[k]) and texts


def test_winnowing_keeps_a_place_of_every_run():
    rng = np.random.default_rng(5)
    for n in (0, 3, 6, 7, 50):
        grams = rng.integers(0, 9, n).astype(np.uint64)
        expected = sorted({at + int(np.argmin(grams[at : at + 7])) for at in range(n - 6)}) if n >= 7 else []
        assert decontaminate.winnow(grams, 7).tolist() == expected


def test_decontamination_without_rows(odd, empty):
    assert decontaminate.decontaminate(empty, odd.selectExpr("doc_id as item_id", "text")).count() == 0
    assert not any(r.n_items for r in decontaminate.decontaminate(odd, empty.selectExpr("doc_id as item_id", "text")).collect())


def brute_components(rows, words, percent):
    sets = {i: minhash.shingle_set(t.encode() if t is not None else None, words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    names = sorted(sets)
    for k, a in enumerate(names):
        for b in names[:k]:
            if minhash.similar(sets[a], sets[b], percent):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in names}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, words, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words, percent).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], words, percent)


def test_near_duplicates_in_a_large_group(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_duplicates_of_large_regions_are_whole(spark, monkeypatch):
    # regions so shallow that nearly all documents share large ones, with few rounds that find links there
    monkeypatch.setattr(minhash, "HUBS", 1)
    monkeypatch.setattr(minhash, "FIRST_TREES", 0)
    monkeypatch.setattr(minhash, "DEPTHS", (1, 24))
    rng = np.random.default_rng(9)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(100):
        words = list(base)
        for at in (i % 10 * 12 + 3, i % 10 * 12 + 7, *rng.choice(120, rng.integers(0, 3), replace=False)):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, f"{text} end") for i, text in rows[:3]] + [(i, rows[i][1]) for i in (0, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == brute_components(dict(rows).items(), 3, 85)


def test_near_duplicates_in_a_group_of_many(spark):
    # 1,000 copies that drift apart, so that links run along them
    rng = np.random.default_rng(11)
    words, rows = [f"w{i}" for i in range(90)], []
    for i in range(1000):
        at = int(rng.integers(0, 90))
        words[at] = f"x{i}"
        own = list(words)
        for k in rng.choice(90, rng.integers(0, 2), replace=False):
            own[k] = f"y{i}_{k}"
        rows.append((i, " ".join(own)))
        if i % 40 == 39:
            words = [f"w{k}" for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_distinct_documents_of_odd_ids(spark, odd, empty):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (None, text + " a"), (5, other), (5, text + " b"), (5, text + " b"), (9, other), (None, None), (9, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int").repartition(3)
    got = minhash.distinct_documents(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(5, text + " b"), (5, other), (9, "")])
    assert minhash.distinct_documents(docs.where("doc_id = 9")).count() == 2
    assert minhash.distinct_documents(empty).count() == 0
    plain = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash.distinct_documents(plain).collect()) == [0, 2, 6]


def test_near_duplicates_edges(odd, empty):
    got = [tuple(r) for r in minhash.near_duplicates(odd, 3, 85).collect()]
    assert len(got) == len(ODD)
    by_id = {r[0]: r for r in got}
    assert by_id[4][2] == 1 and by_id[7][2] == 6 and by_id[2][1:] == (0, 2, True) and by_id[None][2:] == (None, True)
    assert minhash.near_duplicates(empty).count() == 0


def test_line_dedup_edges(spark, odd, empty):
    got = line_dedup.dedup_lines(odd.withColumn("n", F.lit(1)).withColumn("kept", F.lit(2))).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].text == ODD[0][1] and by_id[4].text == "" and by_id[4].n_removed == 2
    assert by_id[2].text is None and by_id[3].text == "" and by_id[7].n_removed == 1
    assert by_id[None].text == ODD[5][1] and by_id[1].kept == 2
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_odd_rows(spark):
    rows = [("b", "one two\tthree four\r\nLes.\n", 7, "x"), ("a", "Four  three two one\n \nles.", 7, "x"), (None, "LES.", 7, "x"), ("c", None, None, None), ("c", "", 7, "x")]
    docs = spark.createDataFrame(rows, "name string, body string, n_lines int, left string").repartition(3)
    out = line_dedup.dedup_lines(docs, "name", "body")
    assert out.columns == ["name", "body", "left", "n_lines", "n_removed"]
    got = {(r.name, r.body, r.n_lines, r.n_removed) for r in out.collect()}
    assert got == {("b", "", 3, 2), ("a", "Four  three two one\n ", 3, 1), (None, "LES.", 1, 0), ("c", None, 0, 0), ("c", "", 1, 0)}


def test_line_dedup_of_rows_that_share_an_id(spark):
    """Texts of one id are told apart whole; of these two 31 bits of a hash are equal."""
    texts = [f"row number {k}\nsecond line of {k} with words {k * 3}" for k in (64106, 177235)]
    more = [f"alpha{k} beta{k} gamma{k}\nx{k} y{k} z{k}" for k in range(40)]
    rows = [(None, t) for t in texts + more] + [(7, t.upper() + " seven") for t in texts] + [(None, texts[0])]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    kept = [r for r in got if r.doc_id is None]
    assert len(got) == len(rows) and min(r.n_removed for r in got) == 0
    assert Counter(r.text for r in kept) == Counter(texts + more + [texts[0]])


def test_line_dedup_of_a_hot_line(spark):
    words = [f"w{i}" for i in range(12)]
    rows = [(i, "\n".join([" ".join(words), " ".join(words[: 10 + i % 3]), f"only {i} here at all", "yes"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0] == f"{' '.join(words)}\nonly 0 here at all\nyes" and all(got[i] == f"only {i} here at all" for i in range(1, 400))


def test_line_dedup_of_a_cluster(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(30)]
    lines = []
    for i in range(120):
        line = list(words)
        for at in rng.choice(30, rng.integers(0, 6), replace=False):
            line[at] = f"x{i}_{at}"
        lines.append((i, " ".join(line)))
    docs = spark.createDataFrame(lines, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    sets = [set(t.split()) for _, t in lines]
    for i, own in enumerate(sets):
        gone = any(5 * len(own & s) >= 4 * len(own | s) for s in sets[:i])
        assert (got[i] == "") == gone


def test_line_dedup_pairs_of_a_cluster_and_a_passage(spark, monkeypatch):
    """Pairs whose texts are compared grow with the lines of a cluster or of a passage, not with their square."""
    rng = np.random.default_rng(9)
    words, passage = [f"w{i}" for i in range(40)], [f"p{i}" for i in range(45)]
    lines = [" ".join(f"x{i}_{at}" if rng.random() < 0.07 else w for at, w in enumerate(words)) for i in range(300)]
    lines += [" ".join(passage + [f"y{i}_{k}" for k in range(8)]) for i in range(300)]
    pairs, removed = [], line_dedup._removed

    def counted(met, texts):
        pairs.append(met.count())
        return removed(met, texts)

    monkeypatch.setattr(line_dedup, "_removed", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    sets = [set(t.split()) for t in lines]
    for i, own in enumerate(sets):
        assert (got[i] == "") == any(5 * len(own & s) >= 4 * len(own | s) for s in sets[:i])
    assert sum(pairs) < 12 * len(lines)


def test_line_dedup_of_short_lines(spark):
    rng = np.random.default_rng(8)
    lines = [" ".join(f"w{k}" for k in rng.integers(0, 7, rng.integers(1, 8))) for _ in range(400)] + ["Les.", "les.", "", "", " "]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    sets = [set(t.lower().split()) for t in lines]
    gone = [bool(own) and any(5 * len(own & s) >= 4 * len(own | s) for s in sets[:i]) for i, own in enumerate(sets)]
    for out in (line_dedup.dedup_lines(docs), corpus_pipeline.drop_repeated_lines(spark, docs, SF)):
        got = {r.doc_id: r.text for r in out.collect()}
        assert [got[i] for i in range(len(lines))] == ["" if g else t for t, g in zip(lines, gone, strict=True)]


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in scored) >= 0.93 * len(scored)


def test_toxicity_edges(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, None), (None, 1, 1), (4, 0, 1), (4, 0, 0)], none.schema)
    for labels in (none, some):
        model = toxicity.fit_toxicity(odd, labels)
        got = toxicity.score_toxicity(odd, model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.score_toxicity(empty, model).count() == 0
        assert toxicity.reject_toxic(odd.select("doc_id", "text"), model).columns == ["doc_id", "text"]


def test_block_max_search_is_exact():
    rng = np.random.default_rng(8)
    dense = rng.random((300, 12)) * (rng.random((300, 12)) < 0.3)
    dense = dense[dense.any(axis=1)]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    index = toxicity.BlockMaxIndex([(np.flatnonzero(r), r[r > 0]) for r in dense], np.zeros(len(dense)), list(range(len(dense))), 12)
    for row in dense[:40]:
        rows, cosines = index.nearest(np.flatnonzero(row), row[row > 0], 7)
        assert np.allclose(cosines, np.sort(dense @ row)[::-1][:7])
        assert np.allclose(dense[rows] @ row, cosines)


def test_toxicity_scores_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    names, texts = model.vocabulary.numbers, {r.doc_id: r.text for r in docs.collect()}
    toxic = {}
    for r in labels.collect():
        if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            toxic[r.doc_id] = max(r.toxic, toxic.get(r.doc_id, 0))
    examples = sorted(i for i in toxic if i in texts)

    def found(text):
        return Counter(names[f] for w in toxicity.plain_words(text) for f in toxicity.features_of(w) if f in names)

    frequency = Counter(f for t in texts.values() for f in found(t))
    idf = np.log((len(texts) + 1) / (np.array([frequency[f] for f in range(len(names))]) + 1)) + 1

    def dense(text):
        counts = found(text)
        vector = np.array([1 + np.log(counts[f]) if counts[f] else 0 for f in range(len(names))]) * idf
        return vector / (np.linalg.norm(vector) or 1)

    rows = np.array([dense(texts[i]) for i in examples])
    marks = np.array([toxic[i] for i in examples], dtype=float)
    bare = ~rows.any(axis=1)
    prior = marks.mean()

    def vote(vector, without=None):
        cosines = rows @ vector
        if without is not None:
            cosines[without] = 0
        best = sorted((k for k in range(len(rows)) if cosines[k] > 0), key=lambda k: (-round(cosines[k], 12), k))[: toxicity.NEIGHBOURS]
        return (cosines[best] @ marks[best] + prior) / (cosines[best].sum() + 1)

    own = [k for k in range(len(rows)) if not bare[k]]
    knots = toxicity.pool_adjacent(np.array([vote(rows[k], k) for k in own]), marks[own])
    weight = toxicity.CALIBRATION * len(own) / (len(own) + toxicity.CALIBRATION_EXAMPLES)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    for i, text in texts.items():
        vector = dense(text)
        plain = vote(vector) if vector.any() else None
        expected = (marks[bare].sum() + 0.5) / (bare.sum() + 2) if plain is None else weight * np.interp(plain, *knots) + (1 - weight) * plain
        assert np.isclose(scores[i], expected), i


def test_toxicity_takes_every_telling_word(spark):
    # a hundred words, each in a hundredth of the toxic texts
    rng = np.random.default_rng(2)
    rows = []
    for i in range(12000):
        words = [f"w{k}" for k in rng.integers(0, 3000, 12)]
        bad = i % 10 == 0
        if bad:
            words.insert(int(rng.integers(0, 12)), f"q{i // 10 % 100:02d}z")
        rows.append((i, " ".join(words), int(bad)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(frame, frame)
    assert {f"q{k:02d}z" for k in range(100)} <= set(model.vocabulary.numbers)
    scored = {r.doc_id: r for r in toxicity.score_toxicity(frame, model).collect()}
    held = [r for r in rows if scored[r[0]].held_out]
    assert sum(scored[i].predicted == y for i, _, y in held) >= 0.99 * len(held)


def test_html_blocks():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><a>menu</a></nav><div class='cookie-notice'>ok?</div>"
        "<article><h1>Head &amp; line</h1><p>one <b>two</b><br>three<p>caf&eacute; &#x263a;\n\n  four<div class='share'>tweet</div>"
        "<section id=comments><p>rude</p></section><script>var x='<p>no</p>';</script></article><aside>more</aside><footer>&copy;</footer>"
    )
    assert html_extract.extract(page) == "Head & line one two three café ☺ four"
    assert html_extract.extract("") == ""
    assert html_extract.extract("plain < text <b") == "plain < text"


def test_html_names_spare_the_text():
    for page in (
        "<html class=search><body class='no-sidebar widget'><p>text</p></body></html>",
        "<body><div class='content with-banner'><p>text</p></div></body>",
        "<body><article class='post has-comments'>text</article></body>",
        "<body><article id='notice-12'>text</article></body>",
        "<body><div id=top class=widget><main class=search>text<div class=share>tweet</div></main></div></body>",
        "<body><span class=promo><article class=notice>text</article></span></body>",
        "<body><article>text<div id=comments><article class=comment>rude</article></div></article></body>",
        "<body><article class=notice>text<div id=comments><article class=comment>rude</article></div></article></body>",
        "<body><article>text</article><div class=related><article>more</article></div></body>",
        "<body><div class='cookie_notice'>ok?</div><div class='social-share'>tweet</div><p>text</p></body>",
    ):
        assert html_extract.extract(page) == "text", page


def test_style_tree_removes_what_a_site_repeats(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div><p>Same words on all pages</p></div><div><section><p>Story {i} of its own</p></section></div>") for i in range(12)]
    pages += [(90, None, None), (91, "", "<p>alone</p>"), (91, "", "<p>alone</p>")]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 of its own" and got[90] == "" and got[91] == "alone"


def test_style_tree_acts_on_declared_articles(spark):
    page = (
        "<body><div class=strap>All the news</div><div class=byline>By writer {0}</div>"
        "<article><p>Story {0} of its own</p><div class=about>Our paper was founded long ago</div></article></body>"
    )
    pages = [(i, f"http://h.example/{i}", page.format(i)) for i in range(12)]
    pages += [(100 + i, "http://copies.example/", page.format(7)) for i in range(12)] + [(200, "http://few.example/", page.format(1))]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "By writer 3 Story 3 of its own"
    assert got[105] == "Story 7 of its own Our paper was founded long ago" and got[200] == "Story 1 of its own Our paper was founded long ago"


def test_html_of_odd_pages():
    for page, text in (
        ('<body class="has-sidebar comments-open"><article><p>hello world</p></article></body>', "hello world"),
        ('<article class="post widget-area related"><p>hello world</p></article>', "hello world"),
        ('<article><p>a</p><svg viewBox="0"/><p>b</p><p>c</p></article>', "a b c"),
        ("<article><p>a</p><iframe><p>b</p><title><p>c</p></article>", "a b c"),
        ('<article><p class="alert">mind</p><p>x <math><mi>y</mi></math></p></article>', "mind x y"),
        ("<body><div><h1>Headline</h1><article><p>text</p></article></div></body>", "Headline text"),
        ("<p>a<script>b", "a"),
    ):
        assert html_extract.extract(page) == text, page


def test_html_of_deep_pages():
    import time
    import tracemalloc

    for page in ("<div>" * 100_000 + "text", "<b class=x><p>" * 60_000 + "</i></b>" * 60_000 + "text", "<div class=ad>" * 50_000 + "</p></table>" * 50_000 + "</div>" * 50_000 + "text"):
        tracemalloc.start()
        began = time.process_time()
        assert html_extract.extract(page) == "text"
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 600 * len(page) and time.process_time() - began < 30


def plain_importance(pages):
    """Composite importances by the definition, from the pages' blocks and layouts."""
    import math

    seen = {}
    for page in set(pages):
        blocks, layouts, _ = html_extract.parse_page(page)
        for node, kind, value in {(b.node, "text", b.text) for b in blocks} | {(n, "layout", x) for n, x in layouts}:
            seen.setdefault(node, {}).setdefault(kind, Counter())[value] += 1
    out = {}
    for node, kinds in seen.items():
        layouts = kinds.get("layout", Counter())
        total = sum(layouts.values())
        m = max(total, 2)
        if "text" in kinds:
            entropies = [-sum(1 / n * math.log(1 / n, m) for _ in range(n)) for n in kinds["text"].values()]
            out[node] = (1 - sum(entropies) / len(entropies), total)
        else:
            own = -sum(n / total * math.log(n / total, m) for n in layouts.values())
            weight = html_extract.DAMPING ** len(layouts)
            out[node] = ((1 - weight) * own + weight, total)
    return out


def test_importance_by_definition(spark):
    rng = np.random.default_rng(3)
    pages = []
    for i in range(40):
        body = f"<nav>m</nav><div class=x>stock {rng.integers(5)}</div><div><h2>title {i}</h2>" + "".join(f"<p>text {i} {k}</p>" for k in range(rng.integers(0, 4)))
        pages.append((f"http://h{i % 2}.example/", f"<body>{body}</div>" + ("<ul><li>a<li>b</ul>" if i % 3 else "")))
    pages += pages[:3]
    frame = spark.createDataFrame(pages, "url string, html string").repartition(3)
    counts = html_extract.page_features(frame.select(html_extract.host_of(F.col("url")).alias("host"), "html"))
    tree = html_extract.style_tree(counts, "host").collect()
    for host in ("h0.example", "h1.example"):
        expected = plain_importance([h for u, h in pages if host in u])
        got = {r.path: (r.importance, r.pages) for r in tree if r.host == host}
        assert got.keys() == expected.keys()
        assert all(np.allclose(got[k], expected[k]) for k in got)


def test_style_tree_without_declarations(spark, monkeypatch):
    # pages of the tables without the tag of the article and without any list of words: what is left is the tree's work
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    expected = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    plain = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article>", "<div class=x>"), "</article>", "</div>"))
    monkeypatch.setattr(html_extract, "NOISE_WORDS", frozenset())
    monkeypatch.setattr(html_extract, "OUTER_NOISE_WORDS", frozenset())
    rows = [(r.host, r.html, r.page_id) for r in plain.select(html_extract.host_of(F.col("url")).alias("host"), "html", "page_id").collect()]
    counts = Counter()
    for host, source, page in {r[:2]: r for r in rows}.values():
        blocks, layouts, _ = html_extract.parse_page(source)
        counts.update({(host, b.node, 0, hash(b.text)) for b in blocks} | {(host, n, 1, hash(x)) for n, x in layouts})
    frame = spark.createDataFrame([(*k, n) for k, n in counts.items()], "host string, path long, kind int, key long, n long")
    verdicts = {r.host: html_extract.Verdicts(*(frozenset(x) for x in (r.low, r.repeated, r.own))) for r in html_extract.judged_nodes(frame).collect()}
    none = html_extract.Verdicts()
    alike = sum(html_extract.extract(source, verdicts.get(host, none)) == expected[page] for host, source, page in rows)
    by_no_tree = sum(html_extract.extract(source) == expected[page] for _, source, page in rows)
    assert alike == len(rows) and by_no_tree == 0


def test_html_of_an_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.main_text(none).count() == 0
    odd = spark.createDataFrame([(None, None, None, 1, "x"), (None, "u", "<p>a", 1, "x"), (None, "u", "<p>a", 1, "x")], "nr long, link string, body string, host int, text string")
    got = html_extract.main_text(odd, "nr", "link", "body").collect()
    assert sorted((r.link or "", r.text) for r in got) == [("", ""), ("u", "a"), ("u", "a")]


def test_html_on_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r, text in [(r, t.text) for r, t in zip(pages.orderBy("page_id").collect(), html_extract.main_text(pages).orderBy("page_id").collect(), strict=True)]:
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.DOTALL)[1]
        import html

        assert text == " ".join(html.unescape(re.sub(r"<[a-zA-Z/!][^>]*(>|\Z)", " ", inside)).split())


def test_warc_roundtrip(spark, tmp_path):
    big = "x" * 150
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "é" * 60
    pages = [(3, "http://a/b?c", big), (1, "http://a/ d\r\ne", big), (2, None, None), (5, "u", tricky), (None, "http://n", "short"), (7, "http://s", "short"), (1, "http://a", big)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.archive_pages(frame).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    expected = {(i, "revisit" if i == 3 else "response", 1 if i == 3 else None, len((t or "").encode()), sha(t)) for i, _, t in pages}
    assert got == expected
    warc.write_warc(frame, f"file://{tmp_path}/archive")
    captures = warc.assemble_captures(warc.read_warc(spark, f"file://{tmp_path}/archive")).collect()
    assert len(captures) == len(pages)
    assert all(c.request and c.response and c.metadata and c.response.intact for c in captures)
    assert {bytes(c.response.payload).decode() for c in captures if c.response.kind == "response"} == {big, "", tricky, "short"}
    assert warc.archive_pages(frame.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 1, 1000])
def test_warc_hot_payloads(spark, broadcast_rows):
    pages = [(i, f"http://h/{i}", "<p>hot</p>" * 20 if i % 3 else f"<p>{i % 7} twice</p>" * 15) for i in range(60, 0, -1)] + [(99, None, "tiny")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in warc.archive_pages(frame, broadcast_rows=broadcast_rows).collect()}
    first = {}
    for i, _, text in sorted(pages):
        first.setdefault(text, i)
    assert len(got) == len(pages)
    for i, _, text in pages:
        assert got[i].refers_to == (None if first[text] == i else first[text]) and got[i].payload_bytes == len(text)


def test_warc_revisits_name_their_response(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"http://h/{i}", "<p>same</p>" * 30) for i in range(5)], "page_id long, url string, html string")
    warc.write_warc(frame, f"file://{tmp_path}/archive")
    rows = warc.read_warc(spark, f"file://{tmp_path}/archive").collect()
    response = {r.record_id for r in rows if r.kind == "response"}
    assert len(response) == 1 and {r.refers for r in rows if r.kind == "revisit"} == response


def test_warc_malformed_records(spark, tmp_path):
    import gzip

    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <%d>\r\nContent-Length: 4\r\n\r\nWARC\r\n\r\n"
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: many\r\n\r\nbody\r\n\r\n"
    nameless = b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    whole = b"junk WARC/\r\n" + good % 1 + bad + nameless + good % 2 + (good % 3)[:-9]
    member = gzip.compress(good % 4)
    files = {"plain": whole, "zip": gzip.compress(whole), "members": member + gzip.compress(good % 5), "cut": member + member[:-20], "torn": member + b"\x1f\x8bnothing", "empty": b""}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = Counter(r.record_id for r in warc.read_warc(spark, f"file://{tmp_path}").collect())
    assert found == {"<1>": 2, "<2>": 2, "<4>": 3, "<5>": 1}
    for size in (1, 7, 1000):
        pieces = [whole[at : at + size] for at in range(0, len(whole), size)]
        assert [f["warc-record-id"] for f, b in warc.parse_records(pieces) if b] == ["<1>", "<2>"]


def test_warc_of_long_urls(spark):
    """Headers of any length, within and across the pieces in which a file is read."""
    sizes = [10, 60_000, 100_000, 300_000, 1 << 20, 2_000_000]
    frame = spark.createDataFrame([(i, f"http://h/{i}/" + "u" * n, f"<p>{i}</p>" * 30) for i, n in enumerate(sizes)], "page_id long, url string, html string")
    got = warc.archive_pages(frame.coalesce(1)).collect()
    assert sorted(r.page_id for r in got) == list(range(len(sizes))) and {r.record_type for r in got} == {"response"}
    for n in (60_000, 100_000, 2_000_000):
        records = [x for i in range(10) for x in warc.capture_records(f"n{i}", str(i), "http://h/" + "u" * n, "body", "d", None, False)]
        whole = "\r\n".join(records).encode() + b"\r\n"
        assert len(list(warc.parse_records([whole[at : at + warc.CHUNK] for at in range(0, len(whole), warc.CHUNK)]))) == 30


def test_warc_of_a_long_payload(spark):
    frame = spark.createDataFrame([(1, "u", "é<p>" * 6_000_000), (2, "u", "é<p>" * 6_000_000)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(frame).collect()}
    assert got == {1: (30_000_000, "response", None), 2: (30_000_000, "revisit", 1)}


def test_pipeline(spark):
    docs, sf = spark.read.parquet(f"{SF}/documents.parquet"), SF
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == columns
        kept = {r.doc_id for r in out.collect()}
        assert kept <= seen
        docs, seen = spark.createDataFrame(out.collect(), docs.schema), kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in last.collect()} == seen
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(
        map(tuple, last.select("doc_id", "start", "length", "ids_crc32").collect())
    )


STAGE_FUNCTIONS = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="session")
def stage_tables(spark, tmp_path_factory):
    """A folder with labels that mark ``vile`` and a benchmark of one item."""
    folder = str(tmp_path_factory.mktemp("stage"))
    marked = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    item = spark.createDataFrame([(1, " ".join(f"exam{k}" for k in range(20))), (None, "x"), (2, None)], "item_id long, text string")
    marked.write.parquet(f"{folder}/labels.parquet")
    item.write.parquet(f"{folder}/benchmark.parquet")
    return folder


def stage_rows():
    """Rows with ids of all kinds and columns that clash with names inside the operators."""
    rng = np.random.default_rng(12)
    item = " ".join(f"exam{k}" for k in range(20))
    rows = []
    for i in range(200):
        words = [f"v{k}" for k in rng.integers(0, 4000, 40)]
        if i % 2:
            words[int(rng.integers(1, 39))] = "vile"
        rows.append((i, " ".join(words)))
    near = " ".join(f"n{k}" for k in range(80))
    rows += [(300, f"{near}\n\nsome lines of this text"), (301, f"{near} more\nsome lines of this text"), (None, near + " still more"), (300, "shares its id")]
    rows += [(None, f"{item} without id"), (302, item), (302, "clean and " + " ".join(f"c{k}" for k in range(30))), (None, None), (303, None), (304, ""), (305, LONG), (305, LONG)]
    return [(i, t, "en", None, len(t) if t else None, i, "k", 1) for i, t in rows]


CLASHING = f"{DOCS}, id long, `key` string, n_lines int"


@pytest.mark.parametrize("name", list(STAGE_FUNCTIONS))
def test_stage_edges(spark, stage_tables, name):
    rows = stage_rows()
    docs = spark.createDataFrame(rows, CLASHING).repartition(3)
    out = STAGE_FUNCTIONS[name](spark, docs, stage_tables)
    nothing = STAGE_FUNCTIONS[name](spark, docs.limit(0), stage_tables)
    assert nothing.count() == 0 and nothing.columns == out.columns
    if name == "packing":
        pieces = Counter(r.doc_id for r in out.collect() if r.start == 0)
        assert pieces == Counter(r[0] for r in rows)
        return
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    pairs = Counter((r[0], r[1]) for r in rows)
    if name == "toxicity":
        assert got == Counter({k: n for k, n in pairs.items() if "vile" not in (k[1] or "").split()})
    elif name == "decontamination":
        texts = [(k, k[1]) for k in pairs]
        bad = {r[0] for r in plain_decontamination(texts, [(1, " ".join(f"exam{k}" for k in range(20)))]) if r[-1]}
        assert len(bad) == 2 and got == Counter({k: n for k, n in pairs.items() if k not in bad})
    elif name == "minhash_near_dedup":
        keyed = sorted(((i is None, i or 0, k), t) for k, (i, t, *_) in enumerate(rows))
        groups = brute_components([(k, t) for k, (_, t) in enumerate(keyed)], 5, 80)
        wordless = [k for k in sorted(groups) if not (keyed[k][1] or "").split()]
        kept = [rows[keyed[k][0][2]][:2] for k in groups if groups[k] == k and k not in wordless[1:]]
        assert got == Counter(kept)
    else:
        seen, expected = [], []
        for at in sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0)):
            left = []
            for line in rows[at][1].split("\n") if rows[at][1] is not None else []:
                own = set(line.lower().split())
                if not any(own and 5 * len(own & s) >= 4 * len(own | s) for s in seen):
                    left.append(line)
                seen.append(own)
            expected.append((rows[at][0], None if rows[at][1] is None else "\n".join(left)))
        # rows that repeat an id come in the order of a hash, and equal ones count as one
        plain = {300, 302, 305, None}
        assert {k: n for k, n in got.items() if k[0] not in plain} == {k: n for k, n in Counter(expected).items() if k[0] not in plain}
        assert got[(305, LONG)] == 2 and sum(got.values()) == len(rows)


def test_stages_against_brute_force(spark):
    """Each stage of the pipeline on what the one before kept of the table, against plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    frame = STAGE_FUNCTIONS["line_dedup"](spark, docs, SF)
    seen, expected = [], {}
    for i in sorted(rows):
        left = []
        for line in rows[i].split("\n") if rows[i] is not None else []:
            own = frozenset(line.lower().split())
            if not any(own and 5 * len(own & s) >= 4 * len(own | s) for s in seen):
                left.append(line)
            seen.append(own)
        expected[i] = None if rows[i] is None else "\n".join(left)
    rows = {r.doc_id: r.text for r in frame.collect()}
    assert rows == expected
    frame = spark.createDataFrame(frame.collect(), docs.schema)
    near = STAGE_FUNCTIONS["minhash_near_dedup"](spark, frame, SF)
    groups, before = brute_components(rows.items(), 5, 80), rows
    rows = {r.doc_id: r.text for r in near.collect()}
    wordless = sorted(i for i in groups if not (before[i] or "").split())
    assert set(rows) == {i for i in groups if groups[i] == i} - set(wordless[1:])
    clean = STAGE_FUNCTIONS["decontamination"](spark, spark.createDataFrame(near.collect(), docs.schema), SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in plain_decontamination(rows.items(), items) if not r[-1]}
