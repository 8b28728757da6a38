"""Phrases, similarity components and conversation tries against brute force and on odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, LONG, ODD

from gridloom.llm import common, metric_join, minhash, phrases, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def trie_by_hand(rows, openings):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    built = own
    if openings:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            built[c] = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (
            m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k],
            hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(k)).encode()).hexdigest(),
        )
        for k, m in members.items()
    )


def conversations():
    """Copies, long shared openings, one long conversation, bases that are absent, odd turns."""
    rows = [(c, t, "user" if t % 2 else "system", f"turn {t}") for c in range(100, 150) for t in range(8)]
    rows += [(c, t, "user", f"turn {t % (c % 7 + 1)} of {c % 3}") for c in range(300, 390) for t in range(c % 11)]
    rows += [(700, t, "user", "the same") for t in range(120)] + [(701, t, "user", "the same") for t in range(119)]
    rows += [(c, 0, "user", "only this") for c in range(901, 930)]
    rows += [(5, None, None, None), (5, 2, "a", "é\U0001f600"), (5, 2, "a", "b"), (5, 2, "a", "b"), (None, 1, "x", "y"), (-7, 3, "b", ""), (8, 1, "a:b", "c"), (9, 1, "a", "b:c")]
    return rows


@pytest.mark.parametrize("bucket_rows", [50_000, 60, 1])
@pytest.mark.parametrize("openings", [True, False])
def test_trie_against_brute_force(spark, bucket_rows, openings):
    rows = conversations()
    frame = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit(1)).repartition(3)
    made = prefix_trie.shared_opening_trie if openings else prefix_trie.prefix_trie
    if bucket_rows == 1:  # nothing is built in buckets then: all nodes are chains
        frame = frame.where("conv_id IS NULL OR conv_id < 305")
        rows = [r for r in rows if r[0] is None or r[0] < 305]
    got = sorted(map(tuple, made(frame, bucket_rows=bucket_rows).collect()))
    assert got == trie_by_hand(rows, openings)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(empty).count() == 0 and prefix_trie.shared_opening_trie(empty).count() == 0
    turnless = spark.createDataFrame([(c, 0, "a", "b") for c in (301, 302, 303)], TURNS)
    got = prefix_trie.shared_opening_trie(turnless).collect()
    assert sorted(map(tuple, got)) == trie_by_hand([(c, 0, "a", "b") for c in (301, 302, 303)], True)


def test_ends_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 10)
    frame = spark.range(1000).selectExpr("id % 3 AS rep", "id AS conv")
    got = {r.rep: r.ends for r in prefix_trie.joined_digests(frame).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(k, 1000, 3)).encode()).hexdigest() for k in range(3)}


def phrases_by_hand(rows, max_n, least, percent, top):
    import re

    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(words)
            for n in range(1, max_n + 1):
                for at in range(len(words) - n + 1):
                    counts["und" if lang is None else lang][tuple(words[at : at + n])] += 1
    found = []
    for lang, f in counts.items():
        listed = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [b for q, b in f.items() if len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= percent * a for b in longer):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            listed.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(listed)[:top], 1):
            found.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(found)


def phrase_rows():
    draw = np.random.default_rng(5)
    words = ["the", "The", "of", "new", "york", "city", "a\x01b", "ünï", "x", "of\x00", " ", "san", "josé"]
    rows = []
    for i in range(240):
        picked = draw.choice(words, 40, p=np.array([9, 3, 6, 2, 2, 2, 1, 1, 1, 1, 1, 2, 2]) / 33)
        glue = draw.choice([" ", "\t", "  ", ". ", "\n", "! "], 40, p=[0.7, 0.05, 0.05, 0.1, 0.05, 0.05])
        rows.append((["en", "de", None, "und", ""][i % 5], "".join(w + g for w, g in zip(picked, glue, strict=True))))
    return rows + [("en", None), ("en", ""), ("fr", "the the"), (None, LONG), ("en", "new york city " * 400)]


@pytest.mark.parametrize("max_n", [2, 3, 5])
@pytest.mark.parametrize("bucket_words", [1_000_000, 300])
def test_phrases_against_brute_force(spark, max_n, bucket_words, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 64 if bucket_words < 1000 else 1 << 21)
    rows = phrase_rows()
    frame = spark.createDataFrame(rows, "lang string, text string").withColumn("a", F.lit(0)).repartition(3)
    got = phrases.collocations(frame, max_n=max_n, least=6, top=25, bucket_words=bucket_words).collect()
    assert sorted(map(tuple, got)) == phrases_by_hand(rows, max_n, 6, 50, 25)


def test_words_of_parts(monkeypatch):
    text = ("Été, the CAT\tsat " * 50 + "x" * 300 + "\n\nthe").encode()
    whole = [h for hashes, *_ in phrases.words_of(text, 7) for h in hashes.tolist()]
    monkeypatch.setattr(phrases, "SLICE_BYTES", 16)
    parts = list(phrases.words_of(text, 7))
    assert len(parts) > 10 and [h for hashes, *_ in parts for h in hashes.tolist()] == whole
    assert len(set(whole)) == 5


def test_words_that_share_a_hash_are_noticed(spark, monkeypatch):
    texts = spark.createDataFrame([("en", "one two three two")], "lang string, text string")
    assert phrases.word_counts(texts, 3).where("word <> other").isEmpty()
    starts, stops = np.array([0, 4, 8]), np.array([3, 7, 11])
    part = np.frombuffer(b"one two one", dtype=np.uint8)
    assert phrases._unlike(part, starts, stops, np.array([0, 0, 0])).tolist() == [1]
    assert not len(phrases._unlike(part, starts, stops, np.array([0, 1, 0])))


def test_exact_scores_of_large_counts(spark):
    rows = [("en", [1, 2], 3_000_000_000_001), ("en", [1], 7_000_000_000_003), ("en", [2], 5_000_000_000_001)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, words array<long>, f long"), 50).first()
    assert got.score == 10**6 * rows[0][2] ** 2 // (rows[1][2] * rows[2][2])


def test_phrases_of_nothing(spark, empty_docs):
    assert phrases.collocations(empty_docs).count() == 0
    one = spark.createDataFrame(ODD, DOCS).withColumn("rank", F.lit(1))
    assert phrases.collocations(one, least=1, top=3).where("lang = 'und'").count() == 0  # the null text alone is of no language
    assert {r.lang for r in phrases.collocations(one, least=1, top=3).collect()} == {"en", "fr", "de"}


@pytest.fixture
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def test_bitmaps_rule_nothing_out_that_is_near():
    draw = np.random.default_rng(3)
    for n in (1, 5, 40, 700):
        a = draw.integers(0, 1 << 63, n).astype(np.uint64)
        for size in (n, 3 * n):
            b = np.unique(np.concatenate((a[: n // 2], draw.integers(0, 1 << 63, size).astype(np.uint64))))
            differ = len(np.setxor1d(a, b))
            assert metric_join.apart(metric_join.bitmap(a), metric_join.bitmap(b)) <= differ
            assert metric_join.apart(metric_join.bitmap(b), metric_join.bitmap(b)) == 0


def components_by_hand(rows, words, percent):
    sets = defaultdict(list)
    for i, text in rows:
        if i is not None:
            split = (text or "").lower().split() if (text or "").isascii() else (text or "").split()
            n = min(words, len(split))
            sets[i].append({tuple(split[k : k + n]) for k in range(len(split) - n + 1)} if n else set())
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = group[i], group[j]
                group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    return group


def near_copies(seed, documents, families, length, changed):
    draw = np.random.default_rng(seed)
    bases = [[f"w{draw.integers(0, 5000)}" for _ in range(length)] for _ in range(families)]
    passage = [f"p{k}" for k in range(length // 2)]
    rows = []
    for i in range(documents):
        words = list(bases[i % families])
        for at in draw.integers(0, length, draw.integers(0, changed + 1)):
            words[at] = f"c{draw.integers(0, 40)}"
        rows.append((i + 1, " ".join(words + (passage if i % 4 == 0 else []))))
    return rows


@pytest.mark.parametrize("words,percent", [(5, 80), (1, 60), (3, 90)])
def test_components_against_brute_force(spark, words, percent):
    rows = near_copies(1, 160, 9, 60, 6) + [(900, None), (901, ""), (902, "w1 w2"), (903, "W1  w2"), (904, " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(0)).repartition(4)
    got = {r.doc_id: r.component_id for r in metric_join.similarity_components(frame, words, percent).collect()}
    assert got == components_by_hand(rows, words, percent)


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_components_at_every_level(spark, levels, monkeypatch):
    monkeypatch.setattr(metric_join, "LEVELS", levels)
    monkeypatch.setattr(metric_join, "BROADCAST_IDS", 1)
    rows = near_copies(2, 140, 2, 80, 9)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in metric_join.similarity_components(frame).collect()}
    assert got == components_by_hand(rows, 5, 80)


def test_shingles_of_a_batch_are_those_of_each_text():
    long = "x" * 500
    texts = [None, "", " \t", "A b", "a\x0bB", f"{long} y z w v u", f"{long}x y z w v u", "\u00c9t\u00e9 \x1c a", "a b c d e A B C D E a b c d e", "", "one two three four five six"] * 9
    data = [t.encode() if t is not None else None for t in texts]
    for words in (1, 3, 5):
        got = common.shingle_sets(data, words)
        assert [len(g) for g in got] == [len(minhash.shingle_set(t, words)) for t in data]
        assert all(np.array_equal(g, common.shingle_sets([t], words)[0]) and np.array_equal(g, np.unique(g)) for g, t in zip(got, data, strict=True))
        assert np.array_equal(got[3], got[4]) and not len(np.intersect1d(got[5][:1], got[6][:1]))


def test_bitmaps_rule_out_near_copies_beyond_the_threshold():
    """Three quarters in common are too few for a link of 0.8; copies of a hot text are like that in masses."""
    draw = np.random.default_rng(6)
    base = draw.integers(0, 1 << 63, 575).astype(np.uint64)
    for _ in range(50):
        taken = draw.permutation(base)
        a, b = taken[:500], taken[75:]
        assert metric_join.apart(metric_join.bitmap(a), metric_join.bitmap(b)) * 180 > 20 * (len(a) + len(b))


def test_components_of_odd_rows(spark, empty_docs):
    rows = [r[:2] for r in ODD]
    got = metric_join.similarity_components(spark.createDataFrame(ODD, DOCS).repartition(3)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].component_id is None and by_id[None].n_shingles == 3
    assert (by_id[4].component_id, by_id[7].component_id, by_id[2].component_id, by_id[2].n_shingles) == (1, 6, 2, 0)
    assert metric_join.similarity_components(empty_docs).count() == 0
    bridge = [(1, "a b c d e f"), (2, "u v w x y z"), (3, "a b c d e f"), (3, "u v w x y z")]
    got = metric_join.similarity_components(spark.createDataFrame(bridge, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}
