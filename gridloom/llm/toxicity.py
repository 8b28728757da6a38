"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over the words and word beginnings that labelled
examples show to go with the label. The examples form an inverted index in
blocks; for each feature and block it keeps the greatest weight, so the
nearest examples by exact cosine are found block by block in order of their
upper bounds, and blocks that cannot reach the k-th best are never opened.
The votes of the neighbours, weighted by closeness, are calibrated on the
examples themselves, each with itself left out.

The examples are a bounded sample of the labelled rows (``EXAMPLES``), and
so bound the vocabulary: every word or beginning among them that goes with the
label beyond chance is a feature. Words that do not are left out because they
drown the label: over all words of the examples the nearest ones share a
language and a subject, not toxicity. Document frequencies count all
documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import map_arrow
from gridloom.llm.decontaminate import words_of
from gridloom.llm.tokens import Remembered
from gridloom.plans.durable import cut

#: Labelled rows that the index is made of, at most; taken by hash of their id.
EXAMPLES = 16_384
#: The G statistic and toxic examples that a feature needs.
LEAST_G, LEAST_TOXIC = 20.0, 3
#: How many times the odds of being toxic of all examples those with a feature have to have.
LEAST_ODDS = 4.0
#: Examples with features whose calibration counts as much as the plain vote, and its weight with very many.
CALIBRATION_EXAMPLES, CALIBRATION = 5, 0.9
#: Lengths of the word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6)
NEIGHBOURS, BLOCK = 15, 64
#: Every FOLDS-th id by checksum is held out.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; not those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features_of(word: bytes) -> list[str]:
    text = word.decode(errors="replace")
    return [text, *(f"{text[:n]}*" for n in BEGINNINGS if len(text) >= n)]


def plain_words(text: str | None) -> list[bytes]:
    return words_of(text.lower().encode()) if text else []


def g_statistic(toxic: int, seen: int, all_toxic: int, total: int) -> float:
    """Log-likelihood ratio of a feature against the label; negative if it is rarer among toxic examples."""
    g = 0.0
    for observed, expected in (
        (toxic, seen * all_toxic / total),
        (seen - toxic, seen * (total - all_toxic) / total),
        (all_toxic - toxic, (total - seen) * all_toxic / total),
        (total - seen - all_toxic + toxic, (total - seen) * (total - all_toxic) / total),
    ):
        if observed > 0 and expected > 0:
            g += 2 * observed * math.log(observed / expected)
    return g if toxic * total > seen * all_toxic else -g


@dataclass
class Vocabulary:
    """Numbers of the features, with a memory of what each word stands for."""

    numbers: dict[str, int]
    memory: Remembered | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"numbers": self.numbers, "memory": None}

    def _of(self, word: bytes) -> tuple:
        return tuple(self.numbers[f] for f in features_of(word) if f in self.numbers)

    def of(self, word: bytes) -> tuple:
        if self.memory is None:
            self.memory = Remembered(self._of, 50_000)
        return self.memory[word]

    def counts(self, text: str | None) -> Counter:
        """How often each feature occurs in a text."""
        found: Counter = Counter()
        if self.numbers and text:
            self.of(b"")
            for numbers in filter(None, map(self.memory.__getitem__, plain_words(text))):
                found.update(numbers)
        return found


class BlockMaxIndex:
    """Unit vectors of examples as postings in blocks, with the greatest weight of each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list, n_features: int):
        self.labels, self.ids = labels, ids
        self.blocks = -(-len(vectors) // BLOCK)
        by_feature: list[list[tuple[int, float]]] = [[] for _ in range(n_features)]
        for row, (numbers, weights) in enumerate(vectors):
            for f, w in zip(numbers, weights, strict=True):
                by_feature[f].append((row, w))
        self.rows, self.weights, self.starts = [], [], []
        self.greatest = np.zeros((n_features, self.blocks), dtype=np.float64)
        for f, postings in enumerate(by_feature):
            rows = np.array([r for r, _ in postings], dtype=np.int64)
            weights = np.array([w for _, w in postings], dtype=np.float64)
            self.rows.append(rows)
            self.weights.append(weights)
            self.starts.append(np.searchsorted(rows, np.arange(self.blocks + 1) * BLOCK))
            np.maximum.at(self.greatest[f], rows // BLOCK, weights)

    def nearest(self, numbers: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the ``k`` nearest examples with a positive cosine, ties by row."""
        bounds = weights @ self.greatest[numbers] if self.blocks else np.empty(0)
        best_rows, best = np.empty(0, dtype=np.int64), np.empty(0)
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or (len(best) == k and bounds[block] < best[-1] - 1e-12):
                break
            scores = np.zeros(BLOCK)
            for f, w in zip(numbers, weights, strict=True):
                low, high = self.starts[f][block], self.starts[f][block + 1]
                scores[self.rows[f][low:high] - block * BLOCK] += w * self.weights[f][low:high]
            if block * BLOCK <= without < (block + 1) * BLOCK:
                scores[without - block * BLOCK] = 0
            there = np.flatnonzero(scores > 0)
            rows, cosines = np.concatenate([best_rows, there + block * BLOCK]), np.concatenate([best, scores[there]])
            order = np.lexsort((rows, -np.round(cosines, 12)))[:k]
            best_rows, best = rows[order], cosines[order]
        return best_rows, best


def pool_adjacent(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit: knots of the monotone step curve of ``y`` over ``x``."""
    order = np.argsort(x, kind="stable")
    stack: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        stack.append([a, b, 1.0])
        while len(stack) > 1 and stack[-2][1] >= stack[-1][1]:
            _, value, n = stack.pop()
            top = stack[-1]
            top[1], top[2] = (top[1] * top[2] + value * n) / (top[2] + n), top[2] + n
    return np.array([s[0] for s in stack]), np.array([s[1] for s in stack])


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    idf: np.ndarray
    index: BlockMaxIndex
    bare: float
    prior: float
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        numbers = np.array(sorted(counts), dtype=np.int64)
        weights = (1 + np.log([counts[f] for f in numbers])) * self.idf[numbers]
        return numbers, weights / np.sqrt((weights**2).sum())

    def vote(self, counts: Counter, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        rows, cosines = self.index.nearest(*self.vector(counts), NEIGHBOURS, without)
        return float((cosines @ self.index.labels[rows] + self.prior) / (cosines.sum() + 1)), rows, cosines

    def score(self, text: str | None) -> tuple[float, list[tuple]]:
        """Calibrated score and the neighbours it rests on: (id, cosine, label)."""
        counts = self.vocabulary.counts(text)
        if not counts:
            return self.bare, []
        vote, rows, cosines = self.vote(counts)
        score = vote
        if self.knots is not None:
            n = len(self.index.ids)
            weight = CALIBRATION * n / (n + CALIBRATION_EXAMPLES)
            score = weight * float(np.interp(vote, *self.knots)) + (1 - weight) * vote
        evidence = [(self.index.ids[r], float(c), int(self.index.labels[r])) for r, c in zip(rows, cosines, strict=True)]
        return min(1.0, max(0.0, score)), evidence


def _feature_counts(examples: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {f for word in set(plain_words(text)) for f in features_of(word)}
                seen.update(found)
                if label:
                    toxic.update(found)
        names = list(toxic)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([seen[n] for n in names], pa.int64())],
            ["feature", "toxic", "seen"],
        )
        rest = [n for n in seen if n not in toxic]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([seen[n] for n in rest], pa.int64())],
            ["feature", "toxic", "seen"],
        )

    counted = map_arrow(examples.select("text", "label"), run, "feature string, toxic long, seen long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("seen").alias("seen"))


def _independent(rows: DataFrame, leading: list, toxic: int, total: int) -> Vocabulary:
    """The features whose toxic examples are more than copies of each other.

    A word of a copied passage comes after the same word wherever it occurs,
    so a feature counts as many toxic examples as it has different words
    before it there, at most.
    """
    looked_at = Vocabulary({r["feature"]: i for i, r in enumerate(leading)})
    shared = rows.sparkSession.sparkContext.broadcast(looked_at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column(0).to_pylist():
                words = plain_words(text)
                for before, word in zip([b"", *words], words, strict=False):
                    found.update((f, before) for f in shared.value.of(word))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in found], pa.int64()), pa.array([w for _, w in found], pa.binary())], ["f", "before"]
            )

    pairs = map_arrow(rows.where("label = 1").select("text"), run, "f long, before binary").distinct()
    contexts = dict(pairs.groupBy("f").count().collect())  # one row per feature looked at
    rated = []
    for i, r in enumerate(leading):
        hits = min(r["toxic"], contexts.get(i, 0))
        g = g_statistic(hits, hits + r["seen"] - r["toxic"], toxic, total)
        telling = hits * (total - toxic) >= LEAST_ODDS * toxic * (r["seen"] - r["toxic"])
        if hits >= LEAST_TOXIC and g >= LEAST_G and telling:
            rated.append((-g, r["feature"]))
    return Vocabulary({f: i for i, (_, f) in enumerate(sorted(rated))})


def _document_frequencies(docs: DataFrame, text_col: str, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature occurs, and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = len(vocabulary.numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            counts[size] += batch.num_rows
            for text in batch.column(0).to_pylist():
                for f in shared.value.counts(text):
                    counts[f] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(counts)], ["f", "n"])

    summed = map_arrow(docs.select(text_col), run, "f long, n long").groupBy("f").agg(F.sum("n"))
    counts = np.zeros(size + 1, dtype=np.int64)
    for f, n in summed.collect():  # one row per feature
        counts[f] = n
    return counts[:size], int(counts[size])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> ToxicityModel:
    """Learn from at most ``examples`` labelled rows outside the held-out fold."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(examples)
    )
    rows = cut(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "id")
        .groupBy("id", "label")
        .agg(F.max("text").alias("text"))
    )
    total, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    # what _independent asks of a feature is harder, so nothing that it would take is lost
    strong = _feature_counts(rows).where(F.col("toxic") >= LEAST_TOXIC).where(
        F.col("toxic") * (total - toxic) >= F.lit(LEAST_ODDS * toxic) * (F.col("seen") - F.col("toxic"))
    )
    leading = strong.orderBy("feature").collect()  # of the words of `examples` texts
    vocabulary = _independent(rows, leading, toxic, total)
    frequency, n_docs = _document_frequencies(docs, text_col, vocabulary)
    idf = np.log((n_docs + 1) / (frequency + 1)) + 1

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [shared.value.counts(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([list(c.keys()) for c in counts], pa.list_(pa.int64())),
                    pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
                ],
                ["id", "label", "features", "counts"],
            )

    schema = T.StructType(
        [*rows.schema.fields[:2], T.StructField("features", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))]
    )
    got = sorted(map_arrow(rows.select("id", "label", "text"), run, schema).collect(), key=lambda r: r[0])  # at most `examples`
    held = [(r[0], r[1], Counter(dict(zip(r[2], r[3], strict=True)))) for r in got if r[2]]
    bare = [r[1] for r in got if not r[2]]
    model = ToxicityModel(vocabulary, idf, None, (sum(bare) + 0.5) / (len(bare) + 2), toxic / total if total else 0.0)
    vectors = [model.vector(c) for _, _, c in held]
    labels_of = np.array([y for _, y, _ in held], dtype=np.float64)
    model.index = BlockMaxIndex(vectors, labels_of, [i for i, _, _ in held], len(vocabulary.numbers))
    if held:
        votes = np.array([model.vote(c, without=row)[0] for row, (_, _, c) in enumerate(held)])
        model.knots = pool_adjacent(votes, labels_of)
    return model


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """Score every whole text.

    Returns ``<id_col>, held_out, score, predicted, evidence`` for each row;
    evidence lists the neighbours with cosine and label. Texts without any
    feature, null and empty ones among them, get the share of toxic labels
    among such examples. Only the text is an input of the score. Further
    columns are ignored.
    """
    return _scored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, 1, explain=True).select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "evidence",
    )


def reject_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below the threshold."""
    scored = _scored(docs, model, docs.columns.index(text_col), name="toxicity__score")
    return scored.where(F.col("toxicity__score") < threshold).drop("toxicity__score")


def _scored(source: DataFrame, model: ToxicityModel, at: int, name: str = "score", explain: bool = False) -> DataFrame:
    """All columns of ``source``, of which ``at`` is the text, then the score; to explain, the first column, score and evidence."""
    shared = source.sparkSession.sparkContext.broadcast(model)
    kind = source.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [shared.value.score(text) for text in batch.column(at).to_pylist()]
            arrays = list(batch.columns)
            if explain:
                arrays = [batch.column(0)]
            arrays.append(pa.array([s for s, _ in results], pa.float64()))
            if explain:
                item = pa.struct([("id", batch.schema.field(0).type), ("cosine", pa.float64()), ("label", pa.int32())])
                arrays.append(pa.array([[dict(id=i, cosine=c, label=y) for i, c, y in e] for _, e in results], pa.list_(item)))
            yield pa.RecordBatch.from_arrays(arrays, names)

    fields = [source.schema[0]] if explain else list(source.schema.fields)
    fields.append(T.StructField(name, T.DoubleType()))
    if explain:
        item = T.StructType([T.StructField("id", kind), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())])
        fields.append(T.StructField("evidence", T.ArrayType(item)))
    names = [f.name for f in fields]
    return map_arrow(source, run, T.StructType(fields))
