"""Token counts by a two-tier lookup next to the scan.

Texts are cut into pre-tokens by the tokenizer's own pattern, which never joins
two of them, so a text's ids are those of its pre-tokens in a row. Lengths of frequent
pre-tokens come from a broadcast table of bounded size; the rest is encoded
once per worker and remembered there in a bounded cache. No pre-token is
shuffled: the frequent ones are found by Misra-Gries summaries, one per task,
merged in a tree.
"""

from __future__ import annotations

import json
import re
import struct
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import default_tokenizer, map_arrow
from gridloom.llm.exact_dedup import misra_gries

#: Pre-tokens in the broadcast table, and the longest that may be in it (bytes): 4 MB at most.
FREQUENT, FREQUENT_BYTES = 32_768, 64
#: Pre-tokens that a worker remembers, twice.
REMEMBERED = 250_000

#: All but the characters for which Python's lower() and the classes below agree with the tokenizer's and NFC changes nothing.
UNSAFE = re.compile("[^\t\n\r\x20-\x7e¡-¬®-įı-ſ‐-‧‰-⁞]")
#: The pattern below for these characters, lower-cased: letters, single numerals, anything else but white space.
_LETTERS, _NUMERALS = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼½¾"
PRETOKEN = re.compile(f"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMERALS}]|[^\\s{_LETTERS}{_NUMERALS}]+")
#: The one pipeline of normaliser and pattern for which texts may be cut beforehand.
SPLITTABLE = (["NFC", "Replace", "Lowercase"], "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")


def splittable(spec: dict) -> bool:
    """Does this tokenizer work on each match of the known pattern by itself?"""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [s["type"] for s in steps] != SPLITTABLE[0] or len(parts) != 2 or parts[1]["type"] != "ByteLevel":
        return False
    return (
        steps[1]["pattern"] == {"Regex": "\\s+"}
        and parts[0]["type"] == "Split"
        and parts[0]["pattern"] == {"Regex": SPLITTABLE[1]}
        and parts[0]["behavior"] == "Removed"
        and parts[0]["invert"]
        and not parts[1]["use_regex"]
        and not parts[1]["add_prefix_space"]
        and all("<|" in t["content"] for t in spec.get("added_tokens", []))
    )


class Remembered(dict):
    """Values of pre-tokens, computed on first sight; the last one or two generations are kept."""

    def __init__(self, compute, limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """A tokenizer file in memory: ``.json`` for tokenizers, ``.model`` for sentencepiece.

    No begin, end or added special tokens, no truncation, no padding; special
    strings inside texts are handled as the library does by default.
    """

    def __init__(self, blob: bytes, kind: str):
        self.kind, self.split = kind, False
        if kind == ".model":
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_str(blob.decode())
            self.model.no_truncation()
            self.model.no_padding()
            self.split = splittable(json.loads(blob))
        self.ids_of = Remembered(self.part_ids)
        self.lengths: Lengths | None = None

    def encode(self, text: str) -> list[int]:
        if self.kind == ".model":
            return self.model.encode(text, num_threads=1)
        return self.model.encode(text, add_special_tokens=False).ids

    def parts(self, text: str) -> list[str] | None:
        """The pre-tokens of a text, or None if it has to be encoded in one piece."""
        if not self.split or "<|" in text or UNSAFE.search(text):
            return None
        return PRETOKEN.findall(text.lower())

    def part_ids(self, part: str) -> bytes:
        ids = self.encode(part)
        return struct.pack(f"<{len(ids)}I", *ids)

    def id_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        parts = self.parts(text)
        if parts is None:
            return np.array(self.encode(text), dtype="<u4").tobytes()
        return b"".join(map(self.ids_of.__getitem__, parts))


class Lengths(Remembered):
    """Two tiers: frequent pre-tokens from the broadcast table, others through the worker's memory."""

    def __init__(self, encoder: Encoder, frequent: dict[str, int]):
        super().__init__(lambda part: frequent.get(part) or len(encoder.encode(part)))
        self.update(frequent)
        self.limit += len(frequent)


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def worker_encoder(blob: bytes, kind: str) -> Encoder:
    """The encoder of this worker process; made once."""
    key = (xxhash.xxh3_64_intdigest(blob), kind)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(blob, kind)
    return _ENCODERS[key]


def load(path: str) -> tuple[bytes, str]:
    return Path(path).read_bytes(), Path(path).suffix


def frequent_pretokens(docs: DataFrame, text_col: str, blob: bytes, kind: str, counters: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of all texts, at most ``counters``.

    A summary holds ``counters`` entries wherever it is, so neither a task nor
    the driver holds more however many texts there are. A wrong choice would
    cost time only.
    """
    if not splittable_blob(blob, kind):
        return []
    shared = docs.sparkSession.sparkContext.broadcast(blob)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = worker_encoder(shared.value, kind), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                parts = encoder.parts(text) if text else None
                if parts:
                    seen.update(parts)
            if len(seen) > 8 * counters:
                seen = misra_gries(seen, counters)
        seen = misra_gries(seen, counters)
        packed = json.dumps({k: n for k, n in seen.items() if len(k.encode()) <= FREQUENT_BYTES}).encode()
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["summary"])

    summaries = map_arrow(docs.select(text_col), summarise, "summary binary").rdd.map(lambda row: Counter(json.loads(bytes(row[0]))))
    merged = summaries.treeAggregate(Counter(), *[lambda a, b: misra_gries(a + b, counters)] * 2, depth=3)
    return [part for part, _ in merged.most_common(counters)]


def splittable_blob(blob: bytes, kind: str) -> bool:
    return kind == ".json" and splittable(json.loads(blob))


def token_counts(
    docs: DataFrame,
    tokenizer: str | None = None,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Bytes and tokens of every whole text.

    Returns ``<id_col>, n_bytes, n_tokens, over_limit`` for each row, rows
    repeated in the input included. A null text counts as empty (no tokens), a
    null id stays null, further columns are ignored, an empty table gives an
    empty result. Texts with characters for which cutting beforehand is
    not proven equal go through the library in one piece.
    """
    blob, kind = load(tokenizer or default_tokenizer())
    context = docs.sparkSession.sparkContext
    encoder = Encoder(blob, kind)
    frequent = {part: len(encoder.encode(part)) for part in frequent_pretokens(docs, text_col, blob, kind)}
    table, file = context.broadcast(frequent), context.broadcast(blob)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(file.value, kind)
        if encoder.lengths is None:
            encoder.lengths = Lengths(encoder, table.value)
        length = encoder.lengths.__getitem__
        for batch in batches:
            counts = []
            for text in batch.column(1).to_pylist():
                parts = encoder.parts(text) if text else []
                counts.append(len(encoder.encode(text)) if parts is None else sum(map(length, parts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    schema = T.StructType([source.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return map_arrow(source, count, schema).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
