"""From raw documents to packed training sequences.

Each stage takes what the one before it kept and, but for the last, returns
the columns of ``documents``. The driver may write and reread the result of
each; :func:`run` does so in the shared checkpoint folder.

Every stage judges rows, not ids: rows with a null or repeated id are
documents like any other. An empty table passes through all stages, further
columns are carried along whatever their names, except that the last stage
returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table
from gridloom.llm.decontaminate import clean_documents
from gridloom.llm.line_dedup import without_repeated_lines
from gridloom.llm.minhash import distinct_documents
from gridloom.llm.packing import pack_documents
from gridloom.llm.toxicity import fit_toxicity, reject_toxic
from gridloom.plans.durable import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores below one half.

    Null and empty texts score like examples without any telling word.
    """
    return reject_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that an earlier line is equal or similar to.

    A null text stays null, a text that loses all lines becomes empty, and
    ``n_chars`` follows the text where it is not null.
    """
    cleaned = without_repeated_lines(docs)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        n_chars = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
        columns[docs.columns.index("n_chars")] = n_chars.alias("n_chars")
    return cleaned.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8), that with the smallest id.

    Texts without words, to which line dedup brings copies, are one group.
    """
    return distinct_documents(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of which less than a twentieth is benchmark text; texts without words are never contaminated."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 4096 tokens; a null or empty text is its end token."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Toxicity and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result does not depend on the tables written between them."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as folder:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
