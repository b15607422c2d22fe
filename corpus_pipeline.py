"""A training corpus from raw documents: each stage is one operator, written and read before the next.

All stages take any rows: NULL and empty texts hold no line, no benchmark item and no token, and count as good; of
rows that repeat an id and its text one is left by near-dedup; NULL ids are never merged with others; texts are
read whole however long; empty tables stay empty; columns beside those of documents are carried along up to the
last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomshelf.llm.byte_bpe import encode_documents
from loomshelf.llm.common import read, settle
from loomshelf.llm.decontaminate import drop_leaks
from loomshelf.llm.line_dedup import drop_lines
from loomshelf.llm.perplexity import keep_good
from loomshelf.llm.shingle_dedup import keep_one

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is above the bound of their language go."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier one go, and documents that lose every word; ``n_chars`` follows."""
    left = drop_lines(docs)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of texts linked by 0.8 or more of their five-word shingles."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: little-endian unsigned 32-bit integers, and their number."""
    coded = encode_documents(docs.select("doc_id", "lang", "source", "text")).drop("text")
    return coded.withColumn("n_tokens", F.expr("CAST(octet_length(token_ids) / 4 AS BIGINT)"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: The stages score with a model and run tokenizers, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
