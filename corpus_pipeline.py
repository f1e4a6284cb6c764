"""The cleaning of a text corpus, from raw documents to packed sequences.

Each stage reads what the one before has written and returns the columns of documents, but
for the last, which returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from forecourt.llm import line_dedup, packing, quality, simhash, suffix_dedup
from forecourt.workspace import fresh_dir, remove, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The tokenizer file whose vocabulary the packed sequences use.
TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's record reject go."""
    return quality.filtered(docs)


def duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; so do documents of which nothing is left."""
    return line_dedup.deduplicated(docs, n_chars="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more are cut out."""
    return suffix_dedup.without_copies(docs, n_chars="n_chars")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, tokenised and packed."""
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        vocabulary = file.read()
    return packing.pack_documents(docs, vocabulary, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", duplicate_lines),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packed_sequences),
]

#: SQL cannot say how bins are filled; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each on what the one before has written to the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name.replace(" ", "_"))
        with scratch(spark):  # what the stage has written on its way goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
