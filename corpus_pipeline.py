"""A corpus pipeline: language, near duplicates, benchmark passages, secrets, packing.

Each stage takes the documents that its predecessor kept and returns documents with all their columns; the last returns where
each piece of a document stands in the packed sequences.  All stages read texts whole, carry extra columns of any name, give no
rows for an empty table, and run on rows with null or repeated ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantlake.llm import decontaminate, jaccard, language, packing, runtime, secrets


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language rank-order profiles tell; those without a letter, or with no n-gram that a profile ranks near, go.

    So null and empty texts go.  Each row is judged by itself, whatever its doc_id; where no row has a lang, nothing is
    learned and every row goes.
    """
    return language.keep(docs, language.learn(language.training_rows(docs)))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that shingle similarity links, the one of the smallest doc_id, null being the largest.

    Each row is a document of its own: rows that share an id but not a text both stay, repeated rows leave one.  Texts
    without words, null or not, are linked with nothing and stay.
    """
    return jaccard.distinct_documents(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts have none, and an empty benchmark has none either."""
    return decontaminate.clean(docs, runtime.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts, overlapping ones as one; null texts stay null."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 4096 tokens; a null text is an end token alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", with_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Language profiles, tokens and packing have no form in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = runtime.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
