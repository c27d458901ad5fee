"""A training corpus from documents: language, near duplicates, private data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and
reads again for the next one. All but the last return the columns of documents, whatever further
ones these have. Every stage works on whole texts, however long, and keeps an empty table empty.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixspan.llm import jaccard, langid, packing, pii
from helixspan.llm.common import stage, table


#: Rows of an Arrow batch, which are whole texts: what a task holds of them outside the heap, in the JVM and in Python.
BATCH_ROWS = 1000
#: A task's cache of encoded pieces: workers also hold what the stages before have left.
CACHE_BYTES = 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows; a stage's plan is made after its function has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null, no letters, or hardly any likelihood).

    Null ids, languages and sources don't matter; repeated rows stay or go together.
    """
    small_batches(spark)
    return langid.keep_known(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group, as one row.

    Documents without a doc_id go if another one of their group stays; rows of one doc_id are one document.
    """
    small_batches(spark)
    return jaccard.one_of_each(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces private values by format-preserving pseudonyms; every row stays, null texts stay null, n_chars follows the text."""
    small_batches(spark)
    return pii.pseudonymise_column(docs, pii.session_key(spark))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into training sequences, sources by their sizes to the power 0.7; null texts are empty, null sources a queue, repeated rows separate documents."""
    small_batches(spark)
    return packing.pack(docs, temperature=0.7, cache_bytes=CACHE_BYTES)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("sequences", sequences),
]

#: Tokenisation and language scores can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
