"""A training-corpus pipeline: toxic documents go, one of each near-duplicate group stays, personal data is replaced,
what is left is packed. Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from groundwork.llm import ngram_join, packing, pii, toxicity
from groundwork.llm._common import checkpoint_dir, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity model, learnt from their own labels, rejects.

    Each row is judged by its own text: repeated and null doc_ids too. Null and empty texts stay; without labels all do.
    """
    return toxicity.accepted(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 5-word shingles at 0.75.

    Rows are judged, not ids: of rows equal in doc_id and text one stays, two texts under one doc_id are two documents,
    a row without doc_id goes if its text links with another row. Texts without words stay.
    """
    return ngram_join.one_of_each(docs).select(docs.columns)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with surrogates for personal data under the session's key; n_chars follows the new text. Null stays null."""
    out = pii.replace(docs, pii.session_key(spark))
    return out.selectExpr(*(f"cast(char_length(text) as bigint) as `{c}`" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left and their places in sequences of 2048 ids. Null texts are empty, and
    every row is packed, also one that repeats or has no doc_id."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("pii", replace_private), ("packing", pack_rest)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again.

    A stage's folder goes when the next one's rows are written; the last one's stays. Of an empty table nothing is left.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


#: Tokenisation and the trained classifier have no SQL form; a test holds run() and its stages against a plain version.
ORACLE_SQL = None
