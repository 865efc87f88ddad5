"""Readers and adapters that give tables the engine's shape."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METADATA = "struct<title: string, author: string, year: string, url: string>"


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Any of Spark's formats."""
    return spark.read.format(kind).options(**options).load(path)


def exploded_sources(responses: DataFrame, column: str = "sources") -> DataFrame:
    """sources(response_id, source_pos, …) from an array of structs in each response; positions count from 1."""
    out = responses.select("response_id", F.posexplode(column).alias("p", "s"))
    return out.select("response_id", (F.col("p") + 1).alias("source_pos"), "s.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def benchmark_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(response_id, response, grp): every benchmark passage as a response, to be judged by one group of documents."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("response_id"), F.col("text").alias("response"), F.expr("concat('src', item_id % 20)").alias("grp"))


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, source_pos, source_id, content): documents in the order of their ids within their source. Places are
    counted over ids alone; texts meet them by a join, so that no text is sorted with all others of its source."""
    docs = table(spark, sf_dir, "documents")
    pos = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    places = docs.select("source", "doc_id", pos.alias("source_pos"))
    own = docs.select("source", "doc_id", F.col("text").alias("content")).join(places, ["source", "doc_id"])
    return own.select(F.col("source").alias("grp"), "source_pos", F.col("doc_id").cast("string").alias("source_id"), "content")


def passage_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(response_id, response, corpus_id): benchmark passages, some with changed words, that cite by number."""
    text = "rtrim('.', case item_id % 3 when 1 then replace(text, 'th', 't') when 2 then replace(text, ' the', ' la bo') else text end)"
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("response_id"), F.expr(f"concat({text}, ' [', item_id % 4 + 1, '].')").alias("response"), F.expr("item_id % 20").alias("corpus_id"))


def passage_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, source_pos, source_id, content): benchmark passages as the sources of the responses made of them."""
    pos = F.row_number().over(Window.partitionBy(F.expr("item_id % 20")).orderBy("item_id"))
    return table(spark, sf_dir, "benchmark").select(F.expr("item_id % 20").alias("corpus_id"), pos.alias("source_pos"), F.expr("concat('p', item_id)").alias("source_id"), F.col("text").alias("content"))


def written(df: DataFrame) -> DataFrame:
    """df written once to the shared folder that spark.checkpoint.dir names, its lineage cut; where that is unset and the
    driver is the only machine (tests), to a temporary one."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="groundwork-"))
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()
