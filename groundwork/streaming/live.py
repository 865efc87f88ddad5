"""Structured Streaming: claims and citations of responses as they arrive, and windowed quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import factual, strip_markers
from ..operators import citations, claims
from ..options import CiteOptions


def segment_stream(responses: DataFrame, granularity: str = "sentence") -> DataFrame:
    """Claims of a stream of responses(response_id, response), without state; numbered by segment."""
    cut = claims.split(responses, granularity).withColumn("text", F.expr(strip_markers("segment"))).where("text <> ''")
    return cut.select("response_id", "seg_seq", "text", "start", "end", F.expr(factual("text")).alias("is_factual"))


def citation_stream(responses: DataFrame, options: CiteOptions = CiteOptions()) -> DataFrame:
    return citations.parse(responses, options)


def windowed_quality(scores: DataFrame, ts: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Averages of scores(ts, grounding, accuracy, quality) by window, for a stream or a table."""
    held = scores.withWatermark(ts, late)
    return held.groupBy(F.window(ts, width)).agg(F.avg("grounding").alias("grounding"), F.avg("accuracy").alias("accuracy"), F.avg("quality").alias("quality"), F.count("*").alias("n"))
