"""Citations to claims, verification states, and the scores of each response."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import CiteOptions

#: UTF-16 units after a claim in which a citation still counts as its own, if it has no other.
SLACK = 5


def attach(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """(response_id, claim_idx, cit_idx): citations that start within a claim, or, for claims without any, up to
    SLACK after it. One citation can belong to two claims."""
    c = claims.select("response_id", "claim_idx", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    k = citations.select("response_id", "cit_idx", F.col("start").alias("k_start"))
    near = c.join(k, "response_id").where(f"k_start >= c_start and k_start <= c_end + {SLACK}").withColumn("inside", F.expr("k_start < c_end"))
    any_inside = F.max("inside").over(Window.partitionBy("response_id", "claim_idx"))
    return near.withColumn("_any", any_inside).where("inside or not _any").select("response_id", "claim_idx", "cit_idx")


def verify(claims: DataFrame, citations: DataFrame, scores: DataFrame, options: CiteOptions = CiteOptions()) -> DataFrame:
    """(response_id, claim_idx, cit_idx, id, resolved_id, state, cited_confidence, correct_sources) for every citation
    of a factual claim; citations have resolved_id."""
    t = options.attribution_threshold
    links = attach(claims, citations).join(claims.where("is_factual").select("response_id", "claim_idx"), ["response_id", "claim_idx"], "left_semi")
    links = links.join(citations.select("response_id", "cit_idx", "id", "resolved_id"), ["response_id", "cit_idx"])
    above = scores.where(F.col("confidence") >= t).groupBy("response_id", "claim_idx").agg(F.expr("transform(array_sort(collect_list(struct(rank, source_id, confidence))), x -> struct(x.source_id as source_id, x.confidence as confidence))").alias("_above"))
    cited = scores.groupBy("response_id", "claim_idx", F.col("source_id").alias("resolved_id")).agg(F.min_by("confidence", "rank").alias("cited_confidence"))
    out = links.join(above, ["response_id", "claim_idx"], "left").join(cited, ["response_id", "claim_idx", "resolved_id"], "left")
    state = f"case when resolved_id is null then 'phantom' when cited_confidence >= {t!r}D then 'verified' when _above is not null then 'misattributed' else 'unsupported' end"
    out = out.withColumn("state", F.expr(state))
    correct = F.when(F.col("state").isin("phantom", "misattributed"), F.col("_above"))
    return out.select("response_id", "claim_idx", "cit_idx", "id", "resolved_id", "state", "cited_confidence", correct.alias("correct_sources"))


def claim_reports(claims: DataFrame, citations: DataFrame, scores: DataFrame, options: CiteOptions = CiteOptions()) -> DataFrame:
    """claims with is_grounded, has_citations and the primary attribution (source and confidence)."""
    best = scores.where((F.col("rank") == 1) & (F.col("confidence") >= options.attribution_threshold))
    best = best.select("response_id", "claim_idx", F.col("source_id").alias("primary_id"), F.col("confidence").alias("primary_confidence"))
    cited = attach(claims, citations).select("response_id", "claim_idx").distinct().withColumn("has_citations", F.lit(True))
    out = claims.join(best, ["response_id", "claim_idx"], "left").join(cited, ["response_id", "claim_idx"], "left")
    return out.withColumn("is_grounded", F.expr("is_factual and primary_confidence is not null")).withColumn("has_citations", F.coalesce("has_citations", F.lit(False)))


def response_scores(responses: DataFrame, reports: DataFrame, verifications: DataFrame, citations: DataFrame, options: CiteOptions = CiteOptions()) -> DataFrame:
    """One row per response: grounding, accuracy (null without verifications), coverage, faithfulness, quality and
    counts. Responses without claims have zeros."""
    facts = reports.where("is_factual").groupBy("response_id").agg(
        F.count("*").alias("claim_count"), F.count_if(F.col("is_grounded")).alias("_g"), F.count_if(F.col("is_grounded") | F.col("has_citations")).alias("_c")
    )
    checked = verifications.groupBy("response_id").agg(
        F.count("*").alias("_v"), F.count_if(F.expr("state = 'verified'")).alias("_ok"), F.expr("avg(cited_confidence) filter (where state = 'verified')").alias("_f"),
        F.count_if(F.expr("state = 'misattributed'")).alias("misattributed_count"), F.count_if(F.expr("state = 'phantom'")).alias("phantom_count"),
        F.count_if(F.expr("state = 'unsupported'")).alias("unsupported_count"),
    )
    parsed = citations.groupBy("response_id").agg(F.count("*").alias("citation_count"))
    out = responses.select("response_id").join(facts, "response_id", "left").join(checked, "response_id", "left").join(parsed, "response_id", "left")
    counts = ["claim_count", "citation_count", "misattributed_count", "phantom_count", "unsupported_count"]
    out = out.fillna(0, [*counts, "_g", "_c", "_v", "_ok"])
    out = out.withColumn("grounding", F.expr("coalesce(try_divide(double(_g), claim_count), 0D)")).withColumn("coverage", F.expr("coalesce(try_divide(double(_c), claim_count), 0D)"))
    out = out.withColumn("accuracy", F.expr("try_divide(double(_ok), nullif(_v, 0))")).withColumn("faithfulness", F.expr("coalesce(_f, grounding)"))
    w = {k: f"{float(v)!r}D" for k, v in options.resolved_score_weights().items()}
    rest = f"({w['grounding']} * grounding + {w['coverage']} * coverage + {w['faithfulness']} * faithfulness)"
    others = f"({w['grounding']} + {w['coverage']} + {w['faithfulness']})"
    quality = f"least(1D, greatest(0D, case when accuracy is null then case when {others} > 0 then {rest} / {others} else 0D end else {rest} + {w['accuracy']} * accuracy end))"
    return out.select("response_id", "grounding", "accuracy", "coverage", "faithfulness", F.expr(quality).alias("quality"), *counts)


def annotate(responses: DataFrame, reports: DataFrame) -> DataFrame:
    """(response_id, text, inserted): grounded factual claims without citations get ` [source]` before their final
    mark; a source without id gives none. Insertions of a response fold from the left over its pieces."""
    todo = reports.where("is_factual and is_grounded and not has_citations and primary_id is not null").select("response_id", F.struct(F.col("end").cast("int").alias("end"), "claim_idx", "primary_id").alias("x"))
    held = responses.select("response_id", "response").join(todo.groupBy("response_id").agg(F.array_sort(F.collect_list("x")).alias("xs")), "response_id", "left")

    # ends count UTF-16 units, as all offsets do
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, marks = [], []
            for text, xs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, done, made = (text or "").encode("utf-16-le", "surrogatepass"), [], []
                at = shift = 0
                char = lambda i: raw[2 * i : 2 * i + 2].decode("utf-16-le", "replace") if i >= 0 else ""  # noqa: E731, B023
                for x in xs or []:
                    place = x["end"]
                    if char(place) not in (".", "!", "?") or not char(place):
                        place -= char(place - 1) in (".", "!", "?") and place > 0
                    place = max(place, at)
                    marker = f" [{x['primary_id']}]"
                    done += [raw[2 * at : 2 * place], marker.encode("utf-16-le")]
                    made.append({"marker": marker[1:], "source_id": x["primary_id"], "claim_idx": x["claim_idx"], "offset": place + shift})
                    shift += len(marker.encode("utf-16-le")) // 2
                    at = place
                texts.append((b"".join(done) + raw[2 * at :]).decode("utf-16-le", "surrogatepass") if text is not None else None)
                marks.append(made)
            kind = pa.list_(pa.struct([("marker", pa.string()), ("source_id", pa.string()), ("claim_idx", pa.int64()), ("offset", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(marks, kind)], names=["response_id", "text", "inserted"])

    key = held.schema["response_id"].dataType.simpleString()
    return held.mapInArrow(run, f"response_id {key}, text string, inserted array<struct<marker: string, source_id: string, claim_idx: bigint, offset: bigint>>")
