"""Scores of claims against the sources of their response, candidates first and ranked last.

Sources are keyed by their response, or by a corpus that many responses share; whatever a side needs (tokens, normal
form, hashed n-grams, TF-IDF weights) is made once for each of its rows, before any join. Shared terms and TF-IDF
products come from one join of both sides' weighted terms, so pairs are ids until candidates are chosen. Word runs
and edit-distance windows take one Arrow pass over the candidate pairs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fuzzy import RUN, best_windows, longest_run
from ..functions.text import cosine, ngram_overlap_of, ngrams, normalize, overlaps_of, tokenize_filtered
from ..options import CiteOptions
from .citations import _strip, utf16

#: How many candidates stay once there are more sources than max_sources_per_claim.
CANDIDATES = 50
STRATEGIES = ["exact", "fuzzy", "ngram", "tfidf", "embedding"]


def idf(sources: DataFrame) -> DataFrame:
    """(response_id, term, df, idf) over sources(response_id, tokens); sources without tokens count in N."""
    n = sources.groupBy("response_id").agg(F.count("*").alias("n"))
    df = sources.select("response_id", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("response_id", "term").agg(F.count("*").alias("df"))
    return df.join(n, "response_id").select("response_id", "term", "df", F.expr("ln((n + 1D) / (df + 1D)) + 1D").alias("idf"))


def weighted(rows: DataFrame, key: list[str], idf_df: DataFrame) -> DataFrame:
    """(key, vector map<term, tf * idf>, norm) of rows with tokens; a term that no source has weighs its tf."""
    tf = rows.select(*key, F.size("tokens").alias("_len"), F.explode("tokens").alias("term")).groupBy(*key, "term", "_len").agg(F.count("*").alias("_n"))
    both = tf.join(idf_df.select("response_id", "term", "idf"), ["response_id", "term"], "left")
    w = both.withColumn("w", F.expr("cast(_n as double) / _len * coalesce(idf, 1D)"))
    return w.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("vector"), F.sqrt(F.sum(F.expr("w * w"))).alias("norm"))


def prepared(rows: DataFrame, column: str, options: CiteOptions) -> DataFrame:
    text = f"coalesce({column}, '')"
    return rows.withColumn("norm_text", F.expr(normalize(text))).withColumn("tokens", F.expr(tokenize_filtered(text, options.stopwords)))


def _terms(rows: DataFrame, place: list[str]) -> DataFrame:
    """(place, term, _n, _len): how often a row's tokens hold a term, and how many tokens it has."""
    return rows.select(*place, F.size("tokens").alias("_len"), F.explode("tokens").alias("term")).groupBy(*place, "term", "_len").agg(F.count("*").alias("_n"))


_CLAIM, _SOURCE = ["_key", "response_id", "claim_idx"], ["_key", "source_pos"]
#: Sums over joined terms come in any order, so their last bits differ from run to run; those decide no type and no rank.
_TFIDF = "round(coalesce(try_divide(_dot, _lc * _ls), 0D), 12)"


def _products(c: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claim, source_pos, _shared, _dot) of pairs that share terms, and both sides' norms."""
    many = s.groupBy("_key").agg(F.count("*").alias("n"))
    s_terms, c_terms = _terms(s, _SOURCE), _terms(c, _CLAIM)
    df = s_terms.groupBy("_key", "term").agg(F.count("*").alias("df")).join(many, "_key")
    weights = df.select("_key", "term", F.expr("ln((n + 1D) / (df + 1D)) + 1D").alias("idf"))
    weight = F.expr("cast(_n as double) / _len * coalesce(idf, 1D)")
    s_terms = s_terms.join(weights, ["_key", "term"]).withColumn("_ws", weight)
    c_terms = c_terms.join(weights, ["_key", "term"], "left").withColumn("_wc", weight)
    shared = c_terms.select(*_CLAIM, "term", "_wc").join(s_terms.select(*_SOURCE, "term", "_ws", "_n"), ["_key", "term"])
    found = shared.groupBy("response_id", "claim_idx", "source_pos").agg(F.sum("_n").alias("_shared"), F.sum(F.expr("_wc * _ws")).alias("_dot"))
    norm = lambda rows, place, w, name: rows.groupBy(*place).agg(F.sqrt(F.sum(F.expr(f"{w} * {w}"))).alias(name))
    return found, norm(c_terms, ["response_id", "claim_idx"], "_wc", "_lc"), norm(s_terms, _SOURCE, "_ws", "_ls")


def _candidates(c: DataFrame, s: DataFrame, found: DataFrame, options: CiteOptions) -> DataFrame:
    """(_key, response_id, claim_idx, source_pos, shared, _dot): all pairs of a key, or, with more sources than the options
    allow, the 50 that share most tokens (counted with the source's repeats), ties to earlier sources. Where the options
    set no limit, every pair stays. Ids and numbers only."""
    many = s.groupBy("_key").agg(F.count("*").alias("_sources"))
    pairs = c.select(*_CLAIM).join(many, "_key").join(s.select(*_SOURCE), "_key").join(found, ["response_id", "claim_idx", "source_pos"], "left")
    limit = options.max_sources_per_claim if options.attribution_threshold > 0 else None
    shared = F.lit(0) if limit is None else F.expr(f"case when _sources > {limit} then coalesce(_shared, 0) else 0 end")
    pairs = pairs.withColumn("shared", shared.cast("long")).withColumn("_dot", F.coalesce("_dot", F.lit(0.0)))
    if limit is not None:
        order = Window.partitionBy("response_id", "claim_idx").orderBy(F.desc("shared"), "source_pos")
        pairs = pairs.withColumn("_rank", F.row_number().over(order)).where(f"_rank <= {CANDIDATES} or _sources <= {limit}")
    return pairs.select(*_CLAIM, "source_pos", "shared", "_dot")


def candidates(claims: DataFrame, sources: DataFrame, options: CiteOptions, key: str = "response_id") -> DataFrame:
    """(response_id, claim_idx, source_pos, shared) of claims(key, response_id, claim_idx, tokens) and sources(key,
    source_pos, tokens): the pairs that are scored."""
    c = claims.select(F.col(key).alias("_key"), "response_id", "claim_idx", "tokens")
    s = sources.select(F.col(key).alias("_key"), "source_pos", "tokens")
    return _candidates(c, s, _products(c, s)[0], options).select("response_id", "claim_idx", "source_pos", "shared")


def _slice(text: str, start: int, end: int) -> str:
    """The text between two places in UTF-16 units."""
    return text[start:end] if text.isascii() else text.encode("utf-16-le", "surrogatepass")[2 * start : 2 * end].decode("utf-16-le", "replace")


def _evidence(content: str, norm: str, run: str | None, exact: float, start: int, length: int):
    """(evidence, match start, match end) of a pair, as the strategies found it."""
    if exact == 1.0 and run is None:
        low = content.lower()
        place = low.find(" ".join(norm.split(" ")[:3]))
        begin = utf16(low)(place) if place >= 0 else 0
        return _strip(_slice(content, begin, begin + len(norm) + 20)), begin, begin + len(norm)
    return run if run is not None else _slice(content, start, start + length) if start >= 0 else None, None, None


def _matches(batches):
    """exact and fuzzy scores, evidence and offsets for rows (…, c_norm, s_norm, content)."""
    for batch in batches:
        claims, sources, contents = (batch.column(n).to_pylist() for n in ("c_norm", "s_norm", "content"))
        rows_of: dict[str, list[int]] = {}
        for i, claim in enumerate(claims):
            rows_of.setdefault(claim or "", []).append(i)
        out = [[None] * len(claims) for _ in range(5)]
        for claim, rows in rows_of.items():
            own = claim.split(" ")
            for i, (fuzzy, start, length) in zip(rows, best_windows(claim, [sources[i] or "" for i in rows])):
                exact, run, source = 0.0, None, sources[i]
                if claim and source:
                    if claim in source:
                        exact = 1.0
                    elif len(own) >= RUN:
                        other = source.split(" ")
                        n, at = longest_run(own, other)
                        if n >= RUN:
                            exact, run = min(1.0, n / len(own)), " ".join(other[at : at + n])
                values = (exact, fuzzy, *_evidence(contents[i] or "", claim, run, exact, start, length))
                for o, v in zip(out, values):
                    o[i] = v
        kinds = (pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.int64())
        keep = [n for n in batch.schema.names if n not in ("c_norm", "s_norm", "content")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *(pa.array(o, k) for o, k in zip(out, kinds))], names=[*keep, "exact", "fuzzy", "match_evidence", "_start", "_end"])


def _embedded(rows: DataFrame, column: str, embedder) -> DataFrame:
    """(column, embedding) for its distinct values."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(map(float, v)) for v in embedder(texts)], pa.list_(pa.float64()))], names=[column, "_embedding"])

    return rows.select(column).distinct().mapInArrow(run, f"{column} string, _embedding array<double>")


def score(claims: DataFrame, sources: DataFrame, options: CiteOptions = CiteOptions(), key: str = "response_id") -> DataFrame:
    """Ranked attributions of claims(key, response_id, claim_idx, text) to sources(key, source_pos, source_id, content[,
    embedding]): strategy scores, confidence, primary_match_type, match_evidence, match_offset and rank.

    All candidates are returned, also those below the threshold. Offsets count UTF-16 units. Null content counts as
    empty; a null source_id is kept; other columns of either side are ignored, whatever their names.
    """
    c = prepared(claims.select(F.col(key).alias("_key"), "response_id", "claim_idx", "text"), "text", options)
    given = [F.col("embedding").cast("array<double>").alias("_given")] if "embedding" in sources.columns else [F.lit(None).cast("array<double>").alias("_given")]
    s = prepared(sources.select(F.col(key).alias("_key"), "source_pos", F.col("source_id").cast("string").alias("source_id"), F.coalesce("content", F.lit("")).alias("content"), *given), "content", options)
    found, c_norms, s_norms = _products(c, s)
    grams = lambda side: [F.expr(f"array_distinct(transform({ngrams('tokens', n)}, g -> xxhash64(g)))").alias(f"{side}{n}") for n in (1, 2, 3)]
    left = c.select("response_id", "claim_idx", "text", F.col("norm_text").alias("c_norm"), F.expr("transform(tokens, t -> xxhash64(t))").alias("c0"), *grams("c"))
    right = s.select(*_SOURCE, "source_id", "content", "_given", F.col("norm_text").alias("s_norm"), *grams("s"))
    pairs = _candidates(c, s, found, options).join(left, ["response_id", "claim_idx"]).join(c_norms, ["response_id", "claim_idx"], "left")
    pairs = pairs.join(right.join(s_norms, _SOURCE, "left"), _SOURCE)
    pairs = pairs.withColumns({k: F.expr(v) for k, v in overlaps_of("c", "s").items()})
    pairs = pairs.withColumn("ngram", F.expr(ngram_overlap_of("c", "s"))).withColumn("tfidf", F.expr(_TFIDF))
    if options.embedder:
        pairs = pairs.join(_embedded(claims, "text", options.embedder).withColumnRenamed("_embedding", "_claim"), "text", "left")
        made = _embedded(s.where("_given is null"), "content", options.embedder).withColumnRenamed("_embedding", "_made")
        pairs = pairs.join(made, "content", "left")
        near = F.expr(cosine("_claim", "coalesce(_given, _made)"))
        pairs = pairs.withColumn("embedding", F.when(near >= options.embedding_threshold, near).otherwise(F.lit(0.0)))
    else:
        pairs = pairs.withColumn("embedding", F.lit(0.0))
    pairs = pairs.select("response_id", "claim_idx", "source_pos", "source_id", "shared", "ngram", "tfidf", "embedding", "c_norm", "s_norm", "content")
    if options.max_sources_per_claim is None:  # the joins leave a claim's pairs scattered; its windows are tried together
        pairs = pairs.repartition("response_id", "claim_idx").sortWithinPartitions("response_id", "claim_idx")
    fields = [f for f in pairs.schema.fields if f.name not in ("c_norm", "s_norm", "content")]
    extra = [T.StructField(n, t) for n, t in (("exact", T.DoubleType()), ("fuzzy", T.DoubleType()), ("match_evidence", T.StringType()), ("_start", T.LongType()), ("_end", T.LongType()))]
    matched = pairs.mapInArrow(_matches, T.StructType(fields + extra))
    w = options.resolved_weights()
    sum_of = " + ".join(f"{float(w[k])!r}D * {k}" for k in STRATEGIES)
    matched = matched.withColumn("confidence", F.expr(f"least(1D, greatest(0D, {sum_of}))"))
    seen = {"exact": "exact", "embedding": "embedding"} | {k: f"case when {k} >= {float(getattr(options, f'{k}_threshold'))!r}D then {k} else 0D end" for k in ("fuzzy", "ngram", "tfidf")}
    best = f"greatest({', '.join(seen[k] for k in STRATEGIES)})"
    kind = "case " + " ".join(f"when {seen[k]} >= {best} then '{k}'" for k in STRATEGIES) + " else 'exact' end"
    rank = Window.partitionBy("response_id", "claim_idx").orderBy(F.desc("confidence"), F.desc("shared"), "source_pos")
    offset = "case when _start is not null then struct(_start as start, _end as end) end"
    return matched.select(
        "response_id", "claim_idx", "source_pos", "source_id", *STRATEGIES, "confidence", F.expr(kind).alias("primary_match_type"),
        "match_evidence", F.expr(offset).alias("match_offset"), F.row_number().over(rank).alias("rank"),
    )
