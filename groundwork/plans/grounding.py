"""Queries of claims, attribution and verification, with a second computation of each in DuckDB's SQL.

Responses are the benchmark's passages, some with changed words, that cite by number; their sources are passages too, so
that SQL can try every window of every pair.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import engine
from ..functions import text as X
from ..operators import attribution, citations, claims, verification
from ..operators.claims import ABBREVIATIONS
from ..options import CiteOptions
from ..sources.tables import passage_responses, passage_sources, table
from .catalogue import _GRAMS, _JACCARD, _KEPT, _NORM, _query, _ranked

_q = lambda x: "'" + x.replace("'", "''") + "'"
_SHORT = "|".join(sorted(w.replace(".", "\\.") for w in ABBREVIATIONS))
_ANY = lambda words: "(?:" + "|".join(words) + ")"
_SAYS = rf"(?is)^{_ANY(X.HEDGES_FIRST + X.META_FIRST + X.DISCLAIMERS_FIRST)}\b|\b{_ANY(X.HEDGES_ANYWHERE + X.DISCLAIMERS_ANYWHERE)}\b|^{_ANY(X.DISCLAIMERS_START)}|^{_ANY(X.GREETINGS_WHOLE)}[.!]*\z"
_FACT = f"""NOT ({{0}} = '' OR {{0}} LIKE '%?' OR regexp_matches({{0}}, {_q(_SAYS)}) OR (len(string_split_regex({{0}}, '\\s+')) <= 6 AND regexp_matches({{0}}, {_q(rf"(?i)^{_ANY(X.TRANSITIONS_FIRST)}\b")})))"""
_STRIPPED = "trim(regexp_replace(regexp_replace({0}, '\\[\\^?\\d+\\]', '', 'g'), '\\s{{2,}}', ' ', 'g'))"
_EDGES = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
#: Sentences of r(response_id, response): a mark goes in behind each end of a sentence, so no place moves.
_SENTENCES = rf"""
    kept AS (SELECT response_id, regexp_replace(coalesce(response, ''), '(^|[^A-Za-z.])({_SHORT})\.', '\1\2' || chr(2), 'gi') AS t FROM r),
    cut AS (SELECT response_id, string_split(replace(regexp_replace(t, '([.!?;])(\s)', '\1' || chr(1) || '\2', 'g'), chr(10), chr(1) || chr(10)), chr(1)) AS parts FROM kept),
    part AS (SELECT response_id, i, replace(parts[i], chr(2), '.') AS part, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) AS ahead FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM cut)),
    said AS (SELECT response_id, i, {_EDGES.format('part')} AS segment, cast(ahead + length(part) - length(regexp_replace(part, '^\s+', '')) AS BIGINT) AS "start" FROM part),
    claim AS (SELECT response_id, cast(row_number() OVER (PARTITION BY response_id ORDER BY i) - 1 AS BIGINT) AS claim_idx, {_STRIPPED.format('segment')} AS text, segment, "start", "start" + length(segment) AS "end"
        FROM said WHERE {_STRIPPED.format('segment')} <> '')"""
_TURNS = "r AS (SELECT conv_id * 100000 + turn AS response_id, text AS response FROM conversations)"


def _turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * 100000 + F.col("turn")).alias("response_id"), F.col("text").alias("response"))


@_query(f"""WITH {_TURNS}, {_SENTENCES} SELECT response_id, claim_idx, text, "start", "end", {_FACT.format('text')} AS is_factual FROM claim""")
def sentence_split(spark, sf_dir):
    return claims.extract(_turns(spark, sf_dir)).select("response_id", "claim_idx", "text", "start", "end", "is_factual")


@_query(rf"""WITH {_TURNS}, {_SENTENCES},
    g AS (SELECT response_id, claim_idx, "start", string_split_regex(segment, ',\s+(?:and|but|or|yet)\s+|;\s+') AS gaps, regexp_extract_all(segment, ',\s+(?:and|but|or|yet)\s+|;\s+') AS hits FROM claim),
    u AS (SELECT *, unnest(range(1, len(gaps) + 1)) AS k FROM g),
    c AS (SELECT response_id, claim_idx, k, gaps[k] AS segment, "start" + coalesce(list_sum(list_transform(gaps[1:k - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS "start" FROM u)
    SELECT response_id, cast(row_number() OVER (PARTITION BY response_id ORDER BY claim_idx, k) - 1 AS BIGINT) AS claim_idx, {_STRIPPED.format('segment')} AS text,
        cast("start" + length(segment) - length(regexp_replace(segment, '^\s+', '')) AS BIGINT) AS "start", cast("start" + length(segment) AS BIGINT) AS "end" FROM c WHERE {_STRIPPED.format('segment')} <> ''""")
def clause_split(spark, sf_dir):
    return claims.extract(_turns(spark, sf_dir), "clause").select("response_id", "claim_idx", "text", "start", "end")


#: Citations [n] of r: their places by the lengths of what is between them.
_CITATIONS = r"""
    f AS (SELECT response_id, string_split_regex(response, '\[\d+\]') AS gaps, regexp_extract_all(response, '\[\d+\]') AS hits FROM r),
    cited AS (SELECT response_id, cast(k - 1 AS BIGINT) AS cit_idx, hits[k][2:-2] AS id, cast(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS k_start
        FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM f)),
    near AS (SELECT response_id, claim_idx, cit_idx, k_start < "end" AS inside FROM claim JOIN cited USING (response_id) WHERE k_start >= "start" AND k_start <= "end" + 5),
    attached AS (SELECT response_id, claim_idx, cit_idx FROM (SELECT *, bool_or(inside) OVER (PARTITION BY response_id, claim_idx) AS own FROM near) WHERE inside OR NOT own)"""


@_query(f"""WITH r AS (SELECT doc_id AS response_id, 'Alpha ' || repeat('ab ', doc_id % 7) || CASE doc_id % 3 WHEN 0 THEN 'beta [1] gamma. ' ELSE 'beta. ' END || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '[2] ' WHEN 2 THEN '[3] [4] ' ELSE '  [5] ' END
        || 'Delta epsilon ' || CASE WHEN doc_id % 5 < 2 THEN '[6].' ELSE 'zeta. [7]' END || CASE WHEN doc_id % 2 = 0 THEN ' Eta theta.' ELSE '' END AS response FROM documents),
    {_SENTENCES}, {_CITATIONS} SELECT response_id, claim_idx, cit_idx FROM attached""")
def claim_citation_join(spark, sf_dir):
    """Which claim, or which two, a marker belongs to: markers within, behind and between claims, for every document."""
    text = """concat('Alpha ', repeat('ab ', cast(doc_id % 7 as int)), case doc_id % 3 when 0 then 'beta [1] gamma. ' else 'beta. ' end, case doc_id % 4 when 0 then '' when 1 then '[2] ' when 2 then '[3] [4] ' else '  [5] ' end,
        'Delta epsilon ', case when doc_id % 5 < 2 then '[6].' else 'zeta. [7]' end, case when doc_id % 2 = 0 then ' Eta theta.' else '' end)"""
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("response_id"), F.expr(text).alias("response"))
    return verification.attach(claims.extract(r), citations.parse(r))


_BOTH = f"""
    r AS (SELECT item_id AS response_id, item_id % 20 AS key, rtrim(CASE item_id % 3 WHEN 1 THEN replace(text, 'th', 't') WHEN 2 THEN replace(text, ' the', ' la bo') ELSE text END, '.') || ' [' || (item_id % 4 + 1) || '].' AS response FROM benchmark),
    src AS (SELECT item_id % 20 AS key, row_number() OVER (PARTITION BY item_id % 20 ORDER BY item_id) AS source_pos, 'p' || item_id AS source_id, {_NORM.format('text')} AS sn, {_KEPT.format('text')} AS st FROM benchmark),
    {_SENTENCES}, {_CITATIONS}"""
_SCORED = f"""
    fact AS (SELECT key, response_id, claim_idx, text, {_NORM.format('text')} AS cn, {_KEPT.format('text')} AS ct FROM claim JOIN r USING (response_id) WHERE {_FACT.format('text')}),
    pair AS MATERIALIZED (SELECT *, string_split(cn, ' ') AS cw, length(cn) AS m, length(sn) AS n, list_distinct(list_transform(range(1, length(cn) - 1), lambda i: substr(cn, i, 3))) AS grams FROM fact JOIN src USING (key)),
    run AS (SELECT response_id, claim_idx, source_pos, max(z) AS run FROM (SELECT response_id, claim_idx, source_pos, cw, sn, z, unnest(range(1, len(cw) - z + 2)) AS i FROM (SELECT *, unnest(range(5, len(cw) + 1)) AS z FROM pair))
        WHERE contains(' ' || sn || ' ', ' ' || array_to_string(cw[i:i + z - 1], ' ') || ' ') GROUP BY ALL),
    hit AS (SELECT response_id, claim_idx, source_pos, cn, sn, m, n, len(grams) AS g, list_transform(range(1, n - 1), lambda i: CASE WHEN list_contains(grams, substr(sn, i, 3)) THEN 1 ELSE 0 END) AS hits FROM pair WHERE m >= 3 AND m <= 2 * n),
    size AS (SELECT *, unnest(range(greatest(1, cast(floor(m * 0.6::DOUBLE) AS BIGINT)), least(cast(ceil(m * 1.5::DOUBLE) AS BIGINT), n) + 1)) AS w FROM hit),
    place AS (SELECT *, unnest(range(0, n - w + 1, greatest(1, w // 10))) AS p FROM size),
    fuzzy AS (SELECT response_id, claim_idx, source_pos, max(1 - levenshtein(cn, substr(sn, p + 1, w)) / cast(greatest(m, w) AS DOUBLE)) AS fuzzy FROM place WHERE coalesce(list_sum(hits[p + 1:p + w - 2]), 0) / cast(g AS DOUBLE) >= 0.3 GROUP BY ALL),
    many AS (SELECT key, count(*) AS n FROM src GROUP BY key),
    freq AS (SELECT key, term, ln((n + 1.0::DOUBLE) / (df + 1)) + 1 AS idf FROM (SELECT key, term, count(*) AS df FROM (SELECT key, unnest(list_distinct(st)) AS term FROM src) GROUP BY ALL) JOIN many USING (key)),
    cw AS (SELECT response_id, claim_idx, key, term, count(*) / cast(n AS DOUBLE) * coalesce(any_value(idf), 1) AS w FROM (SELECT response_id, claim_idx, key, len(ct) AS n, unnest(ct) AS term FROM fact) LEFT JOIN freq USING (key, term) GROUP BY response_id, claim_idx, key, term, n),
    sw AS (SELECT key, source_pos, term, count(*) / cast(n AS DOUBLE) * any_value(idf) AS w FROM (SELECT key, source_pos, len(st) AS n, unnest(st) AS term FROM src) JOIN freq USING (key, term) GROUP BY key, source_pos, term, n),
    tf AS (SELECT response_id, claim_idx, source_pos, sum(cw.w * sw.w) AS dot FROM cw JOIN sw USING (key, term) GROUP BY ALL),
    cl AS (SELECT response_id, claim_idx, sqrt(sum(w * w)) AS l FROM cw GROUP BY ALL), sl AS (SELECT key, source_pos, sqrt(sum(w * w)) AS l FROM sw GROUP BY ALL),
    grams AS (SELECT *, {_GRAMS.format('ct', 2)} AS c2, {_GRAMS.format('st', 2)} AS s2, {_GRAMS.format('ct', 3)} AS c3, {_GRAMS.format('st', 3)} AS s3 FROM pair),
    each AS (SELECT key, response_id, claim_idx, source_pos, source_id,
            CASE WHEN cn <> '' AND sn <> '' AND contains(sn, cn) THEN 1.0::DOUBLE ELSE coalesce(run / cast(len(cw) AS DOUBLE), 0) END AS exact, coalesce(fuzzy, 0) AS fuzzy,
            CASE WHEN len(ct) = 0 OR len(st) = 0 THEN 0 ELSE 0.6::DOUBLE * (0.2::DOUBLE * {_JACCARD.format('ct', 'st')} + 0.3::DOUBLE * {_JACCARD.format('c2', 's2')} + 0.5::DOUBLE * {_JACCARD.format('c3', 's3')})
                + 0.4::DOUBLE * len(list_filter(ct, lambda t: list_contains(st, t))) / len(ct) END AS ngram,
            coalesce(dot / (cl.l * sl.l), 0) AS tfidf
        FROM grams LEFT JOIN run USING (response_id, claim_idx, source_pos) LEFT JOIN fuzzy USING (response_id, claim_idx, source_pos) LEFT JOIN tf USING (response_id, claim_idx, source_pos) LEFT JOIN cl USING (response_id, claim_idx) LEFT JOIN sl USING (key, source_pos)),
    scored AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY response_id, claim_idx ORDER BY confidence DESC, source_pos) AS rank FROM (SELECT *, least(1, greatest(0, 0.4::DOUBLE * exact + 0.25::DOUBLE * fuzzy + 0.2::DOUBLE * ngram + 0.15::DOUBLE * tfidf)) AS confidence FROM each))"""
_CHECKED = f"""
    resolved AS (SELECT cited.*, coalesce(x.source_id, y.source_id) AS resolved_id FROM cited JOIN r USING (response_id) LEFT JOIN src x ON x.key = r.key AND x.source_id = id LEFT JOIN src y ON y.key = r.key AND y.source_pos = cast(id AS BIGINT)),
    above AS (SELECT DISTINCT response_id, claim_idx, true AS above FROM scored WHERE confidence >= 0.4),
    checked AS (SELECT a.response_id, a.claim_idx, cit_idx, CASE WHEN resolved_id IS NULL THEN 'phantom' WHEN confidence >= 0.4 THEN 'verified' WHEN above THEN 'misattributed' ELSE 'unsupported' END AS state, resolved_id, CASE WHEN resolved_id IS NOT NULL THEN confidence END AS cited
        FROM attached a JOIN fact USING (response_id, claim_idx) JOIN resolved USING (response_id, cit_idx) LEFT JOIN scored s ON s.response_id = a.response_id AND s.claim_idx = a.claim_idx AND s.source_id = resolved_id LEFT JOIN above ON above.response_id = a.response_id AND above.claim_idx = a.claim_idx),
    judged AS (SELECT c.response_id, c.claim_idx, c."end", f.text IS NOT NULL AS is_factual, s.source_id AS primary_id, coalesce(s.confidence >= 0.4, false) AS is_grounded, a.response_id IS NOT NULL AS has_citations
        FROM claim c LEFT JOIN fact f USING (response_id, claim_idx) LEFT JOIN scored s ON s.response_id = c.response_id AND s.claim_idx = c.claim_idx AND s.rank = 1 LEFT JOIN (SELECT DISTINCT response_id, claim_idx FROM attached) a ON a.response_id = c.response_id AND a.claim_idx = c.claim_idx),
    facts AS (SELECT response_id, count(*) AS claim_count, count(*) FILTER (is_grounded) AS g, count(*) FILTER (is_grounded OR has_citations) AS c FROM judged WHERE is_factual GROUP BY ALL),
    states AS (SELECT response_id, count(*) AS v, count(*) FILTER (state = 'verified') AS ok, avg(cited) FILTER (state = 'verified') AS f, count(*) FILTER (state = 'misattributed') AS mis, count(*) FILTER (state = 'phantom') AS ph, count(*) FILTER (state = 'unsupported') AS un FROM checked GROUP BY ALL),
    counted AS (SELECT response_id, count(*) AS n FROM cited GROUP BY ALL),
    rates AS (SELECT response_id, coalesce(g / cast(claim_count AS DOUBLE), 0) AS grounding, ok / cast(v AS DOUBLE) AS accuracy, coalesce(facts.c / cast(claim_count AS DOUBLE), 0) AS coverage, coalesce(f, g / cast(claim_count AS DOUBLE), 0) AS faithfulness,
            coalesce(claim_count, 0) AS claim_count, coalesce(n, 0) AS citation_count, coalesce(mis, 0) AS misattributed_count, coalesce(ph, 0) AS phantom_count, coalesce(un, 0) AS unsupported_count
        FROM r LEFT JOIN facts USING (response_id) LEFT JOIN states USING (response_id) LEFT JOIN counted USING (response_id)),
    response AS (SELECT *, CASE WHEN accuracy IS NULL THEN (0.35::DOUBLE * grounding + 0.15::DOUBLE * coverage + 0.2::DOUBLE * faithfulness) / 0.7::DOUBLE ELSE 0.35::DOUBLE * grounding + 0.15::DOUBLE * coverage + 0.2::DOUBLE * faithfulness + 0.3::DOUBLE * accuracy END AS quality FROM rates)"""


#: The queries score every pair of a claim and a passage of its corpus, as their SQL does.
_ALL = CiteOptions(max_sources_per_claim=None)


def _report(spark, sf_dir) -> engine.CitationReport:
    return engine.cite(passage_responses(spark, sf_dir), passage_sources(spark, sf_dir), _ALL)


@_query(f"""WITH {_BOTH}, {_SCORED} SELECT response_id, claim_idx, source_pos, round(exact, 6) AS exact, round(fuzzy, 6) AS fuzzy, round(ngram, 6) AS ngram, round(tfidf, 6) AS tfidf, 0::DOUBLE AS embedding, round(confidence, 6) AS confidence,
    CASE WHEN exact >= greatest(if(fuzzy >= 0.8, fuzzy, 0), if(ngram >= 0.3, ngram, 0), if(tfidf >= 0.3, tfidf, 0)) THEN 'exact' WHEN if(fuzzy >= 0.8, fuzzy, 0) >= greatest(if(ngram >= 0.3, ngram, 0), if(tfidf >= 0.3, tfidf, 0)) THEN 'fuzzy'
        WHEN if(ngram >= 0.3, ngram, 0) >= if(tfidf >= 0.3, tfidf, 0) THEN 'ngram' ELSE 'tfidf' END AS primary_match_type, rank FROM scored""")
def passage_attribution(spark, sf_dir):
    """All strategy scores, confidence, match type and rank of every claim of a passage and passage of its corpus."""
    return _ranked(_report(spark, sf_dir).attributions)


@_query(f"""WITH {_BOTH}, {_SCORED}, {_CHECKED} SELECT response_id, claim_idx, cit_idx, state, resolved_id, round(cited, 6) AS cited_confidence FROM checked""")
def citation_verification(spark, sf_dir):
    out = _report(spark, sf_dir).kept().verifications
    return out.select("response_id", "claim_idx", "cit_idx", "state", "resolved_id", F.round("cited_confidence", 6).alias("cited_confidence"))


_RATES = ("grounding", "accuracy", "coverage", "faithfulness", "quality")


@_query(f"""WITH {_BOTH}, {_SCORED}, {_CHECKED} SELECT response_id, {', '.join(f'round({c}, 6) AS {c}' for c in _RATES)}, claim_count, citation_count, misattributed_count, phantom_count, unsupported_count FROM response""")
def response_scores(spark, sf_dir):
    return _report(spark, sf_dir).kept().scores.withColumns({c: F.round(c, 6) for c in _RATES})


@_query(f"""WITH {_BOTH}, {_SCORED}, {_CHECKED} SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in _RATES)}, cast(sum(phantom_count) AS BIGINT) AS phantom FROM response""")
def batch_quality(spark, sf_dir):
    """Corpus averages; accuracy of responses without verifications is left out."""
    scores = _report(spark, sf_dir).kept().scores
    return scores.agg(*(F.round(F.avg(c), 6).alias(c) for c in _RATES), F.sum("phantom_count").alias("phantom"))


def _claims_where(condition: str) -> str:
    return f"""WITH {_BOTH}, {_SCORED}, {_CHECKED} SELECT response_id, claim_idx, primary_id FROM (SELECT response_id, claim_idx, is_factual, is_grounded, CASE WHEN is_grounded THEN primary_id END AS primary_id FROM judged) WHERE {condition}"""


@_query(_claims_where("is_factual AND is_grounded"))
def attributed_claims(spark, sf_dir):
    return _report(spark, sf_dir).kept().attributed.select("response_id", "claim_idx", "primary_id")


@_query(_claims_where("is_factual AND NOT is_grounded"))
def unattributed_claims(spark, sf_dir):
    return _report(spark, sf_dir).kept().unattributed.select("response_id", "claim_idx", "primary_id")


@_query(f"""WITH {_BOTH}, {_SCORED}, {_CHECKED} SELECT response_id, claim_idx, cit_idx, state FROM checked WHERE state IN ('misattributed', 'phantom')""")
def faulty_citations(spark, sf_dir):
    """The misattributed and the phantom view together."""
    report = _report(spark, sf_dir).kept()
    return report.misattributed.unionByName(report.phantom).select("response_id", "claim_idx", "cit_idx", "state")


@_query(f"""WITH {_BOTH}, {_SCORED}, {_CHECKED},
    todo AS (SELECT response_id, claim_idx, primary_id, response, CASE WHEN substr(response, "end" + 1, 1) IN ('.', '!', '?') THEN "end" WHEN substr(response, "end", 1) IN ('.', '!', '?') THEN "end" - 1 ELSE "end" END AS place
        FROM judged JOIN r USING (response_id) WHERE is_factual AND is_grounded AND NOT has_citations),
    ordered AS (SELECT *, coalesce(lag(place) OVER (PARTITION BY response_id ORDER BY place, claim_idx), 0) AS before FROM todo),
    made AS (SELECT response_id, string_agg(substr(response, before + 1, place - before) || ' [' || primary_id || ']', '' ORDER BY place, claim_idx) AS head, max(place) AS last, count(*) AS n FROM ordered GROUP BY response_id)
    SELECT r.response_id, coalesce(head || substr(response, last + 1), response) AS text, coalesce(n, 0) AS n_inserted FROM r LEFT JOIN made ON made.response_id = r.response_id""")
def annotate_response(spark, sf_dir):
    annotated, _ = engine.attribute(passage_responses(spark, sf_dir), passage_sources(spark, sf_dir), _ALL)
    return annotated.select("response_id", "text", F.size("inserted").cast("long").alias("n_inserted"))


_MARKS = ["[Passage 7]", "[passage 7 of]", "(Smith {y})", "(Smyth {y})", "https://e.org/{i}", "[x](https://e.org/{i}/more)", "[p{i}]", "[{n}]", "(Source {n})", "[^{n}]", "[Doc: tome {i}]", "[99]"]


@_query("""WITH m AS (SELECT item_id, k, item_id % 20 AS key, (item_id // 20) + 1 AS n FROM benchmark, range(0, 12) t(k)),
    s AS (SELECT item_id % 20 AS key, 'p' || item_id AS source_id, row_number() OVER (PARTITION BY item_id % 20 ORDER BY item_id) AS pos, item_id AS i FROM benchmark),
    e AS (SELECT m.item_id, k, s.source_id, pos, CASE WHEN k = 0 THEN s.i % 5 = 2 WHEN k = 1 THEN s.i % 5 = 2 WHEN k = 2 THEN s.i = m.item_id WHEN k = 3 THEN false WHEN k IN (4, 6) THEN s.i = m.item_id WHEN k = 5 THEN starts_with(m.item_id || '/more', s.i::VARCHAR) WHEN k IN (7, 8, 9) THEN pos = n WHEN k = 10 THEN s.i % 5 <> 2 AND contains('my tome ' || s.i || ' x', 'tome ' || m.item_id) ELSE false END AS ok FROM m JOIN s USING (key))
    SELECT item_id AS response_id, cast(k AS BIGINT) AS k, arg_min(source_id, pos) FILTER (ok) AS resolved_id FROM e GROUP BY ALL""")
def metadata_resolution(spark, sf_dir):
    """Titles, whole and in part, authors with years, whole and longer links, ids in any case and numbers as they are resolved."""
    marks = "array(" + ", ".join("concat(" + ", ".join(repr(p) if j % 2 == 0 else {"i": "item_id", "n": "cast(floor(item_id / 20) as bigint) + 1", "y": "1900 + item_id"}[p] for j, p in enumerate(m.replace("{", "}").split("}")) if j % 2 or p) + ")" for m in _MARKS) + ")"
    base = table(spark, sf_dir, "benchmark")
    r = base.select((F.col("item_id") * 100).alias("base"), F.expr("item_id % 20").alias("corpus_id"), F.posexplode(F.expr(marks)).alias("k", "mark"))
    r = r.select((F.col("base") + F.col("k")).alias("response_id"), "corpus_id", F.concat(F.lit("As said "), "mark", F.lit(" here")).alias("response"))
    title = "case when item_id % 5 = 2 then 'Passage 7' else concat('My Tome ', item_id, ' x') end"
    s = passage_sources(spark, sf_dir).join(base.select(F.expr("concat('p', item_id)").alias("source_id"), "item_id"), "source_id")
    s = s.withColumn("metadata", F.expr(f"named_struct('title', {title}, 'year', 1900 + item_id, 'author', 'J. Smith', 'url', concat('https://e.org/', item_id), 'pages', 3)"))
    found = citations.resolve(citations.parse(r).join(r.select("response_id", "corpus_id"), "response_id"), s, key="corpus_id")
    return found.select(F.expr("cast(response_id div 100 as bigint)").alias("response_id"), (F.col("response_id") % 100).alias("k"), "resolved_id")
