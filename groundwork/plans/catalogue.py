"""Queries of the driver contract and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import engine
from ..functions import text as X
from ..operators import attribution, citations, claims
from ..options import CiteOptions
from ..sources.tables import benchmark_responses, document_sources, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9_]+', ' ', 'g'))"
_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9_''-]+')"
_KEPT = f"list_filter({_TOKENS}, lambda t: NOT list_contains({_STOP}, t))"
_GRAMS = "CASE WHEN len({0}) >= {1} THEN list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string({0}[i:i + {1} - 1], ' ')) ELSE [] END"
_JACCARD = "CASE WHEN len({0}) + len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / cast(len(list_distinct(list_concat({0}, {1}))) AS DOUBLE) END"
#: Pairs of a benchmark passage and the documents of its group, with tokens.
_PAIRS = f"""s AS (SELECT source AS grp, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS source_pos, {_KEPT.format('text')} AS st, {_NORM.format('text')} AS sn FROM documents),
    c AS (SELECT item_id, 'src' || (item_id % 20) AS grp, {_KEPT.format('text')} AS ct, {_NORM.format('text')} AS cn FROM benchmark)"""


@_query(f"SELECT doc_id, md5({_NORM.format('text')}) AS norm_md5, cast(length({_NORM.format('text')}) AS BIGINT) AS n FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = X.normalize("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(f"md5({norm})").alias("norm_md5"), F.expr(f"cast(length({norm}) as bigint)").alias("n"))


@_query(f"SELECT doc_id, md5(array_to_string({_TOKENS.format('text')}, ' ')) AS tokens_md5, md5(array_to_string({_KEPT.format('text')}, ' ')) AS kept_md5, cast(len({_KEPT.format('text')}) AS BIGINT) AS n_kept FROM documents")
def tokenize_filtered(spark, sf_dir):
    kept = X.tokenize_filtered("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(f"md5(array_join({X.tokenize('text')}, ' '))").alias("tokens_md5"), F.expr(f"md5(array_join({kept}, ' '))").alias("kept_md5"), F.expr(f"cast(size({kept}) as bigint)").alias("n_kept")
    )


@_query(f"WITH k AS MATERIALIZED (SELECT doc_id, {_KEPT.format('text')} AS kept FROM documents), t AS (SELECT doc_id, unnest(kept) AS term FROM k), c AS (SELECT doc_id, term, count(*) AS c FROM t GROUP BY ALL) SELECT doc_id, term, round(cast(c AS DOUBLE) / len(kept), 9) AS tf FROM c JOIN k USING (doc_id)")
def term_frequency(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(X.tokenize_filtered("text")).alias("tokens"))
    tf = rows.select("doc_id", F.size("tokens").alias("n"), F.explode("tokens").alias("term")).groupBy("doc_id", "term", "n").agg(F.count("*").alias("k"))
    return tf.select("doc_id", "term", F.round(F.col("k").cast("double") / F.col("n"), 9).alias("tf"))


@_query(f"""WITH t AS (SELECT source, doc_id, list_distinct({_KEPT.format('text')}) AS terms FROM documents),
    n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), d AS (SELECT source, term, count(*) AS df FROM (SELECT source, unnest(terms) AS term FROM t) GROUP BY ALL)
    SELECT source AS response_id, term, df, round(ln((n + 1.0::DOUBLE) / (df + 1)) + 1, 9) AS idf FROM d JOIN n USING (source)""")
def doc_frequency_idf(spark, sf_dir):
    """IDF within each group of sources."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("response_id"), F.expr(X.tokenize_filtered("text")).alias("tokens"))
    return attribution.idf(rows).withColumn("idf", F.round("idf", 9))


@_query(f"""WITH {_PAIRS}, p AS (SELECT item_id, doc_id, ct, st, {_GRAMS.format('ct', 2)} AS c2, {_GRAMS.format('st', 2)} AS s2, {_GRAMS.format('ct', 3)} AS c3, {_GRAMS.format('st', 3)} AS s3 FROM c JOIN s USING (grp)),
    j AS (SELECT *, {_JACCARD.format('ct', 'st')} AS j1, {_JACCARD.format('c2', 's2')} AS j2, {_JACCARD.format('c3', 's3')} AS j3,
        CASE WHEN len(ct) = 0 THEN 0 ELSE len(list_filter(ct, lambda t: list_contains(st, t))) / cast(len(ct) AS DOUBLE) END AS k FROM p)
    SELECT item_id, doc_id, round(j1, 9) AS j1, round(j2, 9) AS j2, round(j3, 9) AS j3, round(k, 9) AS containment,
        round(CASE WHEN len(ct) = 0 OR len(st) = 0 THEN 0 ELSE 0.6::DOUBLE * (0.2::DOUBLE * j1 + 0.3::DOUBLE * j2 + 0.5::DOUBLE * j3) + 0.4::DOUBLE * k END, 9) AS overlap FROM j""")
def ngram_similarity(spark, sf_dir):
    """Jaccard of 1- to 3-grams, containment and their blend for all pairs of a passage and its sources."""
    grams = lambda side: [F.expr(f"array_distinct(transform({X.ngrams('t', n)}, g -> xxhash64(g)))").alias(f"{side}{n}") for n in (1, 2, 3)]
    c = benchmark_responses(spark, sf_dir).select(F.col("response_id").alias("item_id"), "grp", F.expr(X.tokenize_filtered("response")).alias("t"))
    c = c.select("item_id", "grp", F.expr("transform(t, w -> xxhash64(w))").alias("c0"), *grams("c"))
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), "doc_id", F.expr(X.tokenize_filtered("text")).alias("t")).select("grp", "doc_id", *grams("s"))
    pairs = c.join(s, "grp").withColumns({k: F.expr(v) for k, v in X.overlaps_of("c", "s").items()})
    j = lambda n: F.round(F.expr(X.jaccard_of("c", "s", n)), 9).alias(f"j{n}")
    return pairs.select("item_id", "doc_id", j(1), j(2), j(3), F.round(F.expr(X.containment_of("c")), 9).alias("containment"), F.round(F.expr(X.ngram_overlap_of("c", "s")), 9).alias("overlap"))


@_query(f"""WITH {_PAIRS}, n AS (SELECT grp, count(*) AS n FROM s GROUP BY grp),
    d AS (SELECT grp, term, count(*) AS df FROM (SELECT grp, unnest(list_distinct(st)) AS term FROM s) GROUP BY ALL),
    i AS (SELECT grp, term, ln((n + 1.0::DOUBLE) / (df + 1)) + 1 AS idf FROM d JOIN n USING (grp)),
    cw AS (SELECT item_id, grp, term, count(*) / cast(n AS DOUBLE) * coalesce(any_value(idf), 1) AS w FROM (SELECT item_id, grp, len(ct) AS n, unnest(ct) AS term FROM c) LEFT JOIN i USING (grp, term) GROUP BY item_id, grp, term, n),
    sw AS (SELECT doc_id, grp, term, count(*) / cast(n AS DOUBLE) * any_value(idf) AS w FROM (SELECT doc_id, grp, len(st) AS n, unnest(st) AS term FROM s) JOIN i USING (grp, term) GROUP BY doc_id, grp, term, n),
    cn AS (SELECT item_id, sqrt(sum(w * w)) AS l FROM cw GROUP BY item_id), sn2 AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM sw GROUP BY doc_id),
    dot AS (SELECT item_id, doc_id, sum(a.w * b.w) AS v FROM cw a JOIN sw b USING (grp, term) GROUP BY ALL)
    SELECT c.item_id, s.doc_id, round(coalesce(v / (cn.l * sn2.l), 0), 6) AS tfidf FROM c JOIN s USING (grp) LEFT JOIN dot ON dot.item_id = c.item_id AND dot.doc_id = s.doc_id LEFT JOIN cn ON cn.item_id = c.item_id LEFT JOIN sn2 ON sn2.doc_id = s.doc_id""")
def tfidf_cosine(spark, sf_dir):
    """TF-IDF cosine for all pairs of a passage and its sources, by sparse vectors joined on terms."""
    c = benchmark_responses(spark, sf_dir).select(F.col("grp").alias("_key"), "response_id", F.lit(0).alias("claim_idx"), F.expr(X.tokenize_filtered("response")).alias("tokens"))
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("_key"), F.col("doc_id").alias("source_pos"), F.expr(X.tokenize_filtered("text")).alias("tokens"))
    found, c_norms, s_norms = attribution._products(c, s)
    dots = found.join(c_norms, ["response_id", "claim_idx"]).join(s_norms.drop("_key"), "source_pos")
    dots = dots.select("response_id", "source_pos", F.expr("coalesce(try_divide(_dot, _lc * _ls), 0D)").alias("v"))
    pairs = c.select("_key", "response_id").join(s.select("_key", "source_pos"), "_key").join(dots, ["response_id", "source_pos"], "left")
    return pairs.select(F.col("response_id").alias("item_id"), F.col("source_pos").alias("doc_id"), F.expr("round(coalesce(v, 0D), 6)").alias("tfidf"))


@_query(f"""WITH b AS (SELECT item_id, {_NORM.format('text')} AS cn FROM benchmark), d AS (SELECT doc_id, {_NORM.format('text')} AS sn FROM documents)
    SELECT item_id, cast(count(doc_id) AS BIGINT) AS n_docs, count(doc_id) > 0 AS is_grounded FROM b LEFT JOIN d ON cn <> '' AND contains(sn, cn) GROUP BY item_id""")
def exact_containment(spark, sf_dir):
    """Documents that hold a passage, after normalisation. Candidates meet on the passage's first words, those of short
    passages on their first letters."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.expr(X.normalize("text")).alias("cn"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(X.normalize("text")).alias("sn"))
    # inside a text a passage begins anywhere, but its second to sixth words stand there whole
    words = "split(cn, ' ')"
    keyed = b.withColumn("key", F.expr(f"case when size({words}) > 6 then array_join(slice({words}, 2, 5), ' ') end"))
    grams = d.select("doc_id", F.explode(F.array_distinct(F.expr(X.ngrams("split(sn, ' ')", 5)))).alias("key"))
    near = keyed.where("key is not null").join(grams, "key").select("item_id", "doc_id", "cn")
    hits = near.join(d, "doc_id").where("contains(sn, cn)").select("item_id", "doc_id")
    # shorter ones need not hold a whole word: their first three letters, of which there are few, pick the documents
    brief = keyed.where("key is null and cn <> ''").select("item_id", "cn", F.expr("substr(cn, 1, 3)").alias("head"))
    heads = brief.agg(F.collect_set("head").alias("heads"))  # one row of at most 37 + 37**2 + 37**3 heads
    tried = d.join(F.broadcast(heads)).select("doc_id", "sn", F.explode(F.expr("filter(heads, h -> contains(sn, h))")).alias("head"))
    short = tried.join(brief, "head").where("contains(sn, cn)").select("item_id", "doc_id")
    return b.select("item_id").join(hits.unionByName(short), "item_id", "left").groupBy("item_id").agg(F.count("doc_id").alias("n_docs"), (F.count("doc_id") > 0).alias("is_grounded"))


def flagship(spark, sf_dir):
    return exact_containment(spark, sf_dir)


@_query(f"""WITH b AS (SELECT item_id, {_NORM.format('text')} AS n FROM benchmark) SELECT x.item_id AS a, y.item_id AS b, cast(levenshtein(x.n, y.n) AS BIGINT) AS distance FROM b x JOIN b y ON y.item_id = x.item_id + 1""")
def levenshtein_pairs(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.expr(X.normalize("text")).alias("n"))
    y = b.select((F.col("item_id") - 1).alias("item_id"), F.col("n").alias("m"))
    return b.join(y, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.expr("cast(levenshtein(n, m) as bigint)").alias("distance"))


@_query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q JOIN e ON q.vec_id % 50 = 0 AND q.label = e.label AND q.vec_id <> e.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, score, cast(rank AS BIGINT) AS rank FROM r WHERE rank <= 10""")
def embedding_cosine_topk(spark, sf_dir):
    """The ten nearest by cosine with the same label, of every vector whose id is divisible by 50 (a top-k report)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("v").alias("q"))
    p = q.join(e, "label").where("query_id <> vec_id").select("query_id", "vec_id", F.round(F.expr(X.cosine("q", "v")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return p.withColumn("rank", rank.cast("long")).where("rank <= 10")


@_query(f"""WITH s AS (SELECT cast(substr(source, 4) AS BIGINT) % 10 AS grp, doc_id, {_KEPT.format('text')} AS st FROM documents),
    t AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) AS source_pos, count(*) OVER (PARTITION BY grp) AS n FROM s),
    p AS (SELECT item_id, source_pos, n, len(list_filter(st, lambda t: list_contains({_KEPT.format('text')}, t))) AS shared FROM benchmark JOIN t ON grp = item_id % 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN n > 50 THEN shared ELSE 0 END DESC, source_pos) AS k FROM p)
    SELECT item_id AS claim_id, cast(source_pos AS BIGINT) AS source_pos, cast(CASE WHEN n > 50 THEN shared ELSE 0 END AS BIGINT) AS shared FROM r WHERE k <= 50 OR n <= 50""")
def candidate_prefilter(spark, sf_dir):
    """The 50 sources that share most tokens with a claim, where a corpus has more than 50 (two groups of documents)."""
    c = table(spark, sf_dir, "benchmark").select(F.expr("item_id % 10").alias("corpus_id"), F.col("item_id").alias("response_id"), F.lit(0).alias("claim_idx"), F.expr(X.tokenize_filtered("text")).alias("tokens"))
    d = table(spark, sf_dir, "documents").select(F.expr("cast(substr(source, 4) as bigint) % 10").alias("corpus_id"), "doc_id", "text")
    places = d.select("doc_id", F.row_number().over(Window.partitionBy("corpus_id").orderBy("doc_id")).alias("source_pos"))
    s = d.join(places, "doc_id").select("corpus_id", "source_pos", F.expr(X.tokenize_filtered("text")).alias("tokens"))
    kept = attribution.candidates(c, s, CiteOptions(), "corpus_id")
    return kept.select(F.col("response_id").alias("claim_id"), F.col("source_pos").cast("long").alias("source_pos"), F.col("shared").cast("long").alias("shared"))


def _marked(spark, sf_dir, suffix: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("response_id"), F.expr(f"concat(text, {suffix})").alias("response"))


@_query("SELECT doc_id AS response_id, 'numbered' AS format, cast(doc_id % 7 AS VARCHAR) AS id, cast(length(text) + 1 AS BIGINT) AS start, cast(length(text) + 4 AS BIGINT) AS \"end\" FROM documents")
def citations_numbered(spark, sf_dir):
    out = citations.parse(_marked(spark, sf_dir, "' [', doc_id % 7, ']'"))
    return out.select("response_id", "format", "id", "start", "end")


_FORMATS = " [1-3] x [4, 7] (Smith et al., 2023) y [Source: Wiki A] z [Ref 9] (Source 2) ^[5] [^6] w [Name] https://e.org/a. [l](https://e.org/b)"


@_query("""SELECT f AS format, i AS id, count(*) AS n FROM documents, (VALUES ('numbered', '1'), ('numbered', '2'), ('numbered', '3'), ('numbered', '4'), ('numbered', '7'), ('parenthetical', 'Smith et al. 2023'),
    ('named', 'Wiki A'), ('numbered', '9'), ('parenthetical', '2'), ('footnote', '5'), ('footnote', '6'), ('named', 'Name'), ('url', 'https://e.org/a.'), ('url', 'https://e.org/b')) v(f, i) GROUP BY ALL""")
def citation_formats(spark, sf_dir):
    """Every built-in format, appended to every document."""
    out = citations.parse(_marked(spark, sf_dir, X.quoted(_FORMATS)))
    return out.groupBy("format", "id").agg(F.count("*").alias("n"))


@_query(r"""SELECT item_id AS response_id, regexp_replace(string_split_regex(rtrim(text, '.'), '[.!?]\s|\n\n')[-1], '^\s+|\s+$', '', 'g') AS covered_text FROM benchmark""")
def covered_text(spark, sf_dir):
    r = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("response_id"), F.expr("concat(rtrim('.', text), ' [1].')").alias("response"))
    return citations.parse(r).select("response_id", "covered_text")


@_query("""WITH s AS (SELECT source, cast(doc_id AS VARCHAR) AS sid, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents),
    b AS (SELECT item_id, 'src' || (item_id % 20) AS grp, item_id % 9 + 1 AS k FROM benchmark)
    SELECT item_id AS response_id, coalesce(x.sid, y.sid) AS resolved_id FROM b LEFT JOIN s x ON x.source = grp AND x.sid = cast(k AS VARCHAR) LEFT JOIN s y ON y.source = grp AND y.p = k""")
def citation_resolution(spark, sf_dir):
    """Numbers by id first, then by position."""
    r = benchmark_responses(spark, sf_dir).withColumn("response", F.expr("concat(response, ' [', response_id % 9 + 1, ']')"))
    found = citations.parse(r).join(r.select("response_id", "grp"), "response_id")
    return citations.resolve(found, document_sources(spark, sf_dir), key="grp").select("response_id", "resolved_id")


@_query(r"""WITH p AS (SELECT conv_id * 100000 + turn AS response_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM conversations)
    SELECT response_id, cast(unnest(range(0, len(parts))) AS BIGINT) AS seg_seq, unnest(parts) AS segment FROM p""")
def paragraph_split(spark, sf_dir):
    return claims.split(_turns(spark, sf_dir), "paragraph").select("response_id", "seg_seq", "segment")


def _turns(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * 100000 + F.col("turn")).alias("response_id"), F.col("text").alias("response"))


@_query(r"""SELECT item_id, regexp_replace(regexp_replace('See [3] (Smith, 2020) ' || text || ' ^4 [Source: a b] end [^2].', '\[\^?\d+\]|\^\d+|\[Source:\s*[^\]]+\]|\([A-Z][a-z]+(?:\s+et\s+al\.?)?,?\s*\d{4}\)', '', 'g'), '\s{2,}', ' ', 'g') AS stripped FROM benchmark""")
def strip_markers(spark, sf_dir):
    whole = "concat('See [3] (Smith, 2020) ', text, ' ^4 [Source: a b] end [^2].')"
    return table(spark, sf_dir, "benchmark").select("item_id", F.expr(X.strip_markers(whole)).alias("stripped"))


@_query("""SELECT item_id, k, NOT (k IN (1, 2, 3, 4, 5)) AS is_factual FROM benchmark, range(0, 7) t(k)""")
def factual_filter(spark, sf_dir):
    heads = ["'Then ', text", "text, '?'", "'I think ', text", "'It is perhaps so: ', text", "'In summary, ', text", "'As an AI, ', text", "'Next week ', text"]
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.expr("array(" + ", ".join(f"struct({k}L as k, concat({h}) as x)" for k, h in enumerate(heads)) + ")")).alias("r"))
    return rows.select("item_id", "r.k", F.expr(X.factual("r.x")).alias("is_factual"))


@_query()
def attribution_rank(spark, sf_dir):
    """All strategy scores, confidence, match type and rank of every claim of a passage and candidate document. The
    documents of a source are one corpus, prepared once for all passages that it judges."""
    r = benchmark_responses(spark, sf_dir).withColumn("response", F.expr("concat(rtrim('.', response), ' [', response_id % 9 + 1, '].')"))
    out = engine.cite(r.withColumnRenamed("grp", "corpus_id"), document_sources(spark, sf_dir).withColumnRenamed("grp", "corpus_id")).attributions
    return _ranked(out)


def _ranked(out: DataFrame) -> DataFrame:
    return out.select("response_id", "claim_idx", F.col("source_pos").cast("long").alias("source_pos"), *(F.round(c, 6).alias(c) for c in (*attribution.STRATEGIES, "confidence")), "primary_match_type", F.col("rank").cast("long").alias("rank"))




from . import grounding  # noqa: E402, F401  (adds its queries, which build on what is above)
