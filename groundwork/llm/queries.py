"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, ctw, neardup_graph, ngram_join, packing, pii, secrets, sentencepiece_ac, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ctw_scoring(spark, sf_dir):
    """Code lengths of all texts under a context-tree-weighting model of the training texts."""
    return ctw.score_corpus(_table(spark, sf_dir, "documents"))


def op2_hash_prefix_forest(spark, sf_dir):
    """The 20 nearest of every vector whose id is divisible by 20, by inner product."""
    rows = _table(spark, sf_dir, "embeddings")
    return ann_forest.search(rows, rows.where("vec_id % 20 = 0"), k=20)


def op3_best_fit_packing(spark, sf_dir):
    """All texts in sequences of at most 2048 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more."""
    return ngram_join.components(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark, sf_dir):
    """Secrets of every text, with parts that complete each other."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark, sf_dir):
    """Vectors of equal labels with a cosine of 0.98 or more."""
    return neardup_graph.links(_table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark, sf_dir):
    """Toxicity of every text by a model of the labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.classify(docs, docs, _table(spark, sf_dir, "labels"))
    return scored.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))


def op8_pii_surrogates(spark, sf_dir):
    """Every text with surrogates for its personal data, and how many of each kind."""
    return pii.report(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op9_sentencepiece(spark, sf_dir):
    """Ids of every text by the Viterbi encoder, as a checksum, and whether decoding gives the text back."""
    return sentencepiece_ac.digest(_table(spark, sf_dir, "documents"))


def op10_warc_archives(spark, sf_dir):
    """All pages written to dictionary-compressed archives and read back."""
    index = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ctw_scoring, op2_hash_prefix_forest, op3_best_fit_packing, op4_ngram_jaccard_join, op5_secret_scan,
        op6_embedding_near_dedup, op7_toxicity, op8_pii_surrogates, op9_sentencepiece, op10_warc_archives,
    )
}

ORACLE_SQL = {
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS grams FROM w),
        g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
        n AS (SELECT doc_id, len(grams) AS n FROM s),
        shared AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
        h AS (SELECT g.* FROM g JOIN shared USING (gram)),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM h a JOIN h b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
        r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
        SELECT n.doc_id, cast(n.n AS BIGINT) AS n_shingles, m.c AS component_id FROM n JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)""",
    "op5_secret_scan": secrets.ORACLE_SQL,
    "op6_embedding_near_dedup": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c),
        m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, cast(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op10_warc_archives": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, cast(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > first THEN first END AS refers_to FROM f""",
}
