"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans (assign, access, hex) are always reported. Parts that are weak alone (a user or client identifier, an
endpoint, a short secret) are joined to the other parts of their text by interval: a weak part is reported only when
a part that completes it begins within `scope` code points. A text's parts are few and stay in its row, so nothing is
shuffled and a very long or often repeated text costs no more than its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]{4,}"""
IDENTITY = r"""(?i)\b(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
SHORT = r"""(?i)\b(?:password|passwd|pwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[^\s"'<>]{6,}"""
#: Base kinds in the order of equal starts, then those that linking adds.
KINDS = ["assign", "access", "hex", "endpoint", "identity", "short"]
#: What completes a weak part.
COMPLETES = {"endpoint": ["assign", "short"], "identity": ["assign", "short"], "short": ["access", "identity", "endpoint"]}
_SPANS = "array<struct<k:int,s:int,e:int>>"


def _lit(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern + '"' if '"' not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(text: str, pattern: str, kind: int, keep: str = "true") -> str:
    """SQL for the spans of all matches of a pattern: lengths between and of matches, summed from the left."""
    p = _lit(pattern)
    return f"""case when {text} rlike {p} then aggregate(
        zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, m) -> struct(length(g) as g, m as m)),
        struct(0 as at, cast(array() as {_SPANS}) as out),
        (a, x) -> struct(
            a.at + x.g + coalesce(length(x.m), 0) as at,
            case when x.m is not null and {keep.format(m="x.m")}
                then concat(a.out, array(struct({kind} as k, a.at + x.g as s, a.at + x.g + length(x.m) as e))) else a.out end as out),
        a -> a.out) else cast(array() as {_SPANS}) end"""


def _joined(spans_sql: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return (
        f"array_join(transform(array_sort({spans_sql}, (a, b) -> case when a.s <> b.s then a.s - b.s when a.k <> b.k then a.k - b.k else a.e - b.e end), "
        f"x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"
    )


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """One row per row of docs(doc_id, text): counts of base kinds, base_sha256, spans, and n_linked (spans added).

    Null text counts as empty: no spans, the checksum of an empty string. Spans count code points. Rows that repeat
    each get a row; a null doc_id is kept; other columns are ignored.
    """
    out = docs.select("doc_id", F.expr("coalesce(text, '')").alias("_t"))
    value = f"length(regexp_extract({{m}}, {_lit(ASSIGN)}, 2)) >= 12"
    base = f"concat({spans('_t', ASSIGN, 0, value)}, {spans('_t', ACCESS, 1, 'length({m}) >= 18')}, {spans('_t', HEX, 2)})"
    weak = f"concat({spans('_t', ENDPOINT, 3)}, {spans('_t', IDENTITY, 4)}, {spans('_t', SHORT, 5)})"
    out = out.withColumn("_base", F.expr(base)).withColumn(
        "_weak",
        F.expr(f"""case when _t rlike '[:=]' then filter({weak}, w ->
            not exists(_base, b -> b.k < 2 and b.s < w.e and w.s < b.e)) else cast(array() as {_SPANS}) end"""),
    )
    code = {k: i for i, k in enumerate(KINDS)}
    completes = " or ".join(
        f"(w.k = {code[k]} and o.k in ({', '.join(str(code[x]) for x in v)}))" for k, v in COMPLETES.items()
    )
    out = out.withColumn("_added", F.expr(f"""case when size(_weak) = 0 then _weak else filter(_weak, w ->
        exists(_weak, o -> ({completes}) and abs(o.s - w.s) <= {scope}) or exists(_base, o -> ({completes}) and abs(o.s - w.s) <= {scope})) end"""))
    count = lambda k: F.expr(f"cast(size(filter(_base, x -> x.k = {k})) as bigint)")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.expr(f"sha2(cast({_joined('_base')} as binary), 256)").alias("base_sha256"),
        F.expr(_joined("concat(_base, _added)")).alias("spans"),
        F.expr("cast(size(_added) as bigint)").alias("n_linked"),
    )


def _oracle(scope: int = 200) -> str:
    """DuckDB SQL for scan: spans as rows, linked by joins on their starts."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = ", ".join(f"({i}, {q(k)}, {q(p)})" for i, (k, p) in enumerate(zip(KINDS, (ASSIGN, ACCESS, HEX, ENDPOINT, IDENTITY, SHORT))))
    completes = ", ".join(f"({KINDS.index(k)}, {KINDS.index(o)})" for k, v in COMPLETES.items() for o in v)
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e){0}, '')"
    return f"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        p(k, kind, pattern) AS (VALUES {kinds}),
        g AS (SELECT r, k, kind, pattern, list_transform(string_split_regex(t, pattern), lambda x: length(x)) AS gaps, regexp_extract_all(t, pattern) AS hits FROM t, p),
        u AS (SELECT r, k, kind, pattern, gaps, list_transform(hits, lambda x: length(x)) AS sizes, hits, unnest(range(1, len(hits) + 1)) AS i FROM g),
        m AS (SELECT r, k, kind, hits[i] AS m, pattern, cast(list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS BIGINT) AS s, sizes[i] AS n FROM u),
        x AS (SELECT r, k, kind, s, s + n AS e FROM m WHERE CASE k WHEN 0 THEN length(regexp_extract(m, pattern, 2)) >= 12 WHEN 1 THEN n >= 18 ELSE true END),
        w AS (SELECT * FROM x WHERE k >= 3 AND NOT EXISTS (SELECT 1 FROM x b WHERE b.r = x.r AND b.k < 2 AND b.s < x.e AND x.s < b.e)),
        o AS (SELECT * FROM x WHERE k < 3 UNION ALL SELECT * FROM w),
        c(k, o) AS (VALUES {completes}),
        a AS (SELECT * FROM w WHERE EXISTS (SELECT 1 FROM o JOIN c ON c.o = o.k WHERE o.r = w.r AND c.k = w.k AND abs(o.s - w.s) <= {scope})),
        f AS (SELECT * FROM x WHERE k < 3 UNION ALL SELECT * FROM a)
        SELECT any_value(doc_id) AS doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
            sha256({listed.format(' FILTER (k < 3)')}) AS base_sha256, {listed.format('')} AS spans, count(*) FILTER (k > 2) AS n_linked
        FROM t LEFT JOIN f USING (r) GROUP BY r"""


ORACLE_SQL = _oracle()
