"""Citation detection and resolution.

Detection is one pass of patterns over each text (an Arrow batch at a time); overlaps, order and covered text follow
from spans. Resolution is a join on the response: every rule is a predicate, the least rule that holds wins, then the
first source, by one aggregate over (rule, position).
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import CitationPattern, CiteOptions

#: White space as the source format counts it.
_W = "[\\t\\n\\x0b\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_N = _W.replace("[", "[^", 1)
_I = re.ASCII | re.IGNORECASE
RANGE_WIDTH = 20
#: Numbers of more digits make no range: they are not told apart exactly by those who count in doubles.
RANGE_DIGITS = 15
#: Fixed values: (format, pattern, ids of a match) in order of priority; formats whose ids share one span come as lists.
DETECTORS = [
    ("footnote", re.compile(r"\[\^(\d+)\]|\^\[(\d+)\]|\^(\d+)(?=\W|\Z)", re.A), lambda m: [m[m.lastindex]]),
    ("numbered", re.compile(rf"\[(\d+){_W}*-{_W}*(\d+)\]", re.A), lambda m: _range(m[1], m[2])),
    ("numbered", re.compile(rf"\[(\d+(?:{_W}*,{_W}*\d+)+)\]", re.A), lambda m: re.findall(r"\d+", m[1], re.A)),
    ("numbered", re.compile(rf"\[(?:Source|Ref){_W}+(\d+)\]", _I), lambda m: [m[1]]),
    ("numbered", re.compile(r"\[(\d+)\]", re.A), lambda m: [m[1]]),
    ("named", re.compile(rf"\[(?:Source|Doc):{_W}*([^\]]+)\]", _I), lambda m: [_strip(m[1])]),
    ("named", re.compile(r"\[([A-Za-z][A-Za-z0-9 ]{1,60})\](?!\()", re.A), lambda m: [_strip(m[1])]),
    ("parenthetical", re.compile(rf"\(Source{_W}+(\d+)\)", _I), lambda m: [m[1]]),
    ("parenthetical", re.compile(rf"\(([A-Z][a-z]+(?:{_W}+et{_W}+al\.?)?,?{_W}*\d{{4}})\)", re.A), lambda m: [re.sub(rf",{_W}*", " ", m[1], count=1)]),
    ("url", re.compile(rf"\[([^\]]+)\]\((https?://(?:(?!\)){_N})+)\)", re.A), lambda m: [m[2]]),
    ("url", re.compile(rf"(?<!\]\()https?://(?:(?!\)){_N})+", re.A), lambda m: [m[0]]),
]
#: Detectors that may share a span that is taken already.
_SHARING = {1, 2}
_BOUNDARY = re.compile(rf"[.!?]{_W}|\n\n")
_EDGE = re.compile(rf"^{_W}+|{_W}+\Z")


def _strip(s: str) -> str:
    return _EDGE.sub("", s)


def _range(first: str, last: str) -> list[str]:
    if max(len(first.lstrip("0")), len(last.lstrip("0"))) > RANGE_DIGITS:
        return []
    low, high = int(first), int(last)
    return [str(n) for n in range(low, high + 1)] if 0 <= high - low < RANGE_WIDTH else []


class Taken:
    """Spans that are taken; they never overlap, so the neighbours of a span decide."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def overlaps(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a)
        return (k > 0 and self.ends[k - 1] > a) or (k < len(self.starts) and self.starts[k] < b)

    def has(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a)
        return k > 0 and self.starts[k - 1] == a and self.ends[k - 1] == b

    def add(self, a: int, b: int) -> None:
        k = bisect_right(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def detect(text: str, patterns: tuple[CitationPattern, ...] = ()) -> list[tuple]:
    """(format, id, start, end, covered text, covered start) of all citations, in order of their starts.

    A user's patterns come before all others. Offsets count code points.
    """
    taken, found = Taken(), []
    for p in patterns:
        for m in re.finditer(p.pattern, text, p.flags):
            if m.end() > m.start() and not taken.overlaps(*m.span()):
                taken.add(*m.span())
                found.append((*p.extract(m), *m.span()))
    for k, (kind, pattern, ids) in enumerate(DETECTORS):
        for m in pattern.finditer(text):
            a, b = m.span()
            names = ids(m)
            known = taken.has(a, b)
            if not names or (taken.overlaps(a, b) and not (known and k in _SHARING)):
                continue
            if not known:
                taken.add(a, b)
            found += [(kind, name, a, b) for name in names]
    found.sort(key=lambda c: c[2])
    ends = [m.end() for m in _BOUNDARY.finditer(text)]
    out = []
    for kind, name, a, b in found:
        k = bisect_right(ends, a)
        begin = ends[k - 1] if k else 0
        lead = re.compile(f"{_W}*").match(text, begin, a)
        begin = lead.end()
        out.append((kind, name, a, b, re.sub(rf"{_W}+\Z", "", text[begin:a]), begin))
    return out


def utf16(text: str):
    """A function that gives the place in UTF-16 units of a place in code points of the text, from one table."""
    if text.isascii():
        return lambda place: place
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table = np.concatenate([[0], np.cumsum(1 + (points > 0xFFFF))])
    return lambda place: int(table[place])


SCHEMA = "response_id {}, cit_idx long, format string, id string, start long, end long, covered_text string, covered_start long"


def parse(responses: DataFrame, options: CiteOptions = CiteOptions()) -> DataFrame:
    """One row per citation of responses(response_id, response). Offsets count UTF-16 units. Null text has none."""
    patterns = options.citation_patterns

    def run(batches):
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0), batch.column(1)):
                text = value.as_py() or ""
                at = utf16(text)
                for i, (kind, name, a, b, covered, begin) in enumerate(detect(text, patterns)):
                    rows.append((key, i, kind, name, at(a), at(b), covered, at(begin)))
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[]] * 8
            columns[0] = [x.as_py() for x in columns[0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["response_id", "cit_idx", "format", "id", "start", "end", "covered_text", "covered_start"])

    own = responses.select("response_id", "response")
    return own.mapInArrow(run, SCHEMA.format(own.schema[0].dataType.simpleString()))


#: Predicates by rule, in order; c is a citation, s a source of its response.
RULES = {
    2: "c.format in ('numbered', 'footnote', 'parenthetical') and s.source_id = c.id",
    3: "c.format in ('numbered', 'footnote') and s.source_pos = try_cast(c.id as bigint)",
    4: "c.format = 'parenthetical' and s.source_pos = try_cast(regexp_extract(c.id, '^\\\\s*(\\\\d+)', 1) as bigint)",
    5: "c.format = 'named' and lower(s.source_id) = lower(c.id)",
    6: "c.format = 'named' and lower(s._title) = lower(c.id)",
    7: "c.format = 'named' and s._title <> '' and (contains(lower(s._title), lower(c.id)) or contains(lower(c.id), lower(s._title)))",
    8: "c.format = 'parenthetical' and c.id rlike '^.+?\\\\s+\\\\d{4}$' and contains(lower(s._author), lower(regexp_extract(c.id, '^(.+?)\\\\s+(\\\\d{4})$', 1))) and s._year = regexp_extract(c.id, '^(.+?)\\\\s+(\\\\d{4})$', 2)",
    9: "c.format = 'url' and s._url = c.id",
    10: "c.format = 'url' and s._url <> '' and (contains(s._url, c.id) or contains(c.id, s._url))",
    11: "s.source_id = c.id",
}


METADATA = ("title", "author", "year", "url")


def metadata_of(sources: DataFrame) -> list:
    """_title, _author, _year and _url of sources, as text: metadata is a struct with any of them, a map, a JSON text or
    missing. What is not there is null."""
    kind = next((f.dataType for f in sources.schema.fields if f.name == "metadata"), None)
    out = []
    for name in METADATA:
        if isinstance(kind, T.StructType) and name in kind.names:
            value = F.col(f"metadata.`{name}`").cast("string")
        elif isinstance(kind, T.MapType):
            value = F.try_element_at("metadata", F.lit(name)).cast("string")
        elif isinstance(kind, T.StringType):
            value = F.get_json_object("metadata", f"$.{name}")
        else:
            value = F.lit(None).cast("string")
        out.append(value.alias(f"_{name}"))
    return out


def resolve(citations: DataFrame, sources: DataFrame, options: CiteOptions = CiteOptions(), key: str = "response_id") -> DataFrame:
    """citations with resolved_pos and resolved_id, null where no source is meant.

    sources(key, source_pos from 1, source_id[, metadata]); metadata_of says what metadata can be, other columns are
    ignored. An id in the source map means its target, or nothing. citations hold the key too.
    """
    rule = "case " + " ".join(f"when {p} then {n}" for n, p in RULES.items()) + " end"
    own = citations
    if options.source_map:
        pairs = F.create_map(*(F.lit(x) for kv in options.source_map.items() for x in kv))
        own = own.withColumn("_mapped", F.try_element_at(pairs, "id"))
        rule = f"case when c._mapped is not null then case when s.source_id = c._mapped then 1 end else {rule} end"
    place = ["response_id", "cit_idx"]
    from_ = sources.select(F.col(key).alias("_key"), F.col("source_pos").cast("long").alias("source_pos"), F.col("source_id").cast("string").alias("source_id"), *metadata_of(sources))
    pairs = own.withColumn("_key", F.col(key)).alias("c").join(from_.alias("s"), "_key").select("c.response_id", "c.cit_idx", "s.source_pos", "s.source_id", F.expr(rule).alias("_rule"))
    best = pairs.where("_rule is not null").groupBy(*place).agg(F.min(F.struct("_rule", "source_pos", "source_id")).alias("_best"))
    out = citations.join(best, place, "left").withColumn("resolved_pos", F.col("_best.source_pos")).withColumn("resolved_id", F.col("_best.source_id"))
    return out.drop("_best")
