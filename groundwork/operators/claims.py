"""Claim extraction: segments by an Arrow pass (the sentence scan keeps state), all else as expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import factual, strip_markers
from .citations import _W, _strip, utf16

#: Words whose dot ends no sentence.
ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof sr jr st e.g i.e vs etc al approx dept est inc ltd co corp jan feb mar apr jun jul aug sep oct "
    "nov dec fig vol no op ed rev gen".split()
)
_PARAGRAPH = re.compile(rf"\n{_W}*\n")
_ITEM = re.compile(rf"(?:[-*]{_W}+|\d+[.)]{_W}+)", re.A)
_MARK = re.compile(r"\.{3}|[.!?;]")
_CLAUSE = re.compile(rf",{_W}+(?:and|but|or|yet){_W}+|;{_W}+")
_SPACES = re.compile(f"{_W}*")
_LINK = re.compile(rf"https?://{_W.replace('[', '[^', 1)}*\Z")
_COUNTRY = re.compile(r"[A-Z]\.[A-Z]\.?\Z")
_LETTERS = re.compile(r"[A-Za-z.]*\Z")
LOOK_BACK = 50


def _paragraphs(text: str):
    at = 0
    for m in [*_PARAGRAPH.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            yield at, text[at:end]
        at = m.end() if m else end


def _ends_here(line: str, i: int) -> bool:
    """Whether the dot at i can end a sentence."""
    if line[i - 1 : i].isascii() and line[i - 1 : i].isdigit() and line[i + 1 : i + 2].isascii() and line[i + 1 : i + 2].isdigit():
        return False
    before = line[max(0, i - LOOK_BACK) : i]
    if _LINK.search(before):
        return False
    # the whole run of letters and dots counts, however long
    start = i
    while start > 0 and (line[start - 1] == "." or (line[start - 1].isascii() and line[start - 1].isalpha())):
        start -= 1
    word = line[start:i]
    low = word.lower()
    return not word or not (low in ABBREVIATIONS or low.removesuffix(".") in ABBREVIATIONS or _COUNTRY.match(word + "."))


def _line(line: str, offset: int):
    """Sentences of a line: after . ! ? at its end or before white space, and after ; before white space."""
    start = _SPACES.match(line).end()
    white = re.compile(_W)
    for m in _MARK.finditer(line):
        i = m.start()
        if i < start or m.group() == "...":
            continue
        after = i + 1
        space = white.match(line, after)
        if line[i] == ";":
            ends = bool(space)
        else:
            ends = (line[i] != "." or _ends_here(line, i)) and (after >= len(line) or bool(space))
        if ends:
            if part := _strip(line[start:after]):
                yield part, offset + start, offset + start + len(part)
            start = _SPACES.match(line, after).end()
    if rest := _strip(line[start:]):
        yield rest, offset + start, offset + start + len(rest)


def sentences(text: str) -> list[tuple[str, int, int]]:
    """(text, start, end) of the sentences; every line is apart, a list item is one sentence."""
    out = []
    for base, paragraph in _paragraphs(text):
        at = 0
        for line in paragraph.split("\n"):
            body = _strip(line)
            item = _ITEM.match(body)
            if item:
                part = _strip(body[item.end() :])
                if part:
                    start = base + paragraph.index(body, at) + item.end()
                    out.append((part, start, start + len(part)))
            elif body:
                out += _line(line, base + at)
            at += len(line) + 1
    return out


def clauses(segment: tuple[str, int, int]) -> list[tuple[str, int, int]]:
    text, start, end = segment
    parts = _CLAUSE.split(text)
    if len(parts) == 1:
        return [segment]
    out, at = [], 0
    for part in filter(None, map(_strip, parts)):
        k = text.index(part, at)
        out.append((part, start + k, start + k + len(part)))
        at = k + len(part)
    return out


def paragraphs(text: str) -> list[tuple[str, int, int]]:
    out, done = [], 0
    for base, paragraph in _paragraphs(text):
        if part := _strip(paragraph):
            at = text.index(part, done)
            out.append((part, at, at + len(part)))
        done = base + len(paragraph)
    return out


def segments(text: str, granularity: str = "sentence") -> list[tuple[str, int, int]]:
    if granularity == "paragraph":
        return paragraphs(text)
    found = sentences(text)
    return [c for s in found for c in clauses(s)] if granularity == "clause" else found


def split(responses: DataFrame, granularity: str = "sentence") -> DataFrame:
    """(response_id, seg_seq, segment, start, end) of responses(response_id, response); offsets are UTF-16 units."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                at = utf16(text)
                rows += [(key, i, s, at(a), at(b)) for i, (s, a, b) in enumerate(segments(text, granularity))]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["response_id", "seg_seq", "segment", "start", "end"])

    own = responses.select("response_id", "response")
    return own.mapInArrow(run, f"response_id {own.schema[0].dataType.simpleString()}, seg_seq long, segment string, start long, end long")


def extract(responses: DataFrame, granularity: str = "sentence") -> DataFrame:
    """(response_id, claim_idx, text, segment, start, end, is_factual); segments of markers only are no claims."""
    cut = split(responses, granularity).withColumn("text", F.expr(strip_markers("segment"))).where("text <> ''")
    order = Window.partitionBy("response_id").orderBy("seg_seq")
    return cut.select("response_id", (F.row_number().over(order) - 1).cast("long").alias("claim_idx"), "text", "segment", "start", "end", F.expr(factual("text")).alias("is_factual"))
