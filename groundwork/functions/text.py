"""Text and vector functions as Spark SQL expressions. Each takes and returns SQL text, so that plans stay in the JVM."""

from __future__ import annotations

#: The default stopwords.
STOPWORDS = (
    "the a an is are was were in on at to for of and or but not with this that it from by as be been being have has "
    "had do does did will would shall should may might must can could its their they them he she him her his we us "
    "our you your i me my so if then than no yes about up out into over after before between under above below each "
    "all both few more most other some such only also just very too any same"
).split()

#: Citation markers, removed from claims in this order.
MARKERS = [
    r"\[\^?\d+\]", r"\^\[\d+\]", r"\^\d+", r"(?i)\[(?:Source|Ref)\s+\d+\]", r"(?i)\[Source:\s*[^\]]+\]",
    r"(?i)\[Doc:\s*[^\]]+\]", r"(?i)\(Source\s+\d+\)", r"\([A-Z][a-z]+(?:\s+et\s+al\.?)?,?\s*\d{4}\)",
]
#: White space as the source format counts it.
WHITE = "[\\t\\n\\x0B\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

#: Phrases that mark a sentence as not factual.
HEDGES_FIRST = ["i think", "i believe", "it seems", "it appears"]
HEDGES_ANYWHERE = ["possibly", "perhaps", "might be", "may be", "could be", "arguably"]
META_FIRST = [
    "as mentioned", "as discussed", "in summary", "to summarize", "in conclusion", "as noted above", "let me explain",
    "i'll now describe", "as i mentioned",
]
TRANSITIONS_FIRST = [
    "moving on", "next", "additionally", "furthermore", "moreover", "however", "on the other hand", "that said",
    "let's move on",
]
GREETINGS_WHOLE = [
    "sure", "great question", "good question", "i hope this helps", "let me know if you have questions",
    "happy to help", "you're welcome", "thanks for asking",
]
DISCLAIMERS_FIRST = ["i'm an ai", "i am an ai", "as an ai", "i cannot guarantee", "i don't have personal opinions"]
DISCLAIMERS_ANYWHERE = ["my training data"]
DISCLAIMERS_START = ["please note that i'm an ai"]


def quoted(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values) -> str:
    return "cast(array() as array<string>)" if not values else "array(" + ", ".join(map(quoted, values)) + ")"


def normalize(x: str) -> str:
    """Lower case, everything but ASCII word characters to single spaces, trimmed."""
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9_]+', ' '))"


def tokenize(x: str) -> str:
    """Words of ASCII letters, digits, _, ' and -, in lower case."""
    return f"regexp_extract_all(lower({x}), {quoted(chr(91) + 'a-z0-9_' + chr(39) + '-]+')}, 0)"


def tokenize_filtered(x: str, stopwords=STOPWORDS) -> str:
    return f"filter({tokenize(x)}, t -> not array_contains({literal_array(stopwords)}, t))" if stopwords else tokenize(x)


def ngrams(tokens: str, n: int) -> str:
    """Contiguous n-grams joined by spaces."""
    return (
        f"transform(array({tokens}), w -> case when size(w) >= {n} then transform(sequence(0, size(w) - {n}), "
        f"i -> array_join(slice(w, i + 1, {n}), ' ')) else cast(array() as array<string>) end)[0]"
    )


def jaccard(a: str, b: str) -> str:
    """Jaccard similarity of two arrays as sets; two empty ones have 0."""
    return f"coalesce(try_divide(cast(size(array_intersect({a}, {b})) as double), size(array_union({a}, {b}))), 0D)"


def containment(claim: str, source: str) -> str:
    """The share of claim tokens, with repeats, that the source has."""
    return f"coalesce(try_divide(cast(size(filter({claim}, t -> array_contains({source}, t))) as double), size({claim})), 0D)"


def ngram_overlap(claim: str, source: str) -> str:
    """Weighted Jaccard of 1- to 3-grams, blended with containment, over token arrays."""
    parts = " + ".join(f"{w}D * {jaccard(ngrams(claim, n), ngrams(source, n))}" for n, w in ((1, 0.2), (2, 0.3), (3, 0.5)))
    return f"case when size({claim}) = 0 or size({source}) = 0 then 0D else 0.6D * ({parts}) + 0.4D * {containment(claim, source)} end"


def overlaps_of(c: str, s: str) -> dict[str, str]:
    """Columns i1, the shared 1-grams, and i2 and i3, how many 2- and 3-grams are shared, of c1 to c3 and s1 to s3, which
    are distinct. The short side is the one that is hashed."""
    return {"i1": f"array_intersect({s}1, {c}1)"} | {f"i{n}": f"size(array_intersect({s}{n}, {c}{n}))" for n in (2, 3)}


def jaccard_of(c: str, s: str, n: int) -> str:
    """Jaccard similarity of n-grams over prepared columns and overlaps_of."""
    both = "size(i1)" if n == 1 else f"i{n}"
    return f"coalesce(try_divide(cast({both} as double), size({c}{n}) + size({s}{n}) - {both}), 0D)"


def containment_of(c: str) -> str:
    """The share of c0, a claim's tokens with repeats, that the source has."""
    return f"coalesce(try_divide(cast(case when size({c}0) = size({c}1) then size(i1) else size(filter({c}0, t -> array_contains(i1, t))) end as double), size({c}0)), 0D)"


def ngram_overlap_of(c: str, s: str) -> str:
    """ngram_overlap over prepared columns and overlaps_of."""
    parts = " + ".join(f"{w}D * {jaccard_of(c, s, n)}" for n, w in ((1, 0.2), (2, 0.3), (3, 0.5)))
    return f"case when size({c}1) = 0 or size({s}1) = 0 then 0D else 0.6D * ({parts}) + 0.4D * {containment_of(c)} end"


def cosine(a: str, b: str) -> str:
    """Cosine of two arrays of doubles; 0 if lengths differ, or one is empty or zero."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> double(p) * double(q)), 0D, (s, v) -> s + v)"
    return f"case when size({a}) <> size({b}) or size({a}) < 1 then 0D else coalesce(try_divide({dot(a, b)}, sqrt({dot(a, a)}) * sqrt({dot(b, b)})), 0D) end"


def term_frequency(tokens: str) -> str:
    """Map of term to count / number of tokens."""
    return (
        f"map_from_entries(transform(array_distinct({tokens}), t -> struct(t, "
        f"cast(size(filter({tokens}, u -> u = t)) as double) / size({tokens}))))"
    )


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, {quoted(f'^{WHITE}+|{WHITE}+' + chr(92) + 'z')}, '')"


def strip_markers(x: str) -> str:
    for m in MARKERS:
        x = f"regexp_replace({x}, {quoted(m)}, '')"
    return trimmed(f"regexp_replace({x}, {quoted(WHITE + '{2,}')}, ' ')")


def factual(x: str) -> str:
    """Whether a stripped sentence states something: no question, greeting, hedge, disclaimer or talk about the talk."""
    edge, start = "(?![A-Za-z0-9_])", "(?<![A-Za-z0-9_])"
    any_of = lambda values: "(?:" + "|".join(values) + ")"
    first = any_of(HEDGES_FIRST + META_FIRST + DISCLAIMERS_FIRST)
    anywhere = any_of(HEDGES_ANYWHERE + DISCLAIMERS_ANYWHERE)
    says = f"(?is)^{first}{edge}|{start}{anywhere}{edge}|^{any_of(DISCLAIMERS_START)}|^{any_of(GREETINGS_WHOLE)}[.!]*\\z"
    short = f"size(split({x}, {quoted(WHITE + '+')})) <= 6 and regexp_like({x}, {quoted(f'(?i)^{any_of(TRANSITIONS_FIRST)}{edge}')})"
    return f"not ({x} = '' or endswith({x}, '?') or regexp_like({x}, {quoted(says)}) or {short})"
