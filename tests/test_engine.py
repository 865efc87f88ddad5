import random

import pytest

from groundwork.engine import Citer, attribute, cite
from groundwork.functions.fuzzy import best_window, longest_run
from groundwork.operators.citations import detect
from groundwork.operators.claims import segments
from groundwork.options import CitationPattern, CiteOptions

PARIS = [(1, "1", "Paris is the capital and most populous city of France."), (2, "2", "The population of Paris was approximately 2.1 million in 2023."), (3, "3", "The Eiffel Tower is located in Paris, France.")]


def ids(text, **kw):
    return [(f, i) for f, i, *_ in detect(text, **kw)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Some claim [1, 2, 3].", [("numbered", "1"), ("numbered", "2"), ("numbered", "3")]),
        ("Some claim [1-3].", [("numbered", "1"), ("numbered", "2"), ("numbered", "3")]),
        ("x [5-3] y", []),
        ("a [Source 1] b [Ref 2]", [("numbered", "1"), ("numbered", "2")]),
        ("[Source: Wikipedia] [Doc: API Reference] [Wikipedia]", [("named", "Wikipedia"), ("named", "API Reference"), ("named", "Wikipedia")]),
        ("x (Smith 2023) (Johnson, 2024)", [("parenthetical", "Smith 2023"), ("parenthetical", "Johnson 2024")]),
        ("x (Source 1)", [("parenthetical", "1")]),
        ("[^1] ^[2] ^3 here", [("footnote", "1"), ("footnote", "2"), ("footnote", "3")]),
        ("https://example.com/page [here](https://example.com)", [("url", "https://example.com/page"), ("url", "https://example.com")]),
        ("array[0]", [("numbered", "0")]),
        ("", []),
    ],
)
def test_detect(text, expected):
    assert ids(text) == expected


def test_custom_pattern_first_and_no_empty_match():
    p = CitationPattern("ref", r"\{ref:(\w+)\}|")
    assert ids("See {ref:abc} [1]", patterns=(p,)) == [("custom", "abc"), ("numbered", "1")]


def test_covered_text():
    found = detect("First claim [1], second claim [2].")
    assert [c[4] for c in found] == ["First claim", "First claim [1], second claim"]
    assert detect("First sentence. Second sentence [1].")[0][4] == "Second sentence"


@pytest.mark.parametrize(
    "text, kind, n",
    [
        ("Dr. Smith went to the store. He bought milk.", "sentence", 2),
        ("Some items, e.g. apples, are healthy.", "sentence", 1),
        ("The value is 3.14 and growing. Next sentence.", "sentence", 2),
        ("He said... then left.", "sentence", 1),
        ("Paris is in France; London is in England.", "sentence", 2),
        ("The product launched in 2023, and it has since gained 1 million users.", "clause", 2),
        ("One.\n\nTwo.", "paragraph", 2),
        ("- a b\n- c d\n1. e", "sentence", 3),
        ("See https://a.b/c. Next one", "sentence", 1),
        ("   \n ", "sentence", 0),
    ],
)
def test_segments(text, kind, n):
    found = segments(text, kind)
    assert len(found) == n and all(text[a:b] == s for s, a, b in found)


def plain_fuzzy(c, s):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    best = (0.0, -1, 0)
    grams = {c[i : i + 3] for i in range(len(c) - 2)}
    if not c or not s or len(c) > 2 * len(s) or not grams:
        return best
    for w in range(max(1, int(len(c) * 0.6)), min(-(-len(c) * 3 // 2), len(s)) + 1):
        for p in range(0, len(s) - w + 1, max(1, w // 10)):
            part = s[p : p + w]
            if sum(part[i : i + 3] in grams for i in range(w - 2)) / len(grams) >= 0.3:
                sim = 1 - lev(c, part) / max(len(c), w)
                if sim > best[0]:
                    best = (sim, p, w)
    return best


def test_fuzzy_against_plain_search():
    r = random.Random(5)
    for n in (3, 9, 30, 64, 65, 90):
        for _ in range(3):
            s = "".join(r.choice("ab cd") for _ in range(160))
            c = "".join(ch if r.random() > 0.15 else r.choice("abx") for ch in s[20 : 20 + n])
            got, want = best_window(c, s), plain_fuzzy(c, s)
            assert got == pytest.approx(want)


def test_longest_run():
    assert longest_run("a b c d e f".split(), "x b c d e y".split()) == (4, 1)
    assert longest_run([], ["a"]) == (0, -1)


def frames(spark, responses):
    r = spark.createDataFrame(list(enumerate(responses, 1)), "response_id long, response string")
    s = spark.createDataFrame([(k, *x) for k in range(1, len(responses) + 1) for x in PARIS], "response_id long, source_pos int, source_id string, content string")
    return r, s


def test_cite_states_and_scores(spark):
    r, s = frames(spark, ["Paris is the capital of France [1].", "The Eiffel Tower is located in Paris [1].", "Some claim [5].", "", None])
    report = cite(r, s)
    assert {(x.response_id, x.state) for x in report.verifications.collect()} == {(1, "unsupported"), (2, "misattributed"), (3, "phantom")}
    scores = {x.response_id: x for x in report.scores.collect()}
    assert len(scores) == 5
    assert scores[2].grounding == 1 and scores[2].accuracy == 0 and scores[2].quality == pytest.approx(0.70)
    assert scores[3].quality == pytest.approx(0.15) and scores[3].coverage == 1
    assert scores[4].quality == 0 and scores[4].accuracy is None and scores[5].claim_count == 0
    first = {(x.claim_idx, x.source_pos): x for x in report.attributions.where("response_id = 1").collect()}[0, 1]
    assert first.fuzzy == pytest.approx(0.766667, abs=1e-6) and first.ngram == pytest.approx(0.508) and first.exact == 0


def test_attribute_inserts_marker(spark):
    r = spark.createDataFrame([(1, "Paris is the capital of France.")], "response_id long, response string")
    s = spark.createDataFrame([(1, 1, "1", "Paris is the capital of France.")], "response_id long, source_pos int, source_id string, content string")
    out, report = attribute(r, s)
    row = out.first()
    assert row.text == "Paris is the capital of France [1]." and row.inserted[0].offset == 30
    assert report.attributions.first().confidence == pytest.approx(1.0)


def test_one_citation_two_claims_and_source_map(spark):
    r, s = frames(spark, ["A fact. [1] Another fact."])
    report = cite(r, s, CiteOptions(source_map={"1": "2"}))
    assert sorted((x.claim_idx, x.resolved_id) for x in report.verifications.collect()) == [(0, "2"), (1, "2")]


def test_citer_overrides_replace(spark):
    citer = Citer(CiteOptions(weights={"exact": 1.0}))
    assert citer.options.with_overrides(weights={"fuzzy": 0.5}).resolved_weights()["exact"] == 0.40
    r, s = frames(spark, ["Claim [1]. I think so."])
    assert citer.extract_citations(r).first().resolved_id is None
    assert [x.is_factual for x in citer.extract_claims(r).orderBy("claim_idx").collect()] == [True, False]


def test_embedder(spark):
    r, s = frames(spark, ["Something else entirely."])
    report = cite(r, s, CiteOptions(embedder=lambda texts: [[1.0, 0.0, 0.0] for _ in texts]))
    assert {x.embedding for x in report.attributions.collect()} == {1.0}


def test_sentences_and_clauses_of_all_turns(spark, tmp_path):
    from groundwork.plans.catalogue import QUERIES

    rows = [(1, 0, "user", "The river is long and wide. It flows to the sea."), (1, 1, "assistant", "The sea is deep and cold.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("sentence_split", "clause_split"):
        assert {r.response_id for r in QUERIES[name](spark, str(tmp_path)).collect()} == {100000, 100001}


def test_range_of_very_long_numbers():
    assert ids("x [" + "1" * 5000 + "-" + "1" * 5000 + "] y [2]") == [("numbered", "2")]


@pytest.mark.parametrize(
    "kind, value",
    [
        ("struct<title: string>", ("Wiki A",)),
        ("struct<pages: int, title: string, year: int>", (3, "Wiki A", 2020)),
        ("map<string, string>", {"title": "Wiki A"}),
        ("string", '{"title": "Wiki A"}'),
    ],
)
def test_metadata_of_any_shape_and_clashing_columns(spark, kind, value):
    r = spark.createDataFrame([(1, "A long fact stands here for all [Wiki A].")], "response_id long, response string")
    s = spark.createDataFrame(
        [(1, 1, "a", "Nothing of it.", None, 1, "x", 0.5), (1, 2, None, None, None, 2, "y", 0.5), (1, 3, "c", "A long fact stands here for all.", value, 3, "z", 0.5)],
        f"response_id long, source_pos int, source_id string, content string, metadata {kind}, shared int, text string, confidence double",
    )
    report = cite(r, s)
    assert [(x.resolved_pos, x.resolved_id) for x in report.citations.collect()] == [(3, "c")]
    assert [x.state for x in report.verifications.collect()] == ["verified"]
    assert report.attributions.count() == 3


def test_evidence_counts_utf16_units(spark):
    r = spark.createDataFrame([(1, "Paris is the capital of France.")], "response_id long, response string")
    s = spark.createDataFrame([(1, 1, "1", "\U0001f600 Paris is the capital of France. ")], "response_id long, source_pos int, source_id string, content string")
    row = cite(r, s).attributions.first()
    assert (row.match_offset.start, row.match_offset.end) == (3, 33) and row.match_evidence == "Paris is the capital of France."


def test_a_corpus_is_shared_by_responses(spark):
    r, s = frames(spark, ["Paris is the capital of France [1].", "The Eiffel Tower is located in Paris [1]."])
    own = cite(r, s)
    shared = cite(r.selectExpr("*", "'c' as corpus_id"), s.where("response_id = 1").drop("response_id").selectExpr("*", "'c' as corpus_id"))
    even = lambda v: round(v, 9) if isinstance(v, float) else v  # noqa: E731  (sums come in any order)
    rows = lambda df: sorted(repr([even(v) for v in r]) for r in df.drop("correct_sources").collect())
    assert rows(own.attributions) == rows(shared.attributions) and rows(own.scores) == rows(shared.kept().scores)
    assert rows(own.verifications) == rows(shared.kept().verifications)
    assert {x.response_id for x in own.to_json().collect()} == {1, 2}


def test_many_sources_keep_the_fifty_that_share_most(spark):
    from groundwork.operators import attribution

    c = spark.createDataFrame([(1, 0, ["a", "b"])], "response_id long, claim_idx long, tokens array<string>")
    s = spark.createDataFrame([(1, k, ["a"] * (k % 7) + ["z"]) for k in range(1, 71)], "response_id long, source_pos int, tokens array<string>")
    got = sorted((r.source_pos, r.shared) for r in attribution.candidates(c, s, CiteOptions()).collect())
    assert got == sorted(sorted(((k, k % 7) for k in range(1, 71)), key=lambda x: (-x[1], x[0]))[:50])


def test_equal_texts_have_a_tfidf_of_one_in_any_order_of_sums(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choice("abcdefgh") + str(draw.randrange(300)) for _ in range(60)) + "." for _ in range(40)]
    r = spark.createDataFrame([(i, i % 4, t) for i, t in enumerate(texts)], "response_id long, corpus_id long, response string")
    s = spark.createDataFrame([(i % 4, i // 4, str(i), t) for i, t in enumerate(texts)], "corpus_id long, source_pos long, source_id string, content string")
    rows = cite(r, s).attributions.where("source_id = string(response_id)").collect()
    assert {(x.exact, x.tfidf, x.primary_match_type, x["rank"]) for x in rows} == {(1.0, 1.0, "exact", 1)} and len(rows) == 40


def test_no_source_is_left_out_where_the_options_set_no_limit(spark):
    from groundwork.operators import attribution

    c = spark.createDataFrame([(1, 0, ["a", "b"])], "response_id long, claim_idx long, tokens array<string>")
    s = spark.createDataFrame([(1, k, ["a"] * (k % 7) + ["z"]) for k in range(1, 71)], "response_id long, source_pos int, tokens array<string>")
    got = sorted((r.source_pos, r.shared) for r in attribution.candidates(c, s, CiteOptions(max_sources_per_claim=None)).collect())
    assert got == [(k, 0) for k in range(1, 71)]


def test_a_passage_is_scored_against_all_passages_of_a_large_corpus(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from groundwork.plans.catalogue import ORACLE_SQL, QUERIES

    draw = random.Random(3)
    passage = lambda: " ".join(draw.choice("bcdfg") + draw.choice("aeiou") + draw.choice("lmnrst") for _ in range(9)) + "."
    rows = [(20 * k, passage()) for k in range(55)]
    rows[54] = (20 * 54, rows[0][1].replace(" ", " zz ", 1))  # a near copy, the last of 55, among the first ranks
    spark.createDataFrame(rows, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["passage_attribution"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from read_parquet('{tmp_path}/benchmark.parquet/*.parquet')")
    # passages judged by themselves have a cosine of 1, which the SQL's sums can miss by a bit, to either side
    even = lambda names, found: sorted(repr(tuple(r[names.index(n)] for n in got.columns if n != "primary_match_type")) for r in found)
    want = con.execute(ORACLE_SQL["passage_attribution"])
    names = [d[0] for d in want.description]
    mine, theirs = even(got.columns, got.collect()), even(names, want.fetchall())
    assert len(theirs) == 55 * 55 and mine == theirs
