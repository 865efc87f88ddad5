"""run() and each of its stages against plain versions, on a small fixture."""

import os
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from groundwork.llm import packing, pii, toxicity
from groundwork.llm._text import Words, flat

FINE = "the quiet river number {0} runs past old mills and green fields towards town {0} where people rest"
BAD = "you total idiotic fool number {0} nobody wants your stupid rotten words here {0}"


def plain_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def plain_near(rows):
    """Of each linked group of rows, that of the smallest id."""
    rows = list(dict.fromkeys((r for r in rows if r[0] is not None or plain_words(r[1])))) + [r for r in rows if r[0] is None and not plain_words(r[1])]
    sets = []
    for _, t in rows:
        w = plain_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(rows[k])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) if len(g) > 1 else g[0] for g in groups.values()]


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, (BAD if i % 4 == 0 else FINE).format(f"{i}{i}x")) for i in range(120)]
    rows += [(200, FINE.format("5"), ), (201, FINE.format("5").upper()), (202, FINE.format("5") + " again"), (None, FINE.format("5")), (203, None), (204, ""), (204, "")]
    rows += [(205, "Write to Dr Smith at joe@example.com; Smith reads it."), (206, "word " * 3000), (206, "two texts under one id"), (None, None), (207, BAD.format("207"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{where}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{where}/labels.parquet")
    return where, docs, rows


def plain_score(model, text):
    """Noisy-or over sentences, word by word."""
    data, places = flat(__import__("pyarrow").array([text or ""]))
    words = Words(data, places)
    known = dict(zip(model.keys.tolist(), model.weights.tolist()))
    hashes, at = toxicity.features(words)
    number = toxicity.sentences(words)
    found = {}
    for h, w in zip(hashes.tolist(), at.tolist()):
        if h in known:
            found.setdefault(int(number[w]), set()).add(h)
    keep = 1.0
    for features in found.values():
        keep *= 1 - 1 / (1 + np.exp(-(sum(known[f] for f in features) + model.bias)))
    return 1 - keep


def test_stages_and_run_equal_plain_versions(spark, fixture):
    where, docs, rows = fixture
    pair = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    model = toxicity.learn(docs, spark.read.parquet(f"{where}/labels.parquet"))
    kept = [(i, t) for i, t in rows if plain_score(model, t) < 0.7]
    one = corpus_pipeline.drop_toxic(spark, docs, where)
    assert pair(one) == sorted(kept, key=repr) and one.columns == docs.columns
    assert 0 < len(kept) < len(rows) and all("idiotic" not in (t or "") for _, t in kept)
    two = corpus_pipeline.drop_near_copies(spark, one, where)
    left = plain_near(kept)
    assert pair(two) == sorted(left, key=repr) and two.columns == docs.columns and len(left) < len(kept) - 2
    three = corpus_pipeline.replace_private(spark, two, where)
    changed = {r.doc_id: r for r in three.collect()}[205]
    assert "Smith" not in changed.text and "joe@" not in changed.text and changed.n_chars == len(changed.text)
    assert [x for x in pair(three) if x[0] != 205] == [x for x in sorted(left, key=repr) if x[0] != 205] and three.columns == docs.columns
    final = [(i, changed.text if i == 205 else t) for i, t in left]
    want = []
    for i, t in final:
        ids = np.frombuffer(packing.encoder().ids(t or ""), "<u4").tolist() + [0]
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    out = corpus_pipeline.run(spark, where)
    got = out.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    fill = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1
    folder = os.path.dirname(out.inputFiles()[0].removeprefix("file:").removeprefix("//"))
    assert os.path.basename(folder) == "3-packing" and os.listdir(os.path.dirname(folder)) == ["3-packing"]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_key_of_the_session(spark):
    assert pii.session_key(spark) == pii.DEMONSTRATION_KEY
    spark.conf.set("spark.groundwork.pii.key", "k")
    assert pii.session_key(spark) == "k"
    spark.conf.unset("spark.groundwork.pii.key")
