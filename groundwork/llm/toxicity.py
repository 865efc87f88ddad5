"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence is its words and the beginnings of its words (4 to 7 bytes, so that inflected forms share features), as
hashes. Its score is logistic; a document's is the noisy-or 1 - prod(1 - p), and only documents have labels in
training. Features are those of the training documents whose document frequencies differ clearly between the labels, and
sentences without any are no evidence, so that long clean texts do not add up chance weights. Training takes a bounded sample of labelled rows (`sample` of
each label, by a hash of the id) on the driver; scoring runs over all texts and only looks features up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import give_back, lean
from ._text import U, Words, flat, index, pieces

PREFIXES = (4, 5, 6, 7)
#: Bytes that end a sentence when white space or the text's end follows.
STOPS = b".!?"


def sentences(words: Words) -> np.ndarray:
    """The sentence number of each word, over all rows: new at a row's start, after a stop, and at line breaks."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    last = words.buf[words.end - 1]
    stop = np.isin(last, np.frombuffer(STOPS, np.uint8))
    breaks = np.cumsum(words.buf == 10)
    line = breaks[words.start[1:]] > breaks[words.end[:-1] - 1]
    new = np.concatenate([[0], stop[:-1] | line | (words.row[1:] != words.row[:-1])])
    return np.cumsum(new).astype(np.int64)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, word) for each word and each of its beginnings; punctuation at a word's ends is left out."""
    trimmed = _trim(words)
    sums = trimmed.sums()
    out = [trimmed.hashes(sums)]
    at = [np.arange(len(words.start))]
    length = trimmed.end - trimmed.start
    for k in PREFIXES:
        long = np.flatnonzero(length > k)
        part = trimmed.hashes(sums, k)[long] + U(k)
        out.append(part)
        at.append(long)
    return np.concatenate(out), np.concatenate(at)


def _trim(words: Words) -> Words:
    import copy

    mark = np.zeros(256, bool)
    mark[33:48] = mark[58:65] = mark[91:97] = mark[123:127] = True
    own = copy.copy(words)
    start, end = words.start.copy(), words.end.copy()
    for _ in range(4):
        end -= ((end - start) > 1) & mark[words.buf[end - 1]]
        start += ((end - start) > 1) & mark[words.buf[np.minimum(start, len(words.buf) - 1)]]
    own.start, own.end = start, end
    return own


class Model:
    """Sorted feature hashes, their weights, and the bias of a sentence."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias

    def sentence_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Summed weights of each sentence with any feature of the model, and its number."""
        hashes, at = features(words)
        if not len(hashes) or not len(self.keys):
            return np.zeros(0), np.zeros(0, np.int64)
        distinct, place = index(hashes)
        where = np.searchsorted(self.keys, distinct)
        known = np.where(self.keys[np.minimum(where, len(self.keys) - 1)] == distinct, where, -1)[place]
        hit = np.flatnonzero(known >= 0)
        if not len(hit):
            return np.zeros(0), np.zeros(0, np.int64)
        pair = np.unique(sentences(words)[at[hit]] * (len(self.keys) + 1) + known[hit])  # a feature counts once a sentence
        sentence, feature = pair // (len(self.keys) + 1), pair % (len(self.keys) + 1)
        number, place = np.unique(sentence, return_inverse=True)
        return np.bincount(place, weights=self.weights[feature]) + self.bias, number

    def scores(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: noisy-or score, its worst sentence (-1: none, else counted in the row), sentences."""
        n = len(words.counts)
        number = sentences(words)
        total = np.bincount(words.row[np.concatenate([[True], number[1:] != number[:-1]])], minlength=n) if len(number) else np.zeros(n, int)
        first = np.concatenate([[0], np.cumsum(total)])
        logits, where = self.sentence_logits(words)
        row = np.searchsorted(first, where, "right") - 1
        keep = np.bincount(row, weights=-np.logaddexp(0, logits), minlength=n) if len(logits) else np.zeros(n)
        worst = np.full(n, -1, np.int64)
        order = np.argsort(logits, kind="stable")
        worst[row[order]] = where[order] - first[row[order]]
        return 0.0 - np.expm1(keep), worst, total


def fit(texts: list[str], labels: np.ndarray, rounds: int = 150, most: int = 4096, least: int = 3) -> Model:
    """Noisy-or maximum likelihood by Adam over the selected features; deterministic."""
    data, places = flat(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string()))
    parts = list(pieces(places, 1 << 18))
    # document frequencies by label; a part's are merged at once, so memory follows the distinct features
    known, df = np.zeros(0, U), np.zeros((2, 0))
    for i, j in parts:
        words = Words(data, places[i : j + 1])
        hashes, at = features(words)
        own, place = index(hashes)
        pair = np.unique((words.row[at] + i) * max(1, len(own)) + place)
        y = labels[pair // max(1, len(own))]
        both, to = np.unique(np.concatenate([known, own]), return_inverse=True)
        fresh = np.zeros((2, len(both)))
        fresh[:, to[: len(known)]] = df
        for label in (0, 1):
            fresh[label, to[len(known) :]] += np.bincount((pair % max(1, len(own)))[y == label], minlength=len(own))
        known, df = both, fresh
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    rate = (df[0] + df[1] + 1) / (n[0] + n[1] + 2)
    z = (df[1] / n[1] - df[0] / n[0]) / np.sqrt(rate * (1 - rate) * (1 / n[0] + 1 / n[1]))
    odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
    good = np.flatnonzero((z > 2.5) & (odds > 1.5) & (df[1] >= least))
    good = np.sort(good[np.argsort(-z[good], kind="stable")[:most]])
    if not len(good):
        return Model(np.zeros(0, U), np.zeros(0), -12.0)
    chosen = known[good]
    del known, df, rate, z, odds
    feature, sentence, doc = [], [], []
    base = 0
    for i, j in parts:
        words = Words(data, places[i : j + 1])
        hashes, at = features(words)
        where = np.minimum(np.searchsorted(chosen, hashes), len(chosen) - 1)
        hit = np.flatnonzero(chosen[where] == hashes)
        number = sentences(words)
        pair = np.unique(number[at[hit]] * len(chosen) + where[hit])  # a feature counts once a sentence
        live, place = np.unique(pair // len(chosen), return_inverse=True)
        of = np.zeros(int(number[-1]) + 1 if len(number) else 0, np.int64)
        of[number] = words.row + i
        feature.append(pair % len(chosen))
        sentence.append(place + base)
        doc.append(of[live])
        base += len(live)
    feature, sentence, doc = np.concatenate(feature), np.concatenate(sentence), np.concatenate(doc)
    live = doc
    w, b = np.full(len(good), 0.5), -3.0
    m, v = np.zeros(len(good) + 1), np.zeros(len(good) + 1)
    weight = np.where(labels == 1, 0.5 / n[1], 0.5 / n[0])
    for t in range(1, rounds + 1):
        logit = np.bincount(sentence, weights=w[feature], minlength=len(live)) + b
        keep = np.bincount(doc, weights=-np.logaddexp(0, logit), minlength=len(labels))
        p = np.clip(-np.expm1(keep), 1e-9, 1 - 1e-9)
        # d(-log likelihood)/d keep: clean documents want keep at 0, toxic ones far below
        slope = np.where(labels == 1, (1 - p) / p, -1.0) * weight
        each = -slope[doc] / (1 + np.exp(-logit))
        gw = np.bincount(feature, weights=each[sentence], minlength=len(good)) + 1e-6 * w
        gb = each.sum() + 1e-6 * b
        grad = np.append(gw, gb)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return Model(chosen, w, b)


def training(docs: DataFrame, labels: DataFrame, sample: int = 600, folds: int = 3, fold: int = 1) -> tuple[pa.ChunkedArray, np.ndarray]:
    """At most `sample` rows of each label outside the held-out fold, by a hash of their id; texts come by one scan
    against that bounded set of ids."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") == 1).alias("y")).where(crc != fold)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (True, False)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * sample rows
    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "text", "y").toArrow()
    order = np.argsort(np.array(rows["doc_id"]), kind="stable")
    y = np.array(rows["y"]).astype(int)
    return rows["text"].take(pa.array(order)), y[order]


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted, worst_sentence, n_sentences) for each row; a null or empty text scores 0."""
    keys, weights, bias = model.keys, model.weights, model.bias

    def run(batches):
        own = Model(keys, weights, bias)
        for batch in batches:
            data, places = flat(batch.column(1))
            out = [np.concatenate(x) for x in zip(*(own.scores(Words(data, places[i : j + 1])) for i, j in pieces(places)))]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(out[0]), pa.array((out[0] >= threshold).astype(np.int32)), pa.array(out[1]), pa.array(out[2].astype(np.int64))],
                    names=["doc_id", "score", "predicted", "worst_sentence", "n_sentences"],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double, predicted int, worst_sentence long, n_sentences long")


def learn(labelled: DataFrame, labels: DataFrame, **options) -> Model:
    """A model of labelled(doc_id, text) and labels(doc_id, toxic); without any label, or with one label only, all
    texts score 0 under it."""
    texts, y = training(labelled, labels, **options)
    model = fit(texts, y) if len(texts) and 0 < y.sum() < len(y) else Model(np.zeros(0, U), np.zeros(0), -40.0)
    del texts
    give_back()
    return model


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold.

    Each row is judged by its own text: rows with a null or repeated id too. Null and empty texts stay.
    """
    keys, weights, bias, place = model.keys, model.weights, model.bias, docs.columns.index("text")

    def run(batches):
        own = Model(keys, weights, bias)
        for batch in batches:
            data, places = flat(batch.column(place))
            found = [own.scores(Words(data, places[i : j + 1]))[0] for i, j in pieces(places)]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def classify(docs: DataFrame, labelled: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores docs by a model of labelled(doc_id, text) and labels(doc_id, toxic).

    Rows that repeat are scored each; a null doc_id is scored and never learnt from. Inputs of a score are the text
    alone.
    """
    return score(docs, learn(labelled, labels, **options))
