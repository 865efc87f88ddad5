"""Context-tree weighting over bytes: every depth's Krichevsky-Trofimov estimate is mixed, bit by bit.

A text is its tokens (A-Z in lower case, cut at 0x20 and 0x09-0x0D) joined by one 0x20 and ended by 0x0A, so the
model and the word unigram base give a probability to the same event. Each byte is eight binary decisions; each
decision has a context tree over the DEPTH bytes before it. A node holds the training counts of its two outcomes,
its KT probability Pe, and Pw = Pe/2 + (product of the children's Pw)/2. With all counts known, the predictive
probability of a bit is, from the deepest node upwards, w*KT + (1-w)*below, w = Pe / (2 Pw).

Plan. Texts are dealt to blocks of about `block_bytes` by a hash of their content. A block sends its distinct
(context, byte) strings with their training counts, and its distinct words, as sorted binary runs to buckets by the
last two context bytes (words: by hash), where whole subtrees meet. Only the sums of depths 0 and 1 (at most 65,280
nodes) reach the driver. Buckets then answer each block with one float per string it sent, and the block scores its
texts. No table of the model is broadcast; what is exchanged grows with the blocks, and so with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialised, text_bytes
from ._text import U, Words, flat, index, pieces

DEPTH = 5
PAD = 10


def canonical(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with DEPTH pads before each text, where each text begins, and the lengths without pads."""
    n = len(words.counts)
    size = np.bincount(words.row, weights=words.end - words.start + 1, minlength=n).astype(np.int64)
    size[words.counts == 0] = 1
    begin = np.concatenate([[0], np.cumsum(size + DEPTH)])
    out = np.full(begin[-1], PAD, np.uint8)
    if len(words.start):
        length = words.end - words.start
        ahead = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
        first = np.concatenate([[0], np.cumsum(words.counts)])[:-1]
        at = begin[:-1][words.row] + DEPTH + ahead - ahead[np.minimum(first, len(ahead) - 1)][words.row]
        inside = np.flatnonzero(words.inside)
        out[np.repeat(at - words.start, length) + inside] = words.buf[inside]
        last = np.append(words.row[1:] != words.row[:-1], True)
        out[(at + length)[~last]] = 32
    return out, begin, size


def strings(out: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every scored byte, context and byte in 48 bits: the nearest context byte on top, the byte lowest."""
    key = out.astype(U)
    for i in range(1, DEPTH + 1):
        key[i:] |= out[:-i].astype(U) << U(8 * (DEPTH + 1 - i))
    row = np.repeat(np.arange(len(size)), size)
    ahead = np.concatenate([[0], np.cumsum(size)])[:-1]
    return key[np.arange(len(row)) - ahead[row] + begin[:-1][row] + DEPTH], row


class Tally:
    """Sums counts of keys; what has gathered is merged whenever it outgrows what is merged already."""

    def __init__(self):
        self.keys, self.counts, self.new, self.waiting = np.zeros(0, U), np.zeros(0), [], 0

    def add(self, keys, counts):
        self.new.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(len(self.keys), 1 << 18):
            self.merge()

    def merge(self):
        if self.new:
            every = np.concatenate([self.keys, *(k for k, _ in self.new)])
            counts = np.concatenate([self.counts, *(c for _, c in self.new)])
            self.keys, place = np.unique(every, return_inverse=True)
            self.counts = np.bincount(place, weights=counts, minlength=len(self.keys))
            self.new, self.waiting = [], 0
        return self.keys, self.counts


def gather(table: pa.Table, most: int = 1 << 20):
    """A block's distinct strings and words with their counts in training texts."""
    data, places = flat(table["text"])
    train = ~np.asarray(table["held_out"]).astype(bool)
    found, known = Tally(), Tally()
    for i, j in pieces(places, most):
        words = Words(data, places[i : j + 1])
        keys, row = strings(*canonical(words))
        distinct, place = index(keys)
        found.add(distinct, np.bincount(place, weights=train[i:j][row], minlength=len(distinct)))
        distinct, place = index(words.hashes())
        known.add(distinct, np.bincount(place, weights=train[i:j][words.row], minlength=len(distinct)))
    return found.merge(), known.merge()


def _deal(found, known, buckets: int):
    """(bucket, keys, counts) of a block; strings by their last two context bytes, words by hash."""
    for offset, (keys, counts), by in (
        (0, found, lambda k: (k >> U(8 * DEPTH - 8)) % U(buckets)),
        (buckets, known, lambda k: k % U(buckets)),
    ):
        where = by(keys).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[order], np.arange(buckets + 1))
        for b in range(buckets):
            if cut[b] < cut[b + 1]:
                own = order[cut[b] : cut[b + 1]]
                yield b + offset, keys[own], counts[own]


def _packed(values: np.ndarray) -> bytes:
    """Numbers as bytes; sorted keys go as differences."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpacked(raw: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=U(0))


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw, U), dtype=U)


_SENT = "bucket int, block int, keys binary, counts binary, texts long"


def _sender(buckets: int):
    def send(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        n = int((~np.asarray(table["held_out"]).astype(bool)).sum())
        rows = [(b, block, _packed(_steps(k)), _packed(c.astype(np.uint32)), 0) for b, k, c in _deal(*gather(table), buckets)]
        rows.append((2 * buckets, block, b"", b"", n))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["bucket", "block", "keys", "counts", "texts"])

    return send


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x >= 0.5, by Stirling's series after a shift by eight."""
    shift = x * (x + 1) * (x + 2) * (x + 3)
    high = (x + 4) * (x + 5) * (x + 6) * (x + 7)
    y = x + 8
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift) - np.log(high)


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the KT probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1.0)


class Subtrees:
    """Nodes of depth 2 and more below the strings of one bucket."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.levels = keys, []
        ctx, sym, n = keys >> U(8), keys & U(255), counts
        inverse = np.arange(len(keys))
        below = None
        for depth in range(DEPTH, 1, -1):
            if depth < DEPTH:
                code, inverse = np.unique(((ctx >> U(8)) << U(8)) | sym, return_inverse=True)
                n = np.bincount(inverse, weights=n, minlength=len(code))
                ctx, sym = code >> U(8), code & U(255)
            bits = []
            for j in range(8):
                node = (ctx << U(j)) | (sym >> U(8 - j))
                group = np.cumsum(np.concatenate([[0], node[1:] != node[:-1]])).astype(np.int64)
                bit = ((sym >> U(7 - j)) & U(1)).astype(np.int64)
                ones = np.bincount(group, weights=n * bit)
                total = np.bincount(group, weights=n)
                pe = kt(total - ones, ones)
                if below is None:
                    pw, w = pe, np.ones(len(pe))
                else:
                    lower_group, lower_pw = below[j]
                    first = np.flatnonzero(np.concatenate([[True], lower_group[1:] != lower_group[:-1]]))
                    product = np.bincount(group[inverse[first]], weights=lower_pw, minlength=len(pe))
                    pw = np.logaddexp(pe, product) - np.log(2)
                    w = np.exp(pe - pw - np.log(2))
                bits.append((group, pw, w, total, ones, bit))
            self.levels.append((ctx, sym, inverse, bits))
            below = [(b[0], b[1]) for b in bits]

    def top(self):
        """For each depth-1 node above: nearest byte, node, sum of the children's ln Pw, zeros, ones."""
        ctx, sym, _, bits = self.levels[-1]
        for j, (group, pw, _, total, ones, _) in enumerate(bits):
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            above = (ctx[first] >> U(8)) * U(256) + U(1 << j) + (sym[first] >> U(8 - j))
            code, place = np.unique(above, return_inverse=True)
            for c, s, t, o in zip(code, np.bincount(place, pw), np.bincount(place, total), np.bincount(place, ones)):
                if t:
                    yield int(c >> U(8)), int(c & U(255)), float(s), float(t - o), float(o)

    def log10(self, shallow: dict[str, np.ndarray]) -> np.ndarray:
        """log10 of the mixed probability of each string's byte in its context."""
        q, to = [None] * 8, np.arange(len(self.keys))
        for depth, (_, _, inverse, bits) in zip(range(DEPTH, 1, -1), self.levels):
            to = inverse[to] if depth < DEPTH else to  # the entry of this depth above each string
            for j, (group, _, w, total, ones, bit) in enumerate(bits):
                hit = np.where(bit == 1, ones[group], (total - ones)[group])
                here = ((hit + 0.5) / (total[group] + 1))[to]
                up = w[group][to]
                q[j] = here if depth == DEPTH else up * here + (1 - up) * q[j]
        near, sym = (self.keys >> U(8 * DEPTH)).astype(np.int64), (self.keys & U(255)).astype(np.int64)
        out = np.zeros(len(self.keys))
        for j in range(8):
            node, bit = (1 << j) + (sym >> (8 - j)), (sym >> (7 - j)) & 1
            for c, at in (("1", (near, node)), ("0", (0, node))):
                w, total, ones = (shallow[k + c][at] for k in ("w", "n", "o"))
                here = (np.where(bit == 1, ones, total - ones) + 0.5) / (total + 1)
                q[j] = w * here + (1 - w) * q[j]
            out += np.log10(q[j])
        return out


def _merge(table: pa.Table):
    """All blocks' keys of one bucket, their summed counts, and each block's places among them."""
    blocks = table["block"].to_pylist()
    keys = [_keys(x) for x in table["keys"].to_pylist()]
    counts = [_unpacked(x, np.uint32) for x in table["counts"].to_pylist()]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct))
    cut = np.cumsum([0, *map(len, keys)])
    return distinct, total, [(b, place[cut[i] : cut[i + 1]]) for i, b in enumerate(blocks)]


def _summary(buckets: int):
    """Sums of the depths that are shared by all buckets, and of words."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket == 2 * buckets:
            rows = [(-2, 0, 0.0, float(sum(table["texts"].to_pylist())), 0.0)]
        elif bucket >= buckets:
            _, total, _ = _merge(table)
            rows = [(-1, 0, 0.0, float(total.sum()), float((total > 0).sum()))]
        else:
            keys, total, _ = _merge(table)
            rows = list(Subtrees(keys, total).top()) or [(-3, 0, 0.0, 0.0, 0.0)]
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["near", "node", "s", "zeros", "ones"])

    return run


def shallow_tables(rows) -> dict[str, np.ndarray]:
    """Weights and counts of depths 1 and 0 from the collected sums (at most 256 x 255 rows)."""
    s, zeros, ones = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        if r["near"] >= 0:
            s[r["near"], r["node"]], zeros[r["near"], r["node"]], ones[r["near"], r["node"]] = r["s"], r["zeros"], r["ones"]
    pe = kt(zeros, ones)
    pw = np.logaddexp(pe, s) - np.log(2)
    root_zeros, root_ones = zeros.sum(0, keepdims=True), ones.sum(0, keepdims=True)
    root_pe = kt(root_zeros, root_ones)
    root_pw = np.logaddexp(root_pe, pw.sum(0, keepdims=True)) - np.log(2)
    return {
        "w1": np.exp(pe - pw - np.log(2)), "n1": zeros + ones, "o1": ones,
        "w0": np.exp(root_pe - root_pw - np.log(2)), "n0": root_zeros + root_ones, "o0": root_ones,
    }


def _answer(buckets: int, shallow):
    """For each block, the values of what it sent: log10 probabilities of strings, counts of words."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys, total, blocks = _merge(table)
        values = total if bucket >= buckets else Subtrees(keys, total).log10(shallow).astype(np.float32)
        return pa.table(
            [
                pa.array([bucket] * len(blocks), pa.int32()),
                pa.array([b for b, _ in blocks], pa.int32()),
                table["keys"],
                pa.array([_packed(values[p]) for _, p in blocks], pa.binary()),
            ],
            names=["bucket", "block", "keys", "found"],
        )

    return run


def _scorer(buckets: int, tokens: float, distinct: float, texts_seen: float):
    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        held = {0: [[], []], 1: [[], []]}
        for b, keys, values in zip(found["bucket"].to_pylist(), found["keys"].to_pylist(), found["found"].to_pylist()):
            held[b >= buckets][0].append(_keys(keys))
            held[b >= buckets][1].append(_unpacked(values, np.float64 if b >= buckets else np.float32))
        lookup = {}
        for kind, (keys, values) in held.items():
            keys = np.concatenate(keys) if keys else np.zeros(0, U)
            order = np.argsort(keys)
            lookup[kind] = keys[order], (np.concatenate(values).astype(float)[order] if values else np.zeros(0))
        data, places = flat(texts["text"])
        out = [[] for _ in range(5)]
        bottom = np.log10(tokens + 0.5 * (distinct + 1))
        ends = np.log10(texts_seen + 0.5) - bottom
        for i, j in pieces(places):
            words = Words(data, places[i : j + 1])
            keys, row = strings(*canonical(words))
            u, place = index(keys)
            value = lookup[0][1][np.searchsorted(lookup[0][0], u)]
            n = len(words.counts)
            out[0].append(np.bincount(row, weights=value[place], minlength=n))
            out[1].append(np.bincount(row, minlength=n))
            u, place = index(words.hashes())
            c = lookup[1][1][np.searchsorted(lookup[1][0], u)]
            base = np.log10(c + 0.5) - bottom
            out[2].append(np.bincount(words.row, weights=base[place], minlength=n) + ends)
            out[3].append(words.counts + 1)
            out[4].append(np.bincount(words.row, weights=(c > 0)[place], minlength=n) + (texts_seen > 0))
        s, size, base, n, known = (np.concatenate(x) for x in out)
        return pa.table(
            [
                texts["doc_id"], texts["held_out"], pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
                pa.array(np.full(len(n), int(tokens), np.int64)), pa.array(base), pa.array(s), pa.array(size.astype(np.int64)),
                pa.array(-s / np.log10(2) / size),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"],
        )

    return score


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 1):
    """Whether crc32 of the id as text leaves `fold`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def score_corpus(docs: DataFrame, block_bytes: int = 24 << 20) -> DataFrame:
    """One row per row of docs(doc_id, text): see _SCORED for the columns.

    Learns from rows that are not held out. Null or empty texts are one end; rows that repeat each get their own row
    and each count in training; a null doc_id is in training. Other columns are ignored. An empty table gives none.
    """
    total = text_bytes(docs)
    blocks = total // block_bytes + 1
    buckets = int(min(4096, max(8, 2 * blocks)))
    block = F.expr(f"cast(pmod(xxhash64(doc_id, text), {blocks}) as int)")
    # tasks grow in number with the blocks, not in size
    own = docs.select("doc_id", held_out().alias("held_out"), "text").withColumn("block", block).repartition(2 * blocks, "block")
    sent = materialised(own.groupBy("block").applyInArrow(_sender(buckets), _SENT))
    sums = (
        sent.groupBy("bucket").applyInArrow(_summary(buckets), "near int, node int, s double, zeros double, ones double")
        .groupBy("near", "node").agg(*(F.sum(c).alias(c) for c in ("s", "zeros", "ones"))).collect()
    )
    of = {r["near"]: r for r in sums if r["near"] < 0}
    texts = of[-2]["zeros"] if -2 in of else 0.0
    tokens = texts + (of[-1]["zeros"] if -1 in of else 0.0)
    distinct = (texts > 0) + (of[-1]["ones"] if -1 in of else 0.0)
    shallow = shallow_tables(sums)
    found = (
        sent.where(F.col("bucket") < 2 * buckets).groupBy("bucket")
        .applyInArrow(_answer(buckets, shallow), "bucket int, block int, keys binary, found binary")
    )
    return own.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _scorer(buckets, tokens, distinct, texts), _SCORED
    )


_SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
    "n_bytes long, bits_per_byte double"
)
