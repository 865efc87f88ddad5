"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and decoding.

The automaton over the pieces reads a segment once; at each position its output links name every piece that ends
there, and each is tried as the last piece of the best segmentation up to there. What is best follows the kind of the
model file. A unigram model relaxes the sum of the pieces' scores; a character that no piece holds takes its UTF-8
bytes as byte pieces, below any piece's score. A BPE model's scores are ranks of merges and are not to be summed:
there a position keeps the one piece that stands with the piece before it in the order of merges, that is, whose
string, joined with that of the piece before, is merged to these two again. Every prefix of a text has exactly one
such last piece, so the ids are those of merging pair by pair. Other kinds of model files are refused, as are those
that normalise texts. Texts are cut before runs of the space mark, which no piece crosses except as a run, and the
segments of a task are cached, so that repeated words cost a look-up.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import BoundedCache, lean, worker_cache

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Bytes of a task's segment cache, and of a worker's cache of pairs; longer segments are not kept. They only save time.
_CACHE, _PAIRS, _LONG = 96 << 20, 48 << 20, 64
#: Kinds of models as the file names them.
KINDS = {1: "unigram", 2: "bpe"}


def fields(raw: bytes):
    """(number, value) of each field of a serialized message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, raw[at : at + size]
            at += size


class Viterbi:
    """Encoder over (piece, score) in order of ids; bytes_at is the id of the byte piece 0x00."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_at: int, usable: list[bool] | None = None, kind: str = "unigram"):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.text, self.scores = [p for p, _ in pieces], [s for _, s in pieces]
        self.bytes_at = bytes_at
        self.score_of: dict[str, float] = {}
        for i, (p, s) in enumerate(pieces):
            if p and (usable is None or usable[i]):
                self.automaton.add_word(p, (len(p), i, s))
                self.score_of[p] = s
        self.automaton.make_automaton()
        self.penalty = min(self.score_of.values(), default=0.0) - 10.0
        self.sizes = [len(p) for p in self.text]
        # of each id its bytes, and what it adds to a score: of a character in byte pieces the first one counts
        self.raw, self.weights = [p.encode() for p in self.text], np.array(self.scores, float)
        for x, i in enumerate(range(bytes_at, min(bytes_at + 256, len(pieces)))):
            self.raw[i], self.weights[i] = bytes([x]), 0.0 if x & 0xC0 == 0x80 else self.penalty
        self.cache, self.pairs = BoundedCache(_CACHE), BoundedCache(_PAIRS)
        if kind == "bpe" and any(c not in self.score_of for p in self.score_of for c in p):
            raise ValueError("a character of some pieces is no piece")
        self.segment = {"unigram": self.by_scores, "bpe": self.by_merges}[kind]

    @classmethod
    def from_file(cls, path: str) -> "Viterbi":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = {number: dict(fields(value)) for number, value in fields(sp.serialized_model_proto()) if number in (2, 3)}
        kind, rules = KINDS.get(spec[2].get(3, 1)), spec.get(3, {})
        if kind is None or rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("only unigram and BPE models that put a space mark in front and else leave texts as they are")
        ids = range(sp.get_piece_size())
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids]
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in ids], sp.piece_to_id("<0x00>"), plain, kind)

    def by_scores(self, text: str) -> list[int]:
        """Ids of the segmentation of a text in marks with the best sum of scores."""
        n = len(text)
        best, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        done = 0

        def settle(upto):  # positions that no piece has reached take the byte pieces of their character
            for e in range(done + 1, upto + 1):
                if back[e] is None:
                    best[e], back[e] = best[e - 1] + self.penalty, (e - 1, -1)

        for end, (length, i, score) in self.automaton.iter(text):
            if end > done:
                settle(end)
                done = end
            e = end + 1
            value = best[e - length] + score
            if value > best[e]:
                best[e], back[e] = value, (e - length, i)
        settle(n)
        out, e = [], n
        while e:
            b, i = back[e]
            out.append([i] if i >= 0 else [self.bytes_at + x for x in text[b:e].encode()])
            e = b
        return [i for part in reversed(out) for i in part]

    def stands(self, before: str, piece: str) -> bool:
        """Whether two pieces stay apart and whole when the adjacent pair of the best score in their string, the first
        of equal ones, is merged until none can be; before is empty at a text's start."""
        none, score_of = float("-inf"), self.score_of
        parts, cut = list(before + piece), len(before)
        scores = [score_of.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            k = scores.index(best)
            if k == cut - 1:
                return False
            cut -= k < cut
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = score_of.get(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = score_of.get(parts[k] + parts[k + 1], none)
        return len(parts) == 1 + bool(before)

    def by_merges(self, text: str) -> list[int]:
        """Ids of the text in the order of merges."""
        get, last, settled = self.pairs.get, [-1] + [-2] * len(text), -1  # last: of each place, the piece up to it
        for end, (length, i, _) in self.automaton.iter(text):
            if end == settled:
                continue
            before = last[end + 1 - length]
            if before == -2:
                return self.with_gaps(text)
            ok = get((before << 32) | i)
            if ok is None:
                ok = self.learnt(before, i)
            if ok:
                last[end + 1], settled = i, end
        out, e, sizes = [], len(text), self.sizes
        if last[e] == -2:
            return self.with_gaps(text)
        while e:
            i = last[e]
            out.append(i)
            e -= sizes[i]
        out.reverse()
        return out

    def learnt(self, before: int, i: int) -> bool:
        """Whether piece i stands after piece `before`, -1 at a start; it is kept."""
        ok = self.stands(self.text[before] if before >= 0 else "", self.text[i])
        self.pairs.put((before << 32) | i, ok, 40)
        return ok

    def with_gaps(self, text: str) -> list[int]:
        """by_merges of a text with characters that no piece holds."""
        n, get = len(text), self.pairs.get
        start, last = [-1] * (n + 1), [-1] * (n + 1)  # of the last piece up to each place: its begin and id
        done = start[0] = 0
        for end, (length, i, _) in self.automaton.iter(text):
            end += 1
            if start[end] >= 0:
                continue
            while done < end - 1:  # no piece holds a character of its own: it stands alone, and what follows begins anew
                done += 1
                if start[done] < 0:
                    start[done] = done - 1
            begin = end - length
            if start[begin] < 0:
                continue
            before = last[begin]
            ok = get((before << 32) | i)
            if ok is None:
                ok = self.learnt(before, i)
            if ok:
                start[end], last[end] = begin, i
        while done < n:
            done += 1
            if start[done] < 0:
                start[done] = done - 1
        out, e = [], n
        while e:
            i = last[e]
            if i >= 0:
                out.append(i)
            else:
                out += [self.bytes_at + x for x in reversed(text[start[e] : e].encode())]
            e = start[e]
        out.reverse()
        return out

    def encode(self, text: str) -> tuple[bytes, float, int]:
        """Little-endian unsigned 32-bit ids, score, and how many ids are byte pieces."""
        if not text:
            return b"", 0.0, 0
        if "  " in text or SPACE in text or text[0] == " ":  # a segment's key lacks its first mark
            keys = [part[1:] for part in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
        else:
            keys = text.split(" ")
        cache = self.cache
        found = list(map(cache.get, keys))
        for k, part in enumerate(found):
            if part is None:
                key = keys[k]
                part = cache.get(key)
                if part is None:
                    own = self.segment(SPACE + key)
                    part = struct.pack(f"<{len(own)}I", *own)
                    if len(key) < _LONG:
                        cache.put(key, part, 2 * len(key) + len(part) + 110)
                found[k] = part
        out = b"".join(found)
        ids = np.frombuffer(out, "<u4")
        return out, float(self.weights[ids].sum()), int(np.count_nonzero((ids >= self.bytes_at) & (ids < self.bytes_at + 256)))

    def decode(self, ids) -> str:
        """The text of ids; the mark that encoding put in front goes, other marks are spaces."""
        whole = b"".join(map(self.raw.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")
        return whole.replace(SPACE, " ")[1:] if whole.startswith(SPACE) else whole.replace(SPACE, " ")

    def forget(self):
        """Drops the segments of a task; the pairs, which all texts share, stay within their bound."""
        self.cache.clear()


def model(path: str | None = None) -> Viterbi:
    import public_tokenizers as public

    path = path or public.path("piece_bpe_32k.model")
    return worker_cache(f"viterbi {path}", lambda: Viterbi.from_file(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, score) of each row of docs(doc_id, text); null and empty texts have no ids and score 0.

    Rows that repeat and null doc_ids are kept, other columns ignored; an empty table gives none.
    """

    def run(batches):
        own = model(path)
        for batch in batches:
            found = [own.encode(t.as_py() or "") for t in batch.column(1)]
            ids = [np.frombuffer(x[0], "<u4").astype(np.int32) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "ids", "score"])
        own.forget()

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, ids array<int>, score double")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of each row of encoded(doc_id, ids); null ids give an empty text."""

    def run(batches):
        own = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, n_bytes, ids_crc32, score, round_trip) of each row; round_trip: decoding gives the text.

    A text that holds the space mark itself decodes to a space there, as the format has it, and does not round-trip.
    Rows that repeat and null doc_ids are kept; null text counts as empty; other columns are ignored; an empty table
    gives none.
    """

    def run(batches):
        own = model(path)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                ids, score, fallback = own.encode(text)
                rows.append((len(ids) // 4, fallback, zlib.crc32(ids), score, own.decode(np.frombuffer(ids, "<u4")) == text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_pieces", "n_bytes", "ids_crc32", "score", "round_trip"])
        own.forget()

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, score double, round_trip boolean")
