"""Best-fit packing of tokenised documents by a configuration linear program over the length histogram.

Texts are tokenised where they are read; only (doc_id, piece, length, checksum) rows go on. The histogram has at most
`capacity` lengths whatever the input, so the driver solves the covering program min sum x_c, sum_c a_cl x_c >= n_l:
multiplicative weights keep a price per length that falls as its pieces are covered, a knapsack dynamic program prices
all configurations (multisets of lengths in one sequence) at once, and the best one with each length is read back from
it. The solution is rounded to whole times, what is left is solved and rounded again, and the few pieces that remain are
packed best-fit decreasing by counts. The prices also give a lower bound of the sequences that any packing takes. The
plan (some ten thousand slots) is broadcast: it is bounded by the capacity and the rounds, not by the input. Pieces meet
their slots by rank within their length; ranks are running counts in salted buckets of each length, as many as its pieces
ask for, so that no length is ever sorted in one task.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import BoundedCache, lean, materialised, worker_cache

CAPACITY = 2048
#: How fast a price falls with the share that is covered, and failures in a row after which a round ends.
RATE, MISSES = 0.2, 16
#: The largest share of a sequence that a rounded configuration may lose against the dual prices.
MOST = 0.25
_UNSAFE = re.compile(r"\s\x20(?:\s|\Z)")
_SPECIAL = "<|endoftext|>"
#: Bytes of a task's chunk cache; it is emptied when full and at the task's end, and only saves time.
_CACHE = 24 << 20
#: Pieces of a length that are ranked in one task, and the most salts of all lengths together.
_RANKED, _SALTS = 4096, 1 << 16


class ChunkEncoder:
    """Ids of the byte-level BPE file, through a cache of the chunks between spaces.

    The pre-tokeniser always cuts before the last space of a white-space run that a non-space follows, so chunks that
    begin with that space can be encoded apart; texts with white space on both sides of a space are encoded whole, as
    are those with the special token's string. Chunks of Latin letters take the rank file of the same vocabulary,
    whose ids are equal; all others the tokenizers file itself.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import base64
        import os

        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(json_path)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.fast = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache = BoundedCache(_CACHE)

    def _one(self, chunk: str) -> bytes:
        latin = max(chunk) < "ɐ"
        ids = self.fast.encode_ordinary(chunk) if latin else self.whole.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if _SPECIAL in text or _UNSAFE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        cache = self.cache
        head, *tail = text.split(" ")
        out = [self._one(head)] if head else []
        for word in tail:
            found = cache.get(word)
            if found is None:
                found = self._one(" " + word)
                cache.put(word, found, 2 * len(word) + len(found) + 100)
            out.append(found)
        return b"".join(out)


def encoder(name: str = "byte_bpe_50k") -> ChunkEncoder:
    import public_tokenizers as public

    return worker_cache(f"chunks {name}", lambda: ChunkEncoder(public.path(f"{name}.json"), public.path(f"{name}.tiktoken")))


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each document's ids and a final 0, cut into pieces of `capacity` only when longer; the first may be shorter."""

    def cut(batches):
        own = encoder()
        encode = own.ids
        for batch in batches:
            rows = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    for x, y in zip(rows, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), ids[4 * a : 4 * b] if with_ids else None)):
                        x.append(y)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)][: 5 + with_ids], names=names[: 5 + with_ids])
        own.cache.clear()

    return docs.select("doc_id", "text").mapInArrow(lean(cut), _PIECES + ", ids binary" * with_ids)


def knapsack(price: np.ndarray, capacity: int) -> np.ndarray:
    """The best worth of any multiset of lengths for each total up to capacity; price[l] for length l, -inf if none.

    One dynamic program over the totals, each step a maximum over all lengths at once.
    """
    back = np.zeros(capacity + 1)  # from the right: a window of it lies against the prices of lengths 1, 2, ...
    top = 0.0
    for c in range(1, capacity + 1):
        top = max(top, float((back[capacity - c + 1 :] + price[1 : c + 1]).max()))
        back[capacity - c] = top
    return back[::-1].copy()


def read_back(first: int, price: np.ndarray, worth: np.ndarray, room: np.ndarray, loss: float) -> tuple[dict[int, int], float]:
    """A configuration with one `first` that takes of each length at most room[length], and what it is worth.

    The dynamic program's values lead: each step takes the length after which most can still be gained, as often as
    nothing is lost by it. It ends early once more than `loss` would be lost against the program's optimum, which
    copies without limit can reach.
    """
    capacity = len(worth) - 1
    made, free, got = {first: 1}, capacity - first, float(price[first])
    least, own = got + worth[free] - loss, price
    while free > 0:
        value = worth[:free] + own[free:0:-1]  # of lengths free, free - 1, ..., 1: the longest of equal ones is taken
        at = int(value.argmax())
        k = free - at
        if got + value[at] < least:
            break
        if made.get(k, 0) >= room[k]:  # of what is used up there is no more
            own = own.copy() if own is price else own
            own[k] = -np.inf
            continue
        many = np.arange(1, min(int(room[k]) - made.get(k, 0), free // k) + 1)
        same = worth[free - k * many] + price[k] * many >= value[at] - 1e-12
        times = len(many) if same.all() else max(1, int(same.argmin()))
        made[k] = made.get(k, 0) + times
        got += float(price[k]) * times
        free -= k * times
    return made, got


def weigh(counts: np.ndarray, centre: np.ndarray, rounds: int, step: float, slack: float) -> tuple[dict[tuple, int], np.ndarray]:
    """Multiplicative weights on the covering program: (times of each configuration, the best dual prices found).

    A length's price falls by the exponent of the share of its pieces that is covered. In each round the dynamic
    program prices all configurations; for every length that is not covered yet, the least covered first, the best
    configuration that holds it is taken, if it is worth at least 1 - slack of the best of all, as often as the round's
    allowance of `step` of each length's pieces lets it. Prices divided by the best worth are feasible in the dual, so
    their sum over all pieces bounds every packing from below; the best such prices are the centre of later rounds.
    """
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts)
    share, times, bound = np.zeros(capacity + 1), {}, 0.0
    allowance = np.minimum(np.maximum(1, (step * counts).astype(np.int64)), counts)
    for _ in range(rounds):
        low = share[lengths].min()
        if low >= 1:
            break
        price = np.where(counts > 0, centre * np.exp(-RATE * np.clip(share - low, 0, 60)), -np.inf)
        worth = knapsack(price, capacity)
        top = price[lengths] + worth[capacity - lengths]
        best = float(top.max())
        if (found := float((price[lengths] * counts[lengths]).sum()) / best) > bound:
            bound, centre = found, np.where(counts > 0, price / best, centre)
        todo = lengths[(top >= (1 - slack) * best) & (share[lengths] < 1)]
        room, own, missed = allowance.copy(), price.copy(), 0
        for first in todo[np.lexsort((-todo, np.round(share[todo], 3)))].tolist():
            if room[first] <= 0:
                continue
            made, got = read_back(first, own, worth, room, slack * best)
            missed = missed + 1 if got < (1 - slack) * best else 0
            if missed > MISSES:  # the allowance is used up
                break
            if missed:
                continue
            many = min(int(room[l]) // n for l, n in made.items())
            for l, n in made.items():
                room[l] -= n * many
                share[l] += n * many / counts[l]
                if room[l] <= 0:
                    own[l] = -np.inf
            key = tuple(sorted(made.items(), reverse=True))
            times[key] = times.get(key, 0) + many
    return times, centre


def configurations(counts: np.ndarray, capacity: int, rounds: int = 6, step: float = 0.3, slack: float = 0.02, most: float = MOST) -> tuple[list[tuple[dict[int, int], int]], float, int]:
    """(plan, lower bound of sequences, pieces placed by the program's configurations).

    The plan's (configuration, times) use every one of counts[l] pieces of each length l exactly once. The program's
    solution is rounded by taking its configurations, those worth most at the dual prices first, as often as pieces are
    left for them whole; those that lose more than `loss` stay out. What is left is a smaller program, which is solved
    and rounded again; the loss that is borne doubles, up to `most`, whenever a solution places less than a tenth of
    what is left. What at last no configuration holds is packed best-fit decreasing.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan: dict[tuple, int] = {}
    whole = int(left[capacity])
    if whole:
        plan[((capacity, 1),)] = whole
        left[capacity] = 0
    size = np.arange(capacity + 1)
    bound, placed, loss, centre = 0.0, 0, 1 / capacity, size / capacity
    while left.any():
        times, centre = weigh(left, centre, rounds, step, slack)
        bound = bound or float((centre * left).sum())
        value = {key: sum(centre[l] * n for l, n in key) for key in times}
        before = left.copy()
        for key in sorted(times, key=lambda k: (-round(value[k], 9), k[0][0] * -1, k)):
            if value[key] < 1 - loss:
                break
            many = min(times[key], *(int(left[l]) // n for l, n in key))
            if many > 0:
                plan[key] = plan.get(key, 0) + many
                for l, n in key:
                    left[l] -= n * many
        gone = before - left
        placed += int(gone.sum())
        if 10 * (gone * size).sum() < (before * size).sum():
            if loss >= most:
                break
            loss = min(most, 2 * loss)
    return [(dict(key), many) for key, many in plan.items()] + best_fit(left, capacity), bound + whole, placed + whole


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over counts: equal bins are made together, so the cost follows the distinct lengths."""
    left = left.copy()
    plan = []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            return plan
        room, made = capacity, {}
        while room > 0:
            k = int(np.searchsorted(lengths, room, "right")) - 1
            while k >= 0 and left[lengths[k]] - made.get(int(lengths[k]), 0) <= 0:
                k -= 1
            if k < 0:
                break
            made[int(lengths[k])] = made.get(int(lengths[k]), 0) + 1
            room -= int(lengths[k])
        times = min(int(left[l] // n) for l, n in made.items())
        plan.append((made, times))
        for l, n in made.items():
            left[l] -= n * times


def _slots(plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset) of every slot of the plan."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for made, times in plan:
        offset = 0
        for length, n in sorted(made.items(), reverse=True):
            for _ in range(n):
                rank = used.get(length, 0)
                rows.append((length, rank, rank + times, sequence, offset))
                used[length] = rank + times
                offset += length
        sequence += times
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, rounds: int = 6) -> DataFrame:
    """One row per piece of docs(doc_id, text): _PIECES, sequence_id and offset, gapless from 0 in each sequence.

    Null and empty texts are one id. Rows that repeat, and null doc_ids, are packed like any other; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = materialised(pieces_of(docs, capacity))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most capacity rows
        histogram[r["length"]] = r["count"]
    # the more pieces have one length, the more salts it has: none is ranked in one task, at most _SALTS rows come back
    unit = max(_RANKED, int(histogram.sum()) // _SALTS)
    salts = spark.createDataFrame([(int(l), int(histogram[l]) // unit + 1) for l in np.flatnonzero(histogram)], "length long, salts int")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.expr("pmod(xxhash64(doc_id, piece, ids_crc32), salts)")).drop("salts")
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()
    slots = _slots(configurations(histogram, capacity, rounds)[0])
    # each salt of a length takes a range of that length's ranks; ranges are cut where slots end
    ahead: dict[int, int] = {}
    cuts: dict[int, list] = {}
    for s in slots:
        cuts.setdefault(s[0], []).append(s)
    base = []
    for r in sorted(by_salt, key=lambda r: (r["length"], r["salt"])):
        base.append((r["length"], r["salt"], ahead.get(r["length"], 0)))
        ahead[r["length"]] = ahead.get(r["length"], 0) + r["n"]
    base_df = spark.createDataFrame(base, "length long, salt long, base long")
    per_length = [(l, [list(map(int, s[1:])) for s in sorted(v, key=lambda s: s[1])]) for l, v in cuts.items()]
    slot_df = spark.createDataFrame(per_length, "length long, slots array<array<long>>")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (
        salted.withColumn("_rank", rank.cast("long") - 1)
        .join(F.broadcast(base_df), ["length", "salt"])
        .withColumn("_rank", F.col("_rank") + F.col("base"))
        .join(F.broadcast(slot_df), "length")
        .withColumn("_slot", F.expr("filter(slots, s -> _rank >= s[0] and _rank < s[1])[0]"))
    )
    return ranked.select(
        *(c.split()[0] for c in _PIECES.split(", ")),
        F.expr("_slot[2] + _rank - _slot[0]").alias("sequence_id"),
        F.expr("_slot[3]").alias("offset"),
    )


def sequences(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: (sequence_id, n_tokens, ids), each at most `capacity` ids long."""
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = pieces_of(docs, capacity, with_ids=True).dropDuplicates(key)
    placed = pack(docs, capacity)
    same = [placed[k].eqNullSafe(ids[k]) for k in key]
    joined = placed.join(ids, same[0] & same[1] & same[2] & same[3] & same[4]).select(placed["sequence_id"], placed["offset"], ids["ids"])

    def decode(batches):
        for b in batches:
            values = [np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(v) for v in values], pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["sequence_id", "n_tokens", "ids"])

    gathered = joined.groupBy("sequence_id").agg(F.expr("transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids)").alias("parts"))
    return gathered.mapInArrow(decode, "sequence_id long, n_tokens long, ids array<long>")
