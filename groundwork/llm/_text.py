"""Vectorised byte work on Arrow text columns: words, hashes, shingles. No Python object is made per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import worker_cache

U = np.uint64
_BASE, _SEED = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: One odd multiplier per place of a word in its shingle.
_PLACES = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits evenly (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Byte tables: lower case of A-Z; what is a word byte (not 0x20, not 0x09-0x0D)."""

    def make():
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        word = np.ones(256, bool)
        word[[9, 10, 11, 12, 13, 32]] = False
        return low, word

    return worker_cache("tables", make)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i up to n."""

    def make(k):
        p = np.full(k + 1, U(_BASE))
        q = np.full(k + 1, U(pow(_BASE, -1, 1 << 64)))
        p[0] = q[0] = U(1)
        return np.cumprod(p, dtype=U), np.cumprod(q, dtype=U)

    held = worker_cache("powers", lambda: [make(1 << 20)])
    if len(held[0][0]) <= n:
        held[0] = make(1 << int(n).bit_length())
    return held[0]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's place among them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "").cast(pa.large_binary())
    places = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return (np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)), places


def pieces(places: np.ndarray, most: int = 1 << 20):
    """Ranges of rows of about `most` bytes; a longer row stays whole."""
    i, n = 0, len(places) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(places, places[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some rows: start, end, row; buf is in lower case and holds these rows only."""

    def __init__(self, data: np.ndarray, places: np.ndarray):
        low, word = tables()
        raw = data[places[0] : places[-1]]
        self.places = places - places[0]
        self.buf = low[raw]
        inside = word[raw]
        edges = self.places[(self.places > 0) & (self.places < len(raw))]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(raw):
            before[0], before[1:] = False, inside[:-1]
            before[edges] = False
            after[-1], after[:-1] = False, inside[1:]
            after[edges - 1] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(self.places, self.start, "right") - 1
        self.counts = np.bincount(self.row, minlength=len(places) - 1)

    def sums(self) -> np.ndarray:
        power, _ = powers(len(self.buf))
        out = np.zeros(len(self.buf) + 1, U)
        np.cumsum((self.buf.astype(U) + U(1)) * power[: len(self.buf)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray | None = None, most: int | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their first `most` bytes."""
        sums = self.sums() if sums is None else sums
        _, inverse = powers(len(self.buf))
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        h = (sums[end] - sums[self.start]) * inverse[self.start]
        return mix(h ^ ((end - self.start).astype(U) * U(_SEED)))

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `width` words, and where each row's begin; fewer words make one run."""
        h, n = self.hashes(), len(self.start)
        first = np.concatenate([[0], np.cumsum(self.counts)])
        total = np.zeros(max(0, n - width + 1), U)
        for k in range(width):
            total += h[k : k + len(total)] * U(_PLACES[k % 5] + 2 * (k // 5))
        full = np.flatnonzero(self.row[: len(total)] == self.row[width - 1 : width - 1 + len(total)])
        values, rows = mix(total[full]), self.row[full]
        short = np.flatnonzero((self.counts > 0) & (self.counts < width))
        part = np.zeros(len(short), U)
        for k in range(width - 1):
            have = np.flatnonzero(self.counts[short] > k)
            part[have] += h[first[short[have]] + k] * U(_PLACES[k % 5] + 2 * (k // 5))
        values = np.concatenate([values, mix(part ^ self.counts[short].astype(U))])
        rows = np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable") if len(rows) > len(full) else slice(None)
        values, rows = values[order], rows[order]
        return values, np.searchsorted(rows, np.arange(len(self.counts) + 1))


def index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and each key's place among them.

    Keys that repeat much are hashed into a table that stays in the processor's cache; if they turn out too
    many for it they are sorted.
    """
    if len(keys) < 4096:
        return np.unique(keys, return_inverse=True)
    bits = int(len(keys)).bit_length() - (1 if len(keys) < 1 << 18 else 2)
    table = np.zeros(1 << bits, U)
    where = np.empty(len(keys), np.int64)
    todo, k, h = None, keys + U(1), mix(keys)
    for _ in range(12):
        slot = (h >> U(64 - bits)).astype(np.int64)
        held = table[slot]
        if todo is None or not held.all():
            free = np.flatnonzero(held == 0)
            table[slot[free]] = k[free]
            held = table[slot]
        hit = held == k
        if todo is None:
            where[:] = slot
            todo = np.flatnonzero(~hit)
            miss = todo
        else:
            done = np.flatnonzero(hit)
            where[todo[done]] = slot[done]
            miss = np.flatnonzero(~hit)
            todo = todo[miss]
        if not len(todo):
            break
        k, h = k[miss], mix(h[miss] * U(_BASE) + U(1))
    else:
        return np.unique(keys, return_inverse=True)
    used = np.flatnonzero(table)
    distinct = table[used] - U(1)
    order = np.argsort(distinct)
    place = np.empty(1 << bits, np.int32)
    place[used[order]] = np.arange(len(used))
    return distinct[order], place[where]
