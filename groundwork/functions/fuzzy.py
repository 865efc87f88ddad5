"""Word runs and windowed edit distance, vectorised over all windows of a source."""

from __future__ import annotations

import numpy as np

RUN, LOW, HIGH, GATE = 5, 0.6, 1.5, 0.3


def longest_run(claim: list[str], source: list[str]) -> tuple[int, int]:
    """Length and start in the source of the longest common run of words.

    Ties go to the run that is earliest in the claim, then in the source. One diagonal sweep over equal words.
    """
    at: dict[str, list[int]] = {}
    for j, w in enumerate(source):
        at.setdefault(w, []).append(j)
    best, where, ends = 0, -1, {}
    for w in claim:
        now = {}
        for j in at.get(w, ()):
            n = ends.get(j - 1, 0) + 1
            now[j] = n
            if n > best:
                best, where = n, j - n + 1
        ends = now
    return best, where


#: Starts whose columns are carried at once; a claim's sources are taken together up to that many.
STARTS = 1 << 14


def _steps(pattern: np.ndarray, text: np.ndarray, starts: np.ndarray, longest: int, needed):
    """Yields, for w = 1..longest, (starts, edit distances of the pattern and text[s:s + w]).

    Bit-parallel columns (Myers; Hyyrö's block form): one step carries the columns of all starts at once. Before a
    step, needed(w) may name the starts that still matter, as a mask over those last yielded; the others are dropped.
    """
    m, words = len(pattern), (len(pattern) + 63) // 64
    one, top = np.uint64(1), np.uint64(1 << 63)
    symbols, code = np.unique(np.concatenate([pattern, text]), return_inverse=True)
    equal = np.zeros((words, len(symbols)), np.uint64)
    for i, c in enumerate(code[:m]):
        equal[i // 64, c] |= one << np.uint64(i % 64)
    code = code[m:]
    plus = np.full((words, len(starts)), ~np.uint64(0))
    minus = np.zeros((words, len(starts)), np.uint64)
    last = np.uint64((m - 1) % 64)
    score = np.full(len(starts), m, np.int64)
    for w in range(longest):
        keep = needed(w + 1)
        if keep is not None:
            starts, plus, minus, score = starts[keep], plus[:, keep], minus[:, keep], score[keep]
            if not len(starts):
                return
        symbol = code[np.minimum(starts + w, len(code) - 1)]
        carry_plus = carry_minus = None
        for k in range(words):
            pv, mv, eq = plus[k], minus[k], equal[k][symbol]
            xv = eq | mv
            if carry_minus is not None:
                eq = eq | carry_minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if k == words - 1:
                score = score + ((ph >> last) & one).view(np.int64) - ((mh >> last) & one).view(np.int64)
            else:
                out_plus, out_minus = ph >> np.uint64(63), mh >> np.uint64(63)
            ph, mh = (ph << one) | (one if carry_plus is None else carry_plus), mh << one
            if carry_minus is not None:
                mh |= carry_minus
            plus[k], minus[k] = mh | ~(xv | ph), ph & xv
            if k < words - 1:
                carry_plus, carry_minus = out_plus, out_minus
        yield starts, score


def _grams(x: np.ndarray) -> np.ndarray:
    return x[:-2].astype(np.int32) << 14 | x[1:-1].astype(np.int32) << 7 | x[2:]


def _together(claim: np.ndarray, sources: list[np.ndarray]) -> list[tuple[float, int, int]]:
    m = len(claim)
    low, high = max(1, int(m * LOW)), int(np.ceil(m * HIGH))
    text = np.concatenate([np.append(s, 0) for s in sources])  # a zero ends each source and is in no claim
    size = np.array([len(s) for s in sources])
    begin = np.cumsum(size + 1) - size - 1
    wanted = np.unique(_grams(claim))
    hits = np.zeros(len(text) + 1, np.int64)
    np.cumsum(np.isin(_grams(text), wanted), out=hits[1 : len(text) - 1])
    hits[len(text) - 1 :] = hits[len(text) - 2] if len(text) > 2 else 0
    # the step of a window is a tenth of it: a start matters up to the longest window whose step divides its place
    place = np.concatenate([np.arange(max(0, n - low + 1)) for n in size])
    own = np.repeat(np.arange(len(size)), np.maximum(0, size - low + 1))
    reach = np.zeros(len(place), np.int64)
    for step in range(max(1, low // 10), max(1, high // 10) + 1):
        reach[place % step == 0] = min(high, 10 * step + 9)
    reach = np.minimum(reach, size[own] - place)
    start = begin[own] + place
    most = hits[np.minimum(start + np.maximum(reach - 2, 0), len(hits) - 1)] - hits[start]
    live = np.flatnonzero((reach >= low) & (most / len(wanted) >= GATE))
    place, own, reach, start = place[live], own[live], reach[live], start[live]
    found = [(0.0, -1, 0)] * len(sources)
    if not len(start):
        return found
    best = np.zeros(len(sources))
    held = [place, own, reach]

    def needed(w):
        if w % 10 and w > low:
            return None
        keep = held[2] >= w
        if keep.all():
            return None
        held[:] = [x[keep] for x in held]
        return keep

    for w, (at, distance) in enumerate(_steps(claim, text, start, high, needed), 1):
        if w < low:
            continue
        place, own, reach = held
        ok = np.flatnonzero((place % max(1, w // 10) == 0) & (reach >= w))
        ok = ok[(hits[at[ok] + max(w - 2, 0)] - hits[at[ok]]) / len(wanted) >= GATE]
        if not len(ok):
            continue
        d, of = distance[ok], own[ok]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        least = np.minimum.reduceat(d, first)
        similarity = 1 - least / max(m, w)
        for j in np.flatnonzero(similarity > best[of[first]]):
            stop = first[j + 1] if j + 1 < len(first) else len(d)
            k = first[j] + int(d[first[j] : stop].argmin())
            best[of[k]] = similarity[j]
            found[of[k]] = (float(similarity[j]), int(place[ok[k]]), w)
    return found


def best_windows(claim: str, sources: list[str]) -> list[tuple[float, int, int]]:
    """(similarity, start, length), for each normalised source, of its window nearest to the normalised claim.

    Windows of 0.6 to 1.5 times the claim's length, every tenth of a window; those that hold few of the claim's
    trigrams do not count. The first best wins, shorter windows before longer ones. (0, -1, 0) if none counts.
    """
    m = len(claim)
    out = [(0.0, -1, 0)] * len(sources)
    todo, held = [], 0
    c = np.frombuffer(claim.encode("ascii"), np.uint8)

    def flush():
        for i, r in zip(todo, _together(c, [np.frombuffer(sources[i].encode("ascii"), np.uint8) for i in todo])):
            out[i] = r
        todo.clear()

    for i, s in enumerate(sources):
        if m < 3 or not s or m > 2 * len(s) or max(1, int(m * LOW)) > len(s):
            continue
        todo.append(i)
        held += len(s)
        if held >= STARTS:
            flush()
            held = 0
    if todo:
        flush()
    return out


def best_window(claim: str, source: str) -> tuple[float, int, int]:
    """best_windows of one source."""
    return best_windows(claim, [source])[0]
