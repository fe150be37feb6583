"""Fuzzy matching: how well the shorter of two strings fits its best place in the longer one, from 0 to 100."""

from __future__ import annotations

import re

import numpy as np

_OTHER = re.compile(r"[\W_]+")


def processed(text: str | None) -> str:
    """Lower case, with spaces for all but letters and digits, trimmed."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def _common(places: dict[str, int], full: int, window: str) -> int:
    """Length of the longest common subsequence, by bit-parallel addition; places holds the bits of each character."""
    state = full
    for c in window:
        hit = state & places.get(c, 0)
        state = (state + hit | state - hit) & full
    return (full & ~state).bit_count()


def _best_place(short: str, long: str) -> float:
    m, n = len(short), len(long)
    places: dict[str, int] = {}
    for k, c in enumerate(short):
        places[c] = places.get(c, 0) | 1 << k
    best, full = 0.0, (1 << m) - 1
    spans = [(0, k) for k in range(1, m)] + [(k, k + m) for k in range(n - m + 1)] + [(n - k, n) for k in range(m - 1, 0, -1)]
    for lo, hi in spans:
        most = 200.0 * min(m, hi - lo) / (m + hi - lo)
        if most > best and (long[lo] in places or long[hi - 1] in places):
            best = max(best, 200.0 * _common(places, full, long[lo:hi]) / (m + hi - lo))
    return best


def partial_ratio(a: str | None, b: str | None) -> int:
    """Of all windows of the longer string up to the shorter one's length, the best similarity by insertions and deletions.

    Of two strings of one length each is tried in the other.
    """
    short, long = sorted((processed(a), processed(b)), key=len)
    if not short:
        return 0
    if short in long:
        return 100
    best = _best_place(short, long)
    return int(round(max(best, _best_place(long, short)) if len(short) == len(long) else best))


CELLS = 200_000  # places of windows that are followed at once


def _characters(texts: list[str], width: int) -> np.ndarray:
    """Code points of texts, a row each, 0 beyond their ends; no processed text has that character."""
    return np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)


def _best_windows(places: np.ndarray, size: int, lengths: np.ndarray) -> np.ndarray:
    """The best ratio of a pattern of size characters (63 at most) in the windows of each row's text.

    places has the bits of the pattern's places for each character of the text. A window begins at each character and has
    size of them or what is left; from the first one the shorter beginnings are windows too. Common subsequences grow in
    all windows at once, a character a step.
    """
    rows, width = places.shape
    full = np.uint64((1 << size) - 1)
    state, padded = np.full((rows, width), full), np.pad(places, ((0, 0), (0, size)))
    best = np.zeros(rows)
    for step in range(size):
        hit = state & padded[:, step : step + width]
        state = (state + hit | state - hit) & full
        begun = np.where(step < lengths, 200.0 * (size - np.bitwise_count(state[:, 0]).astype(float)) / (size + step + 1), 0)
        best = np.maximum(best, begun)
    span = np.minimum(size, lengths[:, None] - np.arange(width))
    found = np.where(span > 0, 200.0 * (size - np.bitwise_count(state).astype(float)) / (size + np.maximum(span, 1)), 0)
    return np.maximum(best, found.max(axis=1))


def _found_in(query: str, texts: list[str]) -> np.ndarray:
    """The best ratio of query in the windows of each of texts, none of which is empty."""
    width, own = max(map(len, texts)), sorted(set(query))
    bits = np.array([sum(1 << k for k, x in enumerate(query) if x == c) for c in own] + [0], np.uint64)
    points, chars = np.array([ord(c) for c in own], np.uint32), _characters(texts, width)
    at = np.searchsorted(points, chars)
    at = np.where(points[np.minimum(at, len(own) - 1)] == chars, np.minimum(at, len(own) - 1), len(own))
    return _best_windows(bits[at], len(query), np.array([len(t) for t in texts]))


def _holding(query: str, texts: list[str]) -> np.ndarray:
    """The best ratio of each of texts, which have one length, in the windows of query."""
    size, chars = len(texts[0]), _characters(texts, len(texts[0]))
    asked = np.array([ord(c) for c in query], np.uint32)
    places = np.zeros((len(texts), len(query)), np.uint64)
    for k in range(size):
        places |= (chars[:, k : k + 1] == asked).astype(np.uint64) << np.uint64(k)
    return _best_windows(places, size, np.full(len(texts), len(query)))


def ratios(query: str, texts: list[str]) -> np.ndarray:
    """partial_ratio() of a query with each of texts, all processed already, many at a time.

    Where the shorter of the two has over 63 characters a pair is rated by itself.
    """
    best, sizes, m = np.zeros(len(texts)), np.array([len(t) for t in texts], np.int64), len(query)
    long = np.minimum(sizes, m) > 63
    for k in np.flatnonzero(long).tolist():
        best[k] = partial_ratio(query, texts[k])

    def rate(which: np.ndarray, by, width) -> None:
        step = max(1, CELLS // max(1, width))
        for i in range(0, len(which), step):
            some = which[i : i + step]
            best[some] = np.maximum(best[some], by(query, [texts[k] for k in some]))

    if m:
        wide = np.flatnonzero((sizes >= m) & ~long)
        wide = wide[np.argsort(sizes[wide], kind="stable")]
        at = 0
        while at < len(wide):  # texts of about one length together
            end = int(np.searchsorted(sizes[wide], sizes[wide[at]] * 5 // 4, "right"))
            rate(wide[at:end], _found_in, int(sizes[wide[end - 1]]))
            at = end
        for size in np.unique(sizes[(sizes <= m) & (sizes > 0) & ~long]).tolist():
            rate(np.flatnonzero(sizes == size), _holding, m)
    return np.rint(best).astype(np.int64)
