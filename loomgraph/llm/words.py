"""Words and 64-bit fingerprints shared by the operators on passages and shingles."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"\w+")
NO_WORD = re.compile(r"\W")
BLOCK_CHARS = 1_000_000
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_IN_WORD: list[np.ndarray] = []


def _in_word() -> np.ndarray:
    """Whether each code point is a word character, as `\\w` has it."""
    if not _IN_WORD:
        _IN_WORD.append(np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), dtype=bool, count=0x110000))
    return _IN_WORD[0]


def _block_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of a lower-cased text, by prefix sums over its code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    inside = _in_word()[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.r_[0, edges] if len(inside) and inside[0] else edges
    edges = np.r_[edges, len(points)] if len(edges) % 2 else edges
    start, end = edges[::2], edges[1::2]
    up, down = _powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, dtype=U64)
    np.cumsum((points + U64(1)) * up[: len(points)], out=sums[1:])
    return scramble((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)), start


def texts_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of word characters, lower-cased) of all texts in a row, and where each text's words begin.

    Whole texts are hashed, in blocks of about BLOCK_CHARS that end between words, which bounds memory."""
    lowered = [t.lower() if isinstance(t, str) else "" for t in texts]
    ends = np.cumsum(np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered)) + 1)
    whole, at, hashes, starts = "\n".join(lowered), 0, [], []
    while at < len(whole):
        gap = NO_WORD.search(whole, at + BLOCK_CHARS)
        to = gap.start() if gap else len(whole)
        h, start = _block_hashes(whole[at:to])
        hashes.append(h)
        starts.append(start + at)
        at = to
    if not hashes:
        return np.zeros(0, dtype=U64), np.zeros(len(lowered) + 1, dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), np.r_[0, ends])


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of the whole text."""
    return texts_hashes([text])[0]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values of x; sorting is several times as fast here as the hashing that np.unique does."""
    x = np.sort(x)
    first = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


_POWERS = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 4096)
        for i, b in enumerate((BASE, _INVERSE)):
            steps = np.full(size, b, dtype=U64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


class Fingerprints:
    """Fingerprints of any stretches of a sequence of hashes: prefix sums of x[i] * B**i, shifted back by B**-start."""

    def __init__(self, x: np.ndarray):
        up, self.down = (p for p in _powers(len(x) + 1))
        self.sums = np.zeros(len(x) + 1, dtype=U64)
        np.cumsum(x * up[: len(x)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def grams(x: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all k-grams of x."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    start = np.arange(n)
    return Fingerprints(x).of(start, start + k)


def gram_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct k-gram fingerprints of each text; a text of fewer words is one gram, one without words has none."""
    x, at = texts_hashes(texts)
    every = grams(x, k)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        own = every[lo : hi - k + 1] if hi - lo >= k else grams(x[lo:hi], hi - lo) if hi > lo else every[:0]
        out.append(distinct(own))
    return out
