"""Word hashes and hashed k-mers of words, with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words; bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) > 150_000:
            self.clear()
        self[word] = h
        return h


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()  # one for each worker process


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes().__getitem__, words), dtype=_U, count=len(words))


def kmers(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words; of all words where there are fewer, but not none."""
    n = len(hashes)
    k = min(k, n)
    if not n:
        return np.zeros(0, dtype=_U)
    out = np.zeros(n - k + 1, dtype=_U)
    for j in range(k):  # a polynomial in an odd number, by Horner's rule
        out = out * _MULTIPLIER + hashes[j : n - k + 1 + j]
    return mixed(out + _U(k))


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes with the number of their occurrence mixed in, so that all differ: the i-th occurrence in one text
    matches the i-th in another."""
    if len(h) < 2:
        return h
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return h
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    rank = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    out = h.copy()
    out[order] = np.where(rank > 0, mixed(s + rank.astype(_U) * _MULTIPLIER), s)
    return out
