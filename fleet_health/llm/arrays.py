"""Whole texts as flat numpy arrays, for the operators that run in Arrow batches.

A batch of texts is worked off in chunks of bounded size: the code points of
the chunk's texts stand in one array, and words, n-grams and pre-tokens are
ranges of it.  ``Hasher`` gives any range a 64-bit hash from prefix sums: with
random values v, H(i) = sum of v[c_j] * P^j for j < i (mod 2^64, P odd), the
hash of [a, b) is (H(b) - H(a)) * P^-a, the same wherever the range stands.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_CHARS = 400_000
CHUNK_ROWS = 4096
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
SPACES = (9, 10, 11, 12, 13, 32)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes to doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


@lru_cache(maxsize=2)
def _char_values(lower: bool) -> np.ndarray:
    c = np.arange(0x110000, dtype=np.uint64)
    if lower:
        c[65:91] += np.uint64(32)
    return mix(c * np.uint64(0xD1342543DE82EF95) + np.uint64(0x632BE59BD9B4E019))


_POWERS: dict[int, tuple] = {}


def _powers(n: int) -> tuple:
    got = _POWERS.get(0)
    if got is None or len(got[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            a = np.empty(size, np.uint64)
            a[0] = 1
            done = 1
            while done < size:  # doubling: a[done:] = a[:done] * base^done
                step = min(done, size - done)
                a[done:done + step] = a[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            out.append(a)
        got = _POWERS[0] = tuple(out)
    return got


def chunked(column: pa.Array, chars: int = CHUNK_CHARS, rows: int = CHUNK_ROWS):
    """(lo, hi, texts) of a string column without nulls, in chunks of at most
    ``rows`` texts and about ``chars`` characters; one longer text is a chunk of
    its own.  Only a chunk's texts are Python strings at a time."""
    lo, size = 0, 0
    sizes = pc.utf8_length(column).to_pylist()
    for i, n in enumerate([*sizes, None]):
        if i > lo and (n is None or size + n > chars or i - lo >= rows):
            yield lo, i, column.slice(lo, i - lo).to_pylist()
            lo, size = i, 0
        size += n or 0


def code_points(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text begins (with the end at last)."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return cp, bounds


class Hasher:
    def __init__(self, cp: np.ndarray, lower: bool = False):
        p, self.inverse = _powers(len(cp))
        self.sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(_char_values(lower)[cp] * p[:len(cp)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def is_space(cp: np.ndarray) -> np.ndarray:
    return ((cp >= 9) & (cp <= 13)) | (cp == 32)


def words(cp: np.ndarray, bounds: np.ndarray):
    """(start, end, text number) of each maximal run without ASCII white space."""
    if not len(cp):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~is_space(cp)
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    begin = bounds[:-1][bounds[:-1] < len(cp)]
    first[begin] |= ink[begin]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    stop = bounds[1:][bounds[1:] > 0] - 1
    last[stop] |= ink[stop]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(bounds, start, side="right") - 1


def per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights=values, minlength=n) if len(text) else np.zeros(n)
