"""Words of many texts as arrays: where they are, their lengths, 64-bit hashes of words and of runs of words."""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
_P, _Q = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(20240501).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, U(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64; ``base`` is odd, so the inverse's powers exist as well."""
    return _powers(int(base), 1 << max(16, (n - 1).bit_length() if n else 0))[:n]


@functools.cache
def inverse(base: int) -> np.uint64:
    return U(pow(base, -1, 1 << 64))


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of ``values[start:end]`` for each pair, from one running sum: equal runs have equal hashes wherever they stand."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    unshift = powers(inverse(int(base)), n + 1)
    return mixed((total[end] - total[start]) * unshift[start] + (end - start).astype(np.uint64))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of texts. ``doc`` is the text of each word, ``first`` each text's first word."""

    def __init__(self, texts: list[str], lower: bool = False):
        """``lower`` turns A-Z into small letters first."""
        parts = [t.encode().lower() if lower else t.encode() for t in texts]
        joined = b"\n".join([b"", *parts, b""])
        self.raw = np.frombuffer(joined, np.uint8)
        space = _SPACE[self.raw]
        edge = np.diff(space.view(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        self.text_start = np.cumsum([1, *[len(p) + 1 for p in parts]])
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.joined = joined

    def __len__(self) -> int:
        return len(self.start)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return run_hashes(_TABLE[self.raw], self.start, self.end, _P)

    def windows(self, k: int) -> np.ndarray:
        """Hashes of ``k`` consecutive words from each word; those that leave their text are to be masked with ``whole``."""
        n = max(0, len(self) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _Q + self.hashes[j:j + n]
        return mixed(out)

    def whole(self, k: int) -> np.ndarray:
        """Whether ``k`` words from each word lie in one text."""
        n = max(0, len(self) - k + 1)
        return self.doc[:n] == self.doc[k - 1:k - 1 + n]
