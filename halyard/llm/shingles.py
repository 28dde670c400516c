"""Word shingles of whole texts as sets of 64-bit numbers, and their MinHash signatures, in numpy."""

from __future__ import annotations

import numpy as np

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``; no two numbers meet."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse, mod 2^64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, np.uint64(base))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def word_hashes(text: bytes) -> np.ndarray:
    """A number for each word of ``text``, letters A-Z as a-z: a polynomial of its bytes, mixed."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside))
    starts = edge[~inside[edge]] + 1
    ends = edge[inside[edge]] + 1
    starts = np.concatenate(([0], starts)) if inside[0] else starts
    ends = np.concatenate((ends, [len(raw)])) if inside[-1] else ends
    up, down = _POWERS.get(len(raw) + 1)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: bytes, k: int = 5) -> np.ndarray:
    """The sorted distinct shingles of ``k`` words; with fewer words, all of them as one; empty without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(k, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size))
    for i in range(size):
        out = mixed(out * np.uint64(0x2545F4914F6CDD1D) + words[i : i + len(out)])
    return np.unique(out)


class Signer:
    """MinHash signatures: ``bands`` keys of ``rows`` hashes each, and the low 16 bits of the first ``kept`` hashes."""

    def __init__(self, bands: int, rows: int, kept: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = bands * rows
        self.bands, self.rows, self.kept = bands, rows, kept
        self.a = (rng.integers(0, 1 << 31, n, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]
        self.weights = mixed(rng.integers(0, 1 << 63, n, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)
        self.buffer = np.empty((n, 256), np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(short), 256):
            part = short[at : at + 256]
            own = self.buffer[:, : len(part)]
            np.multiply(self.a, part, out=own)
            np.add(own, self.b, out=own)
            np.minimum(low, own.min(axis=1), out=low)
        return low

    def sign(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        low = self.minima(shingles)
        keys = (mixed(low.astype(np.uint64)).reshape(self.bands, self.rows) * self.weights).sum(axis=1, dtype=np.uint64)
        places = np.arange(self.bands, dtype=np.uint64)
        return mixed(keys + places * np.uint64(_BASE)).view(np.int64), (low[: self.kept] >> np.uint32(8)).astype("<u2").tobytes()


def set_print(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that follow from the set alone."""
    other = mixed(shingles ^ np.uint64(0xD6E8FEB86659FD93))
    return tuple(int(x) for x in np.array([mixed(shingles).sum(dtype=np.uint64), np.bitwise_xor.reduce(other)], np.uint64).view(np.int64))
