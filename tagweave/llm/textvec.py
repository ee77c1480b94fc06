"""Words and word n-grams of many texts at once, as numpy arrays of positions and 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
#: Bytes that are hashed in one go; memory is about 40 times this.
PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("p", ())) < n:
        _TABLES["p"], _TABLES["q"] = _powers(_P, n), _powers(_P_INV, n)
    return _TABLES["p"], _TABLES["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of data[start:end], by differences of one running sum."""
    p, q = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a list of texts. data: the texts, each followed by a line feed; bounds: where each text begins in data, and the end."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: The first word of each text, and their number.
    first: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words(texts: list[bytes], lower: bool = True, hashed: bool = True) -> Words:
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if lower:
        data = _LOWER[data]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    first = np.searchsorted(starts, bounds)
    if not hashed:
        hashes = np.zeros(0, np.uint64)
    elif len(data) <= 2 * PIECE:
        hashes = _hashes(data, starts, ends)
    else:  # one very long text: words in pieces, so that memory stays bounded
        parts, i = [], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
            a = starts[i]
            parts.append(_hashes(data[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a))
            i = j
        hashes = np.concatenate(parts)
    return Words(data, bounds, starts, ends, first, hashes)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbours, also those across texts: the caller takes the ones that it wants."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m] * _ODD[0]
    for k in range(1, n):
        out += hashes[k : k + m] * _ODD[k]
    return mix(out + np.uint64(n))
