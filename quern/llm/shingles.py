"""Word shingles, their 64-bit values and min-wise signatures, for whole batches in numpy.

A word's value is a polynomial over its bytes, A-Z lowered, read from prefix
sums over the batch; a shingle's combines its words' in order. Sets are equal
where their values are, up to collisions of 64-bit values within a pair of
texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _rng.integers(1, 2**63, 64, dtype=U) * U(2) + U(1)
_SEQ = U(0xD1342543DE82EF95), U(0xAF251AF3B0F025B5)
#: Bytes of text that are hashed at once.
SLICE = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_cache: dict[tuple[int, int], np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    if n > SLICE * 2:
        return _powers(base, n)
    if (int(base), 0) not in _cache:
        _cache[int(base), 0] = _powers(base, SLICE * 2)
    return _cache[int(base), 0][:n]


def _slices(texts: list[str | None]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        raw = (t or "").encode()
        if part and size + len(raw) > SLICE:
            yield part
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield part


def word_values(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Values of all words of the texts, and where each text's begin (one more entry than texts)."""
    data = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
    gap = _GAP[data]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * powers(_P, len(data)), out=sums[1:])
        values = mix((sums[ends] - sums[starts]) * powers(_P_INV, len(data))[starts] + (ends - starts).astype(U))
    at = np.cumsum([1, *(len(r) + 1 for r in raws)])
    return values, np.searchsorted(starts, at)


def _sequence(values: np.ndarray, base: np.uint64) -> int:
    with np.errstate(over="ignore"):
        return int(mix((values * powers(base, len(values))).sum(dtype=U, keepdims=True) + U(len(values)))[0])


def shingle_sets(texts: list[str | None], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its words' values and the sorted distinct values of its k-word shingles."""
    for raws in _slices(texts):
        values, at = word_values(raws)
        with np.errstate(over="ignore"):
            n = max(0, len(values) - k + 1)
            run = np.zeros(n, U)
            for i in range(k):
                run += values[i : i + n] * _PLACE[i]
            run = mix(run)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            own = values[lo:hi]
            if hi - lo >= k:
                yield own, np.unique(run[lo : hi - k + 1])
            elif hi > lo:
                yield own, np.array([_sequence(own, _SEQ[0])], U)
            else:
                yield own, np.zeros(0, U)


def sequence_values(values: np.ndarray) -> tuple[int, int]:
    """Two values of a sequence of words: texts with equal words in equal order have both in common."""
    return _sequence(values, _SEQ[0]), _sequence(values, _SEQ[1])


class Signer:
    """Min-wise signatures; a coordinate's least value is mixed with its number, so that it is a token of its own."""

    def __init__(self, coordinates: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.flip = rng.integers(0, 2**63, coordinates, dtype=U)
        self.times = rng.integers(0, 2**63, coordinates, dtype=U) * U(2) + U(1)
        self.number = mix(np.arange(1, coordinates + 1, dtype=U))

    def tokens(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            least = np.array([((values ^ f) * t).min() for f, t in zip(self.flip, self.times, strict=True)], U)
            return mix(least ^ self.number).view(np.int64)
