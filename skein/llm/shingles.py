"""Sets of hashed word shingles, made from the bytes of many texts at once.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case. A word's hash is
a polynomial over its bytes taken from prefix sums (64 bits, wrapping), a shingle's hash one over
its words' hashes; both are mixed afterwards.
"""

from __future__ import annotations

import numpy as np

from .common import slices

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = int(_RNG.integers(1 << 61, 1 << 62)) * 2 + 1
_Q = int(_RNG.integers(1 << 61, 1 << 62)) * 2 + 1
#: Bytes of text worked on at a time (a longer text is worked on alone).
BLOCK = 1 << 18
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power(n: int) -> list[np.ndarray]:
    """p^i and p^-i for i < n, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            step = np.full(size, base, _U)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = 5):
    """For each text, in order, the sorted distinct hashes (uint64) of its n-word shingles.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    for first, last in slices(off, BLOCK):
        yield from _block(data[off[first] : off[last]], off[first : last + 1] - off[first], n)


def _block(data: np.ndarray, off: np.ndarray, n: int):
    power, inverse = _power(len(data) + 1)
    texts = len(off) - 1
    inside = ~_SPACE[data]
    if not inside.any():
        yield from (np.zeros(0, _U) for _ in range(texts))
        return
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    seams = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    starts[seams] = inside[seams]
    ends[seams - 1] = inside[seams - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    word = mix((sums[ends] - sums[starts]) * inverse[starts])
    bounds = np.searchsorted(starts, off)
    shingle = word[: max(0, len(word) - n + 1)]
    for k in range(1, n):
        shingle = shingle * _U(_Q) + word[k : len(word) - n + 1 + k]
    shingle = mix(shingle)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(shingle[a : b - n + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            whole = b - a
            for w in word[a:b].tolist():
                whole = (whole * _Q + w + 1) & 0xFFFFFFFFFFFFFFFF
            yield mix(np.array([whole], _U))
        else:
            yield np.zeros(0, _U)
