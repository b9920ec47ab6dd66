"""Vectorised hashing of byte and word sequences with numpy.

Rabin-Karp form: with prefix sums of ``value[i] * BASE**i`` (mod 2**64) the
hash of any slice is one subtraction and one multiplication by a power of the
inverse base, so every window of a text costs a constant number of numpy
operations.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i (mod 2**64) for i < n, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that high and low bits are usable."""
    h = h ^ (h >> U(31))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


class Slices:
    """Hashes of slices of one sequence of unsigned 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        up, self.down = powers(n + 1, base)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end]
        h = h - self.sums[start]
        h *= self.down[start]
        return mix(h)

    def every(self, width: int) -> np.ndarray:
        """Of all slices of ``width`` values, by their start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U)
        h = self.sums[width:] - self.sums[:n]
        h *= self.down[:n]
        return mix(h)


def byte_values(raw: np.ndarray) -> np.ndarray:
    """Values for Slices, never 0 so that runs of NUL bytes differ in length."""
    v = raw.astype(U)
    v += U(1)
    return v


def sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every window of ``width``."""
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    m, k = a, 1
    while 2 * k <= width:
        m = op(m[:len(m) - k], m[k:])
        k *= 2
    return m[:n] if k == width else op(m[:n], m[width - k:width - k + n])


def selected(h: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Winnowing: mask of the positions of ``h`` that hold the minimum of at
    least one window of ``width`` consecutive hashes.

    ``valid[s]`` says whether the window that starts at s may be used (it lies
    in one text). All positions that tie for a minimum are selected, so the
    choice depends on the window's content alone.
    """
    least = np.where(valid, sliding(h, width, np.minimum), U(0))
    edge = np.zeros(width - 1, U)
    best = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    return (best == h) & (best > 0)
