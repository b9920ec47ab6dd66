"""XXH64 of many short byte strings at once, with numpy.

The algorithm is the published one; strings of one length are hashed together,
reading 8, 4 and 1 bytes at any offset of one buffer.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
# The five primes of XXH64.
P1, P2, P3, P4, P5 = (U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9),
                      U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U(bits)) | (x >> U(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of ``buffer[start:start + length]``; the buffer must go on for 8
    bytes after the last string."""
    out = np.empty(len(start), U)
    if not len(start):
        return out
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    four = np.ndarray((len(buffer) - 3,), "<u4", buffer, strides=(1,))
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    ends = np.append(first[1:], len(order))
    for size, a, b in zip(sizes.tolist(), first.tolist(), ends.tolist()):
        rows = order[a:b]
        out[rows] = _of_one_length(buffer, eight, four, start[rows], size, U(seed))
    return out


def _of_one_length(buffer, eight, four, at, size, seed):
    zero = np.zeros(len(at), U)
    done = 0
    with np.errstate(over="ignore"):
        if size >= 32:
            acc = [zero + (seed + P1 + P2), zero + (seed + P2), zero + seed, zero + (seed - P1)]
            while size - done >= 32:
                acc = [_round(v, eight[at + (done + 8 * k)]) for k, v in enumerate(acc)]
                done += 32
            h = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for v in acc:
                h = (h ^ _round(zero, v)) * P1 + P4
        else:
            h = zero + (seed + P5)
        h = h + U(size)
        while size - done >= 8:
            h = _turn(h ^ _round(zero, eight[at + done]), 27) * P1 + P4
            done += 8
        if size - done >= 4:
            h = _turn(h ^ (four[at + done].astype(U) * P1), 23) * P2 + P3
            done += 4
        while done < size:
            h = _turn(h ^ (buffer[at + done].astype(U) * P5), 11) * P1
            done += 1
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        h ^= h >> U(32)
    return h
