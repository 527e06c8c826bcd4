"""Bit-parallel counting on numpy words: positional popcounts by carry-save addition, and bit planes of integers."""

from __future__ import annotations

import numpy as np

from supplymetrics.llm.common import ship

ship(__name__)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the unsigned ``words`` have each bit set (index 0: the lowest bit), as int64.

    Three words of weight w become one sum word of weight w and one carry word of weight 2w (a full adder on every
    bit at once), until at most two words of each weight are left; only those are taken apart.
    """
    width = words.dtype.itemsize * 8
    counts, weight = np.zeros(width, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c, rest = words[:third], words[third:2 * third], words[2 * third:3 * third], words[3 * third:]
            half = a ^ b
            carries.append(a & b | half & c)
            words = np.concatenate([half ^ c, rest])
        for word in words.tolist():
            counts += weight * np.array([word >> bit & 1 for bit in range(width)], np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """Two's complement bit planes of int64 ``rows`` (n x 64): n x planes words, the sign plane last.

    Bit d of plane j is bit j of component d. The number of planes is the least that holds every value.
    """
    n_planes = 1 + max((int(v).bit_length() for v in (rows.max(initial=0), ~rows.min(initial=0))), default=0)
    lanes = np.uint64(1) << np.arange(64, dtype=np.uint64)
    planes = [((rows >> j & 1).astype(np.uint64) * lanes).sum(axis=1, dtype=np.uint64) for j in range(n_planes)]
    return np.stack(planes, axis=1)


def plane_weights(n_planes: int) -> list[int]:
    """What a set bit of each plane adds: powers of two, the sign plane negative."""
    return [1 << j for j in range(n_planes - 1)] + [-(1 << (n_planes - 1))]


def planes_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products of every vector of ``a`` (n x planes) with the one vector ``b`` (planes) by AND-popcounts."""
    total = np.zeros(len(a), np.int64)
    for i, wa in enumerate(plane_weights(a.shape[1])):
        for j, wb in enumerate(plane_weights(len(b))):
            total += wa * wb * np.bitwise_count(a[:, i] & b[j]).astype(np.int64)
    return total


def plane_sums(planes: np.ndarray) -> np.ndarray:
    """Componentwise sums of the vectors (n x planes), from the positional popcounts of each plane."""
    return sum((w * positional_popcount(planes[:, j]) for j, w in enumerate(plane_weights(planes.shape[1]))), np.zeros(64, np.int64))
