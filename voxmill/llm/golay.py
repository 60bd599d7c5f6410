"""The binary Golay code (23,12,7) as a fuzzy hash of 23-bit segments.

The code is perfect: every vector lies within 3 bits of exactly one codeword. A vector
that is 3 bits away from its codeword is also 4 bits away from five others. The
12-bit indices of these one or six codewords are its keys; two vectors that differ in
at most two bits always have a key in common.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS = 23
GENERATOR = 0xC75


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each 23-bit vector, and for each syndrome the error patterns (-1: none)."""
    single = []
    for j in range(BITS):
        v = 1 << j
        for top in range(BITS - 1, 10, -1):
            if v >> top & 1:
                v ^= GENERATOR << (top - 11)
        single.append(v)
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for part, first in ((low, 0), (high, 12)):
        for v in range(1, len(part)):
            bit = v & -v
            part[v] = part[v ^ bit] ^ single[first + bit.bit_length() - 1]
    patterns = np.full((1 << 11, 6), -1, np.int32)
    used = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for chosen in combinations(range(BITS), weight):
            e = s = 0
            for j in chosen:
                e |= 1 << j
                s ^= single[j]
            if weight < 4 or used[s]:
                patterns[s, used[s]] = e
                used[s] += 1
    return (low[:, None] ^ high[None, :]).T.ravel(), patterns


def keys(vectors: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit vectors; unused places are -1."""
    syndromes, patterns = tables()
    errors = patterns[syndromes[vectors]]
    return np.where(errors >= 0, (vectors[:, None].astype(np.int32) ^ errors) >> 11, -1)
