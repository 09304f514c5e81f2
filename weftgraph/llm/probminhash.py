"""ProbMinHash signatures of weighted sets, many sets at once.

Each element of a set sends a Poisson process of arrivals with its weight as rate; every arrival
falls into one of m registers, and a register keeps the earliest. Two sets agree in a register with
the probability of their (probability) Jaccard similarity, which for equal weights is the plain
Jaccard similarity. Arrivals are made round by round for all sets of a block; an element ends its
process as soon as its next arrival is later than the latest register of its set, since it could
change nothing any more.
"""

from __future__ import annotations

from math import comb

import numpy as np

from .shingles import mix


def signatures(doc: np.ndarray, element: np.ndarray, n_docs: int, m: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Earliest arrivals (n_docs x m, float64); ``doc`` numbers the sets, infinite for an empty one.

    Equal elements send equal arrivals in every set, scaled by their weight.
    """
    q = np.full(n_docs * m, np.inf)
    at = np.zeros(len(element))
    state, base = mix(element + np.uint64(0x632BE59BD9B4E019)), doc * m
    rate = None if weight is None else 1.0 / np.asarray(weight, dtype=np.float64)
    step = np.uint64(0x9E3779B97F4A7C15)
    while len(state):
        state = state + step
        r = mix(state)
        gap = -np.log(((r >> np.uint64(20)).astype(np.float64) + 0.5) * 2.0**-44)
        at = at + (gap if rate is None else gap * rate)
        slot = base + ((r & np.uint64(0xFFFFF)).astype(np.int64) * m >> 20)
        np.minimum.at(q, slot, at)
        latest = q.reshape(n_docs, m).max(axis=1)
        on = np.flatnonzero(at < latest[base // m])
        state, at, base = state[on], at[on], base[on]
        if rate is not None:
            rate = rate[on]
    return q.reshape(n_docs, m)


def bands(q: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers; the band's number is part of the key."""
    bits = q.view(np.uint64)
    n, m = bits.shape
    part = bits.reshape(n, m // rows, rows)
    key = np.broadcast_to(mix(np.arange(m // rows, dtype=np.uint64) + np.uint64(77)), (n, m // rows)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(3) + part[:, :, k])
    return key.view(np.int64)


def words_of(q: np.ndarray) -> np.ndarray:
    """64 bits of each signature, one of each of the first 64 registers: two words agree in a bit
    with probability ``(1 + J) / 2``."""
    bits = (mix(q[:, :64].copy().view(np.uint64)) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64).ravel()


def radius_for(threshold: float, miss: float, bits: int = 64) -> int:
    """Least Hamming radius that a pair at the threshold exceeds with at most probability ``miss``."""
    p, tail, r = (1 - threshold) / 2, 1.0, -1
    while tail > miss:
        r += 1
        tail -= comb(bits, r) * p**r * (1 - p) ** (bits - r)
    return r
