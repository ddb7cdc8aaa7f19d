"""DartMinHash (Christiani 2020): weighted minhash signatures of sparse sets by hashed darts, in numpy over many sets."""

from __future__ import annotations

import math

import numpy as np

U = np.uint64
GOLDEN, MASK = 0x9E3779B97F4A7C15, 2**64 - 1
#: Rank bands are [0, BASE), [BASE, 2 BASE), [2 BASE, 4 BASE), ...; weight bands are [0, 1), [1, 2), [2, 4), ...
BASE = 0.25


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return (h >> U(11)).astype(np.float64) * 2.0**-53


def _poisson(area: float) -> np.ndarray:
    """Cumulative probabilities of the number of darts in a cell of this area."""
    n = np.arange(int(area + 12 * math.sqrt(area) + 20))
    logs = n * math.log(area) - area - np.array([math.lgamma(i + 1) for i in n])
    return np.cumsum(np.exp(logs))


_tables: dict[float, np.ndarray] = {}


def _counts(h: np.ndarray, area: float) -> np.ndarray:
    if area not in _tables:
        _tables[area] = _poisson(area)
    return np.searchsorted(_tables[area], unit(h), side="right")


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, k: int, weights: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """A `sets` x `k` array of uint64. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.

    elements: hashes (uint64), each once per set; owner: the set each is in; weights: positive, 1 each if None. A set
    without elements gets zeros.

    Darts fall as a Poisson process of rate 1 on the plane of weight and rank of each element, the same for every set.
    The darts of a set are those with a weight up to the element's own and a rank up to a limit that lets about
    k ln k + 2k darts through. Each dart is hashed to a coordinate, and a coordinate keeps the dart of least rank. Sets
    in which a coordinate got none double their limit.
    """
    out = np.zeros((sets, k), U)
    w = np.ones(len(elements)) if weights is None else np.asarray(weights, np.float64)
    total = np.bincount(owner, w, sets)
    todo = total > 0
    limit = np.zeros(sets)
    limit[todo] = (k * math.log(k) + 2 * k) / total[todo]
    while todo.any():
        pick = todo[owner]
        own, best = owner[pick], np.full(sets * k, np.inf)
        hashes, found = [], []
        for e, o, rank in _darts(elements[pick], own, w[pick], limit, seed):
            at = o * k + (e % U(k)).astype(np.int64)
            np.minimum.at(best, at, rank)
            hashes.append(e)
            found.append((at, rank))
        flat = out.reshape(-1)
        for e, (at, rank) in zip(hashes, found):
            first = rank == best[at]
            flat[at[first]] = e[first]
        todo &= ~np.isfinite(best.reshape(sets, k)).all(axis=1)
        limit[todo] *= 2
    return out


def _darts(elements: np.ndarray, owner: np.ndarray, w: np.ndarray, limit: np.ndarray, seed: int):
    """(hash, owner, rank) of the darts inside the sets' regions, by cells of a weight band and a rank band."""
    key = mix(elements ^ U(seed * GOLDEN & MASK))
    even = bool((w == 1.0).all())
    wide, low = 0, 0.0
    while True:
        high = 1.0 if not wide else 2.0**wide
        in_w = np.flatnonzero(w > low) if wide else np.arange(len(w))
        if not len(in_w):
            return
        band, r0, r1 = 0, 0.0, BASE
        at = in_w
        while len(at := at[limit[owner[at]] > r0]):
            cell = mix(key[at] + U(((wide << 8) + band + 1) * GOLDEN & MASK))
            n = _counts(cell, (high - low) * (r1 - r0))
            hit = np.flatnonzero(n)
            n = n[hit]
            if len(hit):
                first = np.repeat(np.cumsum(n) - n, n)
                nth = (np.arange(n.sum()) - first + 1).astype(U)
                e = mix(np.repeat(cell[hit], n) ^ mix(nth))
                src = np.repeat(at[hit], n)
                rank = r0 + (r1 - r0) * unit(mix(e + U(1)))
                inside = rank <= limit[owner[src]]
                if not even:
                    inside &= low + (high - low) * unit(mix(e + U(2))) < w[src]
                yield e[inside], owner[src[inside]], rank[inside]
            band, r0, r1 = band + 1, r1, r1 * 2
        wide, low = wide + 1, high
