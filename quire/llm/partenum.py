"""Universe-partition signatures for exact set-similarity joins.

Sets are held by the 64-bit hashes of their elements. Sizes fall into bands; a
pair with Jaccard similarity of at least ``percent`` whose smaller set lies in a
band differs in at most ``diff`` elements, a bound that the band fixes. The hash
universe is cut into segments; by the pigeonhole principle such a pair agrees in
some segment exactly (a *subset* signature) or up to one element (a *one-deletion*
signature: the segment's subset and all its subsets with one element less).
An exact segment uses up one unit of the bound, a one-deletion segment two.

Which segments get which kind is chosen per band by a cost: signatures emitted,
and the chance that two sets which only share a passage collide, weighed by
``collide``. Signatures of empty subsets say nothing and are left out, so the
plan has ``slack`` more units than the bound needs; a set that lost more than
that is *hollow* and is indexed again under another partition with the other
hollow sets (and, on the last level, with its empty subsets too), which keeps the
guarantee whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from quire.llm.common import mix64

GROWTH = 1.25
LEVELS = 4
#: Words of a passage that unrelated documents may share, for the cost.
PASSAGE = 50
#: Weight of a collision against a signature.
COLLIDE = 500.0


@dataclass(frozen=True)
class Scheme:
    """Signatures for pairs whose smaller set has ``low`` to ``high`` elements."""

    number: int
    low: int
    high: int
    diff: int
    deletions: int  # segments with one-deletion neighbourhoods; they come first
    subsets: int  # segments matched exactly
    slack: int

    @property
    def segments(self) -> int:
        return self.deletions + self.subsets


def largest_difference(high: int, percent: int) -> int:
    """Most elements that two sets of a linked pair can differ in."""
    most = high + high * 100 // percent
    sums = range(max(2, most - 60), most + 1)
    return max(s - 2 * -(-percent * s // (100 + percent)) for s in sums)


def poisson_tail(mean: float, k: int) -> float:
    """P(X > k)."""
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


def allocate(number: int, low: int, high: int, percent: int, collide: float) -> Scheme:
    diff = max(0, largest_difference(high, percent))
    size = (low + high) / 2
    shared = min(0.6, PASSAGE / (size + 1))
    best = None
    tried = {0, *(2**k for k in range(20)), *((diff + 1) * k // 16 for k in range(1, 9))}
    for deletions in sorted(x for x in tried if 2 * x <= diff + 2):
        for slack in range(0, diff + 8):
            subsets = diff + 1 + slack - 2 * deletions
            if subsets < 0:
                continue
            mean = size / (deletions + subsets)
            weak = math.exp(-mean) * (subsets + 2 * deletions * (1 + mean))
            if deletions + subsets == 1 or poisson_tail(weak, slack) <= 0.02:
                break
        own = mean * (1 - shared)
        exact = math.exp(-2 * own)
        near = exact * (1 + own) ** 2
        cost = subsets + deletions * (mean + 1) + collide * (subsets * exact + deletions * near)
        if best is None or cost < best[0]:
            best = (cost, Scheme(number, low, high, diff, deletions, subsets, slack))
    return best[1]


#: Schemes made so far; a plain dict, as it must travel to workers with the code.
_made: dict[tuple, Scheme] = {}


def scheme(number: int, percent: int, collide: float = COLLIDE) -> Scheme:
    key = number, percent, collide
    if key not in _made:
        _made[key] = _scheme(number, percent, collide)
    return _made[key]


def _scheme(number: int, percent: int, collide: float) -> Scheme:
    low = 1
    for _ in range(number):
        low = max(low, int(low * GROWTH)) + 1
    return allocate(number, low, max(low, int(low * GROWTH)), percent, collide)


def schemes_of(size: int, percent: int, collide: float = COLLIDE) -> list[Scheme]:
    """The schemes under which a set of this size must be indexed."""
    least, found, number = -(-percent * size // 100), [], 0
    while True:
        s = scheme(number, percent, collide)
        if s.low > size:
            return found
        if s.high >= least and s.diff > 0:  # with no difference, sets are equal
            found.append(s)
        number += 1


def expected(size: int, percent: int, collide: float = COLLIDE) -> float:
    """About how many signatures a set of this size has."""
    found = schemes_of(size, percent, collide)
    return sum(s.segments + size * s.deletions / s.segments for s in found)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_TAG = np.uint64(0xD6E8FEB86659FD93)


def _signatures(hashes: np.ndarray, s: Scheme, level: int, seed: int) -> tuple[np.ndarray, int]:
    """Keys of one set under one scheme and level, and the units lost."""
    salt = np.uint64((seed * 1_000_003 + s.number * 64 + level) * 2 + 1)
    m = s.segments
    values = (hashes ^ (salt * _ODD)) * _TAG
    values ^= values >> np.uint64(32)
    values *= _ODD
    # the segment is a monotone function of the value, so sorting groups them
    values.sort()
    segment = ((values >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    turn = np.flatnonzero(segment[1:] != segment[:-1]) + 1
    first = np.zeros(len(turn) + 1, np.int64)
    first[1:] = turn
    present = segment[first]
    sums = np.add.reduceat(values, first)
    tag = (present.astype(np.uint64) + salt) * _TAG
    last = level == LEVELS - 1
    keys = mix64(sums + tag)
    if s.deletions:
        sizes = np.empty(len(first), np.int64)
        sizes[:-1] = turn - first[:-1]
        sizes[-1] = len(values) - first[-1]
        lost = s.subsets - int((present >= s.deletions).sum()) + 2 * (
            s.deletions - int(((present < s.deletions) & (sizes > 1)).sum())
        )
        k = int(np.searchsorted(segment, s.deletions))
        group = np.repeat(np.arange(len(first)), sizes)[:k]
        less = mix64(sums[group] - values[:k] + tag[group])
        keys = np.concatenate([keys, less if last else less[sizes[group] > 1]])
    else:
        lost = m - len(first)
    if last and len(first) < m:
        empty = np.setdiff1d(np.arange(m), present).astype(np.uint64)
        keys = np.concatenate([keys, mix64((empty + salt) * _TAG)])
    return keys, lost


def signatures(hashes: np.ndarray, percent: int, seed: int = 0, collide: float = COLLIDE) -> np.ndarray:
    """All keys of a set of distinct element hashes."""
    out = []
    with np.errstate(over="ignore"):
        for s in schemes_of(len(hashes), percent, collide):
            for level in range(LEVELS):
                keys, lost = _signatures(hashes, s, level, seed)
                out.append(keys)
                if lost <= s.slack:
                    break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
