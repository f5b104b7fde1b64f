"""Nearest-neighbour information of continuous variables.

I = mean(digamma(k) + ln n - digamma(n_a) - digamma(n_b)), at least 0: the radius of a point is the Euclidean distance
to its k-th neighbour in the joint space, n_a and n_b count the points within it in each marginal, itself included.

Neighbours and counts come from k-d trees (``kdtree``), in memory that follows the points. Of tables, ``neighbours`` measures many
pairs at once.
"""

from __future__ import annotations

import math

import numpy as np

from gleaner.functions.special import digamma
from gleaner.operators.kdtree import Tree


def _two(a) -> np.ndarray:
    a = np.asarray(a, float)
    return a[:, None] if a.ndim == 1 else a


def kth_distance(points: np.ndarray, k: int) -> np.ndarray:
    """Distance of each point to its k-th neighbour, itself not counted."""
    return Tree(points, max(32, 2 * (k + 2))).nearest(min(k + 1, len(points)))[:, -1]


def within(points: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many points, itself included, lie within each point's radius."""
    if points.shape[1] > 1:
        return Tree(points).count(radius)
    v = points[:, 0]
    x = np.sort(v)
    lo, hi = np.searchsorted(x, v - radius, "left"), np.searchsorted(x, v + radius, "right")
    # v - radius is rounded: the differences decide at the border
    for at, step in ((lo, -1), (hi, 1)):
        while True:
            side = np.minimum(np.maximum(at - (step < 0), 0), len(x) - 1)
            more = (np.abs(x[side] - v) <= radius) & ((at > 0) if step < 0 else (at < len(x)))
            back = np.minimum(np.maximum(at - (step > 0), 0), len(x) - 1)
            less = (np.abs(x[back] - v) > radius) & ~more
            if not (more | less).any():
                break
            at += np.where(more, step, np.where(less, -step, 0))
    return hi - lo


def ksg_mi(a, b, k: int = 10) -> float:
    a, b = _two(a), _two(b)
    n = len(a)
    if n <= k + 1:
        return 0.0
    radius = kth_distance(np.hstack([a, b]), k)
    # exactly rounded: the order of the points changes nothing
    total = math.fsum(np.concatenate([digamma(within(a, radius)), digamma(within(b, radius))]).tolist())
    return max(0.0, float(digamma(np.array([k]))[0]) + math.log(n) - total / n)


def ksg_cmi(x, y, z, k: int = 10) -> float:
    """I(x, z; y) - I(z; y); I(x; y) if z is empty."""
    z = np.asarray(z, float)
    if z.size == 0:
        return ksg_mi(x, y, k)
    z = _two(z)
    return ksg_mi(np.hstack([_two(x), z]), y, k) - ksg_mi(z, y, k)
