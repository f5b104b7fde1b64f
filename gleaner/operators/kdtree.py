"""A balanced k-d tree in arrays: nearest neighbours and ball counts of whole blocks of queries at a time.

Points are halved by the median of their widest axis until LEAF or fewer are left; all leaves lie on one level and differ by one point at most, so a
node's children are found by arithmetic and each level's bounding boxes are two arrays. Queries are the leaves of a tree of their own (often
the same one): pairs of a block of queries and a node go down the tree together, and those whose boxes are farther apart than the block's
largest radius are dropped. Distances are computed as whole tables of a block by a leaf.

Boxes bound distances as they are computed: gaps are rounded like differences of points, so nothing within a radius is lost by rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 32
#: Tables of distances, and blocks of queries, that are handled at a time.
_TABLES, _BLOCKS = 256, 4096


class Tree:
    """``points``: one row a point (at least one). ``distances`` counts the distances that queries took."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        points = np.asarray(points, float)
        n, self.depth = len(points), 0
        while n >> self.depth > leaf:
            self.depth += 1
        order, edge = np.arange(n), np.array([0, n])
        for _ in range(self.depth):
            middle = (edge[:-1] + edge[1:]) // 2
            for lo, mid, hi in zip(edge[:-1].tolist(), middle.tolist(), edge[1:].tolist(), strict=True):
                some = points[order[lo:hi]]
                axis = int(np.argmax(some.max(axis=0) - some.min(axis=0)))
                order[lo:hi] = order[lo:hi][np.argpartition(some[:, axis], mid - lo)]
            edge = np.sort(np.concatenate([edge, middle]))
        sizes = np.diff(edge)
        at = edge[:-1, None] + np.arange(int(sizes.max()))
        real = np.arange(at.shape[1]) < sizes[:, None]
        #: Place of each block's points among ``points``, -1 where a block has fewer; the points, not a number there.
        self.place = np.where(real, order[np.minimum(at, n - 1)], -1)
        self.blocks = np.where(real[:, :, None], points[self.place], np.nan)
        low, high = np.minimum.reduceat(points[order], edge[:-1]), np.maximum.reduceat(points[order], edge[:-1])
        self.boxes, self.sizes = [(low, high)], [sizes]
        for _ in range(self.depth):
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            sizes = sizes[::2] + sizes[1::2]
            self.boxes.insert(0, (low, high))
            self.sizes.insert(0, sizes)
        self.n, self.distances = n, 0

    def flat(self, values: np.ndarray) -> np.ndarray:
        """Values of the blocks' points in the order of the points."""
        out = np.empty((self.n, *values.shape[2:]), values.dtype)
        real = self.place >= 0
        out[self.place[real]] = values[real]
        return out

    def blocked(self, values: np.ndarray) -> np.ndarray:
        """Values of points by block; not a number where a block has fewer."""
        return np.where(self.place >= 0, np.asarray(values, float)[self.place], np.nan)

    def _table(self, queries: Tree, block: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Distances of each pair of block and leaf: (pairs, queries, points)."""
        a, b = queries.blocks[block], self.blocks[leaf]
        self.distances += a.shape[0] * a.shape[1] * b.shape[1]
        return np.sqrt(sum((a[:, :, None, i] - b[:, None, :, i]) ** 2 for i in range(a.shape[2])))

    def _reached(self, queries: Tree, block: np.ndarray, reach: np.ndarray, within: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """(block, node, distance, whole): leaves within each block's reach; with ``within``, nodes that lie wholly within that distance of all of a block."""
        low, high = queries.boxes[-1]
        node = np.zeros(len(block), np.int64)
        for level in range(self.depth + 1):
            a, b = self.boxes[level]
            gap = np.maximum(a[node] - high[block], low[block] - b[node]).clip(0)
            far = np.sqrt(sum(gap[:, i] ** 2 for i in range(gap.shape[1])))
            keep = far <= reach[block]
            block, node, far = block[keep], node[keep], far[keep]
            if within is not None:
                span = np.maximum(b[node] - low[block], high[block] - a[node])
                inside = np.sqrt(sum(span[:, i] ** 2 for i in range(span.shape[1]))) <= within[block]
                yield block[inside], self.sizes[level][node[inside]], far[inside], True
                block, node, far = block[~inside], node[~inside], far[~inside]
            if level < self.depth:
                block, node = np.repeat(block, 2), (2 * node[:, None] + [0, 1]).ravel()
        yield block, node, far, False

    def nearest(self, k: int, queries: Tree | None = None, bound: np.ndarray | None = None) -> np.ndarray:
        """The ``k`` least distances of each query to the points, ascending (infinite where there are fewer).

        Without ``queries`` those of the points themselves, to all points, themselves included. With them, only distances up to
        ``bound`` (one a query) are sure to be there.
        """
        q = self if queries is None else queries
        best = np.full((*q.place.shape, k), np.inf)
        every = np.arange(len(q.place))
        if queries is None:
            for i in range(0, len(every), _TABLES):
                best[i : i + _TABLES] = _least(self._table(q, every[i : i + _TABLES], every[i : i + _TABLES]), best[i : i + _TABLES])
        limit = np.full(q.place.shape, np.inf) if bound is None else q.blocked(bound)
        reach_of = lambda b: np.nan_to_num(np.fmin(np.where(q.place[b] >= 0, best[b].max(axis=2), -1), limit[b]), nan=-1).max(axis=1)
        for first in range(0, len(every), _BLOCKS):
            some = every[first : first + _BLOCKS]
            reach = np.full(len(every), -1.0)
            reach[some] = reach_of(some)
            ((block, leaf, far, _),) = self._reached(q, some, reach)
            if queries is None:
                other = block != leaf
                block, leaf, far = block[other], leaf[other], far[other]
            order = np.lexsort((far, block))
            block, leaf, far = block[order], leaf[order], far[order]
            at = np.searchsorted(block, some)
            turn = np.arange(len(block)) - np.repeat(at, np.diff(np.append(at, len(block))))
            rounds = np.argsort(turn, kind="stable")
            edge = np.searchsorted(turn[rounds], np.arange(int(turn.max(initial=-1)) + 2))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):  # each block's nearest leaf, then its second
                pick = rounds[lo:hi]
                pick = pick[far[pick] <= reach[block[pick]]]
                for i in range(0, len(pick), _TABLES):
                    p = pick[i : i + _TABLES]
                    best[block[p]] = _least(self._table(q, block[p], leaf[p]), best[block[p]])
                reach[block[pick]] = reach_of(block[pick])
        return np.sort(q.flat(best), axis=1)

    def count(self, radius: np.ndarray, queries: Tree | None = None) -> np.ndarray:
        """How many points lie within each query's radius; without ``queries``, of the points themselves."""
        q = self if queries is None else queries
        r = q.blocked(radius)
        found = np.zeros(q.place.shape, np.int64)
        with np.errstate(invalid="ignore"):
            reach, least = np.nanmax(r, axis=1), np.nanmin(r, axis=1)
        for first in range(0, len(r), _BLOCKS):
            for block, node, _, whole in self._reached(q, np.arange(first, min(first + _BLOCKS, len(r))), reach, least):
                if whole:
                    found += np.bincount(block, node, len(r)).astype(np.int64)[:, None]
                    continue
                for i in range(0, len(block), _TABLES):
                    b = block[i : i + _TABLES]
                    np.add.at(found, b, (self._table(q, b, node[i : i + _TABLES]) <= r[b][:, :, None]).sum(axis=2))
        return q.flat(found)


def _least(table: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The least of new distances and those kept, as many as are kept."""
    k = best.shape[2]
    return np.partition(np.concatenate([best, np.where(np.isnan(table), np.inf, table)], axis=2), k - 1, axis=2)[:, :, :k]
