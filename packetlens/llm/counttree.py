"""An R-tree over count vectors, which bounds set overlaps.

A set's elements fall into groups by hash; its point has the count of each
group. Two sets share at most the sum, over groups, of the smaller count. A
node keeps the largest coordinates and the extreme sizes of its points, so the
same sum bounds the overlap with every set below it.
"""

from __future__ import annotations

import numpy as np

LEAF = 16
#: Bounds of about so many numbers are computed at once.
CHUNK = 1 << 21


def n_groups(size: int) -> int:
    """Groups for a set: a power of two, half its size or more."""
    m = 8
    while 2 * m < size:
        m *= 2
    return m


def count_vector(hashes: np.ndarray) -> np.ndarray:
    m = n_groups(len(hashes))
    return np.bincount((hashes >> np.uint64(20)) & np.uint64(m - 1), minlength=m)


def packed(v: np.ndarray) -> bytes:
    """The counts in as few bytes each as the largest needs."""
    return v.astype("<u1" if v.max() < 256 else "<u2" if v.max() < 65_536 else "<u4").tobytes()


def unpacked(data: bytes, m: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // m}")


def fold(v: np.ndarray, m: int) -> np.ndarray:
    """The vector for ``m`` groups, fewer than it has: groups whose last bits agree come together."""
    return v.reshape(-1, m).sum(0, dtype=np.int32) if len(v) > m else v


def passes(bound: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of ``bound`` could give a Jaccard similarity of ``percent`` for sets of ``sizes`` elements together."""
    return (100 + percent) * bound >= percent * sizes


class CountTree:
    """Points of one block, bulk-loaded: sorted by size, tiled by the widest coordinate."""

    def __init__(self, vectors: list[np.ndarray], sizes: np.ndarray):
        self.m = min(len(v) for v in vectors)
        self.points = np.stack([fold(v, self.m) for v in vectors]).astype(np.int32)
        self.sizes = sizes.astype(np.int64)
        n = len(sizes)
        slab = max(LEAF, int(np.ceil(np.sqrt(n / LEAF))) * LEAF)
        by_size = np.argsort(self.sizes, kind="stable")
        widest = int(np.argmax(self.points.var(0)))
        self.order = np.concatenate([s[np.argsort(self.points[s, widest], kind="stable")] for s in (by_size[i : i + slab] for i in range(0, n, slab))])
        self.levels = []
        top, low, high = self.points[self.order], self.sizes[self.order], self.sizes[self.order]
        while len(low) > 1:
            at = np.arange(0, len(low), LEAF)
            top, low, high = np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))
        self.n = n

    def search(self, vectors: list[np.ndarray], sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs whose bound reaches ``percent``."""
        m = min(self.m, min(len(v) for v in vectors))
        queries = np.stack([fold(v, m) for v in vectors]).astype(np.int32)
        sizes = sizes.astype(np.int64)
        folded = lambda x: x.reshape(len(x), -1, m).sum(1) if x.shape[1] > m else x
        q = np.arange(len(sizes))
        node = np.zeros(len(sizes), np.int64)
        for top, low, high in self.levels[::-1]:
            q, node = self._keep(queries, sizes, folded(top), low, high, q, node, percent)
            q, node = np.repeat(q, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            below = len(self.order) if top is self.levels[0][0] else len(self.levels[[x[0] is top for x in self.levels].index(True) - 1][0])
            q, node = q[node < below], node[node < below]
        own = self.sizes[self.order]
        q, node = self._keep(queries, sizes, folded(self.points[self.order]), own, own, q, node, percent)
        return q, self.order[node]

    @staticmethod
    def _keep(queries, sizes, top, low, high, q, node, percent):
        near = (100 * high[node] >= percent * sizes[q]) & (percent * low[node] <= 100 * sizes[q])
        q, node = q[near], node[near]
        good = np.zeros(len(q), bool)
        step = max(1, CHUNK // max(1, queries.shape[1]))
        for i in range(0, len(q), step):
            a, b = q[i : i + step], node[i : i + step]
            good[i : i + step] = passes(np.minimum(queries[a], top[b]).sum(1), sizes[a] + low[b], percent)
        return q[good], node[good]
