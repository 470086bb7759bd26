"""Approximate nearest neighbours by vantage-point trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import best_lists, ranked, usable

LEAF = 64


def directions(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Tree:
    """Rows in the order of a vantage-point tree. A node is a run of rows: its first row is
    the vantage point, then come the nearer half of the others and the farther half, each a
    node; `radii` has, in preorder, the distance between the halves."""

    def __init__(self, order: np.ndarray, radii: np.ndarray):
        self.order, self.radii = order, radii

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        order, radii = np.arange(len(points)), []

        def node(lo: int, hi: int) -> None:
            if hi - lo <= LEAF:
                return
            own = order[lo:hi]
            far = np.argmax(((points[own] - points[own[0]]) ** 2).sum(axis=1))  # an outlying point splits best
            own[0], own[far] = own[far], own[0]
            d = ((points[own[1:]] - points[own[0]]) ** 2).sum(axis=1)
            own[1:] = own[1:][np.argsort(d, kind="stable")]
            half = len(d) // 2
            radii.append(np.sqrt(np.partition(d, half)[half]))
            node(lo + 1, lo + 1 + half)
            node(lo + 1 + half, hi)

        node(0, len(points))
        return cls(order, np.array(radii))

    def search(self, points: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
        """For each query, places (in `points`) that hold its k nearest other than own[q], and
        more. Each query goes down its nearer half first. The other half is left out if its
        distance by the triangle inequality, times `factor`, is over the k-th best so far."""
        rows = points[self.order]
        reach = np.full((len(queries), k), np.inf)
        seen: list[list[np.ndarray]] = [[] for _ in queries]
        sizes: dict[int, int] = {}

        def count(n: int) -> int:  # inner nodes of a run
            if n <= LEAF:
                return 0
            if n not in sizes:
                half = (n - 1) // 2
                sizes[n] = 1 + count(half) + count(n - 1 - half)
            return sizes[n]

        def look(lo: int, hi: int, q: np.ndarray) -> np.ndarray:
            d = np.sqrt(np.maximum(0, 2 - 2 * (queries[q] @ rows[lo:hi].T)))
            d[self.order[lo:hi][None, :] == own[q][:, None]] = np.inf
            for i, near in zip(q, (d <= reach[q, -1:] + 1e-7) & (d < np.inf)):
                if near.any():
                    seen[i].append(self.order[lo:hi][near])
            reach[q] = np.partition(np.concatenate((reach[q], d), axis=1), k - 1, axis=1)[:, :k]
            reach[q] = np.sort(reach[q], axis=1)
            return d

        def node(lo: int, hi: int, at: int, q: np.ndarray) -> None:
            if not len(q):
                return
            if hi - lo <= LEAF:
                look(lo, hi, q)
                return
            d = np.sqrt(np.maximum(0, 2 - 2 * (queries[q] @ rows[lo])))
            look(lo, lo + 1, q)
            half, mid = (hi - lo - 1) // 2, self.radii[at]
            halves = ((lo + 1, lo + 1 + half, at + 1), (lo + 1 + half, hi, at + 1 + count(half)))
            near = d < mid
            node(*halves[0], q[near])
            node(*halves[1], q[~near])
            back = np.abs(d - mid) * factor <= reach[q, -1] + 1e-7
            node(*halves[1], q[near & back])
            node(*halves[0], q[~near & back])

        node(0, len(rows), 0, np.arange(len(queries)))
        return [np.concatenate(x) if x else np.empty(0, int) for x in seen]

    def pack(self) -> bytes:
        return np.array([len(self.order), len(self.radii)], np.int64).tobytes() + self.order.astype(np.int64).tobytes() + self.radii.astype(np.float64).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> tuple[Tree, int]:
        n, m = np.frombuffer(data, np.int64, 2)
        return cls(np.frombuffer(data, np.int64, n, 16), np.frombuffer(data, np.float64, m, 16 + 8 * n)), 16 + 8 * (n + m)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, factor: float = 2.0) -> DataFrame:
    """The k rows of largest cosine for each row whose vec_id is divisible by `every`,
    nearest first, ties to the smaller vec_id.

    Each shard of rows has a vantage-point tree over directions, whose Euclidean distance
    orders as the cosine does. factor=1 searches exactly; a larger one leaves out more of a
    tree. Scores are the cosines of the original vectors in double precision, each computed
    alike wherever it is, so that equal vectors tie. The index holds every row.

    vectors: vec_id, embedding; other columns, of whatever names, are ignored. Zero vectors take no part; see
    usable() for nulls, odd values and repeated ids. A query gets all other rows if they are
    fewer than k. No rows give no rows.

    Returns query_id long, rank int, vec_id long, score double.
    """

    def build(_, rows):
        return Tree.build(directions(rows)).pack() + rows.tobytes()

    def search(data, ids, dim, qids, queries):
        tree, at = Tree.unpack(data)
        rows = np.frombuffer(data, np.float64, -1, at).reshape(-1, dim)
        place = np.minimum(np.searchsorted(ids, qids), len(ids) - 1)
        own = np.where(ids[place] == qids, place, -1)
        unit = directions(rows)
        for q, found in zip(directions(queries), tree.search(unit, directions(queries), own, k, factor)):
            score = np.clip((unit[found] * q).sum(axis=1), -1, 1)
            best = np.lexsort((ids[found], -score))[:k]
            yield ids[found][best], score[best]

    rows = usable(vectors, lambda v: F.exists(v, lambda x: x != 0))
    return ranked(best_lists(rows, F.col("vec_id") % every == 0, k, build, search, "double"))
