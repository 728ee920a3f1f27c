"""Nearest neighbours by inner product: a vantage-point tree for each shard, searched by many queries at once.

Inner products become distances by one more component: with M the largest norm of a shard, each x gets
sqrt(M^2 - |x|^2) and each query, scaled to norm M, gets 0, so that all points lie on a sphere and the nearest one has
the largest inner product. A node keeps a vantage point and the least and largest distance to it in either half. By the
triangle inequality a half is no nearer to a query than its distance to the vantage point lies outside that range, which
bounds the inner products in it. The half is left out if that bound is below the query's k-th best so far, or above it by
less than factor - 1 times the gap between the k-th and the one before it, so that what is left out of a shard has k - 1
better ones there. Factor one is exact search, larger factors leave out more. Differences of inner products decide, so
neither the scale of the vectors nor some that are far longer than the others change what is found.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from fernweave.llm.vector_search import packed_vectors, top_k, usable_vectors

LEAF = 512
SHARD_ROWS, BLOCK_ROWS = 16_384, 2048
#: Queries that meet a leaf together.
TOGETHER = 1024


@dataclass
class Node:
    """A leaf has ``rows``; an inner node has a vantage point and two halves with the range of their distances to it."""

    rows: np.ndarray | None = None
    point: int = -1
    halves: tuple[tuple["Node", float, float], ...] = ()


def build_tree(points: np.ndarray, rows: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Node:
    """A tree over some rows of ``points``, all of one norm; equal distances may fall on either side."""
    if len(rows) <= leaf:
        return Node(rows=np.sort(rows))
    tried = rng.choice(rows, min(4, len(rows)), replace=False)
    some = points[rng.choice(rows, min(256, len(rows)), replace=False)]
    spread = [np.var(np.linalg.norm(some - points[t], axis=1)) for t in tried]
    point = int(tried[int(np.argmax(spread))])
    distance = np.linalg.norm(points[rows] - points[point], axis=1)
    order = np.argsort(distance, kind="stable")
    half = len(rows) // 2
    return Node(point=point, halves=tuple((build_tree(points, rows[o], rng, leaf), float(distance[o[0]]), float(distance[o[-1]])) for o in (order[:half], order[half:])))


class Best:
    """The best rows of each query so far, by score and then by row number."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.row = np.full((queries, k), -1, np.int64)

    def offer(self, queries: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        """scores [queries, rows]: those that are among the best take their place."""
        least = self.score[queries, -1]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        q, r = np.nonzero(scores >= least[:, None])
        who = np.concatenate([np.repeat(np.arange(len(queries)), self.k), q])
        score = np.concatenate([self.score[queries].ravel(), scores[q, r]])
        row = np.concatenate([self.row[queries].ravel(), rows[r]])
        order = np.lexsort((row, -score, who))
        who, score, row = who[order], score[order], row[order]
        place = np.arange(len(who)) - np.searchsorted(who, np.arange(len(queries)))[who]
        keep = place < self.k
        self.score[queries] = score[keep].reshape(len(queries), self.k)
        self.row[queries] = row[keep].reshape(len(queries), self.k)


def search_tree(rows: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, seed: int = 7, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(scores, row numbers) of each query's k largest inner products found among the rows, best first."""
    x, q = rows.astype(np.float64), queries.astype(np.float64)
    norm2 = (x * x).sum(axis=1)
    most = norm2.max()
    points = np.concatenate([x, np.sqrt(np.maximum(most - norm2, 0))[:, None]], axis=1)
    length = np.linalg.norm(q, axis=1)
    best = Best(len(q), k)

    reach = np.sqrt(most) * length  # the inner product with a point in the query's direction
    slight = 1e-12 * reach

    def visit(node: Node, who: np.ndarray) -> None:
        if node.rows is not None:
            own = x[node.rows].T
            for at in range(0, len(who), TOGETHER):
                some = who[at : at + TOGETHER]
                best.offer(some, node.rows, q[some] @ own)
            return
        d = np.sqrt(np.maximum(2 * most * (1 - (q[who] @ x[node.point]) / reach[who]), 0))
        bounds = [np.maximum(np.maximum(low - d, d - high), 0) for _, low, high in node.halves]
        nearer = 0 if (bounds[0] <= bounds[1]).sum() * 2 >= len(who) else 1
        for side in (nearer, 1 - nearer):
            kth, before = best.score[who, -1], best.score[who, max(0, k - 2)]
            gap = np.where(np.isfinite(kth), before - np.where(np.isfinite(kth), kth, 0), 0)
            most_here = reach[who] * (1 - bounds[side] ** 2 / (2 * most))
            open_ = ~(most_here + slight[who] < kth + (factor - 1) * gap)  # what is no number stays
            if open_.any():
                visit(node.halves[side][0], who[open_])

    visit(build_tree(points, np.arange(len(x)), np.random.default_rng(seed), leaf), np.arange(len(q)))
    # the same sums whatever was searched together
    exact = np.stack([(x[np.maximum(r, 0)] * v).sum(axis=1) for r, v in zip(best.row, q, strict=True)])
    return np.where(best.row >= 0, exact, -np.inf), best.row


def nearest_neighbours(vectors: DataFrame, is_query: str, k: int = 20, factor: float = 1.1, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found among all other vectors, by inner product.

    is_query: a condition on ``vec_id``. Every usable vector is in a tree and every query row is asked. Vectors that are
    null, empty or zero, or hold null or non-finite components, and rows without an id take no part; shorter vectors
    count as filled up with zeros. Ties go to smaller ids. With fewer than k candidates all are returned; an empty
    table gives no rows; other columns are ignored. Factor one is exact.
    """
    packed, _ = packed_vectors(usable_vectors(vectors, id_col, vector_col, zero_too=False), lambda a: a.astype("<f8"))
    return top_k(packed, is_query, k, "<f8", partial(search_tree, factor=factor), shard_rows, block_rows)
