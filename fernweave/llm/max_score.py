"""Exact top-k search on integer vectors by MaxScore over postings of signed terms.

Component d of a vector is term (d, +) or (d, -) by its sign, with its absolute value as weight. A query gains from the
terms of the signs that it has itself and loses on the others, so a term's bound is the query's weight times the largest
weight in the term's postings, and losing terms are bounded by zero. Terms are ordered by bound; once the sum of the
smallest ones cannot reach the k-th best score, they are non-essential: only postings of essential terms are traversed,
and the candidates met there are probed for the other terms, largest bound first, as long as they can still compete.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.llm.vector_search import packed_vectors, top_k, usable_vectors

SHARD_ROWS, BLOCK_ROWS = 16_384, 1024
#: Rows of a shard whose postings are traversed before the threshold is looked at again.
STRETCH = 2048


class Postings:
    """A stretch of rows by signed term: term 2 d has the rows where component d is positive, term 2 d + 1 negative."""

    def __init__(self, rows: np.ndarray, first: int):
        self.first, self.rows = first, rows
        self.of: list[tuple[np.ndarray, np.ndarray]] = []
        for column in rows.T:
            for signed in (column, -column):
                at = np.flatnonzero(signed > 0)
                self.of.append((at, signed[at]))
        self.most = np.array([w.max(initial=0) for _, w in self.of])


class Top:
    """The k best (score, row) of one query; rows come in order, so an equal score never replaces an earlier row."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.empty(0, np.int64)
        self.row = np.empty(0, np.int64)

    @property
    def least(self) -> int | None:
        """The score to beat, once there are k."""
        return int(self.score[-1]) if len(self.score) == self.k else None

    def add(self, score: np.ndarray, row: np.ndarray) -> None:
        score, row = np.concatenate([self.score, score]), np.concatenate([self.row, row])
        order = np.lexsort((row, -score))[: self.k]
        self.score, self.row = score[order], row[order]


def search_stretch(postings: Postings, query: np.ndarray, top: Top) -> None:
    """Offer to ``top`` every row of the stretch that can be among its best."""
    gains = np.abs(query) * postings.most[2 * np.arange(len(query)) + (query < 0)]
    order = np.argsort(-gains, kind="stable")
    after = np.concatenate([np.cumsum(gains[order][::-1])[::-1], [0]])  # what terms from here on can add at most
    least = top.least
    if least is None or least < 0:  # nothing to beat yet, or a row without any gaining term may do: all rows compete
        essential, met = 0, np.arange(len(postings.rows))
        partial = np.zeros(len(met), np.int64)
    else:
        essential = int(np.searchsorted(-after, -least))  # the terms behind cannot beat the least by themselves
        sums = np.zeros(len(postings.rows), np.int64)
        for d in order[:essential]:
            at, weight = postings.of[2 * d + int(query[d] < 0)]
            sums[at] += weight * abs(int(query[d]))
        met = np.flatnonzero(sums + after[essential] > least)
        partial = sums[met]
        # what the essential components take away
        for d in order[:essential]:
            if not len(met):
                return
            partial += np.minimum(postings.rows[met, d] * int(query[d]), 0)
            keep = partial + after[essential] > least
            if not keep.all():
                met, partial = met[keep], partial[keep]
    for k in range(essential, len(order)):
        if not len(met):
            return
        if gains[order[k]] == 0 and not query[order[k]]:
            continue
        partial = partial + postings.rows[met, order[k]] * int(query[order[k]])
        if least is not None:
            keep = partial + after[k + 1] > least
            if not keep.all():
                met, partial = met[keep], partial[keep]
    top.add(partial, met + postings.first)


def search_postings(rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, row numbers) of each query's k largest inner products among the rows: exact, ties to earlier rows."""
    rows, queries = rows.astype(np.int64), queries.astype(np.int64)
    tops = [Top(k) for _ in queries]
    for first in range(0, len(rows), STRETCH):
        postings = Postings(rows[first : first + STRETCH], first)
        for query, top in zip(queries, tops, strict=True):
            search_stretch(postings, query, top)
    scores, found = np.zeros((len(queries), k), np.int64), np.full((len(queries), k), -1, np.int64)
    for i, top in enumerate(tops):
        scores[i, : len(top.score)], found[i, : len(top.row)] = top.score, top.row
    return scores, found


def exact_top_k(vectors: DataFrame, is_query: str, k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest integer inner products with all other vectors.

    Components are floor(scale * x), in 64 bits like the scores: vectors so long that a score could be 2 ** 62 or more
    raise a ValueError. Vectors that are null or empty or hold null or non-finite components, and rows without an id
    take no part; zero vectors do. Shorter vectors count as filled up with zeros. Ties go to smaller ids. With fewer than k candidates all are returned; an empty
    table gives no rows; other columns are ignored.
    """
    usable = usable_vectors(vectors, id_col, vector_col, zero_too=True)
    norm2 = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    size, most = usable.select(F.size("vector").alias("size"), norm2.alias("norm2")).agg(F.max("size"), F.max("norm2")).first()
    if (abs(scale) * (most or 0.0) ** 0.5 + (size or 0) ** 0.5) ** 2 >= 2**62:  # no score is larger than the square of the largest norm
        raise ValueError("components are too large for scores in 64 bits")
    packed, _ = packed_vectors(usable, lambda a: np.floor(scale * a).astype("<i8"))
    return top_k(packed, is_query, k, "<i8", search_postings, shard_rows, block_rows, score_type="long")
