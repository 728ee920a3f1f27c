"""Product codes of vectors in exact whole numbers: each part of a vector is the number of its nearest codebook entry.

Components are integers (floor of a scaled component). A round assigns every part to its nearest entry and moves each
entry to the floored mean of its parts. Nearest entries come from a float32 matrix product with an interval around each
product that its rounding cannot leave; only entries whose interval meets the best one are evaluated again, in 64-bit
integers (in integers of any length where 64 bits could overflow), and of equal ones the lowest index stays. So codes
and codebooks are those of exact arithmetic.

A round is one job: tasks sum the parts of each entry and the driver gets parts * entries sums, whatever the table's
size. Sums travel in limbs of 30 bits, so that they are exact for any number of rows and any finite components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.llm._common import join_unique, lean, materialise

#: Bits of a limb of a sum; signed limbs of many tasks add up in 64 bits.
LIMB = 30
#: Largest relative rounding of one operation in float32 and in float64.
U32, U64 = 2.0**-24, 2.0**-53

Book = list[list[list[int]]]  # part, entry, component


def overlapping(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries may be the nearest one of each row: a mask [rows, entries] that always holds the exact nearest ones.

    x, entries: integers held in float64 (infinite where they are beyond it). A squared distance less the row's own norm
    is |c|^2 - 2 x.c. The product is made in float32. Rounding both factors, each product and each of the sums changes x.c
    by at most gamma(d + 2) |x| |c|, in any order of summation; the float64 terms have bounds of their own.
    """
    d = x.shape[1]
    gamma = (d + 2) * U32 / (1 - (d + 2) * U32)
    with np.errstate(over="ignore", invalid="ignore"):
        dots = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
        squares = (entries * entries).sum(axis=1)
        norms = np.sqrt((x * x).sum(axis=1)) * (1 + (d + 4) * U64)
        own = np.sqrt(squares) * (1 + (d + 4) * U64)
        score = squares[None] - 2 * dots
        error = 2 * gamma * norms[:, None] * own[None] + (d + 6) * U64 * (squares[None] + 2 * np.abs(dots))
        error *= 1 + 8 * U64
        known = np.isfinite(score) & np.isfinite(error)
        low = np.where(known, score - error, -np.inf)
        high = np.where(known, score + error, np.inf)
    return low <= high.min(axis=1)[:, None]


def _integers(full: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, whatever their length."""
    flat = [math.floor(v * scale) if abs(v) < 2.0**52 else int(v) * scale for v in full.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(full.shape)


def _fits(largest: float, width: int) -> bool:
    """Whether the squared distance of integers of this size is below 2^62."""
    return largest < 2.0**29 / math.sqrt(max(1, width))


def exact_distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of integer rows."""
    apart = rows - entries
    return (apart * apart).sum(axis=1)


class Codebooks:
    """Codebooks ready for the assignment: exact entries, the same in float64, and as int64 where they fit."""

    def __init__(self, book: Book):
        self.exact = np.array(book, object).reshape(len(book), len(book[0]), -1)
        self.near = np.array([[[_as_float(v) for v in e] for e in part] for part in book], np.float64).reshape(self.exact.shape)
        self.largest = float(np.abs(self.near).max(initial=0.0))
        self.whole = self.near.astype(np.int64) if _fits(self.largest, self.near.shape[2]) else None

    def assign(self, full: np.ndarray, scale: int) -> tuple[np.ndarray, list]:
        """The nearest entry of every part of some vectors [rows, parts] and each row's exact summed squared distance."""
        parts, count, width = self.exact.shape
        with np.errstate(over="ignore"):
            near = np.floor(full * scale)
        small = self.whole is not None and _fits(float(np.abs(near).max(initial=0.0)), width)
        exact = near.astype(np.int64) if small else _integers(full, scale)
        entries = self.whole if small else self.exact
        chosen = np.zeros((len(full), parts), np.int64)
        error = np.zeros(len(full), exact.dtype)
        for p in range(parts):
            own = exact[:, p * width : (p + 1) * width]
            mask = overlapping(near[:, p * width : (p + 1) * width], self.near[p])
            chosen[:, p] = mask.argmax(axis=1)
            unsure = np.flatnonzero(mask.sum(axis=1) > 1)
            if len(unsure):
                at, entry = np.nonzero(mask[unsure])
                far = exact_distances(own[unsure[at]], entries[p][entry])
                first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
                least = np.minimum.reduceat(far, first)
                ties = far == np.repeat(least, np.diff(np.append(first, len(at))))
                ties = np.flatnonzero(ties.astype(bool))
                rows, lowest = np.unique(at[ties], return_index=True)  # entries are ascending within a row
                chosen[unsure[rows], p] = entry[ties[lowest]]
            error = error + exact_distances(own, entries[p][chosen[:, p]])
        return chosen, error.tolist()


def _as_float(v: int) -> float:
    try:
        return float(v)
    except OverflowError:
        return math.inf if v > 0 else -math.inf


def _full(lists: pa.Array, size: int) -> np.ndarray:
    """Lists of numbers as rows of ``size`` components, filled up with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), size))
    out[np.arange(size)[None] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, vector array<double>, label) of the vectors that are not null and hold no null or non-finite component."""
    picked = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), F.col(f"`{label_col}`").alias("label"))
    return picked.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def fit_codebooks(kept: DataFrame, size: int, *, parts: int, entries: int, rounds: int, scale: int) -> Book:
    """Codebooks after ``rounds`` of assignment and floored means, from the parts of the vectors with the smallest ids.

    Equal ids are ordered by their vectors, null ids come last. With fewer vectors than entries a codebook has as many.
    """
    width = size // parts
    first = kept.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()  # entries rows
    whole = _integers(np.array([list(r.vector) + [0.0] * (size - len(r.vector)) for r in first], np.float64).reshape(len(first), size), scale)
    book: Book = [[whole[e, p * width : (p + 1) * width].tolist() for e in range(len(first))] for p in range(parts)]
    for _ in range(rounds if first else 0):
        book = _moved(kept, book, size, scale)
    return book


def _moved(kept: DataFrame, book: Book, size: int, scale: int) -> Book:
    """The codebooks after one round."""
    parts, width, count = len(book), size // len(book), len(book[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Codebooks(book)
        total = np.zeros((parts, count, width), object)
        used = np.zeros((parts, count), np.int64)
        for batch in batches:
            full = _full(batch.column(0), size)
            chosen, _ = books.assign(full, scale)
            small = _fits(float(np.abs(full).max(initial=0.0)) * scale, width)
            own = np.floor(full * scale).astype(np.int64) if small else _integers(full, scale)
            for p in range(parts):
                part = np.zeros((count, width), own.dtype)
                np.add.at(part, chosen[:, p], own[:, p * width : (p + 1) * width])
                total[p] += part.astype(object)
                used[p] += np.bincount(chosen[:, p], minlength=count)
        rows = [(p * count + e, -1, 0, int(used[p, e])) for p in range(parts) for e in range(count) if used[p, e]]
        for (p, e, j), v in np.ndenumerate(total):
            rest, limb, sign = abs(int(v)), 0, 1 if v >= 0 else -1
            while rest:
                rows.append((p * count + e, j, limb, sign * (rest & ((1 << LIMB) - 1))))
                rest, limb = rest >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cell", "place", "limb", "v"])

    found = kept.select("vector").mapInArrow(lean(sums), "cell int, place int, limb int, v long").groupBy("cell", "place", "limb").agg(F.sum("v").alias("v")).collect()  # for each entry its count and the limbs of its sums
    used: dict[int, int] = {r.cell: r.v for r in found if r.place < 0}
    total: dict[tuple[int, int], int] = {}
    for r in found:
        if r.place >= 0:
            total[r.cell, r.place] = total.get((r.cell, r.place), 0) + (r.v << (LIMB * r.limb))
    return [[[total.get((c, j), 0) // used[c] for j in range(width)] if (c := p * count + e) in used else book[p][e] for e in range(count)] for p in range(parts)]


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector that holds only finite components.

    Null ids and repeated rows are coded row by row; shorter vectors count as filled up with zeros, and so does a length
    that ``parts`` does not divide; an empty table gives no rows. Extra columns are ignored. ``error`` is null where it
    has no place in 64 bits, and so is the ``label_error`` of its label; rows without a label are one label. ``scale`` is a
    power of two, and ``entries`` 256 at most. ``vectors`` is read rounds + 3 times: write it first where it is costly.
    """
    if scale < 1 or scale & (scale - 1) or not 1 <= entries <= 256:
        raise ValueError("scale must be a power of two, and entries from 1 to 256")
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    size = max(1, -(-longest // parts)) * parts
    book = fit_codebooks(kept, size, parts=parts, entries=entries, rounds=rounds, scale=scale)
    if not book[0]:
        return kept.where(F.lit(False)).select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    digest = hashlib.sha256(",".join(str(v) for part in book for e in part for v in e).encode()).hexdigest()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Codebooks(book)
        for batch in batches:
            chosen, error = books.assign(_full(batch.column(1), size), scale)
            codes = [bytes(r).hex() for r in chosen.astype(np.uint8)]
            whole = [v if v < 1 << 63 else None for v in error]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.string()), pa.array(whole, pa.int64()), batch.column(2)], names=["vec_id", "code", "error", "key"])

    key = F.when(F.col("label").isNull(), "none").otherwise(F.concat(F.lit("is "), F.col("label").cast("string")))
    coded = materialise(kept.select("vec_id", "vector", key.alias("key")).mapInArrow(lean(code), "vec_id long, code string, error long, key string"), "vector-codes")
    whole = F.count("error") == F.count(F.lit(1))
    labels = coded.groupBy("key").agg(F.when(whole, F.sum(F.col("error").cast("decimal(20,0)"))).alias("sum")).select("key", F.expr("try_cast(sum AS BIGINT)").alias("label_error"))
    return join_unique(coded, labels, "key").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
