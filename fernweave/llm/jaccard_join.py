"""Exact Jaccard join of documents on word shingles by partitioning the universe of shingles.

Sets are banded by size. A band's scheme splits the range of shingle hashes into segments. Two sets with Jaccard
similarity of at least d, the smaller in the band, differ in at most H elements, so by the pigeonhole principle some
segments agree. One segment of a scheme is wide and is indexed with its one-deletion neighbourhood: unless the two sets
differ there by two or more, a neighbour is shared. The H - 1 + x others are indexed whole; if the wide one fails, at
most H - 2 of them differ, so at least 1 + x agree. Hence every document may leave out its x segments with the longest
posting lists: a segment shared by two documents has the same list length for both, so the cheapest shared one is left
out by neither. Width and x of a band are chosen by cost: index entries, and the chance that a set that is like no
other shares a list all the same, because its wide segment is all but empty or more than x others are empty.

Candidates are never all pairs of a posting list. Each list is first compared with its most central member; found
links are contracted to components. Lists that still hold several components are compared in blocks of bounded size:
sketches of the sets say which members may have a link to another component of the block, and the whole sets of those
are compared inside the block, from which only links that join two components come out. Every link is verified on the
whole sets of hashes; documents with equal sets are one class throughout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernweave.llm._common import WORD_REGEX, drop_path, join_unique, lean, materialise, new_path
from fernweave.llm.shingles import mix, shingle_sets

_U = np.uint64
#: Posting entries that a task gathers before it hands them on, and entries that one part of the hash range should get.
GATHER = 1 << 21
DOCS_PER_PART = 4096
#: Members of a posting list that are compared in one block, and shingles that they have together.
BLOCK = 512
BLOCK_SHINGLES = 1 << 18
#: Partners of one document that are compared beside it in one group, and groups that may be larger than that.
PARTNERS = 256
#: Links of which no task can get too many, even if all are of one node.
FEW_LINKS = 1 << 20
#: Most counters of a sketch.
SLOTS = 1 << 14
#: Index entries that a set in a list of unlike ones is worth.
UNLIKE = 4000.0


class Schemes:
    """Size bands for a threshold num / den, and each band's segments."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]
        while self.edges[-1] < 1 << 32:  # two similar sizes are in the same band or in neighbouring ones
            self.edges.append(self.edges[-1] * den * den // (num * num) + 1)
        if len(self.edges) > 128:
            raise ValueError("thresholds above 0.91 need more size bands than a posting entry can name")
        self.starts = np.array(self.edges)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def top(self, k: int) -> int:
        return self.edges[k + 1] - 1

    def own(self, n: int) -> list[tuple[int, int]]:
        """(scheme, 0 or 1): that of the set's band, and as the larger set (1) that of the band below if a partner can be there."""
        k = self.band(n)
        return [(k, 0)] + [(k - 1, 1)] * (k > 0 and n * self.num <= self.top(k - 1) * self.den)

    @lru_cache(maxsize=None)  # noqa: B019
    def widths(self, k: int) -> tuple[int, int]:
        """(width of the wide segment in widths of the others, x) that cost the least for the smallest set of band k."""
        most, n = self.most(k), self.edges[k]
        if most > 500:  # both chances are next to nothing
            return 8, 1 + most // 10
        best = (math.inf, 2, 1)
        for x in sorted({1 + most * t // 20 for t in range(6)} | {1, 2, 3, 4}):
            others = most - 1 + x
            for wide in (2, 3, 4, 6, 8, 12, 16, 24):
                one = n / (wide + others)
                scarce = math.exp(-one * wide) * (1 + one * wide)
                empty, p = 0.0, math.exp(-one)
                if 0 < p * others < 4 * x + 40:
                    term = (1 - p) ** others
                    for i in range(x + 1):
                        empty += term
                        term *= (others - i) / (i + 1) * p / (1 - p)
                best = min(best, (one * wide + others + UNLIKE * (scarce + max(0.0, 1 - empty)), wide, x))
        return best[1:]

    @lru_cache(maxsize=None)  # noqa: B019
    def segments(self, k: int) -> tuple[np.ndarray, bool, int]:
        """(inner bounds of segments in the hash range, whether the first is the wide one, x)."""
        most = self.most(k)
        if most == 0:
            return np.empty(0, np.uint64), False, 0
        wide, x = self.widths(k)
        weights = [wide] + [1] * (most - 1 + x)
        ends = np.cumsum(weights)[:-1].tolist()
        return np.array([(e << 64) // sum(weights) for e in ends], np.uint64), True, x

    def most(self, k: int) -> int:
        """H: elements in which two similar sets differ at most, the smaller in band k."""
        return self.top(k) * (self.den - self.num) // self.num

    def skip(self, k: int) -> int:
        """x: whole segments that a set of band k may leave out."""
        return self.widths(k)[1] if self.most(k) else 0

    def linked(self, s: np.ndarray, t: np.ndarray) -> bool:
        """Whether two whole sets, sorted, are similar enough."""
        if min(len(s), len(t)) * self.den < max(len(s), len(t)) * self.num:
            return False
        both = np.concatenate([s, t])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return common * self.den >= (len(both) - common) * self.num

    def similar(self, n: np.ndarray, m: np.ndarray, difference: np.ndarray) -> np.ndarray:
        """Whether sets of sizes n and m that differ in so many elements are similar enough: |n & m| = (n + m - d) / 2."""
        return (n + m - difference) * self.den >= (n + m + difference) * self.num


def signatures(s: np.ndarray, schemes: Schemes) -> np.ndarray:
    """Index keys of a sorted set: hash, then 7 bits of the scheme, 1 for whole segments, 1 for the larger side."""
    if not len(s):
        return np.empty(0, np.uint64)
    hashed = mix(s)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed, dtype=np.uint64)])
    out = []
    for k, larger in schemes.own(len(s)):
        inner, wide, _ = schemes.segments(k)
        cut = np.concatenate([[0], np.searchsorted(s, inner), [len(s)]])
        sums = total[cut[1:]] - total[cut[:-1]]
        number = np.arange(len(sums), dtype=np.uint64) + _U(k << 40)
        low = _U(k << 2 | larger)
        if wide:
            near = mix(np.concatenate([sums[:1], sums[0] - hashed[: cut[1]]]) + mix(number[:1]))
            out.append(np.unique(near) & ~_U(511) | low)
            sums, number = sums[1:], number[1:]
        out.append(mix(sums + mix(number)) & ~_U(511) | low | _U(2))
    return np.concatenate(out)


def sketch(s: np.ndarray) -> bytes:
    """Counts of the set's elements by hash, cut at 255, about as many counters as elements.

    The L1 distance of two sketches, the longer one folded, is at most the difference of the two sets.
    """
    slots = min(SLOTS, max(64, 1 << (max(1, len(s)) - 1).bit_length()))
    return np.minimum(np.bincount((mix(s) & _U(slots - 1)).astype(np.int64), minlength=slots), 255).astype(np.uint8).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of counts, all as long as the shortest."""
    slots = min(map(len, sketches))
    return np.stack([np.frombuffer(x, np.uint8).reshape(-1, slots).sum(axis=0, dtype=np.int32) for x in sketches])


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a whole set; the first is its class."""
    a = mix(np.array([s.sum(dtype=np.uint64) + _U(len(s))], np.uint64))
    b = mix(mix(s ^ _U(0x5DEECE66D)).sum(keepdims=True, dtype=np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


_INDEX_SCHEMA = "part int, doc_id long, key long, n long, cid long, check long, sigs binary, cids binary"
_FOUND_SCHEMA = "kind int, doc_id long, key long, n long, cid long, check long, sig long, larger int, whole boolean, list_length int, skip int"


def _index(docs: DataFrame, words: int, schemes: Schemes, parts: int, seed: int) -> DataFrame:
    """Rows of documents and, by part of the hash range, posting entries of the sets first seen in a task."""
    shift = _U(64 - (parts - 1).bit_length())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        cids: list[np.ndarray] = []
        held = turn = 0

        def rows(**columns: list) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            types = {"part": pa.int32(), "sigs": pa.binary(), "cids": pa.binary()}
            names = [f.split()[0] for f in _INDEX_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), types.get(c, pa.int64())) for c in names], names=names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held:
                sig, cid = np.concatenate(sigs), np.concatenate(cids)
                order = np.argsort(sig)
                sig, cid = sig[order], cid[order]
                cut = np.searchsorted(sig >> shift, np.arange(parts + 1, dtype=np.uint64))
                for at in range(0, parts, 64):
                    full = [p for p in range(at, min(parts, at + 64)) if cut[p + 1] > cut[p]]
                    if full:
                        yield rows(part=full, sigs=[sig[cut[p] : cut[p + 1]].tobytes() for p in full], cids=[cid[cut[p] : cut[p + 1]].tobytes() for p in full])
            sigs.clear(), cids.clear()
            held = 0

        for batch in batches:
            n, one, check = [], [], []
            for s in shingle_sets(batch.column(2).to_pylist(), words, seed):
                n.append(len(s))
                a, b = class_of(s) if len(s) else (None, None)
                one.append(a), check.append(b)
                if a is not None and a not in seen:
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(a)
                    own = signatures(s, schemes)
                    sigs.append(own), cids.append(np.full(len(own), a, np.int64))
                    held += len(own)
                    if held >= GATHER:
                        yield from flush()
            yield rows(part=[(turn + i) % parts for i in range(len(n))], doc_id=batch.column(0).to_pylist(), key=batch.column(1).to_pylist(), n=n, cid=one, check=check)
            turn += len(n)
        yield from flush()

    return docs.mapInArrow(lean(index), _INDEX_SCHEMA)


def _posting_lists(indexed: DataFrame, schemes: Schemes) -> DataFrame:
    """Rows of documents as they are (kind 0), and the members of posting lists that hold several classes (kind 1)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sigs, cids = None, [], []
        names = [f.split()[0] for f in _FOUND_SCHEMA.split(", ")]
        types = {"kind": pa.int32(), "larger": pa.int32(), "whole": pa.bool_(), "list_length": pa.int32(), "skip": pa.int32()}

        def rows(columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], types.get(c, pa.int64())) if c in columns else pa.nulls(n, types.get(c, pa.int64())) for c in names], names=names)

        def lists() -> Iterator[pa.RecordBatch]:
            if not sigs:
                return
            sig = np.frombuffer(b"".join(sigs), np.uint64)
            cid = np.frombuffer(b"".join(cids), np.int64)
            sigs.clear(), cids.clear()
            key = sig & ~_U(1)
            order = np.argsort(key, kind="stable")
            key = key[order]
            same = key[1:] == key[:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            order = order[keep]
            order = order[np.lexsort((cid[order], sig[order] & ~_U(1)))]
            sig, cid = sig[order], cid[order]
            key = sig & ~_U(1)
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])]) if len(key) else np.empty(0, bool)
            sig, cid, key = sig[fresh], cid[fresh], key[fresh]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
            length = np.diff(np.concatenate([first, [len(key)]]))
            smaller = np.add.reduceat((sig & _U(1) == 0).astype(int), first) if len(first) else length
            length = np.repeat(np.where(smaller > 0, length, 0), length)  # else the scheme above has these pairs
            sig, cid, key, length = (x[length > 1] for x in (sig, cid, key, length))
            skips = np.array([schemes.skip(k) for k in range(len(schemes.edges) - 1)])
            for at in range(0, len(sig), 100_000):
                cut = slice(at, at + 100_000)
                k = (sig[cut] >> _U(2) & _U(127)).astype(int)
                yield rows({"kind": np.ones(len(k), np.int32), "cid": cid[cut], "sig": key[cut].view(np.int64), "larger": (sig[cut] & _U(1)).astype(np.int32), "whole": sig[cut] & _U(2) > 0, "list_length": np.minimum(length[cut], (1 << 31) - 1).astype(np.int32), "skip": skips[k].astype(np.int32)})

        for batch in batches:
            at = batch.schema.names.index
            parts = batch.column(at("part")).to_pylist()
            is_doc = np.array([not x.is_valid for x in batch.column(at("sigs"))])
            if is_doc.any():
                docs = batch.filter(pa.array(is_doc))
                yield rows({"kind": np.zeros(docs.num_rows, np.int32)} | {c: docs.column(at(c)) for c in ("doc_id", "key", "n", "cid", "check")})
            for i in np.flatnonzero(~is_doc).tolist():
                if parts[i] != part:
                    yield from lists()
                    part = parts[i]
                sigs.append(batch.column(at("sigs"))[i].as_py()), cids.append(batch.column(at("cids"))[i].as_py())
        yield from lists()

    return indexed.mapInArrow(lean(merge), _FOUND_SCHEMA)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a long, b long): root is the least node that it reaches.

    Links are rewritten until they are stars around the least node: larger neighbours of a node are linked to its least
    neighbour, then smaller ones are. Both are an aggregate and a join; nodes with many neighbours are joined apart.
    """
    spark = links.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = new_path(spark, "links")
        df.write.parquet(path)
        out = spark.read.schema("a long, b long").parquet(path)
        return out, path, tuple(out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path, state = written(ordered)  # a > b
    while True:
        joined_to = join_unique if state[0] > FEW_LINKS else DataFrame.join
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = joined_to(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = joined_to(large, least, "a")
        small = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new, new_at, new_state = written(small)
        drop_path(spark, path)
        edges, path = new, new_at
        if new_state == state:
            break
        state = new_state
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(edges.select("b", "b").distinct())


def _beside(pairs: DataFrame, table: DataFrame, payload: list[str], passes: Callable[[list[tuple]], Callable[[int, int], bool]]) -> DataFrame:
    """The distinct pairs (a, b) that pass. table: (cid, *payload), one row for each document of the pairs.

    The payload of b travels with its pair, that of a once for each group of its partners, so that neither a's rows nor
    what a task holds grow with the partners of one a. passes: from the payloads of a batch, whether rows i and j pass.
    """
    pairs = materialise(pairs.distinct(), "pairs")
    most = max(PARTNERS, pairs.count() // 4096)
    busy = F.broadcast(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("groups")).where("groups > 1"))  # 4096 rows at most
    group = F.coalesce(F.pmod(F.xxhash64("b"), "groups"), F.lit(0)).cast("int").alias("group")
    hubs = pairs.select("a").distinct().join(busy, "a", "left").select("a", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1)).alias("group"))
    hubs = hubs.join(table.withColumnRenamed("cid", "a"), "a").select("a", "group", F.lit(None).cast("long").alias("b"), *payload)
    partners = pairs.join(busy, "a", "left").select("a", group, "b").join(table.withColumnRenamed("cid", "b"), "b").select("a", "group", "b", *payload)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, partners = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = list(zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True))
            if hub is not None:
                rows.append(hub)
            similar, at, keep = passes(rows), len(rows) - 1, []
            for i, b in enumerate(partners):
                if b is None:
                    at = i
                elif similar(at, i):
                    keep.append(i)
            hub = rows[at]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in keep], pa.int64()), pa.array([partners[i] for i in keep], pa.int64())], names=["a", "b"])

    laid = hubs.unionByName(partners).repartition("a", "group").sortWithinPartitions("a", "group", F.asc_nulls_first("b"))
    return laid.mapInArrow(lean(test), "a long, b long")


def _alike(schemes: Schemes) -> Callable[[list[tuple]], Callable[[int, int], bool]]:
    """Whether the sketches of rows (n, sketch) allow that they are similar."""

    def passes(rows: list[tuple]) -> Callable[[int, int], bool]:
        def similar(i: int, j: int) -> bool:
            (n, s), (m, t) = rows[i], rows[j]
            if min(n, m) * schemes.den < max(n, m) * schemes.num:
                return False
            one, two = folded([s, t])
            return bool(schemes.similar(n, m, int(np.abs(one - two).sum())))

        return similar

    return passes


def _same(schemes: Schemes, words: int, seed: int) -> Callable[[list[tuple]], Callable[[int, int], bool]]:
    """Whether the whole sets of rows (text,) are similar."""

    def passes(rows: list[tuple]) -> Callable[[int, int], bool]:
        sets = list(shingle_sets([r[0] for r in rows], words, seed))
        return lambda i, j: schemes.linked(sets[i], sets[j])

    return passes


class Roots:
    """Which of some components are one by now."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def of(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(above, above)
            x = above
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were two until now."""
        x, y = self.of(x), self.of(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _blocks(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """Sorted rows as runs that are equal in the first ``by`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:by] != held[0][:by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _candidates(rows: list[tuple], schemes: Schemes) -> Iterator[tuple[int, np.ndarray]]:
    """(i, later rows j of other components that may be similar to it).

    rows: (sig, one, two, half, cid, root, n, sketch). Where a block has two halves, i and j are of both.
    """
    half, root, n = (np.array([r[k] for r in rows]) for k in (3, 5, 6))
    counts = folded([r[7] for r in rows])
    apart = rows[0][1] != rows[0][2]
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, len(rows))
        j = j[(root[j] != root[i]) & ((half[j] != half[i]) if apart else True)]
        j = j[np.minimum(n[j], n[i]) * schemes.den >= np.maximum(n[j], n[i]) * schemes.num]
        if len(j):
            least = np.abs(counts[j] - counts[i]).sum(axis=1)
            yield i, j[schemes.similar(n[j], n[i], least)]


def _involved(blocks: DataFrame, schemes: Schemes) -> DataFrame:
    """The members of blocks for which sketches allow a link to another component of the block."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, 3):
            meant: set[int] = set()
            for i, js in _candidates(rows, schemes):
                if len(js):
                    meant.update([i, *js.tolist()])
            if meant:
                own = [rows[i] for i in sorted(meant)]
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in own], t) for k, t in enumerate(types)], names=["sig", "one", "two", "half", "cid", "root"])

    return blocks.mapInArrow(lean(told), "sig long, one int, two int, half int, cid long, root long")


def _joining(blocks: DataFrame, words: int, schemes: Schemes, seed: int) -> DataFrame:
    """Links (a, b) between whole sets, fewer than the components of a block, that join all of them that are linked in it.

    blocks: sig, one, two, half, cid, root, text.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, 3):
            sets = list(shingle_sets([r[6] for r in rows], words, seed))
            roots, found, apart = Roots(), [], rows[0][1] != rows[0][2]
            for i, one in enumerate(rows):
                for j in range(i + 1, len(rows)):
                    other = rows[j]
                    if apart and one[3] == other[3] or roots.of(one[5]) == roots.of(other[5]):
                        continue
                    if schemes.linked(sets[i], sets[j]):
                        roots.join(one[5], other[5])
                        found.append(sorted((one[4], other[4])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return blocks.mapInArrow(lean(joined), "a long, b long")


def _laid_out(members: DataFrame, roots: DataFrame, table: DataFrame) -> DataFrame:
    """Members of lists that hold several components in blocks: sig, one, two, half, cid, root, n, sketch, sorted by block.

    A list has as many parts as its members and their shingles need; each part and each two parts are a block. Of lists
    with the same members one is enough.
    """
    sized = members.join(table.select("cid", "n"), "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lists = sized.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("sum"), F.min("cid").alias("least"), F.max("cid").alias("most"))
    lists = lists.where("low <> high and size > 2").groupBy("size", "shingles", "sum", "least", "most").agg(F.min("sig").alias("sig"))
    parts = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("parts")
    rows = sized.join(lists.select("sig", parts), "sig").withColumn("half", F.pmod(F.xxhash64("cid", F.lit(5)), "parts").cast("int"))
    rows = rows.select("sig", "half", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "cid", "root").join(table.select("cid", "n", "sketch"), "cid")
    rows = rows.select("sig", F.least("half", "other").alias("one"), F.greatest("half", "other").alias("two"), "half", "cid", "root", "n", "sketch")
    return rows.repartition("sig", "one", "two").sortWithinPartitions("sig", "one", "two", "cid")


def _classes(docs: DataFrame, words: int, num: int, den: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n, cid) of ``docs`` (doc_id, key, text_), and (cid, root) of every class that is linked."""
    spark = docs.sparkSession
    schemes = Schemes(num, den)
    parts = 1 << max(6, min(16, (docs.count() // DOCS_PER_PART).bit_length()))
    while True:
        path = new_path(spark, "postings")
        indexed = _index(docs, words, schemes, parts, seed).repartition(parts, "part").sortWithinPartitions("part")
        _posting_lists(indexed, schemes).write.partitionBy("kind").parquet(path)
        found = spark.read.schema(_FOUND_SCHEMA.replace("kind int, ", "") + ", kind int").parquet(path)
        rows = found.where("kind = 0").select("doc_id", "key", "n", "cid", "check")
        if rows.groupBy("cid").agg((F.min("check") != F.max("check")).alias("odd")).where("odd").isEmpty():
            break
        seed += 2  # two sets with one class: other hashes
        drop_path(spark, path)

    # each document leaves out its longest lists, as many as its scheme can spare
    by_cost = W.partitionBy("cid", "larger", "whole").orderBy(F.col("list_length").desc(), "sig")
    members = found.where("kind = 1").select("sig", "cid", "larger", "whole", "list_length", "skip")
    members = members.withColumn("central", F.sum("list_length").over(W.partitionBy("cid")))
    members = members.withColumn("place", F.row_number().over(by_cost)).where("not whole or place > skip")
    members = materialise(members.select("sig", "cid", "larger", "central"), "members")

    # one text for each class that is in a list
    reps = rows.where("cid is not null").groupBy("cid").agg(F.min("key").alias("key"))
    reps = reps.join(members.select("cid").distinct(), "cid").select("key").distinct()

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0).to_pylist(), words, seed))
            cid = [class_of(s)[0] if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), batch.column(0)], names=["cid", "n", "sketch", "text_"])

    texts = join_unique(docs, reps, "key").select("text_").mapInArrow(lean(classes), "cid long, n long, sketch binary, text_ string")
    texts = materialise(texts.groupBy("cid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("text_").alias("text_")), "class-texts")

    # every list against its most central member
    hubs = members.groupBy("sig").agg(F.max(F.struct("central", "cid", "larger")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = join_unique(members, hubs, "sig").where("cid <> hub.cid and (larger = 0 or hub.larger = 0)")
    likely = _beside(stars.select(F.col("hub.cid").alias("a"), F.col("cid").alias("b")), texts, ["n", "sketch"], _alike(schemes))
    links = materialise(_beside(likely, texts, ["text_"], _same(schemes, words, seed)), "star-links")
    roots = materialise(connected_components(links), "roots")
    # lists that still hold several components
    left = _involved(_laid_out(members, roots, texts), schemes)
    left = left.join(texts.select("cid", "text_"), "cid").select("sig", "one", "two", "half", "cid", "root", "text_").repartition("sig", "one", "two").sortWithinPartitions("sig", "one", "two", "cid")
    links = links.union(materialise(_joining(left, words, schemes, seed), "last-links"))
    return rows.drop("check"), materialise(connected_components(links), "roots").withColumnRenamed("node", "cid")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text_): key is a hash of id and text, so that rows are told apart however many share an id."""
    picked = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text_")
    return picked.select("doc_id", F.xxhash64("doc_id", "text_").alias("key"), "text_")


def similar_components(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """Documents linked by a Jaccard similarity of at least num / den of their sets of word shingles, as components.

    Returns a row for each row of ``docs``: doc_id, n_shingles, class_id (documents with equal sets share it) and
    component_id (the smallest id that links reach, its own included). Null and empty texts have no shingles, are
    linked with nothing and keep their own id. A null id is passed over for the smallest id; a component of null ids
    alone has none. Rows that repeat an id are documents of their own. An empty table gives an empty result. Other
    columns are ignored. Texts of any length are read whole. Thresholds above 0.91 raise a ValueError.
    """
    rows, linked = _classes(_keyed(docs, id_col, text_col), words, num, den, seed)
    least = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("own"))
    linked = materialise(linked.join(least, "cid"), "linked-classes")
    components = linked.groupBy("root").agg(F.min("own").alias("component_id"))
    of_class = join_unique(linked, components, "root").select("cid", "component_id", F.lit(True).alias("linked"))
    least = least.join(of_class, "cid", "left").select("cid", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("own")).alias("component_id"))
    whole = join_unique(rows.where("cid is not null"), least, "cid").select("doc_id", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"), "component_id")
    empty = rows.where("cid is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.col("doc_id").alias("component_id"))
    return whole.union(empty)


def one_of_each_group(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group of linked or equal documents, with all columns as they are: the smallest id's.

    Rows without an id come after those with one; of rows with the group's smallest id, or of a group without ids, the
    least by a hash of id and text stays, and of rows that repeat both, one. Documents without words are linked with
    nothing and all stay. An empty table gives an empty result.
    """
    rows, linked = _classes(_keyed(docs, id_col, text_col), words, num, den)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    own = rows.where("cid is not null").groupBy("cid").agg(first.alias("first"))
    own = own.join(linked, "cid", "left").groupBy(F.coalesce("root", "cid").alias("root")).agg(F.min("first").alias("first"))
    repeated = rows.groupBy("doc_id", "key").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    kept = own.select(F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key")).alias("o")
    kept = kept.join(repeated.alias("r"), F.expr("o.key = r.key and o.doc_id <=> r.doc_id")).select(F.col("o.key").alias("key"), F.col("o.doc_id").alias("kept_id"), "repeated")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text_"))
    keyed = keyed.withColumn("key", F.xxhash64("doc_id", "text_"))
    wordless = keyed.where(F.col("text_").isNull() | ~F.col("text_").rlike(WORD_REGEX)).select("row.*")
    joined = join_unique(keyed, kept, "key").where("doc_id <=> kept_id")
    # of rows that repeat id and text, tasks hand on one of each
    again = joined.where("repeated").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return joined.where("not repeated").select("row.*").union(again.select("row.*")).union(wordless)
