"""Phrases whose words stand together more often than chance, for each language, from exact counts over all texts.

A phrase can be frequent only if each of its parts is (Apriori), and it takes two passes over the texts, whatever their size:

1. words are counted; the frequent ones get a minimal perfect hash, whose slots are their numbers;
2. tasks send the phrases of frequent words, as numbers side by side in 64-bit keys with how often they had them, each to
   the task that its hash names. That task counts them in hashed buckets; the phrases of full buckets are the candidates,
   and every frequent phrase is one. They get a minimal perfect hash, and are counted by slot in a numpy array, each key
   being compared with the stored one. There are as many such tasks as shuffle partitions, or one for
   some 4 million phrases if that is more.

The counts of a phrase's parts of several words are found by joins with the counted phrases, those of words by their number.

A broadcast holds 4 * ``most_keys`` words at most. With more frequent words than that, phrases are counted over as many
passes as it takes, in broadcasts that don't grow:

2. phrases of frequent words are counted in hashed buckets, whose number follows the number of words; a bucket's count
   stops at the least frequency, so tasks send few bytes and sums stay right up to it;
3. phrases whose own bucket and whose parts' buckets are full enough are the candidates: every frequent phrase is one.
   A share of the texts is gone through first; of the rest, tasks hand on only what was not found there, so that a common
   phrase does not leave every task anew;
4. candidates and frequent words get a minimal perfect hash, and tasks count them by slot in numpy arrays, each key being
   compared with the stored one; arrays are summed by blocks of slots, in a tree, and the counts of a phrase and of both
   parts of each cut are read by slot.

A slice holds ``most_keys`` keys at most. More candidates are cut by hash into several such slices, which are counted
one after another; nothing is dropped. Buckets take 2^``most_bits`` bits at most; with more words they only let more
candidates through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernweave.llm._common import join_unique, lean, materialise
from fernweave.llm.perfect_hash import PerfectHash
from fernweave.llm.shingles import CHUNK, mix, word_hashes

_U = np.uint64
#: Bytes that end a piece, and that end a word within one.
BREAKS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Buckets or slots of one row on its way from tasks to sums.
BLOCK = 1 << 16
#: Partial sums that meet in one step of the tree.
FAN = 64
#: Words, phrases or slots that a task holds before it hands them on.
HELD = 1 << 18
#: One text in so many is gone through first for candidates.
SHARE = 16


@lru_cache(maxsize=4)
def _bytes(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, A-Z as a-z; which bytes end words; which end pieces."""
    value = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    value[65:91] = value[97:123]
    breaks, ends = np.zeros(256, bool), np.zeros(256, bool)
    breaks[list(BREAKS)] = True
    ends[list(BREAKS + GAPS)] = True
    value[ends] = 0
    return value, ends, breaks


def _parts(raw: bytes, breaks: np.ndarray) -> Iterator[bytes]:
    """A text in parts of about CHUNK bytes, cut at the ends of pieces."""
    while len(raw) > CHUNK:
        ends = np.flatnonzero(breaks[np.frombuffer(raw, np.uint8, CHUNK)])
        if not len(ends):
            later = np.flatnonzero(breaks[np.frombuffer(raw, np.uint8)])
            if not len(later):
                break
            ends = later[:1]
        yield raw[: int(ends[-1]) + 1]
        raw = raw[int(ends[-1]) + 1 :]
    yield raw


class Words:
    """The words of some texts: their identities (language and word, hashed), pieces, and places in the bytes."""

    def __init__(self, held: list[tuple[bytes, str]], seed: int):
        value, ends, breaks = _bytes(seed)
        self.bytes = b"\n".join(raw for raw, _ in held) + b"\n"
        b = np.frombuffer(self.bytes, np.uint8)
        hashes, self.starts = word_hashes(b, value, ends)
        self.piece = np.cumsum(breaks[b], dtype=np.int64)[self.starts] if len(b) else np.zeros(0, np.int64)
        bounds = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum([len(raw) + 1 for raw, _ in held])]))
        self.langs = [lang for _, lang in held]
        self.text = np.repeat(np.arange(len(held)), np.diff(bounds))
        salts = np.array([_salt(lang) for lang in self.langs], np.uint64)
        self.ids = np.maximum(mix(hashes ^ salts[self.text]), _U(1))
        self._ends = ends

    def at(self, places: np.ndarray) -> pa.Array:
        """The words at some distinct places, in lower case, as bytes."""
        order = np.argsort(places)
        starts = self.starts[places[order]]
        stops = np.flatnonzero(self._ends[np.frombuffer(self.bytes, np.uint8)])
        bounds = np.stack([starts, stops[np.searchsorted(stops, starts)]], axis=1).astype(np.int32).ravel()  # each word, then what is before the next
        spans = pa.Array.from_buffers(pa.binary(), max(0, len(bounds) - 1), [None, pa.py_buffer(bounds), pa.py_buffer(self.bytes.translate(_LOWER))])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return spans.take(pa.array(2 * rank))

    def starts_of(self, length: int, usable: np.ndarray) -> np.ndarray:
        """Where phrases of a length start that stay in one piece and hold usable words only."""
        n = len(self.ids) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        good = self.piece[:n] == self.piece[length - 1 :]
        for j in range(length):
            good &= usable[j : j + n]
        return np.flatnonzero(good)


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@lru_cache(maxsize=65536)
def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def prints_of(columns: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """64-bit fingerprints of phrases given by the identities of their words, 0 behind the last."""
    total = np.full(len(columns[0]), _U(seed) * _U(0xD6E8FEB86659FD93) + _U(0x2545F4914F6CDD1D))
    for column in columns:
        total = mix(total ^ column) * _U(0x9E3779B97F4A7C15) + column
    return mix(total)


def _words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[Words]:
    """Words of texts (text, lang), about CHUNK bytes at a time."""
    breaks = _bytes(seed)[2]
    held: list[tuple[bytes, str]] = []
    size = 0
    for batch in batches:
        for raw, lang in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in _parts(raw or b"", breaks):
                if held and size + len(part) > CHUNK:
                    yield Words(held, seed)
                    held, size = [], 0
                held.append((part, lang))
                size += len(part) + 1
    if held:
        yield Words(held, seed)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def _strings(words: pa.Array) -> pa.Array:
    try:
        return words.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no text
        return pa.array([w.decode("utf-8", "replace") for w in words.to_pylist()], pa.string())


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """(id, lang, word, n): how often each language has each word."""

    names = ["id", "lang", "word", "n"]

    def met(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        _, first, of = np.unique(rows["id"].to_numpy(), return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, of, rows["n"].to_numpy())
        (out,) = rows.take(pa.array(first)).combine_chunks().to_batches(max_chunksize=len(first))
        return out.set_column(3, "n", pa.array(total))

    def told(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, rows.num_rows, HELD // 4):
            some = rows.slice(start, HELD // 4)
            yield some.set_column(2, "word", _strings(some.column(2)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for words in _words(batches, seed):
            found, first, times = np.unique(words.ids, return_index=True, return_counts=True)
            langs = pa.array(words.langs, pa.string()).take(pa.array(words.text[first]))
            held.append(pa.RecordBatch.from_arrays([_signed(found), langs, words.at(first), pa.array(times.astype(np.int64))], names=names))
            size += len(found)
            if size > 4 * HELD:
                held = [met(held)]
                size = held[0].num_rows
                if size > 2 * HELD:
                    yield from told(held[0])
                    held, size = [], 0
        if size:
            yield from told(met(held))

    counted = texts.mapInArrow(lean(count), "id long, lang string, word string, n long")
    return counted.repartition("id").groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def identified_words(texts: DataFrame) -> tuple[DataFrame, int]:
    """The counted words, written, and a seed by which no two of them share an identity."""
    for seed in range(1, 9):
        words = materialise(count_words(texts, seed), "collocation-words")
        if not words.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count():
            return words, seed
    raise RuntimeError("eight seeds in a row gave two words one identity")


class Bits:
    """A set of hashed buckets, one bit each: the high bits of a 64-bit value name the bucket."""

    def __init__(self, log: int, blocks: list[tuple[int, bytes]]):
        self.shift = _U(64 - log)
        self.words = np.zeros((1 << log) // 8, np.uint8)
        for block, bits in blocks:
            self.words[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)] = np.frombuffer(bits, np.uint8)

    def has(self, values: np.ndarray) -> np.ndarray:
        bucket = values >> self.shift
        return (self.words[(bucket >> _U(3)).astype(np.int64)] << (bucket & _U(7)).astype(np.uint8)) & np.uint8(128) != 0


def _log(n: int, most: int) -> int:
    return min(most, max(16, (max(1, n) - 1).bit_length()))


def _block_rows(kind: int, at: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Sorted distinct places and their counts as rows (kind, block, places within, counts)."""
    block = at // BLOCK
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(at)]]) if len(at) else [0]
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield kind, int(block[a]), (at[a:b] % BLOCK).astype("<u2").tobytes(), times[a:b].astype("<i8" if times.itemsize == 8 else "<u1").tobytes()


_BLOCKS = "kind int, block long, places binary, counts binary"


def _block_batches(rows: Iterator[tuple[int, int, bytes, bytes]], rows_each: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, bytes, bytes]] = []
    for row in rows:
        held.append(row)
        if len(held) >= rows_each:
            yield _block_batch(held)
            held = []
    if held:
        yield _block_batch(held)


def _block_batch(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["kind", "block", "places", "counts"])


def _tree_sum(rows: DataFrame, kind: str, most: int | None) -> DataFrame:
    """Block rows summed by (kind, block): partial sums of FAN tasks meet first where there are more tasks.

    most: counts stop there; they are bytes then. A task holds the blocks dealt to it and reads its rows one by one.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, block, places, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                total = held.setdefault((k, block), np.zeros(BLOCK, np.int64 if most is None else np.uint8))
                at = np.frombuffer(places, "<u2")
                more = total[at].astype(np.int64) + np.frombuffer(counts, kind)  # places are distinct in a row
                total[at] = more if most is None else np.minimum(more, most)
        sums = ((k, block, np.flatnonzero(total), total) for (k, block), total in sorted(held.items()))
        yield from _block_batches(row for k, block, at, total in sums for row in _block_rows(k, at + block * BLOCK, total[at]))

    tasks = rows.rdd.getNumPartitions()
    while tasks > FAN:
        rows = rows.withColumn("group", (F.spark_partition_id() / FAN).cast("int")).repartition("kind", "block", "group").drop("group").mapInArrow(lean(add), _BLOCKS)
        tasks = -(-tasks // FAN)
    return rows.repartition("kind", "block").mapInArrow(lean(add), _BLOCKS)


def _full_bits(sums: DataFrame, least: int, logs: dict[int, int]) -> dict[int, Bits]:
    """For each kind the buckets that hold ``least`` or more."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, block, places, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                bits = np.zeros(BLOCK, np.uint8)
                bits[np.frombuffer(places, "<u2")[np.frombuffer(counts, "<u1") >= least]] = 1
                if bits.any():
                    rows.append((k, block, b"", np.packbits(bits).tobytes()))
            yield _block_batch(rows)

    found = sums.mapInArrow(pack, _BLOCKS).select("kind", "block", "counts").collect()  # 2 ** log bits for each kind at most
    return {k: Bits(log, [(r.block, r.counts) for r in found if r.kind == k]) for k, log in logs.items()}


def _in_blocks(values: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    found, times = np.unique(np.concatenate(values), return_counts=True)
    return found.astype(np.int64), np.minimum(times, most).astype(np.uint8)


def full_buckets(texts: DataFrame, seed: int, usable: Broadcast, longest: int, least: int, log: int) -> dict[int, Bits]:
    """For each length from 2 the buckets of phrases that could be frequent, counted over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = usable.value
        held: dict[int, list[np.ndarray]] = {k: [] for k in range(2, longest + 1)}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for k, values in held.items():
                if values:
                    yield from _block_batches(_block_rows(k, *_in_blocks(values, min(least, 255))))
                    values.clear()

        for words in _words(batches, seed):
            good = bits.has(words.ids)
            for k in held:
                at = words.starts_of(k, good)
                held[k].append((prints_of([words.ids[at + j] for j in range(k)]) >> _U(64 - log)).astype(np.uint32))
                size += len(at)
            if size > 8 * HELD:
                yield from flush()
                size = 0
        yield from flush()

    return _full_bits(_tree_sum(texts.mapInArrow(lean(count), _BLOCKS), "<u1", least), least, dict.fromkeys(range(2, longest + 1), log))


def word_bits(words: DataFrame, log: int) -> Bits:
    """The buckets of frequent words, by their identities."""
    bucket = F.shiftrightunsigned("id", 64 - log)
    rows = words.select((bucket / BLOCK).cast("long").alias("block"), (bucket % BLOCK).cast("int").alias("place")).groupBy("block").agg(F.collect_set("place").alias("places"))  # BLOCK places at most

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits = np.zeros(BLOCK, np.uint8)
                bits[places] = 1
                out.append((1, block, b"", np.packbits(bits).tobytes()))
            yield _block_batch(out)

    return Bits(log, [(r.block, r.counts) for r in rows.mapInArrow(pack, _BLOCKS).select("block", "counts").collect()])


def _possible(words: Words, usable: Bits, full: dict[int, Bits]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, fingerprints) of phrases that pass every filter: usable words, full buckets of all parts."""
    good = usable.has(words.ids)
    yield 1, np.flatnonzero(good), prints_of([words.ids[good]])
    before = np.zeros(0, bool)
    for k in sorted(full):
        at = words.starts_of(k, good)
        prints = prints_of([words.ids[at + j] for j in range(k)])
        keep = full[k].has(prints)
        if k > 2:
            keep &= before[at] & before[at + 1]
        at, prints = at[keep], prints[keep]
        before = np.zeros(len(words.ids) + 1, bool)
        before[at] = True
        yield k, at, prints


def handed_on(texts: DataFrame, seed: int, filters: Broadcast, longest: int, known: Broadcast | None = None) -> DataFrame:
    """Phrases of 2 words and more that could be frequent and are not in the slice ``known``, as columns w1, w2, ... of word
    identities: once for about 2 * HELD that a task finds."""
    names = [f"w{j + 1}" for j in range(longest)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usable, full = filters.value
        had: Slice | None = known.value if known else None
        held: list[tuple[np.ndarray, list[np.ndarray]]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            prints = np.concatenate([p for p, _ in held])
            _, first = np.unique(prints, return_index=True)
            out = pa.RecordBatch.from_arrays([_signed(np.concatenate([c[j] for _, c in held])[first]) for j in range(longest)], names=names)
            held.clear()
            return out

        for words in _words(batches, seed):
            for k, at, prints in _possible(words, usable, full):
                if k > 1:
                    prints, first = np.unique(prints, return_index=True)
                    columns = [words.ids[at[first] + j] if j < k else np.zeros(len(first), np.uint64) for j in range(longest)]
                    if had:
                        new = np.flatnonzero(had.slots(columns) < 0)
                        prints, columns = prints[new], [c[new] for c in columns]
                    held.append((prints, columns))
                    size += len(prints)
            if size > 2 * HELD:
                yield flush()
                size = 0
        if held:
            yield flush()

    return texts.mapInArrow(lean(find), ", ".join(f"{c} long" for c in names))


def candidates(texts: DataFrame, seed: int, filters: Broadcast, longest: int, most_known: int) -> DataFrame:
    """The distinct phrases of 2 words and more that could be frequent.

    Those of one text in SHARE come first. They are broadcast, ``most_known`` at most, those that left the most tasks before
    others; the other texts add what is not among them. So a phrase leaves tasks about as often as it takes to meet it in the
    share, however frequent it is, and not once for each task.
    """
    spark, names = texts.sparkSession, [f"w{j + 1}" for j in range(longest)]
    early = F.coalesce(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0, F.lit(True))
    first = materialise(handed_on(texts.where(early), seed, filters, longest).groupBy(*names).agg(F.count(F.lit(1)).alias("times")), "collocation-share")
    known = first.select(*names) if first.count() <= most_known else first.orderBy(F.desc("times")).limit(most_known).select(*names)
    slice_ = spark.sparkContext.broadcast(Slice(_columns(known)))
    _hand_back()
    rest = handed_on(texts.where(~early), seed, filters, longest, slice_)
    found = materialise(first.select(*names).unionByName(rest).groupBy(*names).agg(F.lit(0).alias("_")).drop("_"), "collocation-candidates")
    slice_.destroy()
    return found


def _columns(keys: DataFrame) -> list[np.ndarray]:
    rows = keys.toArrow()
    return [column.to_numpy().view(np.uint64) for column in rows.columns]


class Slice:
    """Some keys with their slots: columns of word identities by slot, behind a minimal perfect hash."""

    def __init__(self, columns: list[np.ndarray]):
        self.seed = 1
        while True:  # two keys with one fingerprint ask for another seed
            prints = prints_of(columns, self.seed)
            if len(np.unique(prints)) == len(prints):
                break
            self.seed += 1
        self.hash = PerfectHash(prints)
        slots = self.hash.slots(prints)
        self.columns = [np.zeros(len(prints), np.uint64) for _ in columns]
        for own, column in zip(self.columns, columns, strict=True):
            own[slots] = column

    def slots(self, columns: list[np.ndarray]) -> np.ndarray:
        """The slots of phrases, -1 for those that are no key: the stored key decides."""
        if not len(columns[0]) or not len(self.columns[0]):
            return np.full(len(columns[0]), -1, np.int64)
        slots = self.hash.slots(prints_of(columns, self.seed))
        same = slots >= 0
        for own, column in zip(self.columns, columns, strict=True):
            same &= own[slots] == column
        return np.where(same, slots, -1)


class Vocabulary:
    """The frequent words: numbers from 1 by identity, identities and counts by number, and phrases of them in columns of 64 bits."""

    def __init__(self, ids: np.ndarray, times: np.ndarray, longest: int):
        self.words = Slice([ids])
        self.times = np.zeros(len(ids), np.int64)
        self.times[self.words.slots([ids])] = times
        self.longest, self.bits = longest, max(1, len(ids).bit_length())
        self.each = min(longest, 64 // self.bits)  # words in a column
        self.columns = -(-longest // self.each)

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        """0 for words that are not frequent."""
        return (self.words.slots([ids]) + 1).view(np.uint64)

    def packed(self, numbers: list[np.ndarray]) -> list[np.ndarray]:
        """Phrases of some length, by the numbers of their words; there are zeros behind the last."""
        out = [np.zeros(len(numbers[0]), np.uint64) for _ in range(self.columns)]
        for j, n in enumerate(numbers):
            out[j // self.each] |= n << _U(self.bits * (j % self.each))
        return out

    def unpacked(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        mask = _U((1 << self.bits) - 1)
        return [((columns[j // self.each] >> _U(self.bits * (j % self.each))) & mask).astype(np.int64) for j in range(self.longest)]


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns, and how many there are of each."""
    if len(columns) == 1:
        found, times = np.unique(columns[0], return_counts=True)
        return [found], times
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


_DEALT = "part int, keys binary, counts binary"


def dealt_phrases(texts: DataFrame, seed: int, vocabulary: Broadcast, parts: int) -> DataFrame:
    """All phrases of 2 words and more that consist of frequent words, as rows (part, keys, counts): a row has those of one part
    among about 8 * HELD that a task goes through, each once, and how often it had them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Vocabulary = vocabulary.value
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns, times = _distinct([np.concatenate(c) for c in zip(*held, strict=True)])
            held.clear()
            part = _part(prints_of(columns), parts)
            order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            columns, times = [c[order] for c in columns], times[order]
            bounds = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
            rows = []
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                a, b = bounds[k], bounds[k + 1]
                rows.append((k, b"".join(_steps(c[a:b]) for c in columns), times[a:b].astype(np.min_scalar_type(times[a:b].max())).tobytes()))
                if len(rows) == 64 or b == len(times):
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "keys", "counts"])
                    rows = []

        for words in _words(batches, seed):
            numbers = own.numbers(words.ids)
            for k in range(2, own.longest + 1):
                at = words.starts_of(k, numbers > 0)
                held.append(own.packed([numbers[at + j] for j in range(k)]))
                size += len(at)
            if size > 8 * HELD:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    return texts.mapInArrow(lean(find), _DEALT)


def _steps(column: np.ndarray) -> bytes:
    """The steps between sorted keys, all their lowest bytes first, all their highest last: the shuffle packs these better."""
    return np.diff(column, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _of_steps(raw: bytes, columns: int) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint8).reshape(columns, 8, -1).transpose(0, 2, 1)
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint64)[:, :, 0], axis=1, dtype=np.uint64)


def _part(prints: np.ndarray, parts: int) -> np.ndarray:
    """By the high half of a fingerprint."""
    return (((prints >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)


def counted_phrases(dealt: DataFrame, vocabulary: Broadcast, parts: int, longest: int, least: int) -> DataFrame:
    """(w1, w2, ..., a, first, last): the frequent phrases by their words' identities, their counts, and those of their first
    and last word. Each part is counted by one task: in buckets, then its candidates by slot."""
    names = [*(f"w{j + 1}" for j in range(longest)), "a", "first", "last"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Vocabulary = vocabulary.value
        held: list[np.ndarray] = []
        held_times: list[np.ndarray] = []
        for batch in batches:
            for keys, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append(_of_steps(keys, own.columns))
                held_times.append(np.frombuffer(counts, f"<u{len(counts) // held[-1].shape[1]}").astype(np.int64))
        if not held:
            return
        columns, times = list(np.concatenate(held, axis=1)), np.concatenate(held_times)
        held.clear()
        held_times.clear()
        bucket = (prints_of(columns) & _U((1 << max(16, len(times).bit_length())) - 1)).view(np.int64)
        keep = (_slot_sums(bucket, times) >= least)[bucket]
        columns, times = [c[keep] for c in columns], times[keep]
        candidates = Slice(_distinct(columns)[0])
        slots = candidates.slots(columns)
        total = _slot_sums(slots, times)
        often = np.flatnonzero(total >= least)
        numbers = own.unpacked([c[often] for c in candidates.columns])
        ids = np.concatenate([np.zeros(1, np.uint64), own.words.columns[0]])
        last = numbers[-1].copy()
        for n in numbers[-2::-1]:
            last = np.where(last == 0, n, last)
        out = [*(_signed(ids[n]) for n in numbers), *(pa.array(t) for t in (total[often], own.times[numbers[0] - 1], own.times[last - 1]))]
        for start in range(0, len(often), HELD // 4):
            yield pa.RecordBatch.from_arrays([c.slice(start, HELD // 4) for c in out], names=names)

    return dealt.repartitionById(parts, "part").mapInArrow(lean(count), ", ".join(f"{c} long" for c in names))


def _slot_sums(slots: np.ndarray, times: np.ndarray) -> np.ndarray:
    total = np.zeros(int(slots.max(initial=-1)) + 1, np.int64)
    np.add.at(total, slots, times)
    return total


def _with_parts(phrases: DataFrame, longest: int) -> DataFrame:
    """Counted phrases with the column ``found``: of parts of several words by joins, which need those that have three words
    and more; every part of a frequent phrase is a frequent phrase or word itself."""
    names = [f"w{j + 1}" for j in range(longest)]
    parts = _parts_of(longest)
    none = F.lit(0).cast("long")
    known = phrases.select(*(F.col(c).alias(f"p{j + 1}") for j, c in enumerate(names)), F.col("a").alias("f"))
    joined = [k for k, (first, length) in enumerate(parts) if 1 < length < longest]

    def found(rows: DataFrame) -> DataFrame:
        columns = []
        for k, (first, length) in enumerate(parts):
            if first == 0 and length == 1:
                columns.append(F.col("first"))
            elif first == 0:
                it = F.col("a") if length == longest else F.when(F.col(names[length]) == 0, F.col("a"))
                columns.append(F.coalesce(it, F.col(f"f{k}") if k in joined and f"f{k}" in rows.columns else none))
            else:
                single = F.col(names[first + 1]) == 0 if first + 1 < longest else F.lit(True)
                there = F.coalesce(F.col(f"f{k}"), none) if f"f{k}" in rows.columns else none
                columns.append(F.when(single & (F.col(names[first]) != 0), F.col("last")).otherwise(there))
        return rows.select(*names, F.array(*columns).alias("found"))

    if longest == 2:
        return found(phrases)
    longer = phrases.where("w3 <> 0")
    for k in joined:
        first, length = parts[k]
        same = [F.col(f"p{j + 1}") == (F.col(names[first + j]) if j < length else none) for j in range(longest)]
        longer = longer.join(known.withColumnRenamed("f", f"f{k}"), same, "left").drop(*(f"p{j + 1}" for j in range(longest)))
    return found(phrases.where("w3 = 0")).unionByName(found(longer))


def count_by_slot(texts: DataFrame, seed: int, filters: Broadcast, keys: Broadcast, longest: int) -> np.ndarray:
    """How often each key of a slice occurs: tasks count by slot, the arrays are summed in a tree by blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usable, full = filters.value
        own: Slice = keys.value
        total = np.zeros(len(own.columns[0]), np.int64)
        held: list[np.ndarray] = []
        size = 0
        for words in _words(batches, seed):
            for k, at, _ in _possible(words, usable, full):
                slots = own.slots([words.ids[at + j] if j < k else np.zeros(len(at), np.uint64) for j in range(longest)])
                held.append(slots[slots >= 0])
                size += len(held[-1])
            if size > 2 * HELD:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        at = np.flatnonzero(total)
        yield from _block_batches(_block_rows(0, at, total[at]))

    found = _tree_sum(texts.mapInArrow(lean(count), _BLOCKS), "<i8", None).select("block", "places", "counts").collect()  # a number for each key of the slice
    out = np.zeros(len(keys.value.columns[0]), np.int64)
    for r in found:
        out[r.block * BLOCK + np.frombuffer(r.places, "<u2").astype(np.int64)] = np.frombuffer(r.counts, "<i8")
    return out


def _parts_of(longest: int) -> list[tuple[int, int]]:
    """(first word, words) of what is looked up for a phrase: itself in all lengths from the start, and all its ends."""
    return [(0, k) for k in range(1, longest + 1)] + [(k, longest - k) for k in range(1, longest)]


def _with_counts(phrases: DataFrame, keys: Broadcast, counts: Broadcast, longest: int) -> DataFrame:
    """Adds to each phrase's column ``found`` what one slice knows of the parts; what no slice knows stays 0."""
    names = [f"w{j + 1}" for j in range(longest)]
    parts = _parts_of(longest)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, times = keys.value, counts.value
        for batch in batches:
            words = [batch.column(j).to_numpy().view(np.uint64) for j in range(longest)]
            n = len(words[0])
            none = np.zeros(n, np.uint64)
            found = batch.column(longest).flatten().to_numpy().reshape(n, len(parts)).copy()
            for k, (first, length) in enumerate(parts):
                slots = own.slots([words[first + j] if j < length else none for j in range(longest)])
                found[:, k] += np.where(slots >= 0, times[slots], 0) if len(times) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:longest], pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(parts), pa.int32()), pa.array(found.ravel(), pa.int64()))], names=[*names, "found"])

    return phrases.mapInArrow(lean(look), ", ".join(f"{c} long" for c in names) + ", found array<long>")


def _scored(phrases: DataFrame, longest: int, least: int) -> DataFrame:
    """(w1, ..., length, a, l, r, score) of frequent phrases by their lowest cut, in integers of any length."""
    names = [f"w{j + 1}" for j in range(longest)]
    place = {part: k for k, part in enumerate(_parts_of(longest))}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(j).to_numpy() for j in range(longest)], axis=1)
            found = batch.column(longest).flatten().to_numpy().reshape(len(words), -1)
            lengths = (words != 0).sum(axis=1)
            rows = []
            for i, (m, f) in enumerate(zip(lengths.tolist(), found.tolist(), strict=True)):
                a = f[place[0, m]]
                if m > 1 and a >= least:
                    # an end is looked up at full length, so the words behind it are 0 as in its own key
                    cuts = [(1_000_000 * a * a // (f[place[0, k]] * f[place[k, longest - k]]), k) for k in range(1, m)]
                    low, k = min(cuts)
                    rows.append((*words[i].tolist(), m, a, f[place[0, k]], f[place[k, longest - k]], low))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(longest + 5)], names=[*names, "length", "a", "l", "r", "score"])

    return phrases.mapInArrow(lean(score), ", ".join(f"{c} long" for c in [*names, "length", "a", "l", "r", "score"]))


def _without_inner(scored: DataFrame, longest: int, inside: int) -> DataFrame:
    """Drops phrases of which ``inside`` per cent or more stand in one longer phrase."""
    names = [f"w{j + 1}" for j in range(longest)]
    none = F.lit(0).cast("long")
    inner = [
        F.struct(*(F.col(names[first + j]).alias(names[j]) if j < k else none.alias(names[j]) for j in range(longest)))
        for k in range(2, longest) for first in range(longest - k + 1)
    ]
    if not inner:
        return scored
    part = F.col("part")
    rows = scored.where("length > 2").select("length", "a", F.explode(F.array(*inner)).alias("part"))
    width = sum(F.when(part[c] != 0, 1).otherwise(0) for c in names)
    longer = rows.where(width >= 2).where(width < F.col("length")).select(*(part[c].alias(c) for c in names), "a").groupBy(*names).agg(F.max("a").alias("longer"))
    return scored.join(longer, names, "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(inside) * F.col("a"), F.lit(True))).drop("longer")


def _named(phrases: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """The phrases' texts and language. A word may start any share of the phrases, so its rows are joined apart."""
    own = words.select("id", "lang", "word")
    out = phrases.withColumn("phrase", F.lit("")).withColumn("lang", F.lit(None).cast("string"))
    for j in range(longest):
        key = f"w{j + 1}"
        there, short = out.where(F.col(key) != 0), out.where(F.col(key) == 0)
        found = join_unique(there, own.select(F.col("id").alias(key), F.col("lang").alias("own_lang"), "word"), key)
        phrase = F.col("word") if j == 0 else F.concat("phrase", F.lit(" "), "word")
        out = materialise(found.withColumns({"phrase": phrase, "lang": F.col("own_lang")}).drop("word", "own_lang").unionByName(short), f"collocation-texts-{j}")
    return out


def _best_of_each(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, in a tree: a task never orders much more than FAN * top rows of one."""
    rows, order = phrases.count(), [F.desc("score"), F.desc("a"), "phrase"]
    groups = max(1, rows // max(65536, top))
    while groups > 1:
        group = F.pmod(F.xxhash64("phrase"), F.lit(groups))
        phrases = phrases.withColumn("group", group).withColumn("rank", F.row_number().over(W.partitionBy("lang", "group").orderBy(*order))).where(F.col("rank") <= top).drop("group", "rank")
        groups //= FAN
    return phrases.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def _hand_back() -> None:
    """Free what the driver no longer uses, as ``lean`` does at the end of its work."""
    list(lean(iter)(iter(())))


def _slices(spark: SparkSession, keys: DataFrame, longest: int, most_keys: int) -> Iterator[Broadcast]:
    """Broadcast slices of the keys by hash, of about ``most_keys`` each."""
    names = [f"w{j + 1}" for j in range(longest)]
    count = -(-keys.count() // most_keys) or 1
    for k in range(count):
        columns = _columns(keys.where(F.pmod(F.xxhash64(*names), F.lit(count)) == k) if count > 1 else keys)
        _hand_back()
        yield spark.sparkContext.broadcast(Slice(columns))


def _counted_at_once(texts: DataFrame, frequent: DataFrame, seed: int, every: int, longest: int, least: int) -> DataFrame:
    """The frequent phrases with the counts of their parts, by one pass over the texts. every: how many words they have."""
    spark = texts.sparkSession
    ids, times = _columns(frequent.select("id", "n"))
    vocabulary = spark.sparkContext.broadcast(Vocabulary(ids, times.view(np.int64), longest))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), every * (longest - 1) // (16 * HELD))
    counted = materialise(counted_phrases(dealt_phrases(texts, seed, vocabulary, parts), vocabulary, parts, longest, least), "collocation-counts")
    vocabulary.destroy()
    _hand_back()
    return _with_parts(counted, longest)


def _counted_by_slices(texts: DataFrame, frequent: DataFrame, seed: int, every: int, known: int, longest: int, least: int, most_keys: int, most_bits: int) -> DataFrame:
    """Phrases with the counts of their parts where there are too many words for one broadcast: several passes over the texts."""
    spark = texts.sparkSession
    usable = spark.sparkContext.broadcast(word_bits(frequent, _log(16 * known, most_bits)))
    full = full_buckets(texts, seed, usable, longest, min(least, 255), _log(every // 2, most_bits))
    filters = spark.sparkContext.broadcast((usable.value, full))
    usable.destroy()
    names = [f"w{j + 1}" for j in range(longest)]
    none = F.lit(0).cast("long")
    phrases = candidates(texts, seed, filters, longest, most_keys // 2)
    keys = phrases.unionByName(frequent.select(F.col("id").alias("w1"), *(none.alias(c) for c in names[1:])))
    counted = phrases.withColumn("found", F.array_repeat(none, len(_parts_of(longest))))
    for k, slice_ in enumerate(_slices(spark, keys, longest, most_keys)):
        counts = spark.sparkContext.broadcast(count_by_slot(texts, seed, filters, slice_, longest))
        counted = materialise(_with_counts(counted, slice_, counts, longest), f"collocation-counts-{k}")
        slice_.destroy()
        counts.destroy()
        _hand_back()
    filters.destroy()
    return counted


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, most_keys: int = 1 << 21, most_bits: int = 28) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words.

    Null texts are empty; rows without a language are one, ``und``; repeated rows count each; ids and extra columns are
    not looked at; an empty table gives no rows. A text without breaks is held in memory whole by its task. Ties go by
    count, then by the phrase in byte order.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur once or more")
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    words, seed = identified_words(texts)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    every, known = words.agg(F.sum("n"), F.count_if(F.col("n") >= least)).first()
    if known <= 4 * most_keys:
        counted = _counted_at_once(texts, frequent, seed, every or 0, longest, least)
    else:
        counted = _counted_by_slices(texts, frequent, seed, every, known, longest, least, most_keys, most_bits)
    scored = _scored(counted, longest, least)
    kept = materialise(_without_inner(materialise(scored, "collocation-scores"), longest, inside), "collocation-phrases")
    best = _best_of_each(_named(kept, frequent, longest), top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


