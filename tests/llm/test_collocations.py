"""Phrases against plain counting, the perfect hash, slices, and the query against its SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from fernweave.llm import collocations, queries
from fernweave.llm.perfect_hash import PerfectHash

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest, least, inside, top):
    by_lang = {}
    for lang, text in rows:
        counts = by_lang.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in by_lang.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            low, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= inside * a for b in longer):
                kept.append((-low, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (low, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -low))
    return sorted(out)


def documents(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "c", "Zürich", "d-e", "'f'", "Ägypten", "the", "of", "x" * 40]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!?", ": "]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.choice([0, 1, 3, 40, 200])))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), ("en", " ,. "), ("fr", "only one text"), rows[0], rows[0]]


@pytest.mark.parametrize("longest, least, most_keys", [(3, 10, 1 << 21), (3, 4, 50), (2, 3, 1 << 21), (4, 5, 200)])
def test_phrases_equal_plain_counts(spark, longest, least, most_keys):
    rows = documents(longest + least, 60)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, word string, n int").repartition(7)
    got = collocations.collocations(frame, longest=longest, least=least, inside=50, top=40, most_keys=most_keys)
    assert sorted(map(tuple, got.collect())) == brute(rows, longest, least, 50, 40)


def test_empty_tables_and_many_partial_sums(spark):
    frame = spark.createDataFrame([("en", "so it goes. " * 5)] * 200, "lang string, text string")
    assert collocations.collocations(frame.limit(0)).count() == 0
    got = collocations.collocations(frame.repartition(150)).collect()  # more tasks than meet in one step of the tree
    assert [tuple(r) for r in got] == [("en", 1, "so it goes", 1000, 1000, 1000, 3000, 1_000_000)]


def test_long_texts_are_cut_at_the_ends_of_pieces(spark):
    rows = [("en", "never odd or even. " * 70_000), ("en", "z" * 1_200_000 + " and never odd, " * 12)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 10, 50, 2000)


def test_common_phrases_do_not_leave_every_task(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = [("en", " ".join(rng.choice(words) for _ in range(150)) + f" x{i}") for i in range(80)]
    texts = spark.createDataFrame(rows, "lang string, text string").select("text", "lang").repartition(80, "text")
    counted, seed = collocations.identified_words(texts)
    usable = collocations.word_bits(counted.where("n >= 4"), 20)
    context = spark.sparkContext
    full = collocations.full_buckets(texts, seed, context.broadcast(usable), 2, 4, 20)
    filters, sent, apart = context.broadcast((usable, full)), [], collocations.handed_on

    def noted(*given):
        sent.append(apart(*given).count())
        return apart(*given)

    monkeypatch.setattr(collocations, "handed_on", noted)
    found = collocations.candidates(texts, seed, filters, 2, 1 << 20).collect()
    every = apart(texts, seed, filters, 2)
    assert sorted(found) == sorted(every.distinct().collect())
    assert sum(sent) < every.count() / 3  # once for each task that has them
    assert sorted(collocations.candidates(texts, seed, filters, 2, 50).collect()) == sorted(found)  # a share that is not broadcast whole


def test_perfect_hash_is_minimal_and_strangers_are_told():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        assert sorted(PerfectHash(keys).slots(keys).tolist()) == list(range(len(keys)))
    own = collocations.Slice([keys, keys[::-1].copy()])
    assert sorted(own.slots([keys, keys[::-1]]).tolist()) == list(range(len(keys)))
    assert (own.slots([keys, keys]) >= 0).sum() == (keys == keys[::-1]).sum()  # right first word, wrong second
    assert (own.slots([keys + np.uint64(1), keys]) == -1).all()


def test_exact_scores_beyond_64_bits():
    import pyarrow as pa

    big = 10**12
    batch = pa.RecordBatch.from_arrays([pa.array([5], pa.int64()), pa.array([6], pa.int64()), pa.array([[big + 7, big, big + 3]], pa.list_(pa.int64()))], names=["w1", "w2", "found"])

    class Frame:
        def mapInArrow(self, work, schema):
            return [r for b in work(iter([batch])) for r in b.to_pylist()]

    (row,) = collocations._scored(Frame(), 2, 10)
    assert row["score"] == 1_000_000 * big * big // ((big + 7) * (big + 3))


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_collocations"]).fetchall()
    got = queries.QUERIES["op11_collocations"](spark, SMALL).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_texts_are_read_twice_however_many_phrases(spark):
    rows = documents(5, 60)
    read = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(rows, "lang string, text string").repartition(5).mapInArrow(noted, "lang string, text string")
    got = collocations.collocations(frame, longest=3, least=3, inside=50, top=40, most_keys=20)  # far more candidates than a slice has keys
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 3, 50, 40)
    assert read.value == 2 * len(rows)


def test_more_words_than_a_broadcast_holds_are_counted_by_slices(spark, monkeypatch):
    rows, slices, count = documents(9, 40), [], collocations.count_by_slot
    monkeypatch.setattr(collocations, "count_by_slot", lambda *given: slices.append(1) or count(*given))
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=12, top=40, most_keys=6)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 12, 50, 40)
    assert len(slices) > 1


@pytest.mark.parametrize("each", [1, 2, 3, 4])
def test_phrases_in_columns_of_few_words(spark, each):
    rows = [(lang or "und", text or "") for lang, text in documents(3, 30)]
    texts = spark.createDataFrame(rows, "lang string, text string").select("text", "lang")
    counted, seed = collocations.identified_words(texts)
    found = {r.id: r for r in counted.where("n >= 5").collect()}
    own = collocations.Vocabulary(np.array(list(found), np.int64).view(np.uint64), np.array([r.n for r in found.values()]), 4)
    own.each, own.columns = each, -(-4 // each)
    vocabulary = spark.sparkContext.broadcast(own)
    dealt = collocations.dealt_phrases(texts, seed, vocabulary, 7)
    got = {}
    for *ids, a, first, last in collocations.counted_phrases(dealt, vocabulary, 7, 4, 5).collect():
        words = [found[i] for i in ids if i]
        assert (first, last) == (words[0].n, words[-1].n)
        got[words[0].lang, tuple(w.word for w in words)] = a
    want = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang, tuple(w[i : i + k])) for k in range(2, 5) for i in range(len(w) - k + 1))
    assert got == {p: a for p, a in want.items() if a >= 5}
