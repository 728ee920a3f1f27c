"""Searches, evaluation in two modes, similar questions, token caps and readers of databases."""

import random
import re
import types
from difflib import SequenceMatcher

import numpy as np
import pytest

from fernweave.functions import text as T
from fernweave.operators import conversations as V
from fernweave.operators import kpi as K
from fernweave.operators import retrieval as R
from fernweave.sources import readers as S


def test_nearest_chunks_with_ties_nulls_and_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [rng.integers(-2, 3, 4).astype(float).tolist() for _ in range(300)]  # coarse: many ties
    chunks = [(k, v) for k, v in enumerate(vectors)] + [(900, None), (901, [1.0, 2.0]), (902, [float("nan")] * 4)]
    asked = [(k, vectors[k]) for k in range(0, 300, 9)] + [(990, None), (991, [3.0, 1.0])]
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    got = R.semantic_top_k(spark.createDataFrame(asked, "query_id int, vector array<double>"), spark.createDataFrame(chunks, "chunk_id long, vector array<double>").repartition(5), 6).collect()
    want = []
    for q, v in asked:
        scored = sorted((-float(np.dot(v, c)), k) for k, c in chunks if v is not None and c is not None and len(c) == len(v) and not np.isnan(c).any())
        want += [(q, k, -score, place) for place, (score, k) in enumerate(scored[:6], 1)]
    assert sorted((r.query_id, r.chunk_id, r.score, r.place) for r in got) == sorted(want)
    texts = spark.createDataFrame([("b", [1.0]), ("a", [1.0])], "chunk_id string, vector array<float>")
    assert [r.chunk_id for r in R.semantic_top_k(spark.createDataFrame([(1, [1.0])], "query_id int, vector array<float>"), texts, 1).collect()] == ["a"]
    assert R.semantic_top_k(spark.createDataFrame([], "query_id int, vector array<float>"), texts, 1).count() == 0


def test_similar_equals_difflib_and_compares_few_pairs(monkeypatch):
    rng = random.Random(2)
    words = ["cover", "price", "plan", "how", "long", "is", "the", "of", "what", "ab"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts += [t[:-1] + "x" for t in texts[:20]]
    full = []

    class Spy(SequenceMatcher):
        def ratio(self):
            full.append(1)
            return super().ratio()

    monkeypatch.setattr(R, "SequenceMatcher", Spy)
    pairs = [(a, b) for a in texts for b in texts]
    assert all(R.similar(a, b, 0.9) == (SequenceMatcher(None, a, b).ratio() >= 0.9) for a, b in pairs)
    assert len(full) < len(pairs) / 4


def test_token_caps_from_one_pass(spark):
    def words(text):  # in here, so that tasks are sent it whole
        return [m.span() for m in re.finditer(r"\S+", text)]

    class Encoded:
        def encode(self, text, add_special_tokens):
            return types.SimpleNamespace(offsets=[(0, 0), *words(text)])

    class Called:
        def encode(self, text, add_special_tokens):
            return [1]

        def __call__(self, text, add_special_tokens, return_offsets_mapping):
            return {"offset_mapping": words(text)}

    rng = random.Random(4)
    text = "".join(rng.choice(["word ", "longer-word ", "x. ", "\n", "1. item "]) for _ in range(1500))
    calls = []

    def spans(t):
        calls.append(1)
        return words(t)

    for cap, overlap in ((40, 90), (7, 100), (200, 240)):
        counted = list(R.Page(text).chunks(900, overlap, lambda t: len(t.split()), cap))
        calls.clear()
        assert list(R.Page(text, spans).chunks(900, overlap, None, cap)) == counted and len(calls) == 1
        assert all(len(t.split()) <= cap for _, t in counted)
    pages = spark.createDataFrame([(1, 1, text)], "doc_id long, page_number int, text string")
    for shape in (words, Encoded(), Called()):
        got = R.chunked(pages, 900, 90, most_tokens=40, spans=R.token_spans(shape)).orderBy("chunk_id").collect()
        assert sorted(r.text for r in got) == sorted(t for _, t in R.Page(text).chunks(900, 90, lambda t: len(t.split()), 40))


def test_cases_pass_by_their_kind(spark):
    cases = spark.createDataFrame([(1, "dev", "answerable", "d", [2]), (2, "dev", "ambiguous", None, None), (3, "held", "no_answer", None, None), (4, "held", "odd", None, None)], "case_id int, split string, expected_type string, doc_id string, pages array<int>")
    found = spark.createDataFrame([("m", 1, 1, "x", 2), ("m", 1, 2, "d", 1), ("m", 1, 3, "d", 2), ("n", 1, 1, "d", 9)], "mode string, case_id int, place int, doc_id string, page int")
    status = spark.createDataFrame([(m, c, s) for m in "mn" for c, s in ((1, "sufficient"), (2, "ambiguous"), (3, "ambiguous"), (4, "sufficient"))], "mode string, case_id int, status string")
    judged = R.judged_cases(cases, found, status)
    got = {(r.mode, r.case_id): (r.doc_hit, r.page_hit, r.rank, r.passed) for r in judged.collect()}
    assert got["m", 1] == (True, True, 3, True) and got["n", 1] == (True, False, None, False)
    assert got["m", 2] == (True, True, None, True) and not got["m", 3][3] and not got["m", 4][3]
    times = spark.createDataFrame([("m", 1, 4.0), ("m", 2, 8.0)], "mode string, case_id int, ms double")
    told = {(r.mode, r.split): (r.cases, r.passed, r.mean_rank, r.mean_ms) for r in R.compared_modes(judged, times).collect()}
    assert told["m", "dev"] == (2, 2, 3.0, 6.0) and told["n", "dev"] == (2, 1, None, None)


def test_rules_of_owners_are_refused_unless_one_holds(spark):
    import datetime

    day = datetime.date
    rules = spark.createDataFrame([(1, "a", day(2020, 1, 1), day(2021, 6, 30)), (1, "b", day(2021, 7, 1), None), (2, "c", day(2020, 1, 1), None), (2, "d", day(2021, 1, 1), day(2021, 2, 1)), (4, "e", day(2022, 1, 1), day(2021, 1, 1))], "owner_id int, rule_id string, valid_from date, valid_to date")

    def ruled(*months):
        return [r.rule_id for r in K.with_owner_rule(spark.createDataFrame(list(months), "owner_id int, month_start date"), rules).orderBy("owner_id", "month_start").collect()]

    assert ruled((1, day(2020, 5, 1)), (1, day(2021, 6, 1)), (1, day(2021, 7, 1)), (1, day(2030, 1, 1)), (2, day(2020, 12, 1))) == ["a", "a", "b", "b", "c"]
    for bad in ((1, day(2019, 1, 1)), (2, day(2021, 1, 1)), (3, day(2021, 1, 1)), (4, day(2021, 6, 1)), (None, day(2021, 1, 1))):
        with pytest.raises(Exception, match="exactly one rule"):
            ruled(bad)
    assert [tuple(r) for r in K.overlapping_rules(rules, "owner_id").collect()] == [(2, "c", "d")]


def test_canonical_json_and_purposes(spark):
    import json

    frame = spark.createDataFrame([(1, 'a "b" é\n', None, 2.5), (2, "", True, None)], "k int, t string, b boolean, d double")
    got = [r[0] for r in frame.orderBy("k").select(T.canonical_json({c: frame[c] for c in ("t", "k", "b", "d")})).collect()]
    assert got == [json.dumps(r, sort_keys=True, ensure_ascii=False) for r in ({"t": 'a "b" é\n', "k": 1, "b": None, "d": 2.5}, {"t": "", "k": 2, "b": True, "d": None})]
    said = spark.createDataFrame([(1, k, p) for k, p in enumerate(["product", None, "lead", "product", "product"])], "conv_id int, turn int, purpose string")
    assert [(r.turn, r.place) for r in V.last_messages(said, 2, "product").orderBy("turn").collect()] == [(3, 1), (4, 2)]


def test_database_is_read_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db"
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "K int, V string")
    rows.write.jdbc(f"{url};create=true", "t", mode="overwrite")
    got = S.read_jdbc_parts(spark, url, "t", "K", 4, where="K >= 10", columns=["K", "V"])
    assert got.rdd.getNumPartitions() == 4 and sorted(r[0] for r in got.collect()) == list(range(10, 50))
    assert S.read_jdbc_parts(spark, url, "t", "K", 4, where="K > 999").count() == 0
    assert S.open_table(spark, "jdbc", url, "t").count() == 50
    with pytest.raises(ValueError):
        S.open_table(spark, "other", url, "t")
