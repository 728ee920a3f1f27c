"""Small cases of the corpus, its readers, chunking, and what readers see."""

import hashlib
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.functions import display as Y
from fernweave.operators import campaign as C
from fernweave.operators import corpus as O
from fernweave.operators import kpi as K
from fernweave.operators import retrieval as R
from fernweave.sources import readers as S


def value(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def pieces(text, *how):
    return list(R.Page(text).chunks(*how))


def test_chunks_cover_the_page_and_keep_their_caps():
    draw = random.Random(5)
    for _ in range(200):
        text = "".join(draw.choice(["word ", "a. ", "12. item ", "\n", "3 กลุ่มโรค x\n", "x" * 30, "? "]) for _ in range(draw.randrange(0, 120)))
        most, overlap = draw.choice([(200, 90), (300, 80), (160, 100)])
        got = pieces(text, most, overlap, len, 150)
        assert all(0 < len(t) <= min(most, 150) for _, t in got)
        assert all(t in text for _, t in got)
        assert [k for k, _ in got] == sorted({k for k, _ in got})
        if text.strip():
            assert text.strip().startswith(got[0][1][:1]) and text.strip().endswith(got[-1][1])


def test_chunks_begin_again_at_items_sections_and_lines():
    body = "y" * 100 + " "
    item = body + "z" * 60 + " 15. next item goes on " + "w" * 200
    assert pieces(item, 190, 60)[1][1].startswith("15. next")
    section = body + "z" * 50 + "\n7 กลุ่มโรคร้ายแรง\n8. x " + "w" * 200
    assert pieces(section, 190, 60)[1][1].startswith("7 กลุ่ม")
    line = body + "z" * 60 + "\nnext line goes on " + "w" * 200
    assert pieces(line, 185, 40)[1][1].startswith("next line")
    assert pieces("", 10, 2) == [] and pieces(" " * 30, 10, 2) == []
    with pytest.raises(ValueError):
        R.chunked(None, 10, 2, len, 0)


def test_chunks_by_tokens_run_as_a_job(spark):
    pages = spark.createDataFrame([(1, 1, "one two three four five six"), (2, 1, None)], "doc_id long, page_number int, text string")
    got = R.chunked(pages, 1800, 0, lambda t: len(t.split()), 2).collect()
    assert all(len(r.text.split()) <= 2 for r in got) and "".join(r.text for r in got).replace(" ", "") == "onetwothreefourfivesix"


def test_questions_come_from_later_pools_only_where_needed(spark):
    rows = [(1, 0, "what does it cost", 0.5), (1, 0, "what does it cost?", 0.4), (1, 0, "not gated", None), (1, 1, "who may apply", 0.9), (2, 0, "a b c", 0.1), (2, 1, "x y z", 0.9)]
    got = R.distinct_questions(spark.createDataFrame(rows, "group_id long, pool int, question string, score double"), desired=1).collect()
    assert sorted((r.group_id, r.question) for r in got) == [(1, "what does it cost"), (2, "a b c")]
    two = R.distinct_questions(spark.createDataFrame(rows, "group_id long, pool int, question string, score double"), desired=2).where("group_id = 1").orderBy("place")
    assert [r.question for r in two.collect()] == ["what does it cost", "who may apply"]


def test_manifest_counts_documents_and_tells_missing_fields(spark):
    fields = "position long, doc_id string, sha256 string, page_count int, local_path string, corrected_text_path string"
    files = spark.createDataFrame([("f", "h", True)], "path string, content_hash string, is_pdf boolean")
    rows = [(1, "a", "h", 1, "f", "f"), (2, "a", "h", 0, "f", None), (3, None, None, 1, "f", "f"), (4, "b", "h", 1, "g", "f")]
    got = sorted((r.doc_id or "", r.error) for r in O.manifest_errors(spark.createDataFrame(rows, fields), files, ("doc_id", "sha256"), expected=5).collect())
    assert got == [("", "5 documents expected, not 4"), ("", "missing fields: doc_id, sha256"), ("a", "no corrected text"), ("a", "page count"), ("a", "repeated content"), ("a", "repeated id"), ("b", "no file")]
    assert O.manifest_errors(spark.createDataFrame([], fields), files, ("doc_id",)).count() == 0


def test_embedded_links_are_found_at_any_depth_and_the_last_wins(spark):
    def page(k, *urls):
        return k, f'<script id="__NEXT_DATA__" x>{json.dumps({"a": [{"file": u, "name": f"n{k}", "child": {"file": u}} for u in urls]})}</script>'

    pages = spark.createDataFrame([page(1, "https://h/a b.pdf", "https://i/c.pdf", "https://h/d.txt"), page(2, "https://h/a b.pdf"), (3, "<p>none</p>"), (4, '<script id="__NEXT_DATA__">{broken</script>'), (5, None)], "page_id long, html string")
    got = O.embedded_links(pages, "file", host="h").collect()
    assert [(r.url, r.page_id, r.name) for r in got] == [("https://h/a%20b.pdf", 2, "")]


def test_index_faults(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    stored = O.index_metadata(chunks, {"x": 1})
    assert O.index_faults(stored, chunks.orderBy(F.desc("chunk_id")), {"x": 1}, 2).count() == 0
    assert sorted(r[0] for r in O.index_faults(stored, chunks.where("chunk_id = 'a'"), {"x": 2}, 2).collect()) == ["count", "fingerprint", "ids"]
    assert [r[0] for r in O.index_faults(stored.where("false"), chunks, {"x": 1}).collect()] == ["no metadata"]
    assert O.id_set_hash(chunks.where("false"), "chunk_id").count() == 1


def test_quantiles_equal_numpy(spark):
    draw = random.Random(3)
    values = [0.0, -0.0, 1e-310, 999.9999999999999, 1000.0, -1000.0, -999.9999999999999, 5.0, 5.0] + [draw.choice([-1, 1]) * 10 ** draw.uniform(-5, 7) for _ in range(500)]
    frame = spark.createDataFrame([(v, 2.0 if k == 0 else None, None) for k, v in enumerate(values)], "f double, g double, none double")
    asked = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    got = {r.field: r.q for r in C.exact_quantiles(frame, ["f", "g", "none"], asked).collect()}
    assert got["f"] == pytest.approx(list(np.quantile(values, asked)), abs=1e-9) and got["g"] == [2.0] * 6 and "none" not in got


def test_ranks_in_narrow_ranges_of_any_distribution(spark, monkeypatch):
    draw = np.random.default_rng(8)
    n = 6000
    columns = {
        "epochs": 1.7e9 + draw.integers(0, 90_000, n), "ids": np.arange(n) * 1.0, "constant": np.full(n, 3.5), "normal": draw.normal(0, 1, n), "wide": 10.0 ** draw.uniform(-300, 300, n),
        "two": draw.integers(0, 2, n) * 1.0, "close": 1.0 + np.arange(n) * 2.0**-50, "skewed": np.where(draw.random(n) < 0.4, 7.0, draw.exponential(1, n)), "ends": np.where(np.arange(n) < 5, np.inf, draw.normal(0, 1, n)),
    }
    rows = [tuple(None if (c == "normal" and k % 10 == 0) else math.nan if (c == "normal" and k % 10 == 1) else float(v[k]) for c, v in columns.items()) for k in range(n)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(6).cache()
    asked, held = (0.01, 0.25, 0.5, 0.75, 0.99), []
    narrowed = C._narrowed

    def spy(frame, ranges, accuracy):
        narrowed(frame, ranges, accuracy)
        held.extend((r.field, r.inner) for r in ranges if r.low < r.high)

    monkeypatch.setattr(C, "_narrowed", spy)
    got = {r.field: r.q for r in C.exact_quantiles(frame, list(columns), asked, most=300, accuracy=400).collect()}
    for c, v in columns.items():
        own = v[[k for k in range(n) if not (c == "normal" and k % 10 < 2)]]
        assert got[c] == pytest.approx(list(np.quantile(own, asked)), rel=1e-12), c
    assert {c for c, _ in held} >= {"epochs", "ids", "close"} and "constant" not in {c for c, _ in held}
    assert max(w for _, w in held[-5:]) <= 1000  # a few hundredths of 6000 rows, whatever the distribution


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿k,v\n1,\nx,2.5\n".encode())
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "a.csv"), "k string, v double").collect()] == [("1", None), ("x", 2.5)]
    told = S.typed(S.read_csv(spark, str(tmp_path / "a.csv"), "k string, v string"), "k int, v double").collect()
    assert [tuple(r) for r in told] == [(1, None), (None, 2.5)]
    (tmp_path / "m.json").write_text('{"documents": [{"a": 1},\n {"a": 2}]}')
    assert S.read_json_documents(spark, str(tmp_path / "m.json")).count() == 2
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert S.read_json_lines(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2
    S.write_json(spark.sql("select double('nan') a, array(double('infinity'), 1D) b, struct(double('nan') c) s, 'ก' t"), str(tmp_path / "out"))
    line = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert json.loads(line) == {"a": None, "b": [None, 1.0], "s": {"c": None}, "t": "ก"} and "ก" in line


def test_verified_pages_name_the_first_fault(spark):
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("a", "", "c")}
    pages = [(1, " a ", digest["a"], True), (2, "b", None, True), (3, " ", digest[""], True), (4, "c", digest["c"], None)]
    rows = spark.createDataFrame([(1, pages), (2, None)], "doc_id long, pages array<struct<page_number int, text string, sha256 string, verified boolean>>")
    got = [(r.doc_id, r.page_number, r.fault) for r in S.verified_pages(rows).orderBy("doc_id", "page_number").collect()]
    assert got == [(1, 1, None), (1, 2, "hash"), (1, 3, "empty"), (1, 4, "unverified"), (2, None, "no pages")]


def test_choices_quotes_and_suggestions(spark):
    three = F.array(*[F.lit(x) for x in "abc"])
    said = {"2": "b", " ข้อ 3 ": "c", "0": None, "4": None, "99999999999": None, "อันแรก": "a", "two": None, "": None}
    assert {k: value(spark, Y.chosen(F.col("t"), three), t=k) for k in said} == said
    assert value(spark, Y.bears_out(F.col("t"), F.col("e"), F.col("v")), t="call 08-1234 now", e="08-1234", v="081234")
    assert not value(spark, Y.bears_out(F.col("t"), F.col("e"), F.col("v")), t="call 08-1234 now", e="08-9999", v="089999")
    assert not value(spark, Y.bears_out(F.col("t"), F.col("e"), F.col("v")), t="x", e=" ", v="")
    good = F.array(*[F.lit(f"question {k}?") for k in range(4)])
    assert value(spark, Y.are_safe_questions(good), t="") and not value(spark, Y.are_safe_questions(F.array(*[F.lit("q?")] * 4)), t="")
    assert not value(spark, Y.are_safe_questions(F.concat(F.slice(good, 1, 3), F.array(F.lit("mail a@b.co")))), t="")
    assert value(spark, Y.local_time(F.lit(None).cast("timestamp"), "UTC"), t="") == ""


def test_evidence_in_markdown(spark):
    quoted = value(spark, Y.quoted_evidence(F.col("t"), F.lit("d"), F.lit(2)), t="a \t b\r\n\n  c\n")
    assert quoted.startswith(Y.QUOTE_HEAD + "**เอกสาร:** `d`  \n**หน้า:** 2\n\n> a b\n> c\n\n") and quoted.endswith(Y.QUOTE_TAIL)
    listed = value(spark, Y.listed_evidence(F.col("t")), t="head • one  (1) two 2. three " + "word " * 400 + "• never")
    items = re.findall(r"^- (.*)$", listed.removeprefix(Y.LIST_HEAD), re.M)
    assert items[:3] == ["head", "one", "(1) two"] and items[3].endswith("word…") and items[4] == "ne…" and len(items) == 5
    assert sum(map(len, items)) <= Y.LIST_LETTERS + 1


def test_rules_compare_strictly(spark):
    rules = spark.sql("select 1L required, 0L premium_over, 0L policies_over, date'2024-02-01' valid_from, date'2024-01-01' valid_to, '>=' op")
    assert rules.select(K.rule_errors(F.col("op"))).first()[0] == ["range", "operator"]
