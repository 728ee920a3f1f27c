"""Claims of answers against cited evidence."""

import random
import re

import pytest

from fernweave.operators import claims as C

CASES = [  # answer, evidence, the claim that is not borne
    ("ชำระเบี้ย 20 ปี", "ระยะเวลาชำระเบี้ย 20 ปี", None),
    ("ชำระเบี้ย 20 ปี", "คุ้มครอง 20 ปี", "20ปี"),
    ("รับอายุ 16 - 60 ปี", "อายุรับ 16 – 60 ปี", None),
    ("รับอายุ 16 - 60 ปี", "อายุรับ 16 - 65 ปี", "60ปี"),
    ("เบี้ย 1,200 บาท", "ตาราง premium แผน 1200 บาท", None),
    ("เบี้ย 1,200 บาท", "ทุน 1200 คน และอื่น", "1,200บาท"),
    ("เบี้ย 1,200 บาท", "ตาราง เบี้ย 1300 บาท", "1,200บาท"),
    ("แผน 3", "แผน 3", None),
    ("คุ้มครองมะเร็ง", "ไม่คุ้มครองมะเร็ง", "คุ้มครองมะเร็ง"),
    ("ไม่คุ้มครองมะเร็ง", "ไม่คุ้มครองมะเร็ง", None),
    ("", "", None),
    ("90", "19001", "90"),
    ("คุ้มครอง 25 ปี", "ตาราง คุ้มครอง" + " " * 40 + "ระยะ 25 ปี", None),  # by the label of a table
    ("ชำระ 90 ปี", "เบี้ย" + " " * 40 + "คุ้มครอง 90 ปี", "90ปี"),  # told to be about something else
    ("ลด 5% และ 7 %", "ลด 5% และ 7%", None),
    ("ลด 5 เดือน", "ลด 5 ปี", "5เดือน"),
    ("อัตรา 12.5", "อัตรา 12.5 และ 3", None),
    ("7 7 7 8", "7", "8"),
]


def test_claims_of_many_answers(spark):
    answers = spark.createDataFrame([(k, a) for k, (a, _, _) in enumerate(CASES)] + [(99, None)], "answer_id long, text string")
    cited = spark.createDataFrame([(k, "c", e) for k, (_, e, _) in enumerate(CASES)], "answer_id long, chunk_id string, text string")
    got = {r.answer_id: r.claim for r in C.claim_errors(answers, cited).collect()}
    want = {k: c for k, (_, _, c) in enumerate(CASES) if c is not None}
    assert got == want


def test_figures_with_the_letters_around_them(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b ", "1", "23", " 4,567 ", "8.9", ",", " ปี", "บาท ", "x" * 40]) for _ in range(rng.choice([0, 3, 60, 300]))) for _ in range(30)]
    rows = C.figures(spark.createDataFrame(list(enumerate(texts)), "answer_id long, text string")).collect()
    got = sorted((r.answer_id, r.k, r.number, r.unit, r.said, r.before, r.after) for r in rows)
    pattern = C.FIGURE.removeprefix("(?U)")
    want = [(i, k, m[1].replace(",", ""), m[2] or "", m[0], t[max(0, m.start() - 32) : m.start()], t[m.end() : m.end() + 32]) for i, t in enumerate(texts) for k, m in enumerate(re.finditer(pattern, t))]
    assert got == want and len(want) > 300


def test_faults_come_in_order(spark):
    keys = "answer_id long, doc_id string, page_number int, chunk_id string, source_url string"
    answers = spark.createDataFrame([(1, "ชำระ 5 ปี"), (2, "ชำระ 6 ปี"), (3, "hello there"), (4, "anything"), (5, "คุ้มครองมะเร็ง 7 ปี"), (6, "คุ้มครองมะเร็ง"), (7, None)], "answer_id long, text string")
    cites = spark.createDataFrame([(k, "d", 1, "c", "u") for k in (1, 2, 3, 5, 6, 7)] + [(2, "d", 1, "c2", "u")], keys)
    texts = {1: "ชำระ 5 ปี", 2: "ชำระ 5 ปี", 3: "ชำระ", 5: "ไม่คุ้มครองมะเร็ง", 6: "ไม่คุ้มครองมะเร็ง", 7: "x"}
    chunks = spark.createDataFrame([(k, "d", 1, "c", "u", t) for k, t in texts.items()] + [(2, "d", 1, "c2", "u", "ชำระ 7 ปี"), (3, "d", 1, "uncited", "u", "hello")], keys + ", text string")
    got = {r.answer_id: (r.fault, r.claim) for r in C.answer_faults(answers, cites, chunks).collect()}
    assert got == {2: ("figure", "6ปี"), 3: ("nothing in common", None), 4: ("no citations", None), 5: ("figure", "7ปี"), 6: ("denied", "คุ้มครองมะเร็ง")}


@pytest.mark.parametrize("empty", ["answers", "cited"])
def test_empty_sides(spark, empty):
    answers = spark.createDataFrame([] if empty == "answers" else [(1, "ชำระ 5 ปี")], "answer_id long, text string")
    cited = spark.createDataFrame([] if empty == "cited" else [(1, "c", "x")], "answer_id long, chunk_id string, text string")
    assert [r.claim for r in C.claim_errors(answers, cited).collect()] == ([] if empty == "answers" else ["5ปี"])


def test_letters_around_figures_are_gathered_within_the_row(spark):
    text = "1 " * 40 + "a" * 50 + " 7 บาท" + " 8" * 40
    found = C.figures(spark.createDataFrame([(1, text), (None, "x 5 y"), (None, "z 6"), (2, None), (3, "no")], "answer_id int, text string"))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    own = sorted((r for r in rows if r.answer_id == 1), key=lambda r: r.k)
    assert len(own) == 81
    at = 0
    for r in own:
        at = text.index(r.said, at)
        assert (r.before, r.after) == (text[max(0, at - 32) : at], text[at + len(r.said) :][:32])
        at += len(r.said)
    assert sorted((r.before, r.number, r.after) for r in rows if r.answer_id is None) == [("x ", "5", "y"), ("z ", "6", "")]
