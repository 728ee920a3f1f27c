"""Lead collection as a fold: what each turn makes of the draft."""

import datetime
from decimal import Decimal

import pytest

from fernweave.operators import lead_turns as L

NOW = datetime.datetime(2024, 6, 1)
FIELDS = "name string, occupation string, income decimal(14,2), income_min decimal(14,2), income_max decimal(14,2), income_currency string, income_period string, phone string, product_id string"
ALIASES = [("a", "Product A"), ("a", "คุ้มตลอดชีพ ซีไอ พลัส"), ("b", "Product B"), ("b", "คุ้มตลอดชีพ พลัส"), ("c", "แผนรวม"), ("d", "แผนรวม")]
WHOLE = "ชื่อ เอก อาชีพ ครู รายได้ 30000 บาทต่อเดือน เบอร์ 0812345678"
LEAD = ("เอก", "Engineer", Decimal("30000"), None, None, "THB", "monthly_thb", "0812345678", "a")


def run(spark, turns, leads=(), aliases=ALIASES, active=None):
    """turns: texts of one owner, or (owner, text) pairs in order."""
    rows = [(t[0], k, t[2] if len(t) > 2 else NOW, t[1], active) if isinstance(t, tuple) else ("o", k, NOW, t, active) for k, t in enumerate(turns)]
    frame = spark.createDataFrame(rows, "owner_id string, turn int, at timestamp, text string, active_product_id string")
    known = spark.createDataFrame(list(leads), f"owner_id string, {FIELDS}, verified_at timestamp, refresh_asked boolean")
    folded = L.lead_turns(frame, spark.createDataFrame(aliases, "product_id string, alias string"), known)
    labels = spark.createDataFrame([("a", "แบบ เอ"), ("b", "แบบ บี")], "product_id string, label string")
    said = {(r.owner_id, r.turn): (r.reply, r.summary) for r in L.replies(folded, labels).collect()}
    return [(r, *said[r.owner_id, r.turn]) for r in sorted(folded.collect(), key=lambda r: r.turn)]


def lead(verified=NOW, asked=False, owner="o"):
    return (owner, *LEAD, verified, asked)


def test_a_product_named_then_the_rest_is_saved_without_a_confirmation(spark):
    first, last = run(spark, ["interested in Product A", WHOLE])
    assert first[0].product_id == "a" and first[0].outcome == "asks" and first[0].missing == ["name", "occupation", "income", "income_currency", "income_period", "phone"]
    assert last[0].outcome == "saved" and last[0].status == "confirmed" and last[0].missing == [] and last[1].startswith("สอบถามเกี่ยวกับ แบบ เอ")


def test_parts_are_asked_for_by_their_labels(spark):
    ((row, reply, summary),) = run(spark, ["ชื่อ เอก"], active="a")
    assert reply == "กรุณาแจ้ง อาชีพ, รายได้พร้อมสกุลเงินและช่วงเวลา, เบอร์โทรศัพท์ เพิ่มเติม" and summary == "ชื่อ: เอก | ผลิตภัณฑ์: a" and row.status == "unconfirmed"


def test_several_products_are_chosen_from_by_number(spark):
    first, wrong, last = run(spark, [f"แผนรวม {WHOLE}", "9", "2"])
    assert first[0].candidates == ["c", "d"] and first[0].product_id is None and first[0].outcome == "choose"
    assert first[1] == L.CHOOSE_BEFORE + "1. **c**\n2. **d**" + L.CHOOSE_AFTER
    assert wrong[0].candidates == ["c", "d"] and wrong[0].outcome == "choose"
    assert last[0].candidates == [] and last[0].product_id == "d" and last[0].outcome == "saved"


def test_a_whole_name_decides_and_an_ambiguous_one_takes_the_product_back(spark):
    first, second = run(spark, ["สนใจคุ้มตลอดชีพ พลัส", "แผนรวม"])
    assert first[0].product_id == "b" and first[0].candidates == []
    assert second[0].product_id is None and second[0].candidates == ["c", "d"]


def test_cancel_and_start_anew(spark):
    rows = run(spark, [WHOLE, "ยกเลิก", "confirm", "สนใจสมัคร ชื่อ บี"], active="a")
    assert [r[0].outcome for r in rows[:2]] == ["saved", "cancelled"] and rows[1][1] == L.CANCELLED and rows[1][0].missing == []
    assert rows[2][0].outcome == "saved"  # a complete draft is saved whatever the turn says
    rows = run(spark, ["ชื่อ เอก อาชีพ ครู", "ยกเลิก", "yes", "สนใจสมัคร ชื่อ บี"])
    assert [r[0].status for r in rows] == ["unconfirmed", "cancelled", "cancelled", "unconfirmed"]
    assert rows[3][0].name == "บี" and rows[3][0].occupation is None


def test_a_range_clears_the_income(spark):
    ((row, *_),) = run(spark, ["แก้รายได้ 40000-50000 บาทต่อเดือน"], [lead()])
    assert row.income is None and (row.income_min, row.income_max) == (Decimal("40000.00"), Decimal("50000.00"))
    assert "income_confirmation" in row.missing and row.outcome == "asks"


def test_a_stale_profile_is_asked_for_once(spark):
    old = NOW - datetime.timedelta(days=184)
    first, second = run(spark, ["สวัสดี", "ชื่อ ใหม่"], [lead(old)])
    assert first[0].refreshed and first[0].name is None and first[0].product_id == "a" and first[0].outcome == "asks"
    assert not second[0].refreshed and second[0].name == "ใหม่" and second[0].occupation is None
    ((asked, *_),) = run(spark, ["สวัสดี"], [lead(old, asked=True)])
    assert not asked.refreshed and asked.name == "เอก"
    ((fresh, *_),) = run(spark, ["สวัสดี"], [lead(NOW - datetime.timedelta(days=182))])
    assert not fresh.refreshed and fresh.outcome == "saved"
    third = run(spark, ["สวัสดี", WHOLE, ("o", "สวัสดี", NOW + datetime.timedelta(days=200))], [lead(old)])
    assert [r[0].refreshed for r in third] == [True, False, True]  # saved in between, and stale again


def test_a_product_that_changes_is_saved_and_one_beyond_the_catalogue_is_refused(spark):
    assert run(spark, ["another look"], [lead()], active="b")[0][0].product_id == "b"
    ((row, reply, _),) = run(spark, ["another look"], [lead()], active="zz")
    assert row.outcome == "invalid" and row.status == "confirmed" and reply.endswith("product_id is not present in the active product catalog")
    ((row, reply, _),) = run(spark, [WHOLE.replace("0812345678", "0123456789012")], active="a")
    assert row.outcome == "invalid" and row.status == "unconfirmed" and "phone must be" in reply


@pytest.mark.parametrize("turns", [[], [(None, None), ("x", ""), (None, "ชื่อ เอก")]])
def test_owners_are_apart_and_nulls_are_taken(spark, turns):
    rows = run(spark, turns)
    assert [(r[0].owner_id, r[0].name) for r in rows] == ([(None, None), ("x", None), (None, "เอก")] if turns else [])
