"""Lead collection over turns: fields said in a text, drafts that grow turn by turn, validation, confirmation and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernweave.functions.text import CURRENCY, INCOME_LABEL, NUMBER, PERIOD, income, national_phone

# How names, occupations and phone numbers are said; the first pattern that is found counts.
NAME_SAID = (
    r"ชื่อ\s*[:=]?\s*(.+?)(?=\s+(?:ทำงาน|อาชีพ|รายได้|เงินเดือน|สนใจ|เบอร์)|[,;\n]|$)",
    r"name\s*[:=]?\s*(.+?)(?=\s+(?:occupation|income|phone)|[,;\n]|$)",
)
OCCUPATION_SAID = (
    r"อาชีพ\s*[:=]?\s*(.+?)(?=\s+(?:รายได้|เงินเดือน|สนใจ|เบอร์)|[,;\n]|$)",
    r"ทำงาน(?:เป็น|ด้าน)?\s*(.+?)(?=\s+(?:รายได้|เงินเดือน|สนใจ|เบอร์)|[,;\n]|$)",
    r"occupation\s*[:=]?\s*(.+?)(?=\s+(?:รายได้|income|สนใจ|เบอร์|phone)|[,;\n]|$)",
)
PHONE_SAID = r"((?:\+66|0066|0)[0-9\s().-]{8,14})"
# Whole turns that confirm or cancel, and beginnings that never confirm.
CONFIRMS = ("ยืนยัน", "ยืนยันข้อมูล", "ยืนยันครับ", "ยืนยันค่ะ", "ตกลง", "ตกลงครับ", "ตกลงค่ะ", "ใช่", "ใช่ครับ", "ใช่ค่ะ", "confirm", "yes", "yesconfirm", "ok", "okay")
CANCELS = ("ยกเลิก", "ยกเลิกครับ", "ยกเลิกค่ะ", "ไม่สนใจ", "ไม่สนใจครับ", "ไม่สนใจค่ะ", "ไม่ต้องการ", "ไม่ต้องการครับ", "ไม่ต้องการค่ะ", "ไม่สมัคร", "cancel", "cancelled")
HESITATES = ("ไม่", "ยังไม่", "ขอ", "เดี๋ยว", "ยัง")
# What a reply calls the fields.
LABELS = {
    "name": "ชื่อ", "occupation": "อาชีพ", "income": "รายได้พร้อมสกุลเงินและช่วงเวลา", "income_confirmation": "ยืนยันรายได้แบบตัวเลขเดียว",
    "income_currency": "สกุลเงิน เช่น บาท/THB", "income_period": "ช่วงเวลา เช่น ต่อเดือน", "phone": "เบอร์โทรศัพท์", "product_id": "ผลิตภัณฑ์",
}

MONEY = ("income", "income_min", "income_max", "income_currency", "income_period")
FIELDS = ("name", "occupation", *MONEY, "phone", "product_id")


def _said(text: Column, patterns: tuple[str, ...]) -> Column:
    found = [F.nullif(F.regexp_replace(F.regexp_extract(text, f"(?iu){p}", 1), r"^[ \t,;:|\n]+|[ \t,;:|\n]+$", ""), F.lit("")) for p in patterns]
    return F.coalesce(*found)


def income_said(text: Column) -> Column:
    """Whether a turn speaks of income, if only of its unit."""
    return text.rlike(rf"(?iu){INCOME_LABEL}(?:{CURRENCY})?\s*{NUMBER}") | text.rlike(rf"(?iu){CURRENCY}|{PERIOD}")


def extracted(turns: DataFrame) -> DataFrame:
    """turns (owner_id, turn, text, product_id) with the fields that each text says; what it does not say is null.

    Turns are dealt by owner before their texts are gone through: owners' windows ask for that anyhow, and a small file would else
    be one task's.
    """
    text = F.col("text")
    phone = F.nullif(F.trim(F.regexp_extract(text, PHONE_SAID, 1)), F.lit(""))
    said = turns.repartition("owner_id").withColumn("money_", income(text))
    return said.select("owner_id", "turn", "text", _said(text, NAME_SAID).alias("name"), _said(text, OCCUPATION_SAID).alias("occupation"), *[F.col("money_")[f].alias(f) for f in MONEY], phone.alias("phone"), "product_id", F.coalesce(income_said(text), F.lit(False)).alias("income_said"))


def confirms(text: Column) -> Column:
    """Whether a whole turn is a confirmation."""
    said = F.regexp_replace(F.lower(F.trim(text)), r"(?U)[\s,.;:!?؟]+", "")
    hesitates = F.lit(False)
    for beginning in HESITATES:
        hesitates = hesitates | said.startswith(beginning)
    return F.coalesce(said.isin(*CONFIRMS) & ~hesitates, F.lit(False))


def cancels(text: Column) -> Column:
    """Whether a whole turn is a cancellation."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[\s,.;:!?؟]+", "").isin(*CANCELS), F.lit(False))


def missing(prefix: str = "") -> Column:
    """Names of the fields that a draft still has to get, in order; a range of income has to be confirmed as one figure."""

    def col(name: str) -> Column:
        return F.col(prefix + name)

    def blank(name: str) -> Column:
        return F.coalesce(col(name), F.lit("")) == ""

    checks = [
        F.when(blank("name"), "name"), F.when(blank("occupation"), "occupation"),
        F.when(col("income").isNull(), F.when(col("income_min").isNotNull(), "income_confirmation").otherwise("income")),
        F.when(~col("income_currency").eqNullSafe("THB"), "income_currency"), F.when(~col("income_period").eqNullSafe("monthly_thb"), "income_period"),
        F.when(blank("phone"), "phone"), F.when(blank("product_id"), "product_id"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def drafts(turns: DataFrame) -> DataFrame:
    """The draft after each turn: owner_id, turn, the fields, missing, and status unconfirmed, confirmed or cancelled.

    A field keeps the last value that was said; the income fields are replaced together whenever a turn speaks of
    income, so that a unit alone clears the amount. A confirmation counts only if nothing was missing before it, and
    only until a later turn says something new. Windows over an owner's turns; turns have one order.
    """
    line = W.partitionBy("owner_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    own = extracted(turns)
    block = F.last(F.when(F.col("income_said"), F.struct(*MONEY)), ignorenulls=True).over(line)
    grown = own.select("owner_id", "turn", "text", *[F.last(f, ignorenulls=True).over(line).alias(f) for f in ("name", "occupation", "phone", "product_id")], block.alias("block_"))
    grown = grown.select("owner_id", "turn", "text", "name", "occupation", *[F.col("block_")[f].alias(f) for f in MONEY], "phone", "product_id").withColumn("missing", missing())
    order = W.partitionBy("owner_id").orderBy("turn")
    shown = F.coalesce(F.size(F.lag("missing").over(order)) == 0, F.lit(False))
    fields = F.struct(*FIELDS)
    changed = F.coalesce(~fields.eqNullSafe(F.lag(fields).over(order)), F.lit(True))
    step = F.when(cancels(F.col("text")), "cancelled").when(confirms(F.col("text")) & shown, "confirmed").when(changed, "unconfirmed")
    return grown.withColumn("status", F.coalesce(F.last(step, ignorenulls=True).over(line), F.lit("unconfirmed"))).drop("text")


def errors() -> Column:
    """What forbids to save a draft, in order; an empty array for a lead that can be saved."""
    blank = {f: F.coalesce(F.trim(F.col(f)), F.lit("")) == "" for f in ("name", "occupation", "phone", "product_id")}
    fits = F.col("income") * 100 == F.floor(F.col("income") * 100)
    checks = [  # Fixed values: the texts of the errors
        F.when(F.col("status") != "confirmed", "lead confirmation is required before save"), F.when(blank["name"], "name is required"), F.when(blank["occupation"], "occupation is required"),
        F.when(F.col("income").isNull(), F.when(F.col("income_min").isNotNull(), "income range requires confirmation").otherwise("income is required")).when(F.col("income") < 0, "income must be finite and non-negative").when(~fits, "income must have at most 2 decimal places"),
        F.when(~F.col("income_currency").eqNullSafe("THB"), "income currency must be confirmed as THB"), F.when(~F.col("income_period").eqNullSafe("monthly_thb"), "income must be confirmed as monthly_thb"),
        F.when(blank["phone"], "phone is required"), F.when(blank["product_id"], "product_id is required"),
        F.when(~blank["phone"] & national_phone(F.col("phone")).isNull(), "phone must be a Thai 9-10 digit national number after normalization"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def summary() -> Column:
    """The fields that a draft has, as a line."""
    low, high = (F.coalesce(F.col(f).cast("string"), F.lit("?")) for f in ("income_min", "income_max"))
    amount = F.when(F.col("income_min").isNotNull() | F.col("income_max").isNotNull(), F.concat(low, F.lit("–"), high)).otherwise(F.col("income").cast("string"))
    unit = F.nullif(F.concat_ws(" / ", "income_currency", "income_period"), F.lit(""))

    def part(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))

    return F.concat_ws(" | ", part("ชื่อ", F.col("name")), part("อาชีพ", F.col("occupation")), part("รายได้", F.when(amount.isNotNull(), F.concat_ws(" ", amount, unit))), part("เบอร์", F.col("phone")), part("ผลิตภัณฑ์", F.col("product_id")))


def prompt(fields: Column) -> Column:
    """The labels of missing fields; where the income is missing, its units are not asked for apart."""
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    asked = F.when(F.array_contains(fields, "income"), F.filter(fields, lambda f: ~f.isin("income_currency", "income_period"))).otherwise(fields)
    return F.array_join(F.transform(asked, lambda f: F.coalesce(F.try_element_at(labels, f), f)), ", ")


def fingerprint() -> Column:
    """A hash that binds a confirmation to the fields that were shown."""
    return F.sha2(F.to_json(F.struct(*FIELDS)), 256)


def latest_drafts(all_drafts: DataFrame, leads: DataFrame) -> DataFrame:
    """The last draft of each owner, or what was saved of them: (owner_id, source, fields)."""
    last = all_drafts.groupBy("owner_id").agg(F.max_by(F.struct(*FIELDS), "turn").alias("draft"))
    saved = leads.select("owner_id", F.struct(*FIELDS).alias("lead"))
    both = last.join(saved, "owner_id", "full_outer")
    return both.select("owner_id", F.when(F.col("draft").isNotNull(), "draft").otherwise("lead").alias("source"), F.coalesce("draft", "lead").alias("fields")).select("owner_id", "source", "fields.*")
