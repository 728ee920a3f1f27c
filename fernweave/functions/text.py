"""Text functions as column expressions: normalising, redaction, routing, contact and income fields."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Phrases that decide how a message is routed.
HANDOFF = ("ขอคุยกับพนักงาน", "ขอคุยกับเจ้าหน้าที่", "ติดต่อพนักงาน", "ติดต่อเจ้าหน้าที่", "เรียกพนักงาน", "เรียกเจ้าหน้าที่", "humanagent", "talktoagent")
GREETINGS = ("สวัสดี", "สวัสดีครับ", "สวัสดีค่ะ", "หวัดดี", "ดีครับ", "ดีค่ะ", "hello", "hi", "hey")
THANKS = ("ขอบใจ", "thanks", "thankyou", "โอเคขอบคุณ", "โอเคครับขอบคุณ")
FAREWELLS = ("ลาก่อน", "ไว้คุยใหม่", "จบบทสนทนา", "บาย", "bye", "goodbye")
HELP = ("ช่วยอะไรได้บ้าง", "ทำอะไรได้บ้าง", "ถามอะไรได้บ้าง", "มีประกันอะไรบ้าง", "มีผลิตภัณฑ์อะไรบ้าง", "แนะนำการใช้งาน", "help", "whatcanyoudo")
INTEREST = ("สนใจ", "อยากสมัคร", "ต้องการสมัคร", "ขอสมัคร", "สมัครเลย", "interested", "want to buy", "want to apply")
NO_INTEREST = ("ไม่สนใจ", "ไม่ต้องการ", "ไม่อยาก", "ไม่สมัคร", "ไม่เอา", "ยกเลิก", "cancel")
INTEREST_ASKED = ("วิธีสมัคร", "วิธีการสมัคร", "สมัครอย่างไร", "สมัครยังไง", "ขั้นตอนสมัคร", "how to apply", "how can i apply", "สนใจไหม", "สนใจหรือไม่", "are you interested")
PRODUCT_TERMS = (
    "ประกัน", "กรมธรรม์", "ความคุ้มครอง", "คุ้มครอง", "ผลประโยชน์", "เบี้ย", "ชำระ", "เคลม", "ผู้เอาประกัน", "ผู้รับผลประโยชน์", "สัญญาเพิ่มเติม",
    "คุ้มตลอดชีพ", "คุ้มออมสุข", "คุ้มมั่นใจ", "ตลอดชีพ 90/20", "insurance", "policy", "coverage", "premium", "claim", "benefit",
)
PRODUCT_ASKED = ("คุ้มครอง", "ผลประโยชน์", "ชำระ", "จ่าย", "เบี้ย", "อายุ", "ระยะเวลา", "เงื่อนไข", "กี่", "เท่าไร", "เท่าไหร่", "มีไหม", "ได้ไหม", "coverage", "benefit", "premium", "how many", "how long")
FOLLOW_UP = ("แล้ว", "แบบนั้น", "ดังกล่าว", "อันนี้", "กี่ปี", "กี่เดือน", "เท่าไร", "เท่าไหร่", "ต่ออายุ", "จ่ายยังไง", "ชำระยังไง", "follow up", "how many", "what about")
# Private-use code points of an extraction and the letters that they stand for.
PRIVATE_USE = {0xF702: 0x0E35, 0xF704: 0x0E37, 0xF705: 0x0E48, 0xF706: 0x0E49, 0xF708: 0x0E4B, 0xF70A: 0x0E48, 0xF70B: 0x0E49, 0xF70E: 0x0E4C, 0xF710: 0x0E31, 0xF712: 0x0E47, 0xF714: 0x0E49}
# How an income is written.
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
CURRENCY = r"(?:บาท|thb|฿|usd|ดอลลาร์|\$)"
PERIOD = r"(?:ต่อปี|ต่อเดือน|รายปี|รายเดือน|per\s*year|per\s*month|/year|/month)"
INCOME_LABEL = r"(?:รายได้|เงินเดือน|income)\s*[:=]?\s*"


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether a text contains one of the terms."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found


@F.pandas_udf(StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Canonical decomposition without non-spacing marks; there is no native form of it."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def plain_evidence(text: Column) -> Column:
    """A text without marks, white space and case, as evidence is compared."""
    return F.lower(F.regexp_replace(decomposed(text), r"(?U)\s+", ""))


def query_terms(text: Column) -> Column:
    """Ordered distinct terms: Latin words and numbers of two letters on; Thai runs of four letters on, and their four-grams."""
    runs = F.regexp_extract_all(F.lower(decomposed(text)), F.lit(r"([a-z0-9]+|[฀-๿]+)"), F.lit(1))
    grams = F.flatten(F.transform(runs, lambda t: F.when(t.rlike("^[a-z0-9]"), F.when(F.length(t) >= 2, F.array(t)).otherwise(F.array().cast("array<string>"))).when(F.length(t) < 4, F.array().cast("array<string>")).otherwise(F.concat(F.array(t), F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 3, F.lit(1))), lambda i: F.substr(t, i, F.lit(4)))))))
    return F.array_distinct(grams)


def latin_terms(text: Column) -> Column:
    """Ordered distinct Latin words and numbers of at least two letters of a text in lower case; native throughout."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), F.lit(1)))


def compact_chat(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)[\s!?.,;:]+", "")


def direct_intent(text: Column) -> Column:
    """Turns that need no search: hand-off, greeting, thanks, farewell and help; null for others."""
    said = compact_chat(text)
    return (
        F.when(said == "", None).when(has_any(said, HANDOFF), "human_handoff").when(said.isin(*GREETINGS), "greeting")
        .when(said.startswith("ขอบคุณ") | said.isin(*THANKS), "thanks").when(said.isin(*FAREWELLS), "goodbye").when(said.isin(*HELP), "help")
    )


def shows_interest(text: Column) -> Column:
    """Interest that is said outright: refusals and questions about it are none."""
    low = F.lower(text)
    return has_any(low, INTEREST) & ~has_any(low, NO_INTEREST) & ~has_any(low, INTEREST_ASKED)


def is_follow_up(text: Column) -> Column:
    return has_any(F.lower(text), FOLLOW_UP)


def route(text: Column, collecting: Column, has_history: Column, refresh: Column) -> Column:
    """The intent of a turn: direct, lead, running lead, out of scope, refresh, question, in this order; none for no text."""
    text = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(text)
    asks = F.contains(text, F.lit("?")) | has_any(low, PRODUCT_ASKED)
    related = has_any(low, PRODUCT_TERMS) | (has_history & is_follow_up(text))
    return (
        F.when(direct_intent(text).isNotNull(), direct_intent(text)).when(shows_interest(text) & ~asks, "lead").when(collecting & ~asks, "lead")
        .when(~related, F.when(text == "", "unsupported").otherwise("out_of_scope")).when(refresh, "lead").otherwise("question")
    )


def redacted(text: Column) -> Column:
    """Phone numbers and incomes masked, in digits of any script."""
    # How phone numbers and incomes are written.
    text = F.regexp_replace(text, r"(?U)(?:\+66|0066|0)\d[\d\s().-]{7,13}", "[redacted-phone]")
    return F.regexp_replace(text, r"(?iuU)(รายได้|income|เงินเดือน)\s*[:=]?\s*\d[\d,]*(?:\.\d+)?\s*(?:บาท|THB|USD|ดอลลาร์)?", "$1 [redacted-income]")


def secrets_masked(text: Column) -> Column:
    """Connection addresses and passwords masked."""
    text = F.regexp_replace(text, r"[a-z][a-z0-9+]*://[^\s@/]+@[^\s]+", "[redacted-url]")
    return F.regexp_replace(text, r"(?i)(password\s*[:=]\s*)[^\s]+", "$1[redacted]")


def national_phone(text: Column) -> Column:
    """A national number of nine or ten digits from 0; null where a text is none."""
    digits = F.regexp_replace(text, r"(?U)[\s().-]", "")
    digits = F.regexp_replace(F.regexp_replace(digits, r"^\+66", "0"), "^0066", "0")
    return F.when(digits.rlike(r"(?U)\A0\d{8,9}\z"), digits)


def masked_phone(phone: Column) -> Column:
    return F.concat(F.left(phone, F.lit(3)), F.lit("*****"), F.right(phone, F.lit(2)))


def repaired(text: Column) -> Column:
    """Private-use code points of an extraction as letters."""
    return F.translate(text, "".join(map(chr, PRIVATE_USE)), "".join(map(chr, PRIVATE_USE.values())))


def text_quality(text: Column) -> Column:
    return F.when(text.rlike("[\\uE000-\\uF8FF]"), "unverified_private_use").otherwise("verified")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def pdf_date(text: Column) -> Column:
    """The day of a date such as D:20240131120000."""
    return F.try_to_timestamp(F.regexp_extract(text, r"^D:(\d{8})", 1), F.lit("yyyyMMdd")).cast("date")


def occurrences(text: Column, term: Column) -> Column:
    """Times that a term stands in a text without overlap; the empty term stands nowhere."""
    return F.when(F.length(term) == 0, F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long"))


def pseudonym(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def income(text: Column) -> Column:
    """struct(income, income_min, income_max, income_currency, income_period): a range has no single income; units alone clear it."""
    wide = rf"(?iu){INCOME_LABEL}({CURRENCY})?\s*({NUMBER})\s*(?:-|–|—|ถึง|to)\s*({NUMBER})\s*({CURRENCY})?\s*({PERIOD})?"
    one = rf"(?iu){INCOME_LABEL}({CURRENCY})?\s*({NUMBER})\s*({CURRENCY})?\s*({PERIOD})?"
    units = rf"(?iu)({CURRENCY})|({PERIOD})"

    def part(pattern: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))

    def money(pattern: str, k: int) -> Column:
        return F.replace(part(pattern, k), F.lit(",")).try_cast("decimal(14,2)")

    def currency(value: Column) -> Column:
        low = F.lower(value)
        return F.when(low.isin("บาท", "thb", "฿"), "THB").when(low.isin("usd", "ดอลลาร์", "$"), "USD")

    def period(value: Column, of: Column) -> Column:
        low = F.lower(value)
        kind = F.when(low.rlike("ปี|year"), "annual").when(low.rlike("เดือน|month"), "monthly")
        return F.concat(kind, F.lit("_"), F.lower(of))

    none = F.lit(None)
    range_money, single_money = currency(F.coalesce(part(wide, 1), part(wide, 4))), currency(F.coalesce(part(one, 1), part(one, 3)))
    unit = currency(part(units, 1))
    unit_period = F.when(F.lower(part(units, 2)).rlike("ปี|year"), "annual_pending").when(F.lower(part(units, 2)).rlike("เดือน|month"), "monthly_pending")

    def fields(value, low, high, money_, period_) -> Column:
        return F.struct(value.cast("decimal(14,2)").alias("income"), low.cast("decimal(14,2)").alias("income_min"), high.cast("decimal(14,2)").alias("income_max"), money_.cast("string").alias("income_currency"), period_.cast("string").alias("income_period"))

    return F.when(text.rlike(wide), fields(none, money(wide, 2), money(wide, 3), range_money, period(part(wide, 5), range_money))).when(text.rlike(one), fields(money(one, 2), none, none, single_money, period(part(one, 4), single_money))).otherwise(fields(none, none, none, unit, unit_period))


def missing_fields(fields: list[str]) -> Column:
    """Names of null columns in order."""
    return F.filter(F.array(*[F.when(F.col(f).isNull(), f) for f in fields]), lambda x: x.isNotNull())


def is_safe_question(text: Column) -> Column:
    """A suggestion of at most 140 letters without contact data or terms of lead collection."""
    low = F.lower(text)
    # Terms of lead collection
    lead = has_any(low, ("ชื่อ", "อาชีพ", "รายได้", "เบอร์", "โทรศัพท์", "phone", "income"))
    return (F.length(F.trim(text)) > 0) & (F.length(text) <= 140) & ~lead & ~has_any(low, INTEREST) & ~text.rlike(r"\d{7,}|[\w.+-]+@[\w.-]+")


def canonical_json(columns: dict[str, Column]) -> Column:
    """Columns as one JSON object with sorted names, ``, `` between members and ``: `` behind names; nulls are null.

    Texts are escaped as JSON asks and not beyond (letters of all scripts stay), decimals keep their digits.
    """

    def member(value: Column) -> Column:
        one = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        return F.substr(one, F.lit(6), F.length(one) - 6)  # what stands behind {"v":

    parts = [F.concat(F.lit(f'"{name}": '), member(value)) for name, value in sorted(columns.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
