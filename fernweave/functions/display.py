"""What readers see and choose: local times, replaced codes, quoted evidence, choices from a list, and checked quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernweave.functions.text import is_safe_question

# Codes and what is shown for them, in the order of replacement.
SHOWN = {"monthly_thb": "เดือน", "annual_thb": "ปี", "THB": "บาท"}
# Words before a number that choose from a list, and words that choose by themselves.
CHOOSE = "(?:ข้อ|ตัวเลือก|รายการ|อัน)?"
ORDINALS = {"อันแรก": 1, "ข้อแรก": 1, "รายการแรก": 1, "อันที่สอง": 2, "ข้อที่สอง": 2, "รายการที่สอง": 2, "อันสอง": 2, "ข้อสอง": 2}
# What stands around quoted evidence, and the letters that listed evidence takes at most.
QUOTE_HEAD = "### ข้อความหลักฐานจากเอกสาร\n\n> โหมดออฟไลน์: ข้อความนี้คัดจาก PDF ที่ตรวจแล้ว ไม่ใช่คำตอบที่สร้างโดย LLM\n\n"
QUOTE_TAIL = "\n\n> ข้อความอาจเริ่มหรือต่อเนื่องจากช่วงอื่นของหน้า ให้ใช้ citation เปิดเอกสารต้นฉบับประกอบ"
LIST_HEAD = "### ข้อมูลที่พบในเอกสารผลิตภัณฑ์\n\nรายละเอียดต่อไปนี้คัดจากส่วนที่เกี่ยวข้องมากที่สุดในเอกสาร:\n\n"
LIST_LETTERS = 1400


def local_time(time: Column, zone: str) -> Column:
    """A time in UTC as day, month and minute of a zone; empty where it is null."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(time, zone), "dd MMM HH:mm"), F.lit(""))


def shown(text: Column, names: dict[str, str]) -> Column:
    """A text with codes, and then the ids of ``names``, replaced by what readers know them as."""
    for code, word in {**SHOWN, **names}.items():
        text = F.replace(text, F.lit(code), F.lit(word))
    return text


def choice(text: Column) -> Column:
    """The number from 1 that a whole text chooses by, as a figure or an ordinal; null for other texts."""
    said = F.regexp_replace(F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")
    number = F.regexp_extract(said, rf"(?U)^{CHOOSE}\s*(\d+)$", 1).try_cast("int")
    for word, place in ORDINALS.items():
        number = F.when(said == word, place).otherwise(number)
    return number


def chosen(text: Column, candidates: Column) -> Column:
    """The candidate that a text chooses by its number from 1 or by an ordinal; null if it chooses none that there is."""
    number = choice(text)
    return F.when(number.between(1, F.size(candidates)), F.get(candidates, number - 1))


def quoted_evidence(text: Column, doc_id: Column, page_number: Column) -> Column:
    """A page's text as a quotation in Markdown, a line for each of its lines that is not blank."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    quoted = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("> "), x)), "\n")
    return F.concat(F.lit(QUOTE_HEAD + "**เอกสาร:** `"), doc_id.cast("string"), F.lit("`  \n**หน้า:** "), page_number.cast("string"), F.lit("\n\n"), quoted, F.lit(QUOTE_TAIL))


def listed_evidence(text: Column) -> Column:
    """A page's text as a list in Markdown: items begin at bullets and at numbers, LIST_LETTERS letters in all.

    An item that goes beyond what is left of them is cut at a word and ends with an ellipsis; where nothing is left, items
    are left out.
    """
    one = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ +| +$", "")
    for boundary in (r" *• *", r" +(?=\([1-9]\) )", r" +(?=[1-9]\. +[ก-๙A-Za-z])"):
        one = F.regexp_replace(one, boundary, "\n")
    items = F.filter(F.transform(F.split(one, "\n"), lambda x: F.regexp_replace(x, r"^[ -]+|[ -]+$", "")), lambda x: x != "")

    def add(state: Column, item: Column) -> Column:
        room = F.lit(LIST_LETTERS) - state["used"]
        cut = F.concat(F.regexp_replace(F.regexp_replace(F.substring(item, F.lit(1), room), " [^ ]*$", ""), "[ ,;:]+$", ""), F.lit("…"))
        taken = F.when(F.length(item) > room, cut).otherwise(item)
        more = F.struct((state["used"] + F.length(taken)).alias("used"), F.concat(state["items"], F.array(F.concat(F.lit("- "), taken))).alias("items"))
        return F.when(room > 0, more).otherwise(state)

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("items"))
    return F.concat(F.lit(LIST_HEAD), F.array_join(F.aggregate(items, start, add, lambda s: s["items"]), "\n\n"))


def bears_out(text: Column, evidence: Column, value: Column) -> Column:
    """Whether a quote stands in the text and holds the value, without signs, white space and case."""

    def compact(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, r"(?U)[\s,().-]", ""))

    return F.coalesce((F.trim(evidence) != "") & F.contains(text, evidence) & F.contains(compact(evidence), compact(value)), F.lit(False))


def are_safe_questions(questions: Column, most: int = 4) -> Column:
    """Whether an array of suggestions has 4 (or ``most``, if that is less) to ``most`` of them, all unlike and each safe."""
    number = F.size(questions)
    return number.between(min(4, most), most) & (F.size(F.array_distinct(questions)) == number) & F.forall(questions, lambda q: F.coalesce(is_safe_question(q), F.lit(False)))


def symmetric_difference(a: Column, b: Column) -> Column:
    """Elements of two arrays that only one has, in order."""
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def is_subset(a: Column, b: Column) -> Column:
    """Whether an array has no element that the other lacks."""
    return F.size(F.array_except(a, b)) == 0
