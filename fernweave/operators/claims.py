"""Whether the evidence that an answer cites bears what the answer says: figures by position, denials, and words in common.

Figures are rows with the letters around them, on both sides; the sides meet by answer and number, after each has been reduced to
what differs (unit and subject), so that an answer that repeats one number a thousand times is a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.functions.text import has_any, plain_evidence, query_terms
from fernweave.operators.answers import citation_errors

# How a figure and a range of figures are said.
NUMBER = r"\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?"
UNITS = r"ปี|เดือน|บาท|%|เปอร์เซ็นต์"
FIGURE = rf"(?U)(?<![\d,])({NUMBER})(?![\d,])\s*({UNITS})?"
RANGE = rf"(?U)(?<![\d,])({NUMBER})\s*[-–—]\s*({NUMBER})\s*({UNITS})"
COVER = r"(?U)(?<!ไม่)(?:คุ้มครอง|รับประกัน)\s*[฀-๿ A-Za-z0-9]{2,24}"
NOT, PLAN, MONEY = "ไม่", "แผน", "บาท"
# Words that tell what a figure is about; payment goes before coverage.
PAYMENT = ("ชำระ", "จ่ายเบี้ย", "เบี้ย", "รายเดือน", "รายปี", "ราคา", "ค่าใช้จ่าย")
COVERAGE = ("คุ้มครอง", "ความคุ้มครอง", "รับประกัน")
# Labels of a table whose figures stand apart from them.
PAYMENT_LABELS = ("ชำระ", "ชําระ", "จ่ายเบี้ย", "เบี้ย", "รายเดือน", "รายปี", "payment", "premium")
MONEY_LABELS = ("เบี้ย", "ชำระ", "รายเดือน", "รายปี", "payment", "premium")
COVERAGE_LABELS = ("คุ้มครอง", "ความคุ้มครอง", "รับประกัน", "coverage")
# Letters before a figure of an answer and of evidence that tell its subject, and around one where a range is looked for.
BEFORE_CLAIM, BEFORE_EVIDENCE, RANGE_BEFORE, RANGE_AFTER = 28, 32, 24, 32
_AROUND = 32


def subject(letters: Column) -> Column:
    low = F.lower(letters)
    return F.when(has_any(low, PAYMENT), "payment").when(has_any(low, COVERAGE), "coverage").otherwise("general")


def figures(texts: DataFrame) -> DataFrame:
    """(answer_id, k, number, unit, said, before, after) of the figures in texts (answer_id, text), each id once.

    before, after: up to 32 letters. A text is split at its figures, and the letters around one are gathered from the pieces beside it: a
    figure has a letter at least, so 33 pieces hold them all. All of that is done within the row. unit is empty where none follows;
    number has no commas.
    """
    said = F.regexp_extract_all("text", F.lit(FIGURE), F.lit(0)).alias("said")
    split = texts.where("text is not null").select("answer_id", said, F.split("text", FIGURE, -1).alias("gap")).where(F.size("said") > 0)
    pieces = F.transform(F.arrays_zip("gap", "said"), lambda p: F.struct(F.concat(F.right(p["gap"], F.lit(_AROUND)), F.coalesce(p["said"], F.lit(""))).alias("earlier"), F.concat(F.left(p["gap"], F.lit(_AROUND)), F.coalesce(p["said"], F.lit(""))).alias("later")))
    own = split.select("answer_id", "said", "gap", pieces.alias("pieces"))

    def letters(start: Column, n: Column, side: str) -> Column:
        return F.array_join(F.transform(F.slice("pieces", start, n), lambda p: p[side]), "")

    def figure(text: Column, k: Column) -> Column:
        before = F.concat(letters(F.greatest(k - _AROUND + 1, F.lit(1)), F.least(k, F.lit(_AROUND)), "earlier"), F.right(F.get("gap", k), F.lit(_AROUND)))
        after = letters(k + 2, F.lit(_AROUND + 1), "later")
        return F.struct(k.alias("k"), text.alias("said"), F.right(before, F.lit(_AROUND)).alias("before"), F.left(after, F.lit(_AROUND)).alias("after"))

    around = own.select("answer_id", F.explode(F.transform("said", figure)).alias("f")).select("answer_id", "f.*")
    number, unit = F.regexp_extract("said", FIGURE, 1), F.regexp_extract("said", FIGURE, 2)
    return around.select("answer_id", "k", F.replace(number, F.lit(",")).alias("number"), unit.alias("unit"), number.alias("written"), "said", "before", "after")


def _claims(answers: DataFrame) -> DataFrame:
    """The figures of answers with their subject and the range that they are an end of, if any."""
    near = F.concat(F.right("before", F.lit(BEFORE_CLAIM)), "said")
    about = F.when((F.col("unit") == "") & F.contains(near, F.lit(PLAN)), "general").otherwise(subject(near))
    window = F.concat(F.right("before", F.lit(RANGE_BEFORE)), "said", F.left("after", F.lit(RANGE_AFTER)))
    low, high, unit = (F.regexp_extract(window, RANGE, k) for k in (1, 2, 3))

    def digits(n: Column) -> Column:
        return F.replace(F.replace(n, F.lit(",")), F.lit("."), F.lit(r"\."))

    wide = F.when((low != "") & ((F.col("written") == low) | (F.col("written") == high)), F.concat(F.lit(r"(?<!\d)"), digits(low), F.lit("[-–—]"), digits(high), unit))
    return figures(answers).select("answer_id", "k", "number", "unit", "written", about.alias("about"), wide.alias("wide"))


def evidence_of(cited: DataFrame) -> DataFrame:
    """(answer_id, text): the chunks cited for an answer, in the order of their ids, as one text; cited: (answer_id, chunk_id, text)."""
    chunks = F.array_sort(F.collect_list(F.struct("chunk_id", F.coalesce("text", F.lit("")).alias("text"))))
    return cited.groupBy("answer_id").agg(F.array_join(F.transform(chunks, lambda c: c["text"]), " ").alias("text"))


def unsupported_figures(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, k, claim): figures of answers that their evidence does not have with the same unit about the same subject.

    An end of a range stands if the whole range is in the evidence. An amount about payment stands if it is there at all and a label of
    payment is; another figure with a unit stands by a label of its subject, unless it is told to be about something else.
    """
    claims = _claims(answers).repartition("answer_id")  # worked out once, used three times
    about_it = figures(evidence).select("answer_id", "number", F.col("unit").alias("unit_e"), subject(F.right("before", F.lit(BEFORE_EVIDENCE))).alias("near")).distinct()
    low = F.lower("text")
    labels = evidence.select("answer_id", F.regexp_replace("text", r"(?U)\s+", "").alias("squeezed"), has_any(low, MONEY_LABELS).alias("money"), has_any(low, PAYMENT_LABELS).alias("payment"), has_any(low, COVERAGE_LABELS).alias("coverage"))
    ranges = claims.where("wide is not null").select("answer_id", "wide").distinct().join(labels.select("answer_id", "squeezed"), "answer_id")
    whole = ranges.where(F.regexp_like("squeezed", F.col("wide"))).select("answer_id", "wide", F.lit(True).alias("in_range"))
    said = ["answer_id", "number", "unit", "about"]
    fits = F.col("near").isNotNull() & ((F.col("unit") == "") | (F.col("unit_e") == F.col("unit")))
    same_unit = (F.col("unit") != "") & (F.col("unit_e") == F.col("unit"))
    told = claims.select(*said).distinct().join(about_it, ["answer_id", "number"], "left").groupBy(*said).agg(
        F.bool_or(fits & ((F.col("about") == "general") | (F.col("near") == F.col("about")))).alias("direct"), F.bool_or(F.col("near").isNotNull()).alias("there"),
        F.bool_or(same_unit).alias("with_unit"), F.bool_or(same_unit & (F.col("near") != "general") & (F.col("near") != F.col("about"))).alias("elsewhere"),
    )
    labelled = F.when(F.col("about") == "payment", F.col("payment")).when(F.col("about") == "coverage", F.col("coverage")).otherwise(False)
    by_table = F.when(F.col("unit") == MONEY, (F.col("about") == "payment") & F.col("there") & F.col("money")).otherwise(F.col("with_unit") & ~F.col("elsewhere") & labelled)
    stands = F.coalesce(F.col("direct"), F.lit(False)) | F.coalesce(by_table, F.lit(False)) | F.coalesce("in_range", F.lit(False))
    judged = claims.join(told, said).join(whole, ["answer_id", "wide"], "left").join(labels.drop("squeezed"), "answer_id", "left")
    return judged.where(~stands).select("answer_id", "k", F.concat("written", "unit").alias("claim"))


def denied_covers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, claim): the first cover that an answer promises and its evidence denies in the same words."""
    squeeze = lambda text: F.lower(F.regexp_replace(text, r"(?U)\s+", ""))
    promised = answers.select("answer_id", F.transform(F.regexp_extract_all("text", F.lit(COVER), F.lit(0)), squeeze).alias("covers")).where(F.size("covers") > 0)
    met = promised.join(evidence.select("answer_id", squeeze(F.col("text")).alias("evidence")), "answer_id")
    denied = F.filter("covers", lambda c: F.contains(F.col("evidence"), F.concat(F.lit(NOT), c)))
    return met.select("answer_id", F.get(denied, F.lit(0)).alias("claim")).where("claim is not null")


def without_common_terms(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id): answers with terms of which their evidence has none."""
    asked = answers.select("answer_id", query_terms(F.coalesce("text", F.lit(""))).alias("terms")).where(F.size("terms") > 0)
    met = asked.join(evidence.select("answer_id", plain_evidence(F.coalesce("text", F.lit(""))).alias("evidence")), "answer_id", "left")
    return met.where(~F.coalesce(F.exists("terms", lambda t: F.contains(F.col("evidence"), t)), F.lit(False))).select("answer_id")


def claim_errors(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """(answer_id, claim): the first figure of an answer (answer_id, text) that its cited chunks do not bear, or a cover that they deny."""
    evidence = evidence_of(cited)
    found = unsupported_figures(answers, evidence).unionByName(denied_covers(answers, evidence).withColumn("k", F.lit(1 << 30)))
    return found.groupBy("answer_id").agg(F.min_by("claim", "k").alias("claim"))


def answer_faults(answers: DataFrame, citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(answer_id, fault, claim): why an answer is not to be shown: its citations, its figures, a denied cover, or nothing in common.

    answers: (answer_id, text); citations: (answer_id, doc_id, page_number, chunk_id, source_url); chunks: those retrieved, with the
    same columns and text. The first fault in this order counts; answers without one are not told. Evidence is the text of the
    retrieved chunks whose ids are cited; null texts are empty.
    """
    evidence = evidence_of(chunks.join(citations.select("answer_id", "chunk_id").distinct(), ["answer_id", "chunk_id"], "left_semi"))
    none = F.lit(None).cast("string")
    faults = citation_errors(answers, citations, chunks).select("answer_id", F.lit(0).alias("order"), F.lit(0).alias("k"), F.col("error").alias("fault"), none.alias("claim"))
    faults = faults.unionByName(unsupported_figures(answers, evidence).select("answer_id", F.lit(1).alias("order"), "k", F.lit("figure").alias("fault"), "claim"))
    faults = faults.unionByName(denied_covers(answers, evidence).select("answer_id", F.lit(2).alias("order"), F.lit(0).alias("k"), F.lit("denied").alias("fault"), "claim"))
    faults = faults.unionByName(without_common_terms(answers, evidence).select("answer_id", F.lit(3).alias("order"), F.lit(0).alias("k"), F.lit("nothing in common").alias("fault"), none.alias("claim")))
    first = faults.groupBy("answer_id").agg(F.min_by(F.struct("fault", "claim"), F.struct("order", "k")).alias("f"))
    return first.select("answer_id", "f.fault", "f.claim")
