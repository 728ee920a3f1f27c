"""Queries of the campaign metrics and profiles over orders and customers, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.operators import campaign as C
from fernweave.sources.readers import read_table

#: The campaign table in SQL: a record for each order, with missing values and labels out of range.
BASE = """
campaign AS (
  SELECT o_orderkey AS record_id,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 9 WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS label,
    CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS segment,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'Smarch'
         ELSE substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(o_orderdate) - 2 AS INTEGER), 3) END AS month_name,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal END AS income,
    CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE 18 + (o_custkey % 60) + CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0 END END AS age,
    o_orderpriority AS priority,
    o_totalprice AS inflow, round(o_totalprice / 2, 2) AS outflow,
    CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE round(o_totalprice - round(o_totalprice / 2, 2), 2) + CASE WHEN o_orderkey % 43 = 0 THEN 1 ELSE 0 END END AS net_flow
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
RATE = "count(*) AS records, {v} AS valid, {a} AS accepted, CASE WHEN {v} > 0 THEN CAST({a} AS DOUBLE) / {v} END AS rate".format(v="count(CASE WHEN label IN (0, 1, 2) THEN 1 END)", a="count(CASE WHEN label IN (1, 2) THEN 1 END)")
PRODUCTS = ", ".join(f"count(CASE WHEN label = {k} THEN 1 END) AS {n}" for k, n in enumerate(("rejected", "first_product", "second_product")))
SHARES = ", ".join(f"CASE WHEN count(CASE WHEN label IN (1, 2) THEN 1 END) > 0 THEN CAST(count(CASE WHEN label = {k} THEN 1 END) AS DOUBLE) / count(CASE WHEN label IN (1, 2) THEN 1 END) END AS {n}" for k, n in ((1, "first_share"), (2, "second_share")))
FIELDS = ["label", "segment", "month_name", "income", "age", "net_flow"]
DIMENSIONS = ["segment", "month_name", "priority"]
NUMBERS = ["income", "age", "inflow"]
MONEY = ["income", "inflow", "outflow", "net_flow"]


def campaign(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = (read_table(spark, folder, n) for n in ("orders", "customer"))
    key = F.col("o_orderkey")
    half = C.rounded(F.col("o_totalprice") / 2, 2)
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("record_id"),
        F.when(key % 13 == 0, None).when(key % 17 == 0, 9).when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("label"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(key % 23 == 0, None).when(key % 29 == 0, "Smarch").otherwise(F.element_at(F.array(*[F.lit(m) for m in C.MONTHS]), F.month("o_orderdate"))).alias("month_name"),
        F.when(key % 19 == 0, None).when(key % 31 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("income"),
        F.when(key % 37 != 0, 18 + F.col("o_custkey") % 60 + F.when(key % 2 == 0, 0.5).otherwise(0.0)).alias("age"),
        F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("inflow"), half.alias("outflow"),
        F.when(key % 41 != 0, C.rounded(F.col("o_totalprice") - half, 2) + F.when(key % 43 == 0, 1).otherwise(0)).alias("net_flow"),
    )


def _told(spark: SparkSession, folder: str) -> DataFrame:
    return campaign(spark, folder).withColumns({"response": C.response_label(F.col("label")), "income_band": C.income_band(F.col("income"), CUTS)})


RESPONSE_SQL = "CASE label WHEN 0 THEN 'Rejected' WHEN 1 THEN 'First product' WHEN 2 THEN 'Second product' ELSE 'Unknown' END"


def _each(fields: list[str], expression: str) -> str:
    """SQL of one SELECT for each field, put together."""
    return " UNION ALL ".join(expression.format(c=c) for c in fields)


AGE_SQL = "CASE WHEN age IS NULL THEN 'Unknown' WHEN age <= 29 THEN '<30' WHEN age <= 39 THEN '30-39' WHEN age <= 49 THEN '40-49' WHEN age <= 59 THEN '50-59' ELSE '60+' END"
INCOME_SQL = "CASE WHEN income IS NULL THEN 'Missing' WHEN income < 0 THEN 'Negative' WHEN income = 0 THEN 'Zero' WHEN income <= 1500 THEN '0-1500' WHEN income <= 3000 THEN '1500-3000' WHEN income <= 5000 THEN '3000-5000' WHEN income <= 9000 THEN '5000-9000' ELSE '>9000' END"
CUTS = (1500.0, 3000.0, 5000.0, 9000.0)

QUERIES = {
    "acceptance_overall": lambda s, d: C.acceptance(campaign(s, d)),
    "acceptance_by_segment": lambda s, d: C.acceptance_by(campaign(s, d), "segment"),
    "acceptance_by_language": lambda s, d: C.acceptance_by(read_table(s, d, "documents").join(read_table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left"), "lang", "quality"),
    "acceptance_by_each": lambda s, d: C.acceptance_by_each(campaign(s, d), DIMENSIONS),
    "campaign_snapshot": lambda s, d: C.snapshot(campaign(s, d)),
    "best_groups": lambda s, d: C.best_group(C.acceptance_by_each(campaign(s, d), DIMENSIONS)),
    "sliced_acceptance": lambda s, d: C.acceptance(C.sliced(campaign(s, d), [1])),
    "age_bands": lambda s, d: campaign(s, d).groupBy(C.known(C.age_band(F.col("age"))).alias("grp")).agg(*C.acceptance_columns(F.col("label"))),
    "income_bands": lambda s, d: campaign(s, d).groupBy(C.income_band(F.col("income"), CUTS).alias("grp")).agg(*C.acceptance_columns(F.col("label"))),
    "months_and_responses": lambda s, d: campaign(s, d).groupBy("month_name", C.month_order(F.col("month_name")).alias("month_order"), C.response_label(F.col("label")).alias("response")).agg(F.count(F.lit(1)).alias("records")),
    "rows_with_missing": lambda s, d: campaign(s, d).agg(F.count_if(C.has_missing(FIELDS)).alias("missing_rows"), F.count(F.lit(1)).alias("records")),
    "missing_counts": lambda s, d: C.missing_counts(campaign(s, d), FIELDS),
    "missing_patterns": lambda s, d: C.missing_patterns(campaign(s, d), FIELDS),
    "column_profile": lambda s, d: C.profile_columns(campaign(s, d), FIELDS),
    "top_values": lambda s, d: C.top_values(campaign(s, d), ["segment", "month_name"]),
    "numeric_profile": lambda s, d: C.numeric_profile(campaign(s, d), NUMBERS),
    "financial_summary": lambda s, d: C.financial_summary(campaign(s, d), MONEY),
    "visual_by_month": lambda s, d: C.visual(campaign(s, d), ["month_name"], {"segment": ["BUILDING", "MACHINERY"]}, [C.month_order(F.col("month_name"))]),
    "visual_by_priority": lambda s, d: C.visual(campaign(s, d), ["priority"], {"month_name": list(C.MONTHS)}),
    "text_profile": lambda s, d: C.text_profile(read_table(s, d, "documents"), ["text", "source"]),
    "duplicate_texts": lambda s, d: C.duplicates(read_table(s, d, "documents"), ["text"]),
    "without_duplicates": lambda s, d: C.snapshot(campaign(s, d).dropDuplicates(["label", "segment", "month_name"])),
    "pair_comparison": lambda s, d: C.pair_comparison(campaign(s, d), "outflow", "net_flow"),
    "flow_mismatches": lambda s, d: C.flow_mismatches(campaign(s, d), "net_flow", "inflow", "outflow"),
    "quality_flags": lambda s, d: C.quality_flags(campaign(s, d), FIELDS, compare=("outflow", "net_flow")),
    "measures_by_month": lambda s, d: C.measures(campaign(s, d), [1], ["month_name"]),
    "visual_by_response": lambda s, d: C.visual(_told(s, d), ["response"], {"segment": ["BUILDING", "FURNITURE"]}, [F.desc("records")]),
    "visual_by_income": lambda s, d: C.visual(_told(s, d), ["income_band"], {"priority": []}),
    "visual_by_segment": lambda s, d: C.visual(campaign(s, d), ["segment"], {"month_name": ["Jan", "Feb", "Mar"], "priority": ["1-URGENT", "2-HIGH"]}),
    "report_cards": lambda s, d: C.cards(campaign(s, d), {"segment": ["BUILDING"], "priority": ["1-URGENT", "5-LOW"], "month_name": ["Jan", "Jun", "Smarch"]}, [0, 1]),
    "report_detail": lambda s, d: C.detail(_told(s, d), ["segment", "priority", "month_name", "response", "income_band"], "age", {"segment": ["BUILDING", "MACHINERY"]}),
    "measures_detail": lambda s, d: campaign(s, d).groupBy("segment", "priority", C.response_label(F.col("label")).alias("response")).agg(F.round(F.avg("age"), 6).alias("mean_age"), F.count(F.lit(1)).alias("records")),
}

_MISSING = "count(*) - count({c})"
ORACLE_SQL = {name: f"WITH {BASE}{sql}" for name, sql in {
    "acceptance_overall": f" SELECT {RATE} FROM campaign",
    "acceptance_by_segment": f" SELECT coalesce(segment, 'Unknown') AS grp, {RATE} FROM campaign GROUP BY 1",
    "acceptance_by_language": f", both_ AS (SELECT lang, quality AS label FROM documents LEFT JOIN labels USING (doc_id)) SELECT coalesce(lang, 'Unknown') AS grp, {RATE} FROM both_ GROUP BY 1",
    "acceptance_by_each": f", each_ AS ({_each(DIMENSIONS, "SELECT '{c}' AS dimension, coalesce({c}, 'Unknown') AS grp, label FROM campaign")}) SELECT dimension, grp, {RATE}, {PRODUCTS}, {SHARES} FROM each_ GROUP BY 1, 2",
    "campaign_snapshot": f" SELECT {RATE}, {PRODUCTS}, {SHARES} FROM campaign",
    "best_groups": f", each_ AS ({_each(DIMENSIONS, "SELECT '{c}' AS dimension, coalesce({c}, 'Unknown') AS grp, label FROM campaign")}), rated AS (SELECT dimension, grp, {RATE} FROM each_ GROUP BY 1, 2) SELECT dimension, grp, rate FROM rated WHERE rate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY rate DESC, grp) = 1",
    "sliced_acceptance": f" SELECT {RATE} FROM campaign WHERE label IN (1)",
    "age_bands": f" SELECT {AGE_SQL} AS grp, {RATE} FROM campaign GROUP BY 1",
    "income_bands": f" SELECT {INCOME_SQL} AS grp, {RATE} FROM campaign GROUP BY 1",
    "months_and_responses": " SELECT month_name, CASE WHEN month_name IS NULL THEN NULL WHEN month_name = 'Smarch' THEN 0 ELSE CAST((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', month_name) + 2) / 3 AS BIGINT) END AS month_order, CASE label WHEN 0 THEN 'Rejected' WHEN 1 THEN 'First product' WHEN 2 THEN 'Second product' ELSE 'Unknown' END AS response, count(*) AS records FROM campaign GROUP BY 1, 2, 3",
    "rows_with_missing": f" SELECT count(CASE WHEN {' OR '.join(f'{c} IS NULL' for c in FIELDS)} THEN 1 END) AS missing_rows, count(*) AS records FROM campaign",
    "missing_counts": f", m AS ({_each(FIELDS, "SELECT '{c}' AS field, " + _MISSING + " AS missing, CAST(" + _MISSING + " AS DOUBLE) / count(*) AS rate FROM campaign")}) SELECT *, CASE WHEN rate > 0.2 THEN 'alert' WHEN rate > 0.05 THEN 'warn' ELSE 'info' END AS severity FROM m",
    "missing_patterns": f" SELECT {' || '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in FIELDS).replace('CASE', 'CAST(CASE').replace('END', 'END AS VARCHAR)')} AS pattern, count(*) AS records FROM campaign GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "column_profile": " " + _each(FIELDS, "SELECT '{c}' AS field, count(*) AS records, count({c}) AS non_null, " + _MISSING + " AS nulls, CAST(" + _MISSING + " AS DOUBLE) / count(*) AS null_rate, count(DISTINCT {c}) AS distinct_values, CAST(count(DISTINCT {c}) AS DOUBLE) / count({c}) AS cardinality FROM campaign"),
    "top_values": f", v AS ({_each(['segment', 'month_name'], "SELECT '{c}' AS field, {c} AS value, count(*) AS records FROM campaign GROUP BY {c}")}) SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY records DESC, value NULLS LAST) AS INTEGER) AS place FROM v QUALIFY place <= 10",
    "numeric_profile": " " + _each(NUMBERS, "SELECT '{c}' AS field, count({c}) AS non_null, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS deviation, " + ", ".join(f"round(quantile_cont(CAST({{c}} AS DOUBLE), {q}), 6) AS q{round(q * 100):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + ", count(CASE WHEN {c} = 0 THEN 1 END) AS zeros, count(CASE WHEN {c} < 0 THEN 1 END) AS negatives FROM campaign"),
    "financial_summary": " " + _each(MONEY, "SELECT '{c}' AS field, count({c}) AS values, " + ", ".join(f"round(quantile_cont(CAST({{c}} AS DOUBLE), {q}), 6) AS {n}" for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))) + ", CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most, count(CASE WHEN {c} = 0 THEN 1 END) AS zeros, count(CASE WHEN {c} < 0 THEN 1 END) AS negatives FROM campaign"),
    "visual_by_month": f" SELECT month_name, {RATE} FROM campaign WHERE segment IN ('BUILDING', 'MACHINERY') GROUP BY 1",
    "visual_by_priority": f" SELECT priority, {RATE} FROM campaign WHERE month_name IN ('Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec') GROUP BY 1",
    "text_profile": " " + _each(["text", "source"], "SELECT '{c}' AS field, count(CASE WHEN trim({c}) = '' THEN 1 END) AS empty, count(CASE WHEN trim({c}) <> {c} THEN 1 END) AS untrimmed, CAST(min(length({c})) AS BIGINT) AS shortest, CAST(max(length({c})) AS BIGINT) AS longest, round(avg(length({c})), 6) AS mean_length FROM documents WHERE {c} IS NOT NULL"),
    "duplicate_texts": ", g AS (SELECT text, count(*) AS n FROM documents GROUP BY 1) SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess, CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS in_groups FROM g",
    "without_duplicates": f", u AS (SELECT DISTINCT label, segment, month_name FROM campaign) SELECT {RATE}, {PRODUCTS}, {SHARES} FROM u",
    "pair_comparison": " SELECT count(CASE WHEN outflow = net_flow THEN 1 END) AS equal_pairs, count(CASE WHEN outflow IS NULL AND net_flow IS NULL THEN 1 END) AS shared_missing, count(*) AS pairs, count(CASE WHEN outflow <> net_flow THEN 1 END) AS mismatches FROM campaign",
    "flow_mismatches": " SELECT count(net_flow - (inflow - outflow)) AS compared, count(CASE WHEN abs(net_flow - (inflow - outflow)) > 0.01 THEN 1 END) AS mismatches FROM campaign",
    "quality_flags": f", m AS ({_each(FIELDS, "SELECT '{c}' AS field, " + _MISSING + " AS missing, CAST(" + _MISSING + " AS DOUBLE) / count(*) AS rate FROM campaign")}), g AS (SELECT count(*) - 1 AS more FROM campaign GROUP BY {', '.join(FIELDS)}) SELECT 'missing' AS \"check\", field AS subject, missing AS records, CASE WHEN rate > 0.2 THEN 'alert' WHEN rate > 0.05 THEN 'warn' ELSE 'info' END AS severity FROM m WHERE missing > 0 UNION ALL SELECT 'invalid label', 'label', count(*), 'alert' FROM campaign WHERE label IS NULL OR label NOT IN (0, 1, 2) HAVING count(*) > 0 UNION ALL SELECT 'copies', '*', CAST(sum(more) AS BIGINT), 'warn' FROM g HAVING sum(more) > 0 UNION ALL SELECT 'pair differs', 'outflow/net_flow', count(*), 'info' FROM campaign WHERE outflow <> net_flow HAVING count(*) > 0",
    "measures_by_month": f" SELECT month_name, count(CASE WHEN label IN (1) THEN 1 END) AS visible, {RATE.split(', ', 1)[1]} FROM campaign GROUP BY 1 HAVING count(CASE WHEN label IN (1) THEN 1 END) > 0",
    "visual_by_response": f" SELECT {RESPONSE_SQL} AS response, {RATE} FROM campaign WHERE segment IN ('BUILDING', 'FURNITURE') GROUP BY 1",
    "visual_by_income": f" SELECT {INCOME_SQL} AS income_band, {RATE} FROM campaign GROUP BY 1",
    "visual_by_segment": f" SELECT segment, {RATE} FROM campaign WHERE month_name IN ('Jan', 'Feb', 'Mar') AND priority IN ('1-URGENT', '2-HIGH') GROUP BY 1",
    "report_cards": f" SELECT records AS total, visible, accepted, rate FROM (SELECT {RATE}, count(CASE WHEN label IN (0, 1) THEN 1 END) AS visible FROM campaign WHERE segment = 'BUILDING' AND priority IN ('1-URGENT', '5-LOW') AND month_name IN ('Jan', 'Jun', 'Smarch'))",
    "report_detail": f" SELECT segment, priority, month_name, {RESPONSE_SQL} AS response, {INCOME_SQL} AS income_band, round(avg(age), 6) AS mean_age, count(*) AS records FROM campaign WHERE segment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2, 3, 4, 5",
    "measures_detail": " SELECT segment, priority, CASE label WHEN 0 THEN 'Rejected' WHEN 1 THEN 'First product' WHEN 2 THEN 'Second product' ELSE 'Unknown' END AS response, round(avg(age), 6) AS mean_age, count(*) AS records FROM campaign GROUP BY 1, 2, 3",
}.items()}
