"""Queries of lead collection, staff reads and answer checks over the tables, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.functions import text as T
from fernweave.operators import answers as A
from fernweave.operators import claims as C
from fernweave.operators import conversations as V
from fernweave.operators import leads as L
from fernweave.sources.readers import read_table


def turns(s: SparkSession, d: str) -> DataFrame:
    """What customers say in four turns: name and occupation, income (a range for a third of them), phone, and a last word."""
    own = read_table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    number = F.lpad((F.col("k") % 100_000_000).cast("string"), 8, "1")
    said = F.array(
        F.concat(F.lit("name: Client "), F.col("k").cast("string"), F.lit(" occupation clerk income unknown")),
        F.when(F.col("k") % 3 == 0, "income 15 to 25 THB per month").when(F.col("k") % 7 == 0, "income 1,500.50").otherwise(F.concat(F.lit("Income: "), (F.col("k") * 10).cast("string"), F.lit(" THB per month"))),
        F.concat(F.lit("phone 08"), number),
        F.when(F.col("k") % 5 == 0, "Cancel!").when(F.col("k") % 5 == 1, "well").otherwise("Confirm."),
    )
    product = F.when(F.col("k") % 11 != 0, F.concat(F.lit("p"), (F.col("k") % 4).cast("string")))
    return own.select(F.col("k").alias("owner_id"), product.alias("product_id"), F.posexplode(said).alias("turn", "text")).select("owner_id", "turn", "text", "product_id")


def accounts(s: SparkSession, d: str) -> DataFrame:
    own = read_table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("owner_id"), F.col("c_name").alias("username"), F.lit("customer").alias("account_role"))
    return own.unionByName(read_table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("owner_id"), F.col("s_name").alias("username"), F.lit("staff").alias("account_role")))


def sessions(s: SparkSession, d: str) -> DataFrame:
    """The last order of a customer is their session, and active unless it is filled."""
    own = read_table(s, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderkey").alias("o"))
    return own.select(F.col("o.o_orderkey").alias("session_id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("owner_id"), F.when(F.col("o.o_orderstatus") == "F", "closed").otherwise("active").alias("status"), F.col("o.o_orderdate").alias("last_active_at"))


def messages(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").alias("created_at"))


def cases(s: SparkSession, d: str) -> DataFrame:
    own = read_table(s, d, "orders")
    status = F.when(F.col("o_orderkey") % 3 == 0, "pending").when(F.col("o_orderkey") % 3 == 1, "active").otherwise("closed")
    return own.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderkey").alias("session_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("s"), F.col("o_orderkey") % 5)).alias("assigned_staff_id"))


def questions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    asked = F.element_at(F.array(F.lit("Compare these, please"), F.lit("What about it?"), F.lit(""), F.lit("some plain question"), F.lit("is p 1 good?")), (k % 5 + 1).cast("int"))
    given = F.element_at(F.array(F.lit("sufficient"), F.lit("weak"), F.lit("insufficient"), F.lit("error"), F.lit(None).cast("string")), (k % 7 % 5 + 1).cast("int"))
    own = read_table(s, d, "orders").select(k.alias("query_id"), asked.alias("text"), given.alias("given"), F.when(k % 4 == 0, "p-1").alias("active_product_id"), (k % 2 == 0).alias("supported"))
    found = read_table(s, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("p-"), F.col("l_partkey") % 3).alias("product_id"), F.concat(F.lit("Product "), F.col("l_partkey") % 3).alias("product_name"))
    return own.drop("supported"), found, own.select("query_id", "supported")


def answered(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Answers about what an order holds, and the lines that they cite: every fifth answer says one more than there is."""
    lines = read_table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("last"))
    said = lines.select(F.col("l_orderkey").alias("answer_id"), F.concat(F.lit("ชำระ "), F.col("n") * 10 + F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0), F.lit(" ปี")).alias("text"))
    return said, lines.select(F.col("l_orderkey").alias("answer_id"), F.col("last").cast("string").alias("chunk_id"), F.concat(F.lit("ระยะเวลาชำระเบี้ย "), F.col("n") * 10, F.lit(" ปี")).alias("text"))


def faulty(s: SparkSession, d: str) -> DataFrame:
    """Answers of eight kinds about an order's quantity, whose evidence differs by 0, 1 or 2, and what is wrong with them."""
    own = read_table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.sum("l_quantity").cast("long").alias("q"), F.count(F.lit(1)).alias("n"))
    q, n, p, gap = F.col("q"), F.col("n"), F.col("answer_id") % 3, " " * 40
    kind = (F.col("answer_id") * 5 % 8).cast("int")
    said = F.array(F.concat(F.lit("ชำระเบี้ย "), q, F.lit(" ปี")), F.concat(F.lit("รับอายุ "), n, F.lit(" - "), q + 50, F.lit(" ปี")), F.concat(F.lit("เบี้ย 1,"), F.lpad(q.cast("string"), 3, "0"), F.lit(" บาท")), F.concat(F.lit("คุ้มครอง "), q, F.lit(" ปี")), F.concat(F.lit("ชำระ "), q, F.lit(" ปี")), F.concat(F.lit("คุ้มครองโรค"), p), F.lit("hello"), F.concat(F.lit("ชำระ "), q, F.lit(" ปี")))
    told = F.array(F.concat(F.lit("ระยะเวลาชำระเบี้ย "), q + p, F.lit(" ปี")), F.concat(F.lit("อายุรับ "), n, F.lit(" – "), q + 50 + p, F.lit(" ปี")), F.concat(F.lit("ตาราง premium แผน "), q + 1000 + p), F.concat(F.lit(f"ตาราง คุ้มครอง{gap}ระยะ "), q + p, F.lit(" ปี")), F.concat(F.lit(f"เบี้ย{gap}คุ้มครอง "), q, F.lit(" ปี")), F.lit("ไม่คุ้มครองโรค1"), F.lit("ชำระ"), F.concat(F.lit("ชำระ "), q, F.lit(" ปี")))
    own = own.withColumns({"text": F.get(said, kind), "told": F.get(told, kind), "kind": kind})
    place = [F.lit("d").alias("doc_id"), F.when((F.col("kind") == 0) & (p == 2), 0).otherwise(1).alias("page_number"), F.col("answer_id").cast("string").alias("chunk_id"), F.lit("u").alias("source_url")]
    chunks = own.select("answer_id", *place, F.col("told").alias("text"))
    missed = F.when((F.col("kind") == 3) & (p == 2), "other").otherwise("u")
    return C.answer_faults(own.select("answer_id", "text"), own.where("kind <> 7").select("answer_id", *place[:3], missed.alias("source_url")), chunks)


def follow_ups(s: SparkSession, d: str) -> DataFrame:
    own = read_table(s, d, "conversations")
    asked = own.select("conv_id").distinct().withColumn("text", F.when(F.col("conv_id") % 2 == 0, " What about it? ").otherwise("A new question"))
    return A.standalone(asked, own).select("conv_id", F.sha2("query", 256).alias("query_hash"))


def handed_over(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    intent, kind, status = F.when(k % 2 == 0, "question").otherwise("lead"), F.when(k % 5 == 0, "clarification"), F.when(k % 3 == 0, "insufficient").when(k % 3 == 1, "error").otherwise("sufficient")
    return read_table(s, d, "events").select("event_id", A.needs_staff(F.col("event_type") == "error", intent, (k % 7 % 2).cast("int"), kind, status).alias("needs_staff"))


def draft_rows(s: SparkSession, d: str) -> DataFrame:
    own = L.drafts(turns(s, d))
    return own.select("owner_id", "turn", *L.FIELDS, F.array_join("missing", ",").alias("missing"), "status", F.array_join(L.errors(), "; ").alias("errors"), L.prompt(F.col("missing")).alias("prompt"), L.summary().alias("summary"))


QUERIES = {
    "lead_drafts": draft_rows,
    "candidate_assessment": lambda s, d: A.assessed(*questions(s, d)),
    "lexical_assessment": lambda s, d: A.assessed_lexically(*questions(s, d)),
    "fallback_messages": lambda s, d: A.fallback_messages(A.assessed(*questions(s, d)), questions(s, d)[1]),
    "claim_errors": lambda s, d: C.claim_errors(*answered(s, d)),
    "answer_faults": faulty,
    "standalone_queries": follow_ups,
    "handoffs_needed": handed_over,
    "staff_inbox": lambda s, d: V.staff_inbox(accounts(s, d), sessions(s, d), messages(s, d)),
    "open_handoffs": lambda s, d: V.open_handoffs(cases(s, d), accounts(s, d)),
    "staff_queue": lambda s, d: V.staff_queue(cases(s, d), sessions(s, d), accounts(s, d), messages(s, d), F.lit("s1")),
    "second_searches": lambda s, d: read_table(s, d, "benchmark").select("item_id", F.sha2(A.second_search(F.col("text")), 256).alias("query_hash")),
}

_ACCOUNTS = "accounts AS (SELECT 'c' || c_custkey AS owner_id, c_name AS username, 'customer' AS account_role FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'staff' FROM supplier)"
_SESSIONS = "sessions AS (SELECT o_orderkey AS session_id, 'c' || o_custkey AS owner_id, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'active' END AS status, o_orderdate AS last_active_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)"
_TOLD = "told AS (SELECT l_orderkey AS session_id, count(*) AS message_count, max(l_shipdate) AS last_message_at FROM lineitem GROUP BY 1)"
_CASES = "cases AS (SELECT o_orderkey AS case_id, o_orderkey AS session_id, CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'active' ELSE 'closed' END AS status, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 1 THEN 's' || (o_orderkey % 5) END AS assigned_staff_id FROM orders)"
_QUESTIONS = """q AS (SELECT o_orderkey AS query_id, ['Compare these, please', 'What about it?', '', 'some plain question', 'is p 1 good?'][o_orderkey % 5 + 1] AS asked,
  ['sufficient', 'weak', 'insufficient', 'error', NULL][o_orderkey % 7 % 5 + 1] AS given, CASE WHEN o_orderkey % 4 = 0 THEN 'p-1' END AS active, o_orderkey % 2 = 0 AS supported FROM orders),
t AS (SELECT l_orderkey AS query_id, count(DISTINCT l_partkey % 3) AS products, max(l_partkey % 3) AS product, bool_or(l_partkey % 3 = 1) AS has_one FROM lineitem GROUP BY 1),
j AS (SELECT q.*, t.products, t.product, asked LIKE '%p 1%' AND has_one AS named, contains(lower(asked), 'compare') AS compares, contains(lower(asked), 'what about') AS carries FROM q LEFT JOIN t USING (query_id)),
a AS (SELECT *, CASE WHEN products IS NULL THEN 'insufficient' WHEN given IN ('error', 'insufficient') THEN given
  WHEN given = 'sufficient' AND asked <> '' AND NOT supported AND NOT (carries AND active IS NOT NULL AND products = 1 AND product = 1) THEN 'weak'
  WHEN products > 1 AND active IS NULL THEN CASE WHEN (named OR compares) AND given = 'sufficient' AND asked <> '' AND supported THEN 'sufficient' ELSE 'ambiguous' END
  ELSE coalesce(given, 'weak') END AS status FROM j)"""
_LEADS = f"""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 <> 0 THEN 'p' || (c_custkey % 4) END AS product_id, '08' || lpad(CAST(c_custkey % 100000000 AS VARCHAR), 8, '1') AS phone FROM customer),
r AS (SELECT k AS owner_id, CAST(t AS INTEGER) AS turn, 'Client ' || k AS name, 'clerk' AS occupation,
  CASE WHEN t >= 1 AND k % 3 <> 0 THEN CASE WHEN k % 7 = 0 THEN CAST(1500.50 AS DECIMAL(14,2)) ELSE CAST(k * 10 AS DECIMAL(14,2)) END END AS income,
  CASE WHEN t >= 1 AND k % 3 = 0 THEN CAST(15 AS DECIMAL(14,2)) END AS income_min, CASE WHEN t >= 1 AND k % 3 = 0 THEN CAST(25 AS DECIMAL(14,2)) END AS income_max,
  CASE WHEN t >= 1 AND (k % 3 = 0 OR k % 7 <> 0) THEN 'THB' END AS income_currency, CASE WHEN t >= 1 AND (k % 3 = 0 OR k % 7 <> 0) THEN 'monthly_thb' END AS income_period,
  CASE WHEN t >= 2 THEN phone END AS phone, product_id, k FROM c, range(4) x(t)),
m AS (SELECT *, list_filter([CASE WHEN income IS NULL THEN CASE WHEN income_min IS NOT NULL THEN 'income_confirmation' ELSE 'income' END END, CASE WHEN income_currency IS NULL THEN 'income_currency' END, CASE WHEN income_period IS NULL THEN 'income_period' END,
  CASE WHEN phone IS NULL THEN 'phone' END, CASE WHEN product_id IS NULL THEN 'product_id' END], lambda x: x IS NOT NULL) AS lacks FROM r),
s AS (SELECT *, CASE WHEN turn < 3 OR k % 5 = 1 THEN 'unconfirmed' WHEN k % 5 = 0 THEN 'cancelled' WHEN len(lacks) = 0 THEN 'confirmed' ELSE 'unconfirmed' END AS status FROM m)
SELECT owner_id, turn, name, occupation, income, income_min, income_max, income_currency, income_period, phone, product_id, array_to_string(lacks, ',') AS missing, status,
  array_to_string(list_filter([CASE WHEN status <> 'confirmed' THEN 'lead confirmation is required before save' END, CASE WHEN income IS NULL THEN CASE WHEN income_min IS NOT NULL THEN 'income range requires confirmation' ELSE 'income is required' END END,
    CASE WHEN income_currency IS NULL THEN 'income currency must be confirmed as THB' END, CASE WHEN income_period IS NULL THEN 'income must be confirmed as monthly_thb' END, CASE WHEN phone IS NULL THEN 'phone is required' END, CASE WHEN product_id IS NULL THEN 'product_id is required' END], lambda x: x IS NOT NULL), '; ') AS errors,
  array_to_string(list_transform(list_filter(lacks, lambda x: NOT (list_contains(lacks, 'income') AND x IN ('income_currency', 'income_period'))), lambda x: CASE x {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.LABELS.items())} END), ', ') AS prompt,
  array_to_string(list_filter(['ชื่อ: ' || name, 'อาชีพ: ' || occupation, CASE WHEN income_min IS NOT NULL THEN 'รายได้: 15.00–25.00 THB / monthly_thb' WHEN income IS NOT NULL THEN 'รายได้: ' || CAST(income AS VARCHAR) || CASE WHEN income_currency IS NOT NULL THEN ' THB / monthly_thb' ELSE '' END END, 'เบอร์: ' || phone, 'ผลิตภัณฑ์: ' || product_id], lambda x: x IS NOT NULL), ' | ') AS summary
FROM s"""

ORACLE_SQL = {
    "lead_drafts": _LEADS,
    "candidate_assessment": f"WITH {_QUESTIONS} SELECT query_id, status FROM a",
    "lexical_assessment": f"WITH {_QUESTIONS} SELECT query_id, CASE WHEN products > 0 AND (supported OR (carries AND products = 1)) THEN 'sufficient' ELSE 'insufficient' END AS status FROM j",
    "fallback_messages": f"WITH {_QUESTIONS}, n AS (SELECT l_orderkey AS query_id, string_agg(DISTINCT '- Product ' || (l_partkey % 3), chr(10) ORDER BY '- Product ' || (l_partkey % 3)) AS names FROM lineitem GROUP BY 1) SELECT query_id, CASE WHEN status = 'error' THEN '{A.SEARCH_FAILED}' WHEN status = 'ambiguous' THEN coalesce('{A.CHOOSE_BEFORE}' || names || '{A.CHOOSE_AFTER}', '{A.AMBIGUOUS}') ELSE '{A.NO_ANSWER}' END AS message FROM a LEFT JOIN n USING (query_id)",
    "claim_errors": "SELECT l_orderkey AS answer_id, (count(*) * 10 + 1) || 'ปี' AS claim FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY 1",
    "answer_faults": """WITH a AS (SELECT l_orderkey AS answer_id, CAST(sum(l_quantity) AS BIGINT) AS q, l_orderkey % 3 AS p, l_orderkey * 5 % 8 AS kind FROM lineitem GROUP BY l_orderkey),
f AS (SELECT *, CASE WHEN kind = 7 THEN 'no citations' WHEN kind = 3 AND p = 2 THEN 'not retrieved' WHEN kind = 0 AND p = 2 THEN 'page below one' WHEN kind IN (0, 1, 2, 3) AND p > 0 OR kind = 4 OR kind = 5 AND p <> 1 THEN 'figure' WHEN kind = 5 THEN 'denied' WHEN kind = 6 THEN 'nothing in common' END AS fault FROM a)
SELECT answer_id, fault, CASE fault WHEN 'figure' THEN CASE kind WHEN 1 THEN (q + 50) || 'ปี' WHEN 2 THEN '1,' || lpad(CAST(q AS VARCHAR), 3, '0') || 'บาท' WHEN 5 THEN CAST(p AS VARCHAR) ELSE q || 'ปี' END WHEN 'denied' THEN 'คุ้มครองโรค1' END AS claim FROM f WHERE fault IS NOT NULL""",
    "handoffs_needed": "SELECT event_id, event_type = 'error' OR (event_id % 2 = 0 AND event_id % 7 % 2 = 0 AND event_id % 5 <> 0 AND event_id % 3 <> 2) AS needs_staff FROM events",
    "staff_inbox": f"WITH {_ACCOUNTS}, {_SESSIONS}, {_TOLD} SELECT a.owner_id, username, s.session_id, last_active_at, coalesce(message_count, 0) AS message_count, last_message_at FROM accounts a LEFT JOIN sessions s ON s.owner_id = a.owner_id AND s.status = 'active' LEFT JOIN told t ON t.session_id = s.session_id WHERE account_role = 'customer'",
    "open_handoffs": f"WITH {_ACCOUNTS}, {_CASES} SELECT cases.*, username AS assigned_staff_name FROM cases LEFT JOIN accounts ON owner_id = assigned_staff_id WHERE status IN ('pending', 'active')",
    "staff_queue": f"WITH {_ACCOUNTS}, {_SESSIONS}, {_TOLD}, {_CASES} SELECT case_id, h.session_id, h.status, created_at, assigned_staff_id, s.owner_id AS customer_id, c.username AS customer_name, n.username AS assigned_staff_name, coalesce(message_count, 0) AS message_count, last_message_at FROM cases h JOIN sessions s ON s.session_id = h.session_id AND s.status = 'active' JOIN accounts c ON c.owner_id = s.owner_id AND c.account_role = 'customer' LEFT JOIN accounts n ON n.owner_id = assigned_staff_id LEFT JOIN told t ON t.session_id = h.session_id WHERE h.status = 'pending' OR (h.status = 'active' AND assigned_staff_id = 's1')",
    "second_searches": f"SELECT item_id, sha256(CASE WHEN contains(text, '{A.SUFFIX}') THEN text ELSE trim(text) || ' {A.SUFFIX}' END) AS query_hash FROM benchmark",
}
