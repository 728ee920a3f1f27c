"""Queries of logins, leads, texts and evaluations over the tables, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernweave.functions import text as T
from fernweave.operators import conversations as V
from fernweave.operators import retrieval as R
from fernweave.operators import tables as D
from fernweave.sources.readers import read_table

NOW = "2024-01-20 12:00:00"
ALIASES = [("en", "English plan"), ("de", "German plan"), ("fr", "French plan"), ("es", "Spanish plan"), ("en", "world cover"), ("fr", "world cover")]


def logins(s: SparkSession, d: str) -> DataFrame:
    """Every event is a login of half an hour; some last ten days, some are revoked."""
    k, at = F.col("event_id"), F.col("ts").cast("timestamp")
    ends = at + F.when(k % 4 == 0, F.expr("interval 10 days")).otherwise(F.expr("interval 30 minutes"))
    return read_table(s, d, "events").select(F.sha2(k.cast("string"), 256).alias("token_hash"), (F.col("user_id") % 200).alias("owner_id"), ends.alias("expires_at"), F.when(k % 5 == 0, at).alias("revoked_at"))


def accounts(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("username"), F.when(F.col("c_custkey") % 9 == 0, "staff").otherwise("customer").alias("account_role"))


def owned_sessions(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("owner_id"))


def leads(s: SparkSession, d: str) -> DataFrame:
    """A lead for every second customer, last seen at one of three times, one of which cannot be read."""
    k = F.col("c_custkey")
    verified = F.when(k % 6 == 0, F.lit("2023-12-01 00:00:00")).when(k % 6 == 2, F.lit("long ago"))
    return read_table(s, d, "customer").where("c_custkey % 2 = 0").select(k.alias("owner_id"), F.concat(F.lit("p"), k % 3).alias("product_id"), verified.alias("profile_verified_at"), F.when(k % 4 == 0, F.lit("2023-07-20 00:00:00")).alias("updated_at"), F.lit("2023-07-21 13:00:00").alias("created_at"))


def texts(s: SparkSession, d: str) -> DataFrame:
    """What extraction and logs have in them: private-use letters, dates of PDFs, addresses and passwords."""
    k = F.col("o_orderkey")
    faulty = F.when(k % 3 == 0, F.concat(F.lit("a\uf702b\uf70e"), k.cast("string"))).otherwise(F.concat(F.lit("plain "), k.cast("string")))
    date = F.when(k % 5 == 0, "created yesterday").otherwise(F.concat(F.lit("D:"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMdd"), F.lit("120000+07")))
    log = F.when(k % 4 == 0, F.concat(F.lit("open postgresql://u:p@host/"), k.cast("string"), F.lit(" now"))).otherwise(F.concat(F.lit("PassWord: x"), k.cast("string"), F.lit(" end")))
    own = read_table(s, d, "orders").select(k.alias("text_id"), faulty.alias("t"), date.alias("d"), log.alias("l"))
    return own.select("text_id", T.text_quality(F.col("t")).alias("quality"), F.sha2(T.repaired(F.col("t")), 256).alias("repaired_hash"), T.pdf_date(F.col("d")).alias("day"), T.secrets_masked(F.col("l")).alias("log"))


def purposeful(s: SparkSession, d: str) -> DataFrame:
    own = read_table(s, d, "conversations").withColumn("purpose", F.when((F.col("conv_id") + F.col("turn")) % 3 != 0, "product"))
    return V.last_messages(own, 2, "product").select("conv_id", "turn", "place")


def copied(s: SparkSession, d: str) -> DataFrame:
    """Customers of one table put into another that lacks a column and has one more."""
    own = read_table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    target = own.where("c_custkey % 2 = 0").select("c_custkey", F.lit("old").alias("c_name"), F.lit(1).alias("extra"))
    return D.copied(own.where("c_custkey % 3 = 0"), target, ["c_custkey"])


def retried(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("sufficient", "weak", "insufficient", "ambiguous")))
    first = read_table(s, d, "orders").select(k.alias("query_id"), F.get(kinds, (k % 4).cast("int")).alias("status"))
    second = read_table(s, d, "orders").where("o_orderkey % 3 <> 0").select(k.alias("query_id"), F.get(kinds, (k % 5 % 4).cast("int")).alias("status"))
    return R.with_retry(first, second)


def cases(s: SparkSession, d: str) -> DataFrame:
    """An evaluation case for each order: what kind it is of, and the document and pages (its lines' suppliers) that it expects."""
    own = read_table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("doc"), F.sort_array(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_linenumber")))).alias("pages"))
    kind = F.get(F.array(*map(F.lit, ("answerable", "answerable", "ambiguous", "no_answer", "other"))), (F.col("l_orderkey") % 5).cast("int"))
    return own.select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_orderkey") % 3 == 0, "dev").otherwise("held_out").alias("split"), kind.alias("expected_type"), F.when(kind.isin("answerable", "ambiguous"), F.col("doc")).alias("doc_id"), "pages")


def searched(s: SparkSession, d: str) -> DataFrame:
    """Two modes of ranking an order's lines, by price and by quantity; three places each."""
    own = read_table(s, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("page"), "l_extendedprice", "l_quantity")
    place = {mode: F.row_number().over(W.partitionBy("case_id").orderBy(F.desc(by), "page", "doc_id")) for mode, by in (("semantic", "l_extendedprice"), ("hybrid", "l_quantity"))}
    rows = own.select("case_id", "doc_id", "page", *(p.alias(m) for m, p in place.items())).unpivot(["case_id", "doc_id", "page"], list(place), "mode", "place")
    return rows.where("place <= 3").select("mode", "case_id", "place", "doc_id", "page")


def outcomes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    own = read_table(s, d, "orders").select(k.alias("case_id"), F.explode(F.array(F.lit("semantic"), F.lit("hybrid"))).alias("mode"))
    status = F.get(F.array(*map(F.lit, ("sufficient", "sufficient", "ambiguous", "insufficient"))), ((F.col("case_id") + F.length("mode")) % 4).cast("int"))
    return own.select("mode", "case_id", status.alias("status")), own.select("mode", "case_id", (F.col("case_id") % 100 + F.length("mode") / 2).alias("ms"))


def compared(s: SparkSession, d: str) -> DataFrame:
    status, times = outcomes(s, d)
    return R.compared_modes(R.judged_cases(cases(s, d), searched(s, d), status), times)


def inferred(s: SparkSession, d: str) -> DataFrame:
    """How many chunks each benchmark text is searched in: those of the product it names, or all."""
    k = F.col("item_id")
    said = F.get(F.array(*map(F.lit, ("about the English plan", "German plan!", "any plan at all", "world cover", "nothing"))), (k % 5).cast("int"))
    asked = R.with_inferred_product(read_table(s, d, "benchmark").select(k.alias("query_id"), said.alias("text"), F.when(k % 7 == 0, "es").alias("product_id")), s.createDataFrame(ALIASES, "product_id string, alias string"))
    found = read_table(s, d, "documents").where("lang is not null").select((F.col("doc_id") % 40).alias("query_id"), F.col("lang").alias("product_id"), "doc_id")
    return R.of_product(asked, found).groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("doc_id").alias("first"))


def digests(s: SparkSession, d: str) -> DataFrame:
    own = read_table(s, d, "customer")
    columns = {"name": F.concat(F.col("c_name"), F.lit(' "é"')), "key": F.col("c_custkey"), "empty": F.lit(None).cast("string"), "segment": F.col("c_mktsegment")}
    return own.select("c_custkey", F.sha2(T.canonical_json(columns), 256).alias("digest"))


QUERIES = {
    "restored_logins": lambda s, d: V.restored_logins(logins(s, d), accounts(s, d), F.lit(NOW).cast("timestamp")),
    "leads_of_sessions": lambda s, d: V.leads_of_sessions(owned_sessions(s, d), leads(s, d), F.lit(NOW).cast("timestamp")).select("session_id", "owner_id", "product_id", "is_stale"),
    "text_faults": texts,
    "purposeful_messages": purposeful,
    "copied_customers": copied,
    "retried_queries": retried,
    "compared_modes": compared,
    "inferred_products": inferred,
    "content_digests": digests,
}

_COMPARED = """WITH cases AS (SELECT l_orderkey AS case_id, max((l_linenumber, l_partkey))[2] AS doc, l_orderkey % 5 AS kind FROM lineitem GROUP BY l_orderkey),
ranked AS (SELECT l_orderkey AS case_id, l_partkey AS doc_id, l_linenumber AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS b FROM lineitem),
found AS (SELECT 'semantic' AS mode, case_id, doc_id, page, a AS place FROM ranked WHERE a <= 3 UNION ALL SELECT 'hybrid', case_id, doc_id, page, b FROM ranked WHERE b <= 3),
asked AS (SELECT mode, o_orderkey AS case_id, ['sufficient', 'sufficient', 'ambiguous', 'insufficient'][(o_orderkey + length(mode)) % 4 + 1] AS status, o_orderkey % 100 + length(mode) / 2 AS ms FROM orders, (SELECT unnest(['semantic', 'hybrid']) AS mode)),
judged AS (SELECT a.mode, a.case_id, a.ms, a.status, c.kind, CASE WHEN a.case_id % 3 = 0 THEN 'dev' ELSE 'held_out' END AS split,
    c.kind > 2 OR EXISTS (SELECT 1 FROM found f WHERE f.mode = a.mode AND f.case_id = a.case_id AND f.doc_id = c.doc) AS doc_hit,
    (SELECT min(place) FROM found f WHERE f.mode = a.mode AND f.case_id = a.case_id AND f.doc_id = c.doc AND f.page <= 2 AND c.kind <= 2) AS rank FROM asked a JOIN cases c USING (case_id)),
told AS (SELECT *, kind > 2 OR rank IS NOT NULL AS page_hit, CASE WHEN kind <= 1 THEN doc_hit AND rank IS NOT NULL AND status = 'sufficient' WHEN kind = 2 THEN status = 'ambiguous' WHEN kind = 3 THEN status = 'insufficient' ELSE false END AS passed FROM judged)
SELECT mode, split, count(*) AS cases, count(*) FILTER (passed) AS passed, count(*) FILTER (doc_hit) AS doc_hits, count(*) FILTER (page_hit) AS page_hits, round(avg(rank), 6) AS mean_rank, round(avg(ms), 6) AS mean_ms FROM told GROUP BY mode, split"""

ORACLE_SQL = {
    "restored_logins": f"SELECT sha256(CAST(event_id AS VARCHAR)) AS token_hash, user_id % 200 AS owner_id, c_name AS username, CASE WHEN c_custkey % 9 = 0 THEN 'staff' ELSE 'customer' END AS account_role FROM events JOIN customer ON c_custkey = user_id % 200 WHERE event_id % 5 <> 0 AND ts + CASE WHEN event_id % 4 = 0 THEN INTERVAL 10 DAY ELSE INTERVAL 30 MINUTE END > TIMESTAMP '{NOW}'",
    "leads_of_sessions": "SELECT o_orderkey AS session_id, o_custkey AS owner_id, 'p' || (o_custkey % 3) AS product_id, CASE WHEN o_custkey % 6 = 0 THEN false WHEN o_custkey % 4 = 0 THEN true ELSE false END AS is_stale FROM orders WHERE o_custkey % 2 = 0",
    "text_faults": "SELECT o_orderkey AS text_id, CASE WHEN o_orderkey % 3 = 0 THEN 'unverified_private_use' ELSE 'verified' END AS quality, sha256(CASE WHEN o_orderkey % 3 = 0 THEN 'a' || chr(3637) || 'b' || chr(3660) || o_orderkey ELSE 'plain ' || o_orderkey END) AS repaired_hash, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 4 = 0 THEN 'open [redacted-url] now' ELSE 'PassWord: [redacted] end' END AS log FROM orders",
    "purposeful_messages": "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM (SELECT * FROM conversations WHERE (conv_id + turn) % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2)",
    "copied_customers": "SELECT c_custkey, c_name, CAST(NULL AS INTEGER) AS extra FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'old', 1 FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0",
    "retried_queries": "WITH k AS (SELECT ['sufficient', 'weak', 'insufficient', 'ambiguous'] AS kinds) SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 <> 0 THEN kinds[o_orderkey % 5 % 4 + 1] ELSE kinds[o_orderkey % 4 + 1] END AS status FROM orders, k",
    "compared_modes": _COMPARED,
    "inferred_products": "WITH q AS (SELECT item_id AS query_id, CASE WHEN item_id % 7 = 0 THEN 'es' WHEN item_id % 5 = 0 THEN 'en' WHEN item_id % 5 = 1 THEN 'de' END AS product FROM benchmark) SELECT query_id, count(*) AS chunks, min(doc_id) AS first FROM q JOIN documents ON doc_id % 40 = query_id WHERE lang IS NOT NULL AND (product IS NULL OR product = lang) GROUP BY query_id",
    "content_digests": """SELECT c_custkey, sha256('{"empty": null, "key": ' || c_custkey || ', "name": "' || c_name || ' \\"é\\"", "segment": "' || c_mktsegment || '"}') AS digest FROM customer""",
}
