"""Queries of the corpus behind retrieval and of what readers see, over the tables, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.functions import display as Y
from fernweave.operators import corpus as O
from fernweave.sources import readers as S
from fernweave.sources.readers import read_table

MUST = ("doc_id", "product_id", "sha256", "page_count", "local_path")
CONFIG = {"max_characters": 1800, "overlap": 240, "model": "none"}


def documents(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents")


def manifest(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A manifest of all documents with faults of every kind, and the files that it speaks of."""
    k = F.col("doc_id")
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    listed = documents(s, d).select(
        k.alias("position"), F.concat(F.lit("d"), F.when(k % 50 == 7, k - 1).otherwise(k).cast("string")).alias("doc_id"),
        F.when(k % 17 != 0, F.col("lang")).alias("product_id"), F.when(k % 21 == 0, "x").otherwise(content).alias("sha256"),
        (F.col("n_chars") % 10).alias("page_count"), F.concat(F.when(k % 31 == 0, "absent/").otherwise("files/"), k.cast("string")).alias("local_path"),
        F.when(k % 19 != 0, F.concat(F.lit("files/"), F.when(k % 23 == 0, k + 100_000_000).otherwise(k).cast("string"))).alias("corrected_text_path"),
    )
    files = documents(s, d).select(F.concat(F.lit("files/"), k.cast("string")).alias("path"), content.alias("content_hash"), (k % 29 != 0).alias("is_pdf"))
    return listed, files


def page_faults(s: SparkSession, d: str) -> DataFrame:
    """The faults of a page for each document: some of another source, revision or hash, unverified or without pages."""
    k = F.col("doc_id")
    page = F.struct(F.lit(1).alias("page_number"), "text", F.when(k % 9 == 0, "x").otherwise(F.sha2("text", 256)).alias("sha256"), (k % 8 != 0).alias("verified"))
    own = documents(s, d).select("doc_id", F.lit("h").alias("source_hash"), F.when(k % 15 == 0, "old").otherwise("new").alias("mapping_revision"), F.filter(F.array(page), lambda p: k % 12 != 0).alias("pages"))
    expected = documents(s, d).select("doc_id", F.when(k % 14 == 0, "g").otherwise("h").alias("sha256"))
    return S.verified_pages(own, expected, "new").select("doc_id", "fault")


def link_pages(s: SparkSession, d: str) -> DataFrame:
    """A page for each part whose embedded JSON has a link to the part, one to its brand within, and one elsewhere."""
    brand = F.translate("p_brand", "#", " ")
    within = F.struct(F.col("p_brand").alias("name"), F.lit("/brands").alias("path"), F.concat(F.lit("https://files.example.org/brands/"), brand, F.lit(".PDF")).alias("file"))
    other = F.struct(F.lit("https://other.example.org/a.pdf").alias("file"))
    item = F.struct(F.col("p_name").alias("name"), F.concat(F.lit("/parts/"), F.col("p_partkey")).alias("path"), F.col("p_type").alias("type"), F.concat(F.lit("https://files.example.org/parts/"), F.col("p_partkey"), F.lit(".pdf")).alias("file"), within.alias("brand"), F.array(other).alias("more"))
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.to_json(F.struct(F.array(item).alias("items"))), F.lit("</script><p>text</p></html>"))
    return read_table(s, d, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))


def index_rows(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = documents(s, d).select(F.col("doc_id").alias("chunk_id"), "text")
    stored = own.select("chunk_id", F.sha2("text", 256).alias("content_hash"), F.lit("stored").alias("origin"))
    current = own.select(F.when(F.col("chunk_id") % 5 == 0, -F.col("chunk_id") - 1).otherwise(F.col("chunk_id")).alias("chunk_id"), F.sha2(F.when(F.col("chunk_id") % 7 == 0, F.lower("text")).otherwise(F.col("text")), 256).alias("content_hash"), F.lit("current").alias("origin"))
    return stored, current


def event_sets(s: SparkSession, d: str) -> DataFrame:
    """Which kinds of event a user has of low and of high value, and how the two sets differ."""

    def kinds(held: str) -> object:
        return F.array_sort(F.collect_set(F.when(F.expr(held), F.col("event_type"))))

    own = read_table(s, d, "events").groupBy("user_id").agg(kinds("value < 50").alias("low"), kinds("value >= 50").alias("high"))
    return own.select("user_id", F.array_join(Y.symmetric_difference(F.col("low"), F.col("high")), ",").alias("differing"), Y.is_subset(F.col("low"), F.col("high")).alias("low_in_high"))


def choices(s: SparkSession, d: str) -> DataFrame:
    """What customers choose of three products: by number, by ordinal, or nothing that there is."""
    k = F.col("c_custkey")
    said = F.when(k % 4 == 0, F.concat(F.lit(" ข้อ  "), (k % 5).cast("string"))).when(k % 4 == 1, F.lit("อันที่สอง")).when(k % 4 == 2, (k % 3 + 1).cast("string")).otherwise("none")
    return read_table(s, d, "customer").select("c_custkey", Y.chosen(said, F.array(F.lit("a"), F.lit("b"), F.concat(F.lit("c"), (k % 2).cast("string")))).alias("choice"))


def turn_traces(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "complete").when(F.col("event_type") == "view", "cancelled").otherwise(F.col("event_type"))
    return S.traces(read_table(s, d, "events").select(F.col("event_id").alias("trace_id"), F.col("user_id").alias("owner_id"), F.col("event_id").alias("session_id"), status.alias("status"), "props", (F.col("event_id") % 9).alias("candidate_count")))


_MANIFEST = """m AS (SELECT doc_id AS position, 'd' || CASE WHEN doc_id % 50 = 7 THEN doc_id - 1 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 17 <> 0 THEN lang END AS product_id, CASE WHEN doc_id % 21 = 0 THEN 'x' ELSE sha256(coalesce(text, '')) END AS sha,
  n_chars % 10 AS page_count, CASE WHEN doc_id % 31 = 0 THEN 'absent/' ELSE 'files/' END || doc_id AS local_path, CASE WHEN doc_id % 19 <> 0 THEN 'files/' || CASE WHEN doc_id % 23 = 0 THEN doc_id + 100000000 ELSE doc_id END END AS corrected FROM documents),
f AS (SELECT 'files/' || doc_id AS path, sha256(coalesce(text, '')) AS h, doc_id % 29 <> 0 AS pdf FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS nth FROM m WHERE product_id IS NOT NULL AND page_count IS NOT NULL),
j AS (SELECT w.*, h, pdf, row_number() OVER (PARTITION BY h ORDER BY position) AS nth_content FROM w JOIN f ON path = local_path),
e AS (SELECT doc_id, 'missing fields: ' || concat_ws(', ', CASE WHEN page_count IS NULL THEN 'page_count' END, CASE WHEN product_id IS NULL THEN 'product_id' END) AS error FROM m WHERE product_id IS NULL OR page_count IS NULL
  UNION ALL SELECT doc_id, 'repeated id' FROM w WHERE nth > 1 UNION ALL SELECT doc_id, 'no file' FROM w WHERE local_path NOT IN (SELECT path FROM f)
  UNION ALL SELECT doc_id, 'not a PDF' FROM j WHERE NOT pdf UNION ALL SELECT doc_id, 'hash differs' FROM j WHERE h <> sha UNION ALL SELECT doc_id, 'page count' FROM j WHERE page_count < 1
  UNION ALL SELECT doc_id, 'no corrected text' FROM j WHERE corrected IS NULL UNION ALL SELECT doc_id, 'repeated content' FROM j WHERE nth_content > 1
  UNION ALL SELECT doc_id, 'corrected text does not exist' FROM j WHERE corrected IS NOT NULL AND corrected NOT IN (SELECT path FROM f))"""

QUERIES = {
    "manifest_errors": lambda s, d: O.manifest_errors(*manifest(s, d), MUST),
    "page_faults": page_faults,
    "embedded_links": lambda s, d: O.embedded_links(link_pages(s, d), "file", host="files.example.org", within="/B"),
    "extraction_quality": lambda s, d: O.extraction_quality(read_table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), F.when(F.col("turn") % 3 != 1, F.col("text")).alias("text"))).withColumn("empty_pages", F.array_join(F.transform("empty_pages", lambda x: x.cast("string")), ",")),
    "index_state": lambda s, d: O.index_metadata(documents(s, d), CONFIG, "doc_id"),
    "refreshed_rows": lambda s, d: O.refreshed_rows(*index_rows(s, d)),
    "coverage": lambda s, d: O.coverage(read_table(s, d, "orders").withColumnRenamed("o_custkey", "k"), read_table(s, d, "customer").withColumn("k", F.col("c_custkey") * 2), "k"),
    "event_sets": event_sets,
    "event_times": lambda s, d: read_table(s, d, "events").select("event_id", Y.local_time(F.col("ts"), "Asia/Bangkok").alias("shown")),
    "choices": choices,
    "shown_types": lambda s, d: read_table(s, d, "part").select("p_partkey", Y.shown(F.concat("p_type", F.lit(" THB monthly_thb")), {"STEEL": "iron", "BRASS": "alloy"}).alias("shown")),
    "quoted_evidence": lambda s, d: documents(s, d).select("doc_id", F.sha2(Y.quoted_evidence(F.col("text"), F.col("doc_id"), F.lit(1)), 256).alias("quoted")),
    "turn_traces": turn_traces,
}

ORACLE_SQL = {
    "manifest_errors": f"WITH {_MANIFEST} SELECT doc_id, error FROM e",
    "page_faults": "WITH t AS (SELECT doc_id, text, regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '^\\s+|\\s+$', '', 'g') AS body FROM documents) SELECT doc_id, CASE WHEN doc_id % 14 = 0 THEN 'provenance' WHEN doc_id % 15 = 0 THEN 'revision' WHEN doc_id % 12 = 0 THEN 'no pages' WHEN doc_id % 8 = 0 THEN 'unverified' WHEN body = '' THEN 'empty' WHEN regexp_matches(body, '[\\x{E000}-\\x{F8FF}]') THEN 'private use' WHEN CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE sha256(text) END IS DISTINCT FROM sha256(body) THEN 'hash' END AS fault FROM t",
    "embedded_links": "SELECT 'https://files.example.org/brands/' || replace(p_brand, '#', '%20') || '.PDF' AS url, max(p_partkey) AS page_id, p_brand AS name, '/brands' AS path, '' AS kind FROM part GROUP BY p_brand",
    "extraction_quality": "WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 1 THEN coalesce(text, '') ELSE '' END AS t FROM conversations), q AS (SELECT conv_id AS doc_id, count(*) AS page_count, count(*) FILTER (regexp_matches(t, '\\S')) AS pages_with_text, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (NOT regexp_matches(t, '\\S')), '') AS empty_pages, CAST(sum(length(t)) + count(*) - 1 AS BIGINT) AS characters, CAST(sum(length(t) - length(regexp_replace(t, '[\\x{E000}-\\x{F8FF}]', '', 'g'))) AS BIGINT) AS private_use FROM c GROUP BY 1) SELECT *, CASE WHEN pages_with_text = 0 THEN 'image_only' WHEN private_use > 0 THEN 'limited_text_encoding' ELSE 'passed' END AS extraction_status FROM q",
    "index_state": f"WITH l AS (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 4) AS part, sha256(string_agg(DISTINCT CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS digest FROM documents WHERE doc_id IS NOT NULL GROUP BY 1) SELECT (SELECT count(*) FROM documents) AS chunk_count, sha256(coalesce(string_agg(digest, '' ORDER BY part), '')) AS ids_sha256, '{O.fingerprint(CONFIG)}' AS fingerprint FROM l",
    "refreshed_rows": "WITH c AS (SELECT CASE WHEN doc_id % 5 = 0 THEN -doc_id - 1 ELSE doc_id END AS chunk_id, sha256(CASE WHEN doc_id % 7 = 0 THEN lower(text) ELSE text END) AS content_hash FROM documents), s AS (SELECT doc_id AS chunk_id, sha256(text) AS content_hash FROM documents) SELECT c.chunk_id, c.content_hash, CASE WHEN s.chunk_id IS NULL THEN 'current' ELSE 'stored' END AS origin FROM c LEFT JOIN s ON c.chunk_id = s.chunk_id AND c.content_hash = s.content_hash",
    "coverage": "SELECT DISTINCT o_custkey AS k, 'list' AS absent FROM orders WHERE o_custkey NOT IN (SELECT c_custkey * 2 FROM customer) UNION ALL SELECT DISTINCT c_custkey * 2, 'data' FROM customer WHERE c_custkey * 2 NOT IN (SELECT o_custkey FROM orders)",
    "event_sets": "WITH k AS (SELECT user_id, event_type, bool_or(value < 50) AS low, bool_or(value >= 50) AS high FROM events GROUP BY 1, 2) SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (low <> high), '') AS differing, count(*) FILTER (low AND NOT high) = 0 AS low_in_high FROM k GROUP BY 1",
    "event_times": "SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%d %b %H:%M') AS shown FROM events",
    "choices": "WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 5 WHEN 1 THEN 2 WHEN 2 THEN c_custkey % 3 + 1 END AS n FROM customer) SELECT c_custkey, CASE n WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' || c_custkey % 2 END AS choice FROM n",
    "shown_types": "SELECT p_partkey, replace(replace(p_type, 'STEEL', 'iron'), 'BRASS', 'alloy') || ' บาท เดือน' AS shown FROM part",
    "turn_traces": "SELECT event_id AS trace_id, substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS owner_ref, substr(sha256(CAST(event_id AS VARCHAR)), 1, 16) AS session_ref, CASE event_type WHEN 'click' THEN 'complete' WHEN 'view' THEN 'cancelled' ELSE 'error' END AS status, event_id % 9 AS candidate_count FROM events",
}
