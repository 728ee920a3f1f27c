"""Queries of conversations, table changes, texts, retrieval and event streams, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.functions import text as T
from fernweave.operators import conversations as V
from fernweave.operators import retrieval as R
from fernweave.operators import tables as D
from fernweave.sources import readers as S
from fernweave.streaming import events as E
from fernweave.sources.readers import read_table


def messages(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "conversations")


def sessions(s: SparkSession, d: str) -> DataFrame:
    own = messages(s, d).select("conv_id").distinct()
    return own.withColumn("status", F.when(F.col("conv_id") % 4 == 0, "closed").otherwise("active"))


def cases(s: SparkSession, d: str) -> DataFrame:
    events = read_table(s, d, "events").where("event_type = 'error'")
    status = F.when(F.col("event_id") % 3 == 0, "pending").when(F.col("event_id") % 3 == 1, "active").otherwise("closed")
    return events.select(F.col("event_id").alias("case_id"), "user_id", status.alias("status"), F.concat(F.lit("staff"), (F.col("user_id") % 5).cast("string")).alias("staff"), F.col("ts").alias("opened"))


def customers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = read_table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    changed = own.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "NEW").otherwise(F.col("c_mktsegment")))
    added = own.where("c_custkey % 10 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return own, changed.unionByName(added)


def history(s: SparkSession, d: str) -> DataFrame:
    return customers(s, d)[0].withColumns({"revision": F.lit(1).cast("long"), "is_current": F.lit(True)})


CUSTOMER = ["c_name", "c_mktsegment", "c_acctbal"]
INCOMING_SQL = """own AS (SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer),
incoming AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM own WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey + 1000000, c_name, c_mktsegment, c_acctbal FROM own WHERE c_custkey % 10 = 0)"""
CHECKS = {"positive price": "l_extendedprice >= 0", "discount": "l_discount between 0 and 0.05", "flag and status": "not (l_returnflag = 'N' and l_linestatus = 'F')"}


def chunks(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("chunk_id"), "lang", "text")


def asked_terms(s: SparkSession, d: str) -> DataFrame:
    """Every term of every benchmark text: a stated set of queries."""
    return read_table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.query_terms(F.col("text"))).alias("term"))


def vectors(s: SparkSession, d: str, asked: str = "vec_id % 20 = 0") -> tuple[DataFrame, DataFrame]:
    """Vectors that are asked for, and all of them."""
    own = read_table(s, d, "embeddings")
    return own.where(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), own.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def rankings(s: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Two rankings for each benchmark text: the 15 nearest to the vector with its id, and of all chunks by their terms the first k and those 15."""
    items = read_table(s, d, "benchmark").select(F.col("item_id").alias("query_id"))
    asked, own = vectors(s, d, "true")
    nearest = R.semantic_top_k(asked.join(items, "query_id", "left_semi"), own, 15)
    return nearest, R.bm25(asked_terms(s, d), chunks(s, d), k=k, also=nearest)


def gated(s: SparkSession, d: str) -> DataFrame:
    """Whether the ten best chunks of each benchmark text by both rankings bear it; their scores are the semantic ones, 0 for others."""
    asked = read_table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    semantic, lexical = rankings(s, d, 10)
    found = R.fused(semantic, lexical, 10).select("query_id", "chunk_id").join(semantic.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left").join(chunks(s, d), "chunk_id")
    return R.evidence_gate(asked, found.select("query_id", F.col("lang").alias("product_id"), F.lit("").alias("product_name"), "text", F.coalesce("score", F.lit(0.0)).alias("score")))


SCORE_SQL = "list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"
RANKED_SQL = """b AS (SELECT doc_id AS chunk_id, lower(regexp_replace(strip_accents(text), '\\s+', '', 'g')) AS body FROM documents WHERE text IS NOT NULL),
w AS (SELECT count(*) AS n, avg(length(body)) AS mean_size FROM b),
t AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]{2,}'))) AS term FROM benchmark),
h AS MATERIALIZED (SELECT chunk_id, length(body) AS size, term, CAST((length(body) - length(replace(body, term, ''))) / length(term) AS BIGINT) AS f FROM b, (SELECT DISTINCT term FROM t) WHERE contains(body, term)),
d AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
p AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * size / mean_size))) AS score FROM t JOIN h USING (term) JOIN d USING (term), w GROUP BY 1, 2),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM p)"""
LOCKED_SQL = """WITH RECURSIVE a AS (SELECT user_id, event_id, epoch_us(ts) AS at, event_type = 'signup' AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('error', 'signup')),
s AS (SELECT user_id, event_id, k, CASE WHEN good THEN 0 ELSE 1 END AS failures, CAST(NULL AS BIGINT) AS until, CASE WHEN good THEN 'ok' ELSE 'failed' END AS outcome FROM a WHERE k = 1
  UNION ALL
  SELECT a.user_id, a.event_id, a.k,
    CASE WHEN a.at < s.until THEN s.failures WHEN good THEN 0 ELSE s.failures + 1 END,
    CASE WHEN a.at < s.until THEN s.until WHEN NOT good AND s.failures + 1 >= 5 THEN a.at + 60000000 END,
    CASE WHEN a.at < s.until THEN 'rejected' WHEN good THEN 'ok' WHEN s.failures + 1 >= 5 THEN 'locked' ELSE 'failed' END
  FROM s JOIN a ON a.user_id = s.user_id AND a.k = s.k + 1)
SELECT user_id, event_id, outcome FROM s"""


def _any_sql(text: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _in_sql(text: str, terms: tuple[str, ...]) -> str:
    return f"{text} IN ({', '.join(f"'{t}'" for t in terms)})"


ROUTED_SQL = f"""WITH m AS (SELECT *, trim(coalesce(text, '')) AS said, lower(trim(coalesce(text, ''))) AS low, regexp_replace(lower(trim(coalesce(text, ''))), '[\\s!?.,;:]+', '', 'g') AS compact FROM conversations),
d AS (SELECT *, CASE WHEN compact = '' THEN NULL WHEN {_any_sql("compact", T.HANDOFF)} THEN 'human_handoff' WHEN {_in_sql("compact", T.GREETINGS)} THEN 'greeting' WHEN starts_with(compact, 'ขอบคุณ') OR {_in_sql("compact", T.THANKS)} THEN 'thanks'
  WHEN {_in_sql("compact", T.FAREWELLS)} THEN 'goodbye' WHEN {_in_sql("compact", T.HELP)} THEN 'help' END AS direct,
  contains(said, '?') OR {_any_sql("low", T.PRODUCT_ASKED)} AS asks, {_any_sql("low", T.INTEREST)} AND NOT {_any_sql("low", T.NO_INTEREST)} AND NOT {_any_sql("low", T.INTEREST_ASKED)} AS keen,
  {_any_sql("low", T.PRODUCT_TERMS)} OR (turn > 0 AND {_any_sql("low", T.FOLLOW_UP)}) AS related FROM m)
SELECT CASE WHEN direct IS NOT NULL THEN direct WHEN keen AND NOT asks THEN 'lead' WHEN turn % 5 = 4 AND NOT asks THEN 'lead' WHEN NOT related THEN CASE WHEN said = '' THEN 'unsupported' ELSE 'out_of_scope' END ELSE 'question' END AS intent, count(*) AS messages FROM d GROUP BY 1"""
REDACTED_SQL = """SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(?:\\+66|0066|0)\\d[\\d\\s().-]{7,13}', '[redacted-phone]', 'g'), '(?i)(รายได้|income|เงินเดือน)\\s*[:=]?\\s*\\d[\\d,]*(?:\\.\\d+)?\\s*(?:บาท|THB|USD|ดอลลาร์)?', '\\1 [redacted-income]', 'g')) AS redacted FROM documents"""

QUERIES = {
    "inbox": lambda s, d: V.inbox(messages(s, d), sessions(s, d)),
    "last_messages": lambda s, d: V.last_messages(messages(s, d), 3).select("conv_id", "turn", "role", "place"),
    "bounded_context": lambda s, d: V.bounded_context(messages(s, d)),
    "conversations_with_system": lambda s, d: V.with_any(sessions(s, d), messages(s, d), "system"),
    "handoff_queue": lambda s, d: V.queue(cases(s, d), "staff1"),
    "latest_events": lambda s, d: D.latest(read_table(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type"),
    "first_claims": lambda s, d: D.claims(read_table(s, d, "events").withColumn("staff", F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string"))), "user_id", "staff", "ts"),
    "elapsed_events": lambda s, d: V.elapsed(read_table(s, d, "events"), "user_id", "ts", "event_id").select("event_id", "elapsed_us"),
    "upserted_customers": lambda s, d: D.upsert(*customers(s, d), ["c_custkey"]),
    "inserted_customers": lambda s, d: D.insert_or_ignore(*customers(s, d), ["c_custkey"]),
    "changed_customers": lambda s, d: D.changed_versions(*customers(s, d), ["c_custkey"], CUSTOMER),
    "customer_revisions": lambda s, d: D.next_revisions(history(s, d), customers(s, d)[1], ["c_custkey"], CUSTOMER),
    "segment_revisions": lambda s, d: D.revision_numbers(read_table(s, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "revision"),
    "reconciled_customers": lambda s, d: D.reconcile(customers(s, d)[0].select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("superseded")), customers(s, d)[1], ["c_custkey"]),
    "conflicting_requests": lambda s, d: D.conflicting_requests(read_table(s, d, "events").withColumn("request", F.col("event_id") % 500), "request", ["event_type"]),
    "check_violations": lambda s, d: D.violations(read_table(s, d, "lineitem"), CHECKS),
    "repeated_lines": lambda s, d: D.repeated_keys(read_table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity > 10"),
    "orphan_lines": lambda s, d: D.orphans(read_table(s, d, "lineitem"), read_table(s, d, "orders").where("o_orderkey % 10 <> 0"), "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("records")),
    "closed_sessions": lambda s, d: D.closed_by_owner(sessions(s, d), sessions(s, d).where("conv_id % 3 = 0"), ["conv_id"]),
    "migrated_customers": lambda s, d: D.migrated(customers(s, d)[0], {"c_name": "name"}, {"tier": "case when c_acctbal > 5000 then 'gold' else 'plain' end"}),
    "text_hashes": lambda s, d: read_table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"), T.pseudonym(F.col("text")).alias("pseudonym")),
    "routed_messages": lambda s, d: messages(s, d).groupBy(T.route(F.col("text"), F.col("turn") % 5 == 4, F.col("turn") > 0, F.lit(False)).alias("intent")).agg(F.count(F.lit(1)).alias("messages")),
    "redacted_texts": lambda s, d: read_table(s, d, "documents").select("doc_id", F.sha2(T.redacted(F.col("text")), 256).alias("redacted")),
    "masked_phones": lambda s, d: read_table(s, d, "customer").select("c_custkey", T.masked_phone(T.national_phone(F.concat(F.lit("+66 8-"), F.lpad(F.col("c_custkey").cast("string"), 7, "1")))).alias("phone")),
    "slugs": lambda s, d: read_table(s, d, "part").select("p_partkey", T.slug(F.col("p_type")).alias("slug")),
    "term_counts": lambda s, d: read_table(s, d, "documents").select("doc_id", T.occurrences(F.lower("text"), F.lit("er")).alias("n")),
    "semantic_top": lambda s, d: R.semantic_top_k(*vectors(s, d), 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "place"),
    "lexical_top": lambda s, d: R.bm25(asked_terms(s, d), chunks(s, d), k=10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "place"),
    "fused_top": lambda s, d: R.fused(*rankings(s, d, 5), 5).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "place"),
    "alias_matches": lambda s, d: R.alias_matches(read_table(s, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("text")), read_table(s, d, "part").select(F.col("p_brand").alias("product_id"), F.col("p_type").alias("alias")).distinct()),
    "evidence_gate": gated,
    "index_refresh": lambda s, d: R.refreshed_index(chunks(s, d).where("chunk_id % 3 <> 0").select("chunk_id", F.sha2("text", 256).alias("content_hash")), chunks(s, d).where("chunk_id % 5 <> 0").select("chunk_id", F.sha2(F.when(F.col("chunk_id") % 7 == 0, F.lower("text")).otherwise(F.col("text")), 256).alias("content_hash"))),
    "page_chunks": lambda s, d: R.chunked(read_table(s, d, "documents").select("doc_id", F.lit(1).alias("page_number"), "text")),
    "page_links": lambda s, d: S.page_links(read_table(s, d, "pages")),
    "page_hosts": lambda s, d: read_table(s, d, "pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count(F.lit(1)).alias("pages")),
    "tumbling_events": lambda s, d: E.tumbling(read_table(s, d, "events")),
    "sliding_events": lambda s, d: E.sliding(read_table(s, d, "events")),
    "event_sessions": lambda s, d: E.sessions(read_table(s, d, "events")),
    "locked_logins": lambda s, d: E.locked_out(read_table(s, d, "events")),
    "json_props": lambda s, d: read_table(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count(F.lit(1)).alias("events")),
}

ORACLE_SQL = {
    "inbox": "SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'closed' ELSE 'active' END AS status, count(*) AS messages, max(turn) AS last_turn, coalesce(substr(arg_min(text, turn) FILTER (role = 'user'), 1, 72), 'New conversation') AS title FROM conversations GROUP BY 1",
    "last_messages": "SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)",
    "bounded_context": "WITH c AS (SELECT *, substr(text, 1, 400) AS cut FROM conversations), k AS (SELECT *, row_number() OVER o AS back, sum(length(cut)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, string_agg(role || ': ' || cut, chr(10) ORDER BY turn) AS context FROM k WHERE back <= 6 AND used <= 2400 GROUP BY 1",
    "conversations_with_system": "SELECT DISTINCT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'closed' ELSE 'active' END AS status FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')",
    "handoff_queue": "WITH c AS (SELECT event_id AS case_id, user_id, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'active' ELSE 'closed' END AS status, 'staff' || CAST(user_id % 5 AS VARCHAR) AS staff, ts AS opened FROM events WHERE event_type = 'error') SELECT * FROM c WHERE status = 'pending' OR (status = 'active' AND staff = 'staff1')",
    "latest_events": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "first_claims": "WITH a AS (SELECT user_id, ts, 's' || CAST(event_id % 7 AS VARCHAR) AS staff FROM events) SELECT user_id, first(staff ORDER BY ts, staff) AS winner, count(*) AS attempts FROM a GROUP BY 1",
    "elapsed_events": "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS elapsed_us FROM events",
    "upserted_customers": f"WITH {INCOMING_SQL} SELECT * FROM own WHERE c_custkey NOT IN (SELECT c_custkey FROM incoming) UNION ALL SELECT * FROM incoming",
    "inserted_customers": f"WITH {INCOMING_SQL} SELECT * FROM own UNION ALL SELECT * FROM incoming WHERE c_custkey NOT IN (SELECT c_custkey FROM own)",
    "changed_customers": f"WITH {INCOMING_SQL} SELECT c_custkey FROM own JOIN incoming i USING (c_custkey) WHERE own.c_mktsegment <> i.c_mktsegment",
    "customer_revisions": f"WITH {INCOMING_SQL}, fresh AS (SELECT i.* FROM incoming i LEFT JOIN own o USING (c_custkey) WHERE o.c_custkey IS NULL OR o.c_mktsegment <> i.c_mktsegment) SELECT *, CAST(1 AS BIGINT) AS revision, c_custkey NOT IN (SELECT c_custkey FROM fresh) AS is_current FROM own UNION ALL SELECT f.*, CASE WHEN c_custkey IN (SELECT c_custkey FROM own) THEN 2 ELSE 1 END, true FROM fresh f",
    "segment_revisions": "WITH m AS (SELECT *, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS moved FROM events) SELECT user_id, event_id, CAST(sum(moved) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS BIGINT) AS revision FROM m",
    "reconciled_customers": f"WITH {INCOMING_SQL} SELECT coalesce(o.c_custkey, i.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'insert' WHEN i.c_custkey IS NULL AND o.c_custkey % 2 <> 0 THEN 'supersede' WHEN i.c_custkey IS NOT NULL AND o.c_custkey % 2 = 0 THEN 'revive' ELSE 'keep' END AS action FROM own o FULL JOIN incoming i ON o.c_custkey = i.c_custkey",
    "conflicting_requests": "SELECT event_id % 500 AS request, count(DISTINCT event_type) AS contents FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1",
    "check_violations": " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(CASE WHEN NOT ({c}) THEN 1 END) AS violations FROM lineitem" for n, c in CHECKS.items()),
    "repeated_lines": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2 HAVING count(*) > 1",
    "orphan_lines": "SELECT l_orderkey, count(*) AS records FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) GROUP BY 1",
    "closed_sessions": "SELECT DISTINCT conv_id, CASE WHEN conv_id % 4 = 0 OR conv_id % 3 = 0 THEN 'closed' ELSE 'active' END AS status FROM conversations",
    "migrated_customers": "SELECT c_custkey, c_name AS name, c_mktsegment, round(c_acctbal, 2) AS c_acctbal, CASE WHEN round(c_acctbal, 2) > 5000 THEN 'gold' ELSE 'plain' END AS tier FROM customer",
    "text_hashes": "SELECT doc_id, sha256(text) AS text_hash, substr(sha256(text), 1, 16) AS pseudonym FROM documents",
    "masked_phones": "SELECT c_custkey, CASE WHEN regexp_full_match('08' || lpad(CAST(c_custkey AS VARCHAR), 7, '1'), '0\\d{8,9}') THEN '08' || substr(lpad(CAST(c_custkey AS VARCHAR), 7, '1'), 1, 1) || '*****' || right(lpad(CAST(c_custkey AS VARCHAR), 7, '1'), 2) END AS phone FROM customer",
    "slugs": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part",
    "term_counts": "SELECT doc_id, CAST((length(text) - length(replace(lower(text), 'er', ''))) / 2 AS BIGINT) AS n FROM documents",
    "semantic_top": f"SELECT query_id, chunk_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {SCORE_SQL} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {SCORE_SQL} DESC, c.vec_id) AS place FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0) WHERE place <= 5",
    "lexical_top": f"WITH {RANKED_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM lexical WHERE place <= 10",
    "fused_top": f"WITH {RANKED_SQL}, semantic AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {SCORE_SQL} DESC, c.vec_id) AS place FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings c), r AS (SELECT query_id, chunk_id, 0.7 AS w, place FROM semantic WHERE place <= 15 UNION ALL SELECT query_id, chunk_id, 0.3, place FROM lexical), f AS (SELECT query_id, chunk_id, sum(CAST(w AS DOUBLE) / (60 + place)) AS score FROM r GROUP BY 1, 2) SELECT query_id, chunk_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS INTEGER) AS place FROM f QUALIFY place <= 5",
    "routed_messages": ROUTED_SQL,
    "redacted_texts": REDACTED_SQL,
    "locked_logins": LOCKED_SQL,
    "alias_matches": "WITH a AS (SELECT DISTINCT p_brand AS product_id, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS alias FROM part), q AS (SELECT p_partkey AS query_id, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS text FROM part) SELECT DISTINCT query_id, product_id FROM q JOIN a ON contains(text, alias) QUALIFY rank() OVER (PARTITION BY query_id ORDER BY length(alias) DESC) = 1",
    "index_refresh": "WITH s AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0), c AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN lower(text) ELSE text END) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0) SELECT coalesce(s.doc_id, c.doc_id) AS chunk_id, CASE WHEN c.doc_id IS NULL THEN 'delete' WHEN s.doc_id IS NULL THEN 'insert' WHEN s.h <> c.h THEN 'update' ELSE 'keep' END AS action FROM s FULL JOIN c ON s.doc_id = c.doc_id",
    "page_links": "SELECT url, max(page_id) AS page_id FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS url FROM pages) GROUP BY 1",
    "page_hosts": "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1",
    "tumbling_events": "SELECT date_trunc('hour', ts) AS starts, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "sliding_events": "SELECT to_timestamp(0)::TIMESTAMP + INTERVAL (7200 * (CAST(floor(epoch(ts) / 7200) AS BIGINT) - k)) SECOND AS starts, count(*) AS events FROM events, range(3) r(k) GROUP BY 1",
    "event_sessions": "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS starts, count(*) AS events FROM n GROUP BY user_id, k",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS events FROM events GROUP BY 1",
}
