"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm import collocations, context_mixing, html_text, jaccard_join, max_score, mixing, packing, secret_scan, token_output, toxicity, vantage_points, vector_codes, warc
from fernweave.llm._common import ship, small_batches, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark, 256)
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
    return packed.withColumnRenamed("id", "doc_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark, 1000)
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark, 256)
    return token_output.token_matrices(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark, 500)
    read = warc.archive_round_trip(spark, table(spark, sf_dir, "pages"), least_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark, 1000)
    found = jaccard_join.similar_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark, 2000)
    return vantage_points.nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, factor=1.1)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark, 500)
    return html_text.main_texts(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark, 1000)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark, 2000)
    return max_score.exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10, scale=1024)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3, seed=17)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark, 1000)
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, inside=50, top=2000)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark, 2000)
    return vector_codes.product_codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark, 1000)
    return context_mixing.score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_secret_scan, op3_token_matrices, op4_warc, op5_jaccard_join, op6_vantage_points, op7_html_text, op8_toxicity, op9_max_score, op10_mixing, op11_collocations, op12_vector_codes, op13_context_mixing)}

OP10_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 8)) AS BIGINT) AS digest
  FROM documents),
sources AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY k),
rounds AS (
  SELECT 0 AS i, k, CAST(source_size AS DOUBLE) * 3 AS cap, CAST(weight AS DOUBLE) AS weight, source_size,
         CAST(sum(source_size) OVER () AS DOUBLE) * weight / sum(weight) OVER () AS target, false AS cut
  FROM sources
  UNION ALL
  SELECT i + 1, k, cap, weight, source_size,
         CASE WHEN is_full THEN cap
              ELSE (all_words - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) * weight / sum(CASE WHEN NOT is_full THEN weight END) OVER () END,
         is_full
  FROM (SELECT *, cut OR target > cap AS is_full, CAST(sum(source_size) OVER () AS DOUBLE) AS all_words FROM rounds)
  WHERE i < (SELECT count(*) FROM sources)),
targets AS (
  SELECT k, source_size, target,
         CASE WHEN source_size > 0 THEN least(3.0, target / source_size) ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('17|' || k), 1, 8)) AS BIGINT) / 4294967296.0 AS first
  FROM rounds WHERE i = (SELECT count(*) FROM sources)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY size, digest % greatest(64, (n + 1048575) // 1048576), doc_id NULLS FIRST, digest) AS place
  FROM (SELECT *, count(*) OVER () AS n FROM sized))
SELECT doc_id, size, source_size, target,
       CAST(least(3, floor(first + place * rate) - floor(first + (place - 1) * rate)) AS BIGINT) * size AS taken
FROM placed JOIN targets USING (k)
"""

OP9_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT * FROM whole WHERE vec_id % 100 = 0) q JOIN whole c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""

OP11_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
worded AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM texts)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS n
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM worded, (SELECT unnest([1, 2, 3]) AS k))
  GROUP BY lang, k, phrase),
candidates AS MATERIALIZED (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS before, array_to_string(w[c + 1:k], ' ') AS behind
  FROM candidates, (SELECT unnest([1, 2]) AS c) WHERE c < k),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.c, l.n AS l, r.n AS r,
         CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.before JOIN f r ON r.lang = c.lang AND r.phrase = c.behind),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_parts AS (
  SELECT lang, part, max(a) AS longer
  FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM candidates WHERE k = 3) GROUP BY lang, part),
kept AS (
  SELECT s.* FROM lowest s LEFT JOIN inner_parts i ON i.lang = s.lang AND i.part = s.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

#: Long form: one row for each vector, part and place; a round is two statements more, so the text is made by a rule.
_OP12_NEAREST = """
nearest{i} AS MATERIALIZED (
  SELECT id, part, arg_min(entry, struct_pack(d := distance, e := entry)) AS entry, min(distance) AS distance
  FROM (SELECT v.id, v.part, b.entry, CAST(sum((v.x - b.x) * (v.x - b.x)) AS BIGINT) AS distance
        FROM cells v JOIN book{i} b ON v.part = b.part AND v.place = b.place GROUP BY v.id, v.part, b.entry)
  GROUP BY id, part),
"""
_OP12_MOVED = """
book{j} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.x) AS x
  FROM book{i} b LEFT JOIN (
    SELECT v.part, a.entry, v.place, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n
    FROM cells v JOIN nearest{i} a ON v.id = a.id AND v.part = a.part GROUP BY v.part, a.entry, v.place) m
  ON b.part = m.part AND b.entry = m.entry AND b.place = m.place),
"""
OP12_SQL = (
    """
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
  SELECT id, (pos - 1) // (size // 8) AS part, (pos - 1) % (size // 8) AS place, x
  FROM (SELECT id, len(v) AS size, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM whole)),
book0 AS MATERIALIZED (SELECT part, id - 1 AS entry, place, x FROM cells WHERE id <= 16),
"""
    + "".join(_OP12_NEAREST.format(i=i) + _OP12_MOVED.format(i=i, j=i + 1) for i in range(6))
    + _OP12_NEAREST.format(i=6)
    + """
coded AS (
  SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error FROM nearest6 GROUP BY id)
SELECT w.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY w.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book6) AS codebooks_sha256
FROM whole w JOIN coded c ON w.id = c.id
"""
)

ORACLE_SQL: dict[str, str] = {"op9_max_score": OP9_SQL, "op10_mixing": OP10_SQL, "op11_collocations": OP11_SQL, "op12_vector_codes": OP12_SQL}
