"""Queries of what changes over time: streams, stored tables, late corrections and lead collection, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.operators import lead_turns as L
from fernweave.operators import stored as B
from fernweave.operators.leads import FIELDS
from fernweave.plans import performance as P
from fernweave.plans import records as R
from fernweave.sources.readers import read_table
from fernweave.streaming import corrections, locks, runs

CLOSED = "2001-06-30"
ALIASES = [("p-a", "Product A"), ("p-b", "Product B"), ("p-a", "shared plan"), ("p-b", "shared plan")]


def streamed_locks(s: SparkSession, d: str) -> DataFrame:
    """The login lock over the events as a stream, up to ten minutes before the last attempt."""
    locks.use_state(s)
    return runs.run_now(locks.locked_stream(runs.file_stream(s, f"{d}/events.parquet*"), "10 minutes"), runs.shared_folder(s, "locks"))


def merged_customers(s: SparkSession, d: str) -> DataFrame:
    """Customers as a stored table, changed by those that come."""
    own, incoming = R.customers(s, d)
    path = runs.shared_folder(s, "customers")
    for rows in (own, incoming):
        B.merge_stored(s, path, rows, ["c_custkey"], 16)
    return B.read_stored(s, path).drop(B.BUCKET)


def refreshed_documents(s: SparkSession, d: str) -> DataFrame:
    """Chunks as a stored table, made equal to a corpus in which some are new, changed or gone; which buckets were written is not shown."""
    own = read_table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))
    path = runs.shared_folder(s, "chunks")
    B.refresh_stored(s, path, own.where("chunk_id % 9 <> 4"), ["chunk_id"], 64)
    B.refresh_stored(s, path, own.where("chunk_id % 9 <> 2").withColumn("content_hash", F.when(F.col("chunk_id") % 100 == 0, F.lit("changed")).otherwise(F.col("content_hash"))), ["chunk_id"], 64)
    return B.read_stored(s, path).drop(B.BUCKET)


def _corrected(s: SparkSession, d: str) -> str:
    """The folder of the monthly tables after all months, and then after corrections of every fifth agent's, sent twice."""
    folder = runs.shared_folder(s, "months")
    months = P.performance(s, d)
    late = months.where("agent_id % 5 = 0 and (agent_id + month(month_start)) % 4 = 1").withColumn("premium", (F.col("premium") / 4).cast("long"))
    for k, batch in ((0, months), (1, late), (1, late), (2, late)):
        corrections.correct(s, folder, batch, k, P.agents(s, d), F.broadcast(P.rules(s)), CLOSED, 8)  # the list of two rules
    return folder


def late_evaluations(s: SparkSession, d: str) -> DataFrame:
    own = B.read_stored(s, f"{_corrected(s, d)}/evaluations")
    return own.select("agent_id", "month_start", "rule_id", "premium", "result", "pass_streak", "fail_streak", "revision", "is_current")


def late_events(s: SparkSession, d: str) -> DataFrame:
    return B.read_stored(s, f"{_corrected(s, d)}/events").select("agent_id", "effective_from", "from_type", "to_type", "superseded")


def said(s: SparkSession, d: str) -> DataFrame:
    """What customers say, a turn for each of their orders."""
    k, own = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(
        F.lit("interested in Product A"), F.concat(F.lit("name: Client "), own, F.lit(" occupation clerk income unknown")), F.concat(F.lit("Income: "), own * 10, F.lit(" THB per month")),
        F.lit("income 15 to 25 THB per month"), F.concat(F.lit("phone 08"), F.lpad((own % 100_000_000).cast("string"), 8, "1")), F.lit("phone 0123456789012"), F.lit("Cancel!"), F.lit("well, tell me"),
        F.lit("I like the shared plan"), F.lit("2"), F.lit("interested in Product B"), F.lit("income 1,500.50"),
    )
    kind = F.pmod(F.col("o_orderkey") * 7 + F.col("o_custkey"), F.lit(12)).cast("int")
    return read_table(s, d, "orders").select(own.alias("owner_id"), k.alias("turn"), F.col("o_orderdate").alias("at"), F.get(kinds, kind).alias("text"), F.when(own % 3 == 0, "p-a").alias("active_product_id"))


def saved_leads(s: SparkSession, d: str) -> DataFrame:
    """Every fourth customer has a profile, every eighth one from early in 1992."""
    own, none = F.col("c_custkey"), F.lit(None)
    fields = {"name": F.lit("Old"), "occupation": F.lit("smith"), "income": F.lit(500).cast("decimal(14,2)"), "income_min": none.cast("decimal(14,2)"), "income_max": none.cast("decimal(14,2)"), "income_currency": F.lit("THB"), "income_period": F.lit("monthly_thb"), "phone": F.lit("0812345678"), "product_id": F.lit("p-b")}
    verified = F.when(own % 8 == 0, "1992-01-01").otherwise("1996-01-01").cast("timestamp")
    return read_table(s, d, "customer").where("c_custkey % 4 = 0").select(own.alias("owner_id"), *(fields[f].alias(f) for f in FIELDS), verified.alias("verified_at"), (own % 16 == 4).alias("refresh_asked"))


def turn_rows(s: SparkSession, d: str) -> DataFrame:
    folded = L.lead_turns(said(s, d), s.createDataFrame(ALIASES, "product_id string, alias string"), saved_leads(s, d))
    return folded.select("owner_id", "turn", *FIELDS, "status", "outcome", "refreshed", F.array_join("candidates", ",").alias("candidates"), F.array_join("missing", ",").alias("missing"))


QUERIES = {"streamed_locks": streamed_locks, "merged_customers": merged_customers, "refreshed_documents": refreshed_documents, "late_evaluations": late_evaluations, "late_events": late_events, "lead_turns": turn_rows}

_STREAKS = P.CHAIN + "SELECT agent_id, month_start, rule_id, premium, result, pass_streak, fail_streak FROM streaks"
_EVENTS = P.CHAIN + "SELECT agent_id, effective_from, from_type, to_type FROM events"
_LATE = "FROM (SELECT * REPLACE (CASE WHEN agent_id % 5 = 0 AND (agent_id + month(month_start)) % 4 = 1 THEN premium // 4 ELSE premium END AS premium) FROM perf) perf JOIN agents"
_NO_MONEY = "CAST(NULL AS DECIMAL(14,2))"
_LEAD_TURNS = f"""WITH RECURSIVE turns AS (
  SELECT o_custkey AS owner_id, o_orderkey AS turn, CAST(o_orderdate AS TIMESTAMP) AS at_, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, (o_orderkey * 7 + o_custkey) % 12 AS kind, CASE WHEN o_custkey % 3 = 0 THEN 'p-a' END AS active FROM orders),
said AS (SELECT *, CASE WHEN kind = 1 THEN 'Client ' || owner_id END AS name, CASE WHEN kind = 1 THEN 'clerk' END AS occupation, kind IN (2, 3, 11) AS money,
    CASE kind WHEN 2 THEN CAST(owner_id * 10 AS DECIMAL(14,2)) WHEN 11 THEN CAST(1500.50 AS DECIMAL(14,2)) END AS income, CASE WHEN kind = 3 THEN CAST(15 AS DECIMAL(14,2)) END AS low, CASE WHEN kind = 3 THEN CAST(25 AS DECIMAL(14,2)) END AS high,
    CASE WHEN kind IN (2, 3) THEN 'THB' END AS currency, CASE WHEN kind IN (2, 3) THEN 'monthly_thb' END AS period,
    CASE kind WHEN 4 THEN '08' || lpad(CAST(owner_id % 100000000 AS VARCHAR), 8, '1') WHEN 5 THEN '0123456789012' END AS phone, kind = 4 AS fits,
    CASE kind WHEN 0 THEN ['p-a'] WHEN 8 THEN ['p-a', 'p-b'] WHEN 10 THEN ['p-b'] ELSE CAST([] AS VARCHAR[]) END AS products, CASE WHEN kind = 9 THEN 2 END AS number, kind = 6 AS cancels, kind IN (0, 10) AS interested FROM turns),
steps AS (
  SELECT c_custkey AS owner_id, CAST(NULL AS BIGINT) AS turn, CAST(0 AS BIGINT) AS i, CASE WHEN c_custkey % 4 = 0 THEN 'Old' END AS name, CASE WHEN c_custkey % 4 = 0 THEN 'smith' END AS occupation, CASE WHEN c_custkey % 4 = 0 THEN CAST(500 AS DECIMAL(14,2)) END AS income,
    {_NO_MONEY} AS low, {_NO_MONEY} AS high, CASE WHEN c_custkey % 4 = 0 THEN 'THB' END AS currency, CASE WHEN c_custkey % 4 = 0 THEN 'monthly_thb' END AS period, CASE WHEN c_custkey % 4 = 0 THEN '0812345678' END AS phone, true AS fits,
    CASE WHEN c_custkey % 4 = 0 THEN 'p-b' END AS product, CASE WHEN c_custkey % 4 = 0 THEN 'confirmed' ELSE 'unconfirmed' END AS status, CAST([] AS VARCHAR[]) AS candidates,
    CASE WHEN c_custkey % 8 = 0 THEN TIMESTAMP '1992-01-01' WHEN c_custkey % 4 = 0 THEN TIMESTAMP '1996-01-01' END AS verified, CASE WHEN c_custkey % 4 = 0 THEN 'p-b' END AS saved, c_custkey % 16 = 4 AS asked, CAST(NULL AS VARCHAR) AS outcome, false AS refreshed
  FROM customer
  UNION ALL
  SELECT owner_id, turn, i, name, occupation, income, low, high, currency, period, phone, fits, product, CASE WHEN cancels THEN 'cancelled' WHEN complete AND fits THEN 'confirmed' ELSE status END,
    CASE WHEN cancels THEN CAST([] AS VARCHAR[]) ELSE candidates END, CASE WHEN complete AND fits AND NOT cancels THEN at_ ELSE verified END, CASE WHEN complete AND fits AND NOT cancels THEN product ELSE saved END,
    CASE WHEN complete AND fits AND NOT cancels THEN false ELSE asked OR refreshed END,
    CASE WHEN cancels THEN 'cancelled' WHEN complete THEN CASE WHEN fits THEN 'saved' ELSE 'invalid' END WHEN len(candidates) > 0 THEN 'choose' ELSE 'asks' END, refreshed
  FROM (
    SELECT *, coalesce(name <> '' AND occupation <> '' AND phone <> '' AND product <> '' AND income IS NOT NULL AND currency = 'THB' AND period = 'monthly_thb', false) AS complete
    FROM (
      SELECT owner_id, turn, i, at_, coalesce(t_name, CASE WHEN NOT anew THEN name END) AS name, coalesce(t_occupation, CASE WHEN NOT anew THEN occupation END) AS occupation,
        CASE WHEN money THEN t_income WHEN NOT anew THEN income END AS income, CASE WHEN money THEN t_low WHEN NOT anew THEN low END AS low, CASE WHEN money THEN t_high WHEN NOT anew THEN high END AS high,
        CASE WHEN money THEN t_currency WHEN NOT anew THEN currency END AS currency, CASE WHEN money THEN t_period WHEN NOT anew THEN period END AS period,
        coalesce(t_phone, CASE WHEN NOT anew THEN phone END) AS phone, CASE WHEN t_phone IS NOT NULL THEN t_fits WHEN anew THEN true ELSE fits END AS fits,
        CASE WHEN len(left_) = 0 THEN coalesce(given, CASE WHEN refreshed THEN saved WHEN NOT anew THEN product END) END AS product,
        CASE WHEN len(left_) > 0 OR anew THEN 'unconfirmed' ELSE status END AS status, left_ AS candidates, verified, saved, asked, refreshed, cancels
      FROM (
        SELECT *, refreshed OR (status = 'cancelled' AND interested) AS anew,
          CASE WHEN picked THEN CAST([] AS VARCHAR[]) WHEN len(products) > 1 THEN products WHEN len(products) = 1 THEN CAST([] AS VARCHAR[]) ELSE candidates END AS left_,
          CASE WHEN picked THEN candidates[number] WHEN len(products) = 1 THEN products[1] WHEN len(products) = 0 AND len(candidates) = 0 THEN active END AS given
        FROM (
          SELECT t.owner_id, t.turn, t.i, t.at_, t.active, t.products, t.number, t.cancels, t.interested, t.money, t.name AS t_name, t.occupation AS t_occupation, t.income AS t_income, t.low AS t_low, t.high AS t_high, t.currency AS t_currency, t.period AS t_period, t.phone AS t_phone, t.fits AS t_fits,
            s.name, s.occupation, s.income, s.low, s.high, s.currency, s.period, s.phone, s.fits, s.product, s.status, s.candidates, s.verified, s.saved, s.asked,
            coalesce(t.at_ - s.verified >= INTERVAL 183 DAY, false) AND NOT s.asked AS refreshed, coalesce(t.number BETWEEN 1 AND len(s.candidates), false) AS picked
          FROM steps s JOIN said t ON t.owner_id = s.owner_id AND t.i = s.i + 1)))))
SELECT owner_id, turn, name, occupation, income, low AS income_min, high AS income_max, currency AS income_currency, period AS income_period, phone, product AS product_id, status, outcome, refreshed, array_to_string(candidates, ',') AS candidates,
  CASE WHEN status = 'cancelled' THEN '' ELSE array_to_string(list_filter([CASE WHEN name IS NULL THEN 'name' END, CASE WHEN occupation IS NULL THEN 'occupation' END, CASE WHEN income IS NULL THEN CASE WHEN low IS NOT NULL THEN 'income_confirmation' ELSE 'income' END END,
    CASE WHEN currency IS NULL THEN 'income_currency' END, CASE WHEN period IS NULL THEN 'income_period' END, CASE WHEN phone IS NULL THEN 'phone' END, CASE WHEN product IS NULL THEN 'product_id' END], lambda x: x IS NOT NULL), ',') END AS missing
FROM steps WHERE i > 0"""

ORACLE_SQL = {
    "streamed_locks": R.LOCKED_SQL + " WHERE event_id IN (SELECT event_id FROM events WHERE epoch_us(ts) <= (SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 FROM events WHERE event_type IN ('error', 'signup')))",
    "merged_customers": f"WITH {R.INCOMING_SQL} SELECT * FROM incoming UNION ALL SELECT * FROM own WHERE c_custkey NOT IN (SELECT c_custkey FROM incoming)",
    "refreshed_documents": "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 100 = 0 THEN 'changed' ELSE sha256(text) END AS content_hash FROM documents WHERE text IS NOT NULL AND doc_id % 9 <> 2",
    "late_evaluations": f"""WITH before AS ({_STREAKS}), after AS ({_STREAKS.replace("FROM perf JOIN agents", _LATE)}),
pairs AS (SELECT b.*, a.premium AS new_premium, a.result AS new_result, a.pass_streak AS new_pass, a.fail_streak AS new_fail, (a.premium, a.result, a.pass_streak, a.fail_streak) IS DISTINCT FROM (b.premium, b.result, b.pass_streak, b.fail_streak) AS moved FROM before b JOIN after a USING (agent_id, month_start))
SELECT agent_id, month_start, rule_id, premium, result, pass_streak, fail_streak, CAST(1 AS BIGINT) AS revision, NOT moved AS is_current FROM pairs UNION ALL
SELECT agent_id, month_start, rule_id, new_premium, new_result, new_pass, new_fail, 2, true FROM pairs WHERE moved""",
    "late_events": f"""WITH before AS ({_EVENTS}), after AS ({_EVENTS.replace("FROM perf JOIN agents", _LATE)})
SELECT agent_id, effective_from, from_type, to_type, false AS superseded FROM after UNION ALL
SELECT agent_id, effective_from, from_type, to_type, true FROM before b WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.agent_id = b.agent_id AND a.effective_from = b.effective_from AND a.to_type = b.to_type)""",
    "lead_turns": _LEAD_TURNS,
}
