"""Queries of the monthly performance rules over line items and suppliers, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.operators import kpi as K
from fernweave.sources.readers import read_table

RULES = [("r1", "1900-01-01", "1997-12-31", 30_000_000, 5, 3), ("r2", "1998-01-01", None, 35_000_000, 6, 2)]
RULE_SCHEMA = "rule_id string, valid_from date, valid_to date, premium_over long, policies_over long, required long"


def rules(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{r}', date'{a}', {f"date'{b}'" if b else 'cast(null as date)'}, {p}L, {n}L, {q}L)" for r, a, b, p, n, q in RULES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(rule_id, valid_from, valid_to, premium_over, policies_over, required)")


def agents(spark: SparkSession, folder: str) -> DataFrame:
    own = read_table(spark, folder, "supplier")
    joined = F.date_add(F.lit("1994-12-20").cast("date"), (F.col("s_suppkey") % 40).cast("int"))
    left = F.when(F.col("s_suppkey") % 7 == 0, F.lit("2000-06-15").cast("date"))
    return own.select(F.col("s_suppkey").alias("agent_id"), F.col("s_name").alias("agent_name"), joined.alias("joined_on"), left.alias("inactive_on"), F.when(F.col("s_suppkey") % 2 == 0, "salary").otherwise("commission").alias("initial_type"))


def performance(spark: SparkSession, folder: str) -> DataFrame:
    months = read_table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("agent_id"), F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month_start"))
    own = months.agg(F.sum((F.col("l_extendedprice") * 100).cast("decimal(18,0)").cast("long")).alias("premium"), F.count(F.lit(1)).alias("policies"))
    status = F.when((F.col("agent_id") + F.month("month_start")) % 29 == 0, "PENDING").otherwise("COMPLETE")
    return own.withColumns({"status": status, "month_closed": F.lit(True)})


def evaluated(spark: SparkSession, folder: str) -> DataFrame:
    own = K.with_one_rule(performance(spark, folder).join(agents(spark, folder), "agent_id"), F.broadcast(rules(spark)))  # the list of rules above
    return K.with_streaks(K.judged(own, K.is_pending(F.lit("2001-06-30").cast("date"))))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return K.contract_events(evaluated(spark, folder))


def owned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders of customers by month, and three rules that follow one another for each customer; the last has no end."""
    own = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("owner_id"))
    turn, end = F.expr("date_add(date'1994-01-01', cast(owner_id % 900 as int))"), F.expr("date_add(date'1996-06-01', cast(owner_id % 500 as int))")
    each = [("a", F.lit("1900-01-01").cast("date"), F.date_sub(turn, 1)), ("b", turn, F.date_sub(end, 1)), ("c", end, F.lit(None).cast("date"))]
    rules_ = own.select("owner_id", F.explode(F.array(*(F.struct(F.concat(F.lit(n), F.col("owner_id")).alias("rule_id"), a.alias("valid_from"), b.alias("valid_to")) for n, a, b in each))).alias("r")).select("owner_id", "r.*")
    months = read_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("owner_id"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month_start")).agg(F.count(F.lit(1)).alias("n"))
    return months, rules_


_VALUES = ", ".join(f"('{r}', DATE '{a}', {f"DATE '{b}'" if b else 'NULL'}, {p}, {n}, {q})" for r, a, b, p, n, q in RULES)
CHAIN = f"""WITH rules(rule_id, valid_from, valid_to, premium_over, policies_over, required) AS (VALUES {_VALUES}),
agents AS (SELECT s_suppkey AS agent_id, s_name AS agent_name, CAST(DATE '1994-12-20' + CAST(s_suppkey % 40 AS INTEGER) AS DATE) AS joined_on,
  CASE WHEN s_suppkey % 7 = 0 THEN DATE '2000-06-15' END AS inactive_on, CASE WHEN s_suppkey % 2 = 0 THEN 'salary' ELSE 'commission' END AS initial_type FROM supplier),
perf AS (SELECT l_suppkey AS agent_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start, CAST(sum(CAST(CAST(l_extendedprice * 100 AS DECIMAL(18,0)) AS BIGINT)) AS BIGINT) AS premium, count(*) AS policies FROM lineitem GROUP BY 1, 2),
judged AS (SELECT *, CASE WHEN (agent_id + month(month_start)) % 29 = 0 OR joined_on > month_start OR coalesce(inactive_on < last_day(month_start), false) OR rule_id IS NULL OR last_day(month_start) > DATE '2001-06-30' THEN 'PENDING'
    WHEN premium > premium_over AND policies > policies_over THEN 'PASS' ELSE 'FAIL' END AS result
  FROM perf JOIN agents USING (agent_id) LEFT JOIN rules ON valid_from <= month_start AND (valid_to IS NULL OR month_start <= valid_to)),
marked AS (SELECT *, CASE WHEN (year(month_start) * 12 + month(month_start)) - lag(year(month_start) * 12 + month(month_start)) OVER o = 1 AND lag(rule_id) OVER o = rule_id AND lag(result) OVER o = result AND result <> 'PENDING' THEN 0 ELSE 1 END AS broken
  FROM judged WINDOW o AS (PARTITION BY agent_id ORDER BY month_start)),
islands AS (SELECT *, sum(broken) OVER (PARTITION BY agent_id ORDER BY month_start) AS island FROM marked),
streaks AS (SELECT *, CASE WHEN result = 'PASS' THEN row_number() OVER r ELSE 0 END AS pass_streak, CASE WHEN result = 'FAIL' THEN row_number() OVER r ELSE 0 END AS fail_streak FROM islands WINDOW r AS (PARTITION BY agent_id, island ORDER BY month_start)),
targets AS (SELECT *, CASE WHEN pass_streak >= required THEN 'salary' WHEN fail_streak >= required THEN 'commission' END AS to_type FROM streaks),
moves AS (SELECT *, coalesce(last_value(to_type IGNORE NULLS) OVER (PARTITION BY agent_id ORDER BY month_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), initial_type) AS from_type FROM targets),
events AS (SELECT agent_id, from_type, to_type, CAST(month_start + INTERVAL 1 MONTH AS DATE) AS effective_from, month_start FROM moves WHERE to_type IS NOT NULL AND to_type <> from_type) """

_OWNED = """WITH own AS (SELECT c_custkey AS owner_id, DATE '1994-01-01' + CAST(c_custkey % 900 AS INTEGER) AS turn, DATE '1996-06-01' + CAST(c_custkey % 500 AS INTEGER) AS ends FROM customer),
rules AS (SELECT owner_id, 'a' || owner_id AS rule_id, DATE '1900-01-01' AS valid_from, turn - 1 AS valid_to FROM own UNION ALL SELECT owner_id, 'b' || owner_id, turn, ends - 1 FROM own UNION ALL SELECT owner_id, 'c' || owner_id, ends, NULL FROM own),
months AS (SELECT o_custkey AS owner_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, count(*) AS n FROM orders GROUP BY 1, 2) """

QUERIES = {
    "kpi_monthly": lambda s, d: evaluated(s, d).select("agent_id", "month_start", "rule_id", "premium", "policies", "result", "pass_streak", "fail_streak"),
    "kpi_contract_events": _events,
    "kpi_report": lambda s, d: K.reported(agents(s, d), evaluated(s, d).drop("agent_name")),
    "kpi_report_joined": lambda s, d: K.kpi_report(agents(s, d), evaluated(s, d).select("agent_id", "month_start", "premium", "policies", "result", "pass_streak", "fail_streak").withColumn("is_current", F.lit(True)), _events(s, d).withColumn("superseded_at", F.when(F.col("agent_id") % 5 == 0, F.lit("2002-01-01").cast("date")))),
    "owner_rules": lambda s, d: K.with_owner_rule(*owned(s, d)).select("owner_id", "month_start", "n", "rule_id"),
    "owner_rule_overlaps": lambda s, d: K.overlapping_rules(owned(s, d)[1].unionByName(owned(s, d)[1].where("owner_id % 7 = 0 and rule_id like 'a%'").withColumns({"rule_id": F.concat(F.lit("x"), "rule_id"), "valid_from": F.date_add("valid_from", 400)})), "owner_id"),
    "kpi_overlapping_rules": lambda s, d: K.overlapping_rules(rules(s).unionByName(s.sql("SELECT 'r3' rule_id, date'1999-01-01' valid_from, cast(null as date) valid_to, 1L premium_over, 1L policies_over, 1L required"))),
    "kpi_performance_errors": lambda s, d: performance(s, d).withColumn("premium", F.when(F.col("policies") % 5 == 0, -F.col("premium")).otherwise(F.col("premium"))).withColumn("errors", K.performance_errors()).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("records")),
    "kpi_agent_errors": lambda s, d: performance(s, d).withColumn("source_kind", F.when(F.col("policies") % 7 == 0, "guess").otherwise("external")).join(agents(s, d), "agent_id", "left").withColumn("errors", K.performance_errors(with_agent=True)).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("records")),
}
ORACLE_SQL = {
    "kpi_monthly": CHAIN + "SELECT agent_id, month_start, rule_id, premium, policies, result, pass_streak, fail_streak FROM streaks",
    "kpi_contract_events": CHAIN + "SELECT * FROM events",
    "kpi_report": CHAIN + "SELECT s.agent_id, agent_name, s.month_start, s.premium / 100.0 AS premium, policies, result, pass_streak, fail_streak, e.to_type FROM streaks s LEFT JOIN events e ON s.agent_id = e.agent_id AND s.month_start = e.effective_from",
    "kpi_report_joined": CHAIN + "SELECT s.agent_id, agent_name, s.month_start, s.premium / 100.0 AS premium, policies, result, pass_streak, fail_streak, e.to_type FROM streaks s LEFT JOIN events e ON s.agent_id = e.agent_id AND s.month_start = e.effective_from AND e.agent_id % 5 <> 0",
    "owner_rules": _OWNED + "SELECT m.owner_id, m.month_start, m.n, r.rule_id FROM months m JOIN rules r ON r.owner_id = m.owner_id AND r.valid_from <= m.month_start AND (r.valid_to IS NULL OR m.month_start <= r.valid_to)",
    "owner_rule_overlaps": _OWNED + ", every AS (SELECT * FROM rules UNION ALL SELECT owner_id, 'x' || rule_id, valid_from + 400, valid_to FROM rules WHERE owner_id % 7 = 0 AND rule_id LIKE 'a%'), m AS (SELECT owner_id, rule_id, valid_from, lag(rule_id) OVER o AS earlier, lag(valid_to) OVER o AS earlier_to FROM every WINDOW o AS (PARTITION BY owner_id ORDER BY valid_from, rule_id)) SELECT owner_id, earlier, rule_id FROM m WHERE earlier IS NOT NULL AND (earlier_to IS NULL OR earlier_to >= valid_from)",
    "kpi_overlapping_rules": f"WITH rules(rule_id, valid_from, valid_to, a, b, c) AS (VALUES {_VALUES}, ('r3', DATE '1999-01-01', NULL, 1, 1, 1)), m AS (SELECT rule_id, valid_from, lag(rule_id) OVER o AS earlier, lag(valid_to) OVER o AS earlier_to FROM rules WINDOW o AS (ORDER BY valid_from, rule_id)) SELECT earlier, rule_id FROM m WHERE earlier IS NOT NULL AND (earlier_to IS NULL OR earlier_to >= valid_from)",
    "kpi_performance_errors": "WITH p AS (SELECT l_suppkey, date_trunc('month', l_shipdate) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT 'negative' AS error, count(*) AS records FROM p WHERE n % 5 = 0",
    "kpi_agent_errors": CHAIN + "SELECT error, count(*) AS records FROM (SELECT unnest([CASE WHEN policies % 7 = 0 THEN 'source' END, CASE WHEN month_start < date_trunc('month', joined_on) THEN 'before joining' END, CASE WHEN month_start > date_trunc('month', inactive_on) THEN 'after leaving' END]) AS error FROM perf JOIN agents USING (agent_id)) WHERE error IS NOT NULL GROUP BY 1",
}
