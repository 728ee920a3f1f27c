"""Monthly performance rules: evaluation, streaks and contract transitions as windows over (agent, month)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def with_rule(performance: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule valid in each month; rules are a short list (rule_id, valid_from, valid_to, thresholds, required).

    A month without a rule keeps null rule columns; with non-overlapping rules a month has at most one.
    """
    month = F.col("month_start")
    held = (F.col("valid_from") <= month) & (F.col("valid_to").isNull() | (month <= F.col("valid_to")))
    return performance.join(rules, held, "left")


def with_one_rule(performance: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule valid in each month; a month with no rule or with several is refused: the query fails and names it.

    The short list of rules is one row beside each month, in which a month finds its own: no join by ranges, and months are read
    once. For rules of many owners there is ``with_owner_rule``.
    """
    rule = rules.columns
    listed = rules.agg(F.collect_list(F.struct(*rule)).alias("rules_"))
    month = F.col("month_start")
    held = performance.crossJoin(F.broadcast(listed)).withColumn("rules_", F.filter("rules_", lambda r: (r["valid_from"] <= month) & (r["valid_to"].isNull() | (month <= r["valid_to"]))))
    return _one_of(held, performance.columns, rule)


def _one_of(held: DataFrame, columns: list[str], rule: list[str]) -> DataFrame:
    """The only rule of each row's list ``rules_``; any other number of them is refused."""
    refusal = F.raise_error(F.concat(F.lit("exactly one rule must be valid in "), F.col("month_start").cast("string")))
    one = F.when(F.size("rules_") == 1, F.get("rules_", F.lit(0))).otherwise(refusal)
    return held.withColumn("rule_", one).select(*columns, *[F.col("rule_")[c].alias(c) for c in rule])


def with_owner_rule(performance: DataFrame, rules: DataFrame, owner: str = "owner_id") -> DataFrame:
    """The rule of each row's owner that is valid in its month, for any number of owners and rules; refused as in ``with_one_rule``.

    The days on which an owner's rules begin and have ended stand between the owner's months in one order. A window counts the rules
    that are open and sums their numbers: where one is open the sum is its number, by which it is joined. Owners are dealt by shuffles
    and nothing is broadcast, however long the intervals. Rows without an owner have no rule and are refused.
    """
    rule = [c for c in rules.columns if c != owner]
    number = F.row_number().over(W.partitionBy(owner).orderBy("valid_from", "valid_to")).cast("long")
    held = rules.where(f"{owner} is not null and valid_from is not null and (valid_to is null or valid_to >= valid_from)").withColumn("number_", number)
    none = F.lit(None).cast(performance.select(F.struct(*performance.columns)).schema[0].dataType)
    opened, closed = (F.struct(day.alias("day_"), F.lit(sign).alias("sign_")) for day, sign in ((F.col("valid_from"), 1), (F.date_add("valid_to", 1), -1)))
    days = held.select(owner, "number_", F.explode(F.array(opened, closed)).alias("d")).where("d.day_ is not null").select(owner, "d.day_", "d.sign_", "number_", none.alias("row_"))
    months = performance.select(owner, F.col("month_start").alias("day_"), F.lit(0).alias("sign_"), F.lit(0).cast("long").alias("number_"), F.struct(*performance.columns).alias("row_"))
    line = W.partitionBy(owner).orderBy("day_", F.col("sign_") == 0).rowsBetween(W.unboundedPreceding, 0)  # a day's changes go before its months
    told = days.unionByName(months).withColumns({"open_": F.sum("sign_").over(line), "sum_": F.sum(F.col("sign_") * F.col("number_")).over(line)}).where("sign_ = 0")
    asked = told.select(owner, F.when((F.col("open_") == 1) & F.col("day_").isNotNull(), F.col("sum_")).alias("number_"), "row_")
    met = asked.join(held.select(owner, "number_", F.struct(*rule).alias("rule_")).hint("merge"), [owner, "number_"], "left")
    return _one_of(met.select("row_.*", F.when(F.col("rule_").isNull(), F.array()).otherwise(F.array("rule_")).alias("rules_")), performance.columns, rule)


def overlapping_rules(rules: DataFrame, owner: str | None = None) -> DataFrame:
    """Pairs (earlier, rule_id), with the owner if rules have one, of rules that begin before the one before has ended.

    With an owner each owner's rules are gone through apart. Without one the rules are a short list and one task orders it.
    """
    keys = [owner] if owner else []
    order = W.partitionBy(*keys).orderBy("valid_from", "rule_id")
    marked = rules.withColumns({"earlier": F.lag("rule_id").over(order), "earlier_to": F.lag("valid_to").over(order)})
    return marked.where("earlier is not null and (earlier_to is null or earlier_to >= valid_from)").select(*keys, "earlier", "rule_id")


def rule_errors(operator: Column | None = None) -> Column:
    """Names of the checks that a rule row breaks; operator: how it compares, which must be strictly."""
    checks = {"streak": F.col("required") < 1, "premium": F.col("premium_over") < 0, "policies": F.col("policies_over") < 0, "range": F.col("valid_to") < F.col("valid_from")}
    if operator is not None:
        checks["operator"] = ~operator.eqNullSafe(">")
    return F.filter(F.array(*[F.when(bad, name) for name, bad in checks.items()]), lambda x: x.isNotNull())


def performance_errors(with_agent: bool = False) -> Column:
    """Names of the checks that a performance row breaks; repeated months are told by a window.

    with_agent: check source_kind too, and against the agent's columns, joined from the left, that there is one
    (agent_name) and that the month is neither before joined_on's nor after inactive_on's.
    """
    checks = {
        "first of month": F.col("month_start") != F.trunc("month_start", "MM"),
        "status": ~F.coalesce(F.col("status").isin("COMPLETE", "PENDING"), F.lit(False)),
        "negative": (F.col("premium") < 0) | (F.col("policies") < 0),
        "whole": (F.col("premium") != F.floor("premium")) | (F.col("policies") != F.floor("policies")),
        "incomplete": (F.col("status") == "COMPLETE") & (F.col("premium").isNull() | F.col("policies").isNull()),
        "repeated month": F.count(F.lit(1)).over(W.partitionBy("agent_id", "month_start")) > 1,
    }
    if with_agent:
        checks |= {
            "source": ~F.coalesce(F.col("source_kind").isin("synthetic", "external"), F.lit(False)),
            "agent": F.col("agent_name").isNull(),
            "before joining": F.col("month_start") < F.trunc("joined_on", "MM"),
            "after leaving": F.col("month_start") > F.trunc("inactive_on", "MM"),
        }
    return F.filter(F.array(*[F.when(bad, name) for name, bad in checks.items()]), lambda x: x.isNotNull())


def is_pending(closed_through: Column | None = None) -> Column:
    """Whether a month cannot be judged: no figures, not closed, or the agent joined in it or left before its end."""
    month, end = F.col("month_start"), F.last_day("month_start")
    pending = (F.col("status") == "PENDING") | ~F.col("month_closed") | (F.col("joined_on") > month) | (F.col("inactive_on") < end) | F.col("rule_id").isNull()
    if closed_through is not None:
        pending = pending | (end > closed_through)
    return F.coalesce(pending, F.lit(False))


def judged(ruled: DataFrame, pending: Column) -> DataFrame:
    """result PASS, FAIL or PENDING; both thresholds must be exceeded."""
    passed = (F.col("premium") > F.col("premium_over")) & (F.col("policies") > F.col("policies_over"))
    return ruled.withColumn("result", F.when(pending, "PENDING").when(passed, "PASS").otherwise("FAIL"))


def with_streaks(results: DataFrame) -> DataFrame:
    """pass_streak and fail_streak: runs of equal results in consecutive months under one rule."""
    order = W.partitionBy("agent_id").orderBy("month_start")
    goes_on = (month_number(F.col("month_start")) - F.lag(month_number(F.col("month_start"))).over(order) == 1) & (F.lag("rule_id").over(order) == F.col("rule_id")) & (F.lag("result").over(order) == F.col("result")) & (F.col("result") != "PENDING")
    broken = results.withColumn("broken", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    islands = broken.withColumn("island", F.sum("broken").over(order.rowsBetween(W.unboundedPreceding, 0)))
    n = F.row_number().over(W.partitionBy("agent_id", "island").orderBy("month_start")).cast("long")
    zero = F.lit(0).cast("long")
    return islands.withColumns({"pass_streak": F.when(F.col("result") == "PASS", n).otherwise(zero), "fail_streak": F.when(F.col("result") == "FAIL", n).otherwise(zero)}).drop("broken", "island")


def contract_events(streaks: DataFrame) -> DataFrame:
    """Transitions (agent_id, from_type, to_type, effective_from, month_start): a streak of the length that the rule asks for changes the contract from the next month."""
    order = W.partitionBy("agent_id").orderBy("month_start")
    target = F.when(F.col("pass_streak") >= F.col("required"), "salary").when(F.col("fail_streak") >= F.col("required"), "commission")
    marked = streaks.withColumn("to_type", target)
    before = F.coalesce(F.last("to_type", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("initial_type"))
    marked = marked.withColumn("from_type", before).where("to_type is not null and to_type <> from_type")
    return marked.select("agent_id", "from_type", "to_type", F.add_months(F.trunc("month_start", "MM"), 1).alias("effective_from"), "month_start")


def reported(agents: DataFrame, streaks: DataFrame) -> DataFrame:
    """The report of ``kpi_report`` straight from the judged months: an event takes effect in the month behind its own.

    So the event that meets a month is that of the row before it, if that is of the month before: a window, and no second reading of
    the months.
    """
    order = W.partitionBy("agent_id").orderBy("month_start")
    target = F.when(F.col("pass_streak") >= F.col("required"), "salary").when(F.col("fail_streak") >= F.col("required"), "commission")
    marked = streaks.withColumn("target", target)
    before = F.coalesce(F.last("target", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("initial_type"))
    moved = marked.withColumn("moved", F.when(F.col("target") != before, F.col("target")))
    follows = month_number(F.col("month_start")) - F.lag(month_number(F.col("month_start"))).over(order) == 1
    told = moved.withColumn("to_type", F.when(follows, F.lag("moved").over(order)))
    joined = agents.select("agent_id", "agent_name").join(told, "agent_id")
    return joined.select("agent_id", "agent_name", "month_start", (F.col("premium") / 100.0).alias("premium"), "policies", "result", "pass_streak", "fail_streak", "to_type").orderBy("agent_id", "month_start")


def kpi_report(agents: DataFrame, results: DataFrame, events: DataFrame) -> DataFrame:
    """Each agent's months with the contract event that takes effect in them, if any; money in units of 100; in order.

    Where results have ``is_current`` and events ``superseded_at``, only current ones meet; both are conditions of the
    joins, so that a month whose event is superseded stays without one.
    """
    results = results.where("is_current") if "is_current" in results.columns else results
    events = events.where("superseded_at is null") if "superseded_at" in events.columns else events
    joined = agents.join(results, "agent_id").join(events.select("agent_id", F.col("effective_from").alias("month_start"), "to_type"), ["agent_id", "month_start"], "left")
    return joined.select("agent_id", "agent_name", "month_start", (F.col("premium") / 100.0).alias("premium"), "policies", "result", "pass_streak", "fail_streak", "to_type").orderBy("agent_id", "month_start")
