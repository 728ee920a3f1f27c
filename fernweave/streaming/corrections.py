"""Late corrections of monthly figures as a stream: each batch revises what it changes, once, and keeps what was said before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.operators import kpi as K
from fernweave.operators.stored import BUCKET, merge_stored, read_stored
from fernweave.operators.tables import content_hash, latest, next_revisions

MONTH = ["agent_id", "month_start"]
FIGURES = ["premium", "policies", "status", "month_closed"]
JUDGED = ["rule_id", *FIGURES, "result", "pass_streak", "fail_streak"]
EVENT = ["agent_id", "effective_from", "to_type"]


def with_input_revisions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Months by key, the incoming ones in the place of stored ones; changed figures raise input_revision by one."""
    had = current.select(*MONTH, content_hash(FIGURES).alias("had_"), F.col("input_revision").alias("last_"))
    came = incoming.select(*MONTH, *FIGURES).join(had, MONTH, "left")
    same = F.col("had_") == content_hash(FIGURES)
    revision = F.when(F.col("last_").isNull(), 1).when(same, F.col("last_")).otherwise(F.col("last_") + 1).cast("long")
    return current.join(incoming.select(*MONTH), MONTH, "left_anti").unionByName(came.select(*MONTH, *FIGURES, revision.alias("input_revision")))


def reconciled_events(current: DataFrame, derived: DataFrame, touched: DataFrame) -> DataFrame:
    """Transitions after a batch: those that are derived no more are superseded, those derived again revived, new ones added.

    touched: the agents whose months came; events of other agents stay as they are.
    """
    others = current.join(touched, "agent_id", "left_anti")
    own = current.join(touched, "agent_id", "left_semi").select(*EVENT, F.col("from_type").alias("was_from_"), F.lit(True).alias("was_"))
    both = own.join(derived.select(*EVENT, "from_type"), EVENT, "full_outer")
    return others.unionByName(both.select(*EVENT, F.coalesce("from_type", "was_from_").alias("from_type"), F.col("from_type").isNull().alias("superseded")))


def correct(spark: SparkSession, folder: str, batch: DataFrame, batch_id: int, agents: DataFrame, rules: DataFrame, closed_through: str | None = None, buckets: int = 64) -> bool:
    """Take one batch of months (agent_id, month_start, premium, policies, status, month_closed) into the tables of ``folder``.

    ``performance`` keeps the last figures, ``evaluations`` every revision of each month's result, ``events`` the transitions
    and which are superseded. All months of the agents in the batch are judged again, so a late month moves the streaks
    behind it. Returns whether anything was done: a batch id that was taken before changes nothing, and one that broke off
    on its way is made again with the same outcome. Of equal months in a batch the one with the largest content hash stays.
    """
    done = f"{folder}/batches"
    taken = _taken(spark, done)
    if taken is not None and taken.where(F.col("batch_id") == batch_id).limit(1).count():
        return False
    came = latest(batch.select(*MONTH, *FIGURES), MONTH, [content_hash(FIGURES).desc()]).persist()
    try:
        place = ["agent_id"]
        months = came.withColumn("input_revision", F.lit(1).cast("long"))
        written = merge_stored(spark, f"{folder}/performance", months, place, buckets, lambda now, new: with_input_revisions(now, new) if now.columns else new)
        touched = came.select("agent_id").distinct()
        stored = read_stored(spark, f"{folder}/performance").where(F.col(BUCKET).isin(written)).drop(BUCKET).join(touched, "agent_id", "left_semi")
        ruled = K.with_one_rule(stored.join(agents, "agent_id"), rules)
        judged = K.with_streaks(K.judged(ruled, K.is_pending(F.lit(closed_through).cast("date") if closed_through else None)))
        evaluations = judged.select(*MONTH, *JUDGED)
        first = evaluations.withColumns({"revision": F.lit(1).cast("long"), "is_current": F.lit(True)})
        merge_stored(spark, f"{folder}/evaluations", first, place, buckets, lambda now, new: next_revisions(now, new.drop("revision", "is_current"), MONTH, JUDGED), written)
        events = K.contract_events(judged).select(*EVENT, "from_type")
        # agents whose last event fell away have no derived row, so their buckets are touched by name
        named = touched.select("agent_id", F.lit(None).cast("date").alias("effective_from"), F.lit(None).cast("string").alias("to_type"), F.lit(None).cast("string").alias("from_type"))
        merge_stored(spark, f"{folder}/events", events.unionByName(named).withColumn("superseded", F.lit(False)), place, buckets, lambda now, new: reconciled_events(now, new.where("to_type is not null"), touched), written)
    finally:
        came.unpersist()
    spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")).write.mode("append").parquet(done)
    return True


def _taken(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("batch_id long").parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def corrections_sink(folder: str, agents: Callable[[SparkSession], DataFrame], rules: Callable[[SparkSession], DataFrame], closed_through: str | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: agents and rules are read anew for each batch."""

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        correct(spark, folder, batch, batch_id, agents(spark), rules(spark), closed_through, buckets)

    return take


def run_corrections(stream: DataFrame, folder: str, agents: Callable[[SparkSession], DataFrame], rules: Callable[[SparkSession], DataFrame], closed_through: str | None = None, buckets: int = 64) -> None:
    """Take all batches that a stream of months has now; the next run goes on behind them."""
    sink = corrections_sink(folder, agents, rules, closed_through, buckets)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
