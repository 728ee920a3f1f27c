"""Changes of tables as functions that return the next state, and constraints as queries for what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of some columns as text; null and the empty text differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]), 256)


def latest(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return frame.withColumn("place_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("place_ = 1").drop("place_")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``incoming`` replace those of ``current`` with their key; others are kept or added.

    Of incoming rows with one key the first in the order stays (by default that with the largest content hash). Null
    keys are equal to each other.
    """
    first = latest(incoming, keys, order or [content_hash(incoming.columns).desc()])
    came = first.select(*[F.col(k).alias(f"{k}_new_") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_new_"))
    return current.join(came, same, "left_anti").unionByName(first)


def insert_or_ignore(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` with new keys are added."""
    return current.unionByName(incoming.join(current.select(*keys).distinct(), keys, "left_anti"))


def changed_versions(current: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose columns differ in ``incoming``: what an immutable table must refuse."""
    own = current.select(*keys, content_hash(columns).alias("own_"))
    return incoming.select(*keys, content_hash(columns).alias("new_")).join(own, keys).where("own_ <> new_").select(*keys)


def next_revisions(history: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A versioned table (keys, columns, revision, is_current) after new content: changed keys get a new current revision.

    Unchanged content adds nothing, so that a second run gives the same table.
    """
    current = history.where("is_current").select(*keys, content_hash(columns).alias("own_"), F.col("revision").alias("last_"))
    compared = incoming.withColumn("new_", content_hash(columns)).join(current, keys, "left")
    fresh = compared.where("own_ is null or own_ <> new_").select(*keys, *columns, (F.coalesce("last_", F.lit(0)) + 1).cast("long").alias("revision"), F.lit(True).alias("is_current"))
    closed = history.join(fresh.select(*keys, F.lit(True).alias("closed_")), keys, "left").withColumn("is_current", F.col("is_current") & F.col("closed_").isNull()).drop("closed_")
    return closed.select(*keys, *columns, "revision", "is_current").unionByName(fresh)


def revision_numbers(changes: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """revision: one more whenever the content differs from the row before."""
    line = W.partitionBy(*keys).orderBy(*order)
    hashed = changes.withColumn("hash_", content_hash(columns))
    moved = hashed.withColumn("moved_", F.coalesce((F.col("hash_") != F.lag("hash_").over(line)).cast("int"), F.lit(0)))
    return moved.withColumn("revision", (F.sum("moved_").over(line.rowsBetween(W.unboundedPreceding, 0)) + 1).cast("long")).drop("hash_", "moved_")


def reconcile(stored: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """stored (keys, superseded) against what is derived now: keys with action keep, supersede, revive or insert."""
    both = stored.withColumn("was_", F.lit(True)).join(derived.select(*keys).distinct().withColumn("is_", F.lit(True)), keys, "full_outer")
    action = F.when(F.col("was_").isNull(), "insert").when(F.col("is_").isNull() & ~F.col("superseded"), "supersede").when(F.col("is_").isNotNull() & F.col("superseded"), "revive").otherwise("keep")
    return both.select(*keys, action.alias("action"))


def conflicting_requests(requests: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Request ids that came with different contents."""
    return requests.groupBy(id_col).agg(F.count_distinct(content_hash(columns)).alias("contents")).where("contents > 1")


def claims(attempts: DataFrame, case_col: str, staff_col: str, time_col: str) -> DataFrame:
    """The first who claimed each case wins it; ties go to the smaller name."""
    winner = F.min(F.struct(F.col(time_col), F.col(staff_col).alias("staff_")))
    return attempts.groupBy(case_col).agg(winner["staff_"].alias("winner"), F.count(F.lit(1)).alias("attempts"))


def violations(frame: DataFrame, checks: dict[str, str]) -> DataFrame:
    """(check, violations) of CHECK constraints given as conditions; like in SQL a null condition does not break one."""
    counted = frame.agg(*[F.count_if(~F.expr(c)).alias(n) for n, c in checks.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])).alias("c")).select("c.*")


def repeated_keys(frame: DataFrame, keys: list[str], where: str | None = None) -> DataFrame:
    """Keys that a (partial) UNIQUE constraint forbids; keys with a null are never equal."""
    kept = frame.where(where) if where else frame
    return kept.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key is in no row of ``parent``; null keys are none."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def closed_by_owner(sessions: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions with status closed where a request names both the session and its owner; others as they are."""
    asked = requests.select(*keys).distinct().withColumn("asked_", F.lit(True))
    return sessions.join(asked, keys, "left").withColumn("status", F.when(F.col("asked_"), "closed").otherwise(F.col("status"))).drop("asked_")


def copied(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``source`` put in, by the columns that both have."""
    shared = [c for c in target.columns if c in source.columns]
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source.select(*shared), allowMissingColumns=True)


def migrated(frame: DataFrame, renamed: dict[str, str], added: dict[str, str]) -> DataFrame:
    """Columns renamed, and columns with an expression for their first value added where they are missing."""
    out = frame.withColumnsRenamed({a: b for a, b in renamed.items() if a in frame.columns})
    return out.withColumns({c: F.expr(e) for c, e in added.items() if c not in out.columns})
