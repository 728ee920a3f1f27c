"""Stored tables that change by buckets, and late corrections that come as a stream."""

import datetime
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fernweave.operators import kpi, stored
from fernweave.streaming import corrections, runs


def times(folder):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_merge_writes_touched_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    base = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    assert len(stored.merge_stored(spark, path, base, ["k"], 16)) == 16
    before = times(tmp_path)
    change = spark.createDataFrame([(3, 100), (900, 1)], "k long, v long")
    written = stored.merge_stored(spark, path, change, ["k"], 16)
    after = times(tmp_path)
    untouched = {p for p in before if not any(f"/bucket={k}/" in p for k in written)}
    assert len(written) <= 2 and untouched and all(after[p] == before[p] for p in untouched)
    want = sorted([(k, k % 7) for k in range(500) if k != 3] + [(3, 100), (900, 1)])
    assert sorted(map(tuple, stored.read_stored(spark, path).select("k", "v").collect())) == want
    stored.merge_stored(spark, path, change, ["k"], 16)  # once more: the same table
    assert sorted(map(tuple, stored.read_stored(spark, path).select("k", "v").collect())) == want
    assert stored.merge_stored(spark, path, change.limit(0), ["k"], 16) == []


def test_refresh_drops_stale_rows_and_whole_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    base = spark.range(60).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.col("id").cast("string").alias("text"))
    stored.refresh_stored(spark, path, base, ["chunk_id"], 32)
    before = times(tmp_path)
    assert stored.refresh_stored(spark, path, base, ["chunk_id"], 32) == [] and times(tmp_path) == before
    kept = base.where("chunk_id not in ('c1', 'c2', 'c3', 'c4', 'c5')").withColumn("text", F.when(F.col("chunk_id") == "c9", "new").otherwise(F.col("text")))
    written = stored.refresh_stored(spark, path, kept, ["chunk_id"], 32)
    assert 1 <= len(written) <= 6 and rows(stored.read_stored(spark, path).select("chunk_id", "text")) == rows(kept)
    few = base.where("chunk_id = 'c9'")
    stored.refresh_stored(spark, path, few, ["chunk_id"], 32)
    assert rows(stored.read_stored(spark, path).select("chunk_id", "text")) == [("c9", "9")]
    assert len(list(Path(tmp_path).rglob("bucket=*"))) == 1


MONTHS = "agent_id long, month_start date, premium long, policies long, status string, month_closed boolean"


def month(k):
    return datetime.date(2024 + k // 12, k % 12 + 1, 1)


def agents(spark):
    return spark.createDataFrame([(a, f"A{a}", datetime.date(2023, 1, 1), None, "commission") for a in range(1, 4)], "agent_id long, agent_name string, joined_on date, inactive_on date, initial_type string")


def rules(spark):
    return spark.createDataFrame([("r", datetime.date(2020, 1, 1), None, 10, 1, 3)], "rule_id string, valid_from date, valid_to date, premium_over long, policies_over long, required long")


def figures(agent, passes):
    return [(agent, month(k), 20 if ok else 5, 5, "COMPLETE", True) for k, ok in enumerate(passes)]


@pytest.fixture
def first():
    return figures(1, [1, 1, 1, 1]) + figures(2, [0, 0, 0]) + figures(3, [1, 0, 1])


def state(spark, folder):
    read = lambda name, *c: sorted(map(tuple, stored.read_stored(spark, f"{folder}/{name}").select(*c).collect()), key=str)
    return (
        read("performance", "agent_id", "month_start", "premium", "input_revision"),
        read("evaluations", "agent_id", "month_start", "result", "pass_streak", "fail_streak", "revision", "is_current"),
        read("events", "agent_id", "effective_from", "from_type", "to_type", "superseded"),
    )


def test_a_late_month_gives_one_new_current_revision(spark, tmp_path, first):
    folder = f"file://{tmp_path}"
    assert corrections.correct(spark, folder, spark.createDataFrame(first, MONTHS), 0, agents(spark), rules(spark), buckets=8)
    assert state(spark, folder)[2] == [(1, month(3), "commission", "salary", False)]
    before = times(tmp_path)
    late = spark.createDataFrame([(1, month(1), 5, 5, "COMPLETE", True)], MONTHS)  # agent 1 failed in the second month after all
    assert corrections.correct(spark, folder, late, 1, agents(spark), rules(spark), buckets=8)
    performance, evaluations, events = state(spark, folder)
    assert [r for r in performance if r[3] > 1] == [(1, month(1), 5, 2)]
    of_month = [r for r in evaluations if r[0] == 1 and r[1] == month(1)]
    assert [(r[2], r[5], r[6]) for r in of_month] == [("FAIL", 2, True), ("PASS", 1, False)]
    assert sum(r[6] for r in evaluations) == 10  # one current row a month
    assert [r for r in evaluations if r[0] != 1 and r[5] > 1] == []
    assert events == [(1, month(3), "commission", "salary", True)]  # two passes behind the failure are too few
    other = [p for p in before if "/batches/" not in p and os.path.exists(p) and times(tmp_path)[p] == before[p]]
    assert other  # buckets of other agents kept their files
    held = state(spark, folder)
    assert not corrections.correct(spark, folder, late, 1, agents(spark), rules(spark), buckets=8)  # the same batch once more
    assert corrections.correct(spark, folder, late, 2, agents(spark), rules(spark), buckets=8) and state(spark, folder) == held  # its rows as another
    back = spark.createDataFrame([(1, month(1), 20, 5, "COMPLETE", True)], MONTHS)
    corrections.correct(spark, folder, back, 3, agents(spark), rules(spark), buckets=8)
    performance, evaluations, events = state(spark, folder)
    assert events == [(1, month(3), "commission", "salary", False)]  # revived, not added
    assert sorted((r[5], r[6]) for r in evaluations if r[0] == 1 and r[1] == month(1)) == [(1, False), (2, False), (3, True)]


def test_corrections_as_a_stream_with_a_restart(spark, tmp_path, first):
    folder, one = f"file://{tmp_path}/stream", f"file://{tmp_path}/once"
    late = [(1, month(1), 5, 5, "COMPLETE", True), (2, month(3), 1, 1, "PENDING", True)]
    for k, part in enumerate([first[:5], first[5:], late]):
        spark.createDataFrame(part, MONTHS).coalesce(1).write.parquet(f"{folder}/in/{k}")
        corrections.run_corrections(runs.file_stream(spark, f"{folder}/in/*", MONTHS, 1), folder, agents, rules, buckets=4)
    corrections.correct(spark, one, spark.createDataFrame(first, MONTHS), 0, agents(spark), rules(spark), buckets=4)
    corrections.correct(spark, one, spark.createDataFrame(late, MONTHS), 1, agents(spark), rules(spark), buckets=4)
    mine, other = state(spark, folder), state(spark, one)
    assert mine[0] == other[0] and mine[2] == other[2]
    assert [r[:5] for r in mine[1] if r[6]] == [r[:5] for r in other[1] if r[6]]
    batch = kpi.with_streaks(kpi.judged(kpi.with_one_rule(stored.read_stored(spark, f"{one}/performance").drop("bucket").join(agents(spark), "agent_id"), rules(spark)), kpi.is_pending()))
    assert [r[:5] for r in mine[1] if r[6]] == sorted(map(tuple, batch.select("agent_id", "month_start", "result", "pass_streak", "fail_streak").collect()), key=str)


def test_judged_months_are_not_made_once_more_to_find_their_buckets(spark, tmp_path, first, monkeypatch):
    known, merge = [], corrections.merge_stored
    monkeypatch.setattr(corrections, "merge_stored", lambda *given: known.append(given[6] if len(given) > 6 else None) or merge(*given))
    corrections.correct(spark, f"file://{tmp_path}", spark.createDataFrame(first, MONTHS), 0, agents(spark), rules(spark), buckets=8)
    own = {r[0] for r in stored.read_stored(spark, f"file://{tmp_path}/performance").select("bucket").collect()}
    assert known == [None, sorted(own), sorted(own)]
