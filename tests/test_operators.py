"""Small cases: nulls, ties, order and edges of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fernweave.functions import text as T
from fernweave.operators import answers as A
from fernweave.operators import campaign as C
from fernweave.operators import conversations as V
from fernweave.operators import kpi as K
from fernweave.operators import leads as L
from fernweave.operators import retrieval as R
from fernweave.operators import tables as D
from fernweave.streaming import events as E


def one(spark, column, **values):
    types = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], types).select(column.alias("x")).first()[0]


def test_rate_is_null_without_valid_rows_and_slicers_leave_it(spark):
    frame = spark.createDataFrame([(0,), (1,), (2,), (None,), (7,)], "label int")
    assert tuple(C.acceptance(frame).first()) == (5, 3, 2, 2 / 3)
    assert tuple(C.acceptance(C.sliced(frame, [99])).first()) == (0, 0, 0, None)
    assert C.sliced(frame, None).count() == 5
    measured = C.measures(frame, [1]).first()
    assert (measured.visible, measured.valid, measured.accepted) == (1, 3, 2)


def test_bands(spark):
    frame = spark.createDataFrame([(-1.0,), (0.0,), (10_000.0,), (15_000.0,), (15_000.01,), (30_000.0,), (50_000.0,), (100_000.0,), (100_000.01,), (None,)], "v double")
    assert [r[0] for r in frame.select(C.income_band(F.col("v"))).collect()] == ["Negative", "Zero", "0-15000", "0-15000", "15000-30000", "15000-30000", "30000-50000", "50000-100000", ">100000", "Missing"]
    ages = spark.createDataFrame([(29.0,), (29.5,), (60.0,), (None,)], "v double")
    assert [r[0] for r in ages.select(C.age_band(F.col("v"))).collect()] == ["<30", "30-39", "60+", None]


def test_pair_comparison_counts_one_sided_missing_nowhere(spark):
    frame = spark.createDataFrame([(1, 1), (2, 3), (None, None), (None, 5)], "a int, b int")
    assert tuple(C.pair_comparison(frame, "a", "b").first()) == (1, 1, 4, 1)


def streaks(spark, results, rules=None):
    rows = [(1, dt.date(2024 + (m - 1) // 12, (m - 1) % 12 + 1, 1), r, (rules or {}).get(m, "r"), 2, "commission") for m, r in results]
    return K.with_streaks(spark.createDataFrame(rows, "agent_id int, month_start date, result string, rule_id string, required long, initial_type string"))


def test_streaks_break_at_gaps_pending_months_and_new_rules(spark):
    def both(results, rules=None):
        got = streaks(spark, results, rules).orderBy("month_start").collect()
        return [r.pass_streak for r in got], [r.fail_streak for r in got]

    assert both([(1, "PASS"), (2, "PASS"), (3, "FAIL"), (4, "PASS")]) == ([1, 2, 0, 1], [0, 0, 1, 0])
    assert both([(1, "PASS"), (3, "PASS"), (4, "PASS")])[0] == [1, 1, 2]
    assert both([(1, "PASS"), (2, "PENDING"), (3, "PASS")]) == ([1, 0, 1], [0, 0, 0])
    assert both([(11, "PASS"), (12, "PASS"), (13, "PASS")])[0] == [1, 2, 3]
    assert both([(1, "PASS"), (2, "PASS")], {2: "s"})[0] == [1, 1]


def test_contract_changes_once_and_from_the_next_month(spark):
    events = K.contract_events(streaks(spark, [(1, "PASS"), (2, "PASS"), (3, "PASS"), (4, "FAIL"), (5, "FAIL")])).orderBy("month_start").collect()
    assert [(e.from_type, e.to_type, e.effective_from) for e in events] == [("commission", "salary", dt.date(2024, 3, 1)), ("salary", "commission", dt.date(2024, 6, 1))]


def test_thresholds_are_strict(spark):
    frame = spark.createDataFrame([(1_500_000, 6), (1_500_001, 5), (1_500_001, 6)], "premium long, policies long").withColumns({"premium_over": F.lit(1_500_000), "policies_over": F.lit(5)})
    assert [r.result for r in K.judged(frame, F.lit(False)).collect()] == ["FAIL", "FAIL", "PASS"]


def test_revisions_are_idempotent(spark):
    history = spark.createDataFrame([(1, "a", 1, True)], "k int, v string, revision long, is_current boolean")
    incoming = spark.createDataFrame([(1, "b"), (2, None)], "k int, v string")
    once = D.next_revisions(history, incoming, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1, False), (1, "b", 2, True), (2, None, 1, True)]
    assert sorted(map(tuple, D.next_revisions(once, incoming, ["k"], ["v"]).collect())) == sorted(map(tuple, once.collect()))


def test_constraints(spark):
    frame = spark.createDataFrame([(1, 5), (1, -1), (None, None), (None, 2)], "k int, v int")
    assert [tuple(r) for r in D.violations(frame, {"v": "v >= 0"}).collect()] == [("v", 1)]
    assert [tuple(r) for r in D.repeated_keys(frame, ["k"]).collect()] == [(1, 2)]
    assert D.orphans(frame, spark.createDataFrame([(2,)], "k int"), "k", "k").count() == 2


def test_phones_and_incomes(spark):
    t = F.col("t")
    assert one(spark, T.national_phone(t), t="+66 81-234-5678") == "0812345678"
    assert one(spark, T.national_phone(t), t="12345") is None
    got = one(spark, T.income(t), t="income 20,000 - 30,000 THB per month")
    assert (got.income, int(got.income_min), int(got.income_max), got.income_currency, got.income_period) == (None, 20_000, 30_000, "THB", "monthly_thb")
    got = one(spark, T.income(t), t="รายได้: 15000.50 บาท ต่อปี")
    assert (float(got.income), got.income_currency, got.income_period) == (15000.5, "THB", "annual_thb")
    assert one(spark, T.redacted(t), t="call 081-234-5678") == "call [redacted-phone]"


def test_routes(spark):
    def intent(text, collecting=False, history=False, refresh=False):
        return one(spark, T.route(F.col("t"), F.lit(collecting), F.lit(history), F.lit(refresh)), t=text)

    assert [intent("Hello!"), intent("I am interested"), intent("how to apply"), intent("coverage?"), intent("weather"), intent("")] == ["greeting", "lead", "out_of_scope", "question", "out_of_scope", "unsupported"]
    assert intent("Somchai", collecting=True) == "lead" and intent("coverage", refresh=True) == "lead"


def test_query_terms(spark):
    assert one(spark, T.query_terms(F.col("t")), t="Plan A 12 plan") == ["plan", "12"]
    assert one(spark, T.query_terms(F.col("t")), t="ประกนภย")[:3] == ["ประกนภย", "ประก", "ระกน"]


def test_aliases_tie_on_parts_and_win_whole(spark):
    names = spark.createDataFrame([("p1", "life long plus"), ("p2", "life long")], "product_id string, alias string")
    asked = spark.createDataFrame([(1, "about life long plus please"), (2, "the longest lifelong"), (3, "nothing")], "query_id int, text string")
    assert sorted(map(tuple, R.alias_matches(asked, names).collect())) == [(1, "p1"), (2, "p1"), (2, "p2")]


def test_evidence_needs_one_chunk_with_the_terms(spark):
    asked = spark.createDataFrame([(1, "waiting period"), (2, "waiting period"), (3, "?"), (4, "waiting")], "query_id int, text string")
    found = spark.createDataFrame([(1, "p", "n", "the waiting period is 30 days", 0.1), (2, "p", "n", "waiting", 0.1), (2, "q", "n", "period", 0.9)], "query_id int, product_id string, product_name string, text string, score double")
    assert dict(map(tuple, R.evidence_gate(asked, found).collect())) == {1: True, 2: False, 3: False, 4: False}


def test_chunks_overlap_and_cover(spark):
    text = " ".join(f"w{i}" for i in range(900))
    pages = spark.createDataFrame([(1, 1, text), (2, 1, None), (3, 1, "  ")], "doc_id long, page_number int, text string")
    got = R.chunked(pages, most=400, overlap=50).collect()
    assert {r.doc_id for r in got} == {1} and all(len(r.text) <= 400 for r in got)
    assert set(" ".join(r.text for r in got).split()) >= {f"w{i}" for i in range(0, 900, 7)}


def test_near_duplicate_questions_are_taken_once(spark):
    rows = [(1, "what is covered?", 0.9), (1, "what is covered", 0.8), (1, "how much is it?", 0.7)]
    got = R.distinct_questions(spark.createDataFrame(rows, "group_id long, question string, score double")).collect()
    assert [r.question for r in got] == ["what is covered?", "how much is it?"]


def test_lock_gates_counting_and_outlasts_itself(spark):
    at = dt.datetime(2024, 1, 1)
    times = [0, 1, 2, 3, 4, 10, 70, 140]
    kinds = ["error"] * 7 + ["signup"]
    events = spark.createDataFrame([(1, i, at + dt.timedelta(seconds=s), k) for i, (s, k) in enumerate(zip(times, kinds, strict=True))], "user_id long, event_id long, ts timestamp, event_type string")
    got = [r.outcome for r in E.locked_out(events).orderBy("event_id").collect()]
    assert got == ["failed"] * 4 + ["locked", "rejected", "locked", "ok"]


def test_windows_run_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = E.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("hours").count() == E.tumbling(events).count()


def test_lead_turns(spark):
    said = [
        (1, 0, "สนใจครับ ชื่อ สมชาย ใจดี อาชีพ วิศวกร รายได้ 50,000 บาทต่อเดือน เบอร์ 081-234-5678", "p1"), (1, 1, "ยืนยัน", "p1"), (1, 2, "รายได้ 60000", "p1"),
        (2, 0, "name: Ann Lee occupation: nurse income: 15-25 THB per month", None), (2, 1, "ใช่", None), (2, 2, "ยกเลิกครับ", None), (3, 0, None, None), (3, 1, "ไม่ยืนยัน", None),
    ]
    own = L.drafts(spark.createDataFrame(said, "owner_id long, turn long, text string, product_id string"))
    rows = {(r.owner_id, r.turn): r for r in own.select("*", L.errors().alias("errors"), L.summary().alias("summary"), L.prompt(F.col("missing")).alias("prompt"), L.fingerprint().alias("mark")).collect()}
    first = rows[1, 0]
    assert (first.name, first.occupation, float(first.income), first.income_currency, first.income_period, first.phone) == ("สมชาย ใจดี", "วิศวกร", 50000.0, "THB", "monthly_thb", "081-234-5678")
    assert first.missing == [] and first.errors == ["lead confirmation is required before save"] and rows[1, 1].status == "confirmed" and rows[1, 1].errors == []
    assert rows[1, 2].status == "unconfirmed" and rows[1, 2].missing == ["income_currency", "income_period"] and rows[1, 2].mark != first.mark == rows[1, 1].mark
    assert rows[2, 0].missing == ["income_confirmation", "phone", "product_id"] and rows[2, 1].status == "unconfirmed" and rows[2, 2].status == "cancelled"
    assert rows[2, 0].summary == "ชื่อ: Ann Lee | อาชีพ: nurse | รายได้: 15.00–25.00 THB / monthly_thb"
    assert rows[3, 1].status == "unconfirmed" and rows[3, 0].prompt.startswith("ชื่อ, อาชีพ, รายได้")
    saved = own.where("owner_id = 1 and turn = 0").select(F.lit(9).cast("long").alias("owner_id"), *L.FIELDS)
    assert {r.owner_id: r.source for r in L.latest_drafts(own, saved).collect()} == {1: "draft", 2: "draft", 3: "draft", 9: "lead"}


def test_citations_resolve(spark):
    keys = "answer_id long, doc_id string, page_number int, chunk_id string, source_url string"
    chunks = spark.createDataFrame([(1, "d", 1, "c", "u"), (3, "d", 0, "c", "u")], keys)
    cites = spark.createDataFrame([(1, "d", 1, "c", "u"), (2, "d", 1, "c", "u"), (3, "d", 0, "c", "u")], keys)
    errors = A.citation_errors(spark.createDataFrame([(i,) for i in range(1, 5)], "answer_id long"), cites, chunks).collect()
    assert {r.answer_id: r.error for r in errors} == {2: "not retrieved", 3: "page below one", 4: "no citations"}


def test_follow_up_carries_what_was_said(spark):
    said = [(1, 0, "user", "old"), *[(1, k, "assistant", "x" * 500) for k in range(1, 6)], (1, 6, "user", "ชื่อ สมชาย"), (1, 7, "user", "call 081-234-5678"), (2, 0, "user", "a"), (3, 0, "system", "s")]
    asked = spark.createDataFrame([(1, " แล้วกี่ปี "), (2, "new"), (3, "แล้วไง"), (4, None)], "conv_id long, text string")
    got = {r.conv_id: r.query for r in A.standalone(asked, spark.createDataFrame(said, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {1: A.FOLLOWS + " | ".join(["assistant: " + "x" * 400] * 4 + ["user: call [redacted-phone]"]) + A.NEW_QUESTION + "แล้วกี่ปี", 2: "new", 3: "แล้วไง", 4: ""}


def test_staff_and_session_changes(spark):
    accounts = spark.createDataFrame([("a", "Ann", "customer"), ("b", "Bob", "customer"), ("s", "Sue", "staff")], "owner_id string, username string, account_role string")
    sessions = spark.createDataFrame([("s1", "a", "active", "t1"), ("s0", "b", "closed", "t0")], "session_id string, owner_id string, status string, last_active_at string")
    assert {r.session_id: r.owner_id for r in V.with_sessions(accounts, sessions, F.lit("t2")).collect()} == {"s1": "a", "s0": "b", "s-b": "b"}
    messages = spark.createDataFrame([("r1", "private", "{}"), ("r1:assistant", "private", None), ("r2", "private", "{}")], "request_id string, purpose string, metadata string")
    turns = spark.createDataFrame([("r1", "product", ["c"])], "request_id string, purpose string, citations array<string>")
    assert {r.request_id: (r.purpose, r.metadata) for r in V.annotated(messages, turns).collect()} == {"r1": ("product", '{"citations":["c"]}'), "r1:assistant": ("product", '{"citations":["c"]}'), "r2": ("private", "{}")}
    profiles = spark.createDataFrame([("a", None), ("b", "old"), ("c", None)], "owner_id string, refresh_requested_at string")
    assert {r.owner_id: r.refresh_requested_at for r in V.refresh_requested(profiles, profiles.where("owner_id <> 'c'"), F.lit("now")).collect()} == {"a": "now", "b": "old", "c": None}
    held = sessions.withColumn("token_hash", F.sha2(F.lit("t"), 256))
    requests = spark.createDataFrame([("s1", "t"), ("s1", "x"), ("s0", "t"), ("s1", None)], "session_id string, access_token string")
    assert [tuple(r) for r in V.authorised(requests, held).collect()] == [("s1", "t")]
    said = spark.createDataFrame([("s1", k, "user", t, p) for k, (t, p) in enumerate([("about plan A", "private"), ("phone 081", "product"), ("premium?", "product"), ("hello", "private")])], "session_id string, turn int, role string, text string, purpose string")
    lead, text = F.contains("text", F.lit("phone")), F.col("text")
    assert [r.text for r in V.product_history(said, sessions, lead, text, F.contains("text", F.lit("plan A"))).orderBy("turn").collect()] == ["about plan A", "premium?"]
    assert V.closed_vocabulary(said.where("turn = 0").select("turn", "text"), ["Plan A", "Plan B"], ["premium"]).collect()[0].products == ["Plan A"]


def test_upsert_takes_one_row_of_a_key(spark):
    current = spark.createDataFrame([(1, "a", 1), (None, "n", 1)], "k int, v string, at int")
    incoming = spark.createDataFrame([(1, "b", 2), (1, "c", 3), (None, "m", 2), (5, "e", 1)], "k int, v string, at int")
    assert sorted((r.k or 0, r.v) for r in D.upsert(current, incoming, ["k"], [F.desc("at")]).collect()) == [(0, "m"), (1, "c"), (5, "e")]


def test_masks_and_routes(spark):
    row = spark.createDataFrame([("โทร ๐" + "๘๑๒๓๔๕๖๗๘ หรือ 0๘๑๒๓๔๕๖๗๘ รายได้ ๕๐๐๐๐ บาท", None)], "a string, b string").select(T.redacted(F.col("a")).alias("a"), T.route(F.col("b"), F.lit(False), F.lit(False), F.lit(False)).alias("b")).first()
    assert "0๘" not in row.a and "[redacted-phone]" in row.a and "[redacted-income]" in row.a and row.b == "unsupported"


def test_a_month_needs_exactly_one_rule(spark):
    months = spark.sql("select 1 agent_id, date'2024-01-01' month_start union all select 1, date'2024-02-01'")
    rules = spark.sql("select 'a' rule_id, date'2024-01-01' valid_from, date'2024-01-31' valid_to")
    assert K.with_one_rule(months.where("month_start < date'2024-02-01'"), rules).first().rule_id == "a"
    for some in (rules, rules.unionByName(spark.sql("select 'b', date'2024-01-01', cast(null as date)").toDF(*rules.columns))):
        with pytest.raises(Exception, match="exactly one rule"):
            K.with_one_rule(months, some).collect()


def test_terms_are_counted_without_overlap(spark):
    texts = [(1, "Aaaa b. é È e"), (2, None), (3, "xx")]
    got = {r.chunk_id: (r.size, {h.term: h.f for h in r.hits}) for r in R.occurrences_of(spark.createDataFrame(texts, "chunk_id long, text string"), ["aa", "ab", "eee", "e"]).collect()}
    assert got == {1: (9, {"aa": 2, "ab": 1, "eee": 1, "e": 3}), 2: (0, {}), 3: (2, {})}
    assert R.occurrences_of(spark.createDataFrame(texts, "chunk_id long, text string"), []).count() == 3


def test_rules_of_owners_are_not_broadcast(spark):
    day = dt.date
    rules = spark.createDataFrame([(1, "long", day(1, 1, 1), day(9990, 1, 1)), (2, "early", day(1900, 1, 1), None), (2, "within", day(1950, 1, 1), day(1959, 12, 31)), (3, "x", None, day(2000, 1, 1)), (3, "y", day(1990, 1, 1), None)], "owner_id int, rule_id string, valid_from date, valid_to date")
    months = spark.createDataFrame([(1, day(2000, 1, 1)), (1, day(2000, 1, 1)), (2, day(1949, 12, 1)), (2, day(1960, 1, 1)), (3, day(1999, 1, 1))], "owner_id int, month_start date")
    ruled = K.with_owner_rule(months, rules)
    assert sorted(tuple(r) for r in ruled.collect()) == [(1, day(2000, 1, 1), "long", day(1, 1, 1), day(9990, 1, 1))] * 2 + [(2, day(1949, 12, 1), "early", day(1900, 1, 1), None), (2, day(1960, 1, 1), "early", day(1900, 1, 1), None), (3, day(1999, 1, 1), "y", day(1990, 1, 1), None)]
    plan = ruled._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "sequence(" not in plan


def test_doubles_are_rounded_as_in_sql(spark):
    import duckdb

    values = [1162.85 / 2, 1166.11 / 2, 1.005, 1.025, 0.285, 2.675, -1.005, -2.5, 0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(C.rounded(F.col("v"), 2)).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 2)", [v]).fetchone()[0] for v in values]


def test_alias_matches_neither_shuffle_nor_group_queries(spark):
    asked = spark.createDataFrame([(1, "a LARGE one"), (2, "large and small"), (3, "none")], "query_id int, text string")
    names = spark.createDataFrame([("p", "large"), ("q", "small"), (None, "small"), ("r", "extra large")], "product_id string, alias string")
    matched = R.alias_matches(asked, names)
    assert sorted(matched.collect(), key=str) == sorted([(1, "p"), (2, "p"), (2, "q"), (2, None)], key=str)
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate(key=[query_id" not in plan and "Aggregate(keys=[query_id" not in plan


def test_first_chunks_and_places_far_behind_are_those_of_the_whole_ranking(spark, monkeypatch):
    monkeypatch.setattr(R, "CELLS", 4)
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    texts = [(k, "ab" * (k % 7) + " cd" * (k % 3) + " xyz" * (k % 5)) for k in range(40)]
    chunks = spark.createDataFrame([*texts, (40, None), (41, "none")], "chunk_id long, text string")
    terms = spark.createDataFrame([("a", "ab"), ("a", "cd"), ("b", "xyz"), ("c", "cd"), ("c", "absent"), ("d", "absent")], "query_id string, term string")
    whole = {(r.query_id, r.chunk_id): (r.score, r.place) for r in R.bm25(terms, chunks).collect()}
    assert {q for q, _ in whole} == {"a", "b", "c"} and sorted(p for (q, _), (_, p) in whole.items() if q == "b") == list(range(1, 33))
    ranked = sorted((k for q, k in whole if q == "a"), key=lambda k: (-round(whole["a", k][0], 9), k))
    assert [whole["a", k][1] for k in ranked] == list(range(1, len(ranked) + 1))
    far = spark.createDataFrame([("a", ranked[-1]), ("a", ranked[0]), ("b", 1), ("b", 40)], "query_id string, chunk_id long")
    got = {(r.query_id, r.chunk_id): (r.score, r.place) for r in R.bm25(terms, chunks, k=3, also=far).collect()}
    assert got == {key: v for key, v in whole.items() if v[1] <= 3 or key in {("a", ranked[-1]), ("b", 1)}}


def test_turns_of_a_small_file_are_read_by_many_tasks(spark):
    turns = spark.createDataFrame([(k, 0, f"name: Client {k}", None) for k in range(200)], "owner_id long, turn int, text string, product_id string").coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few here
    try:
        tasks = L.extracted(turns).select("name", F.spark_partition_id().alias("task")).where("name is not null").select("task").distinct().count()
        plan = L.drafts(turns)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1
    assert plan.count("Exchange") == 1  # the windows need no further one
