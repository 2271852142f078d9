"""Some of the registered queries against their SQL on the smallest tables (the driver compares them all), and the streams against the batch forms."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docweave.operators import events as V
from docweave.plans import event_queries, inputs

from .conftest import assert_same

SOME = """f1_canonicalize_url f5_canonical_hash f6_tokens s2_docs_root s4_parse_sitemap s6_validate_contract n4_notebook_markdown n7_extract_locators q2_quality_gate q5_redact_url j1_state_diff o6_plan_reuse w4_unique_destinations
r1_rank_documents r9_hybrid_search a10_retrieval_metrics a12_leak_check j4_use_decision j5_eligible_claims j7_blocked_documents j12_derivative_check a5_reconcile_sources l8_link_conflicts g1_impact_closure g4_change_impact t2_coalesce_jobs t4_impact_state a8_open_investigations
a9_metric_regression l5_review w7_poll_changes""".split()


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, small, name):
    assert_same(entry.QUERIES[name](spark, small), entry.ORACLES[name], small)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rate_limit_stream_equals_batch(spark, small):
    stream = {(r["feedback_id"], r["seq"]): r["accepted"] for r in event_queries.t6s(spark, small).collect()}
    by_subject = {}
    for r in inputs.feedback(spark, small).orderBy("seq").collect():
        by_subject.setdefault(r["subject_hash"], []).append(r)
    for rs in by_subject.values():
        ok = V.accept_greedily((r["occurred_at"].timestamp() for r in rs), 1800, 2)
        assert [stream[r["feedback_id"], r["seq"]] for r in rs] == ok


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Tokyo"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_debounce_stream_equals_batch(spark, small, zone):
    got = {}
    for r in event_queries.t3(spark, small).collect():
        got.setdefault(r["job_key"], []).append((round(r["first"], 3), round(r["last"], 3), round(r["due"], 3), r["events"]))
    times = {}
    for r in inputs.events(spark, small).select("package_id", "type", F.unix_micros("occurred_at").alias("at")).collect():
        times.setdefault(f"{r['package_id']}/{r['type']}", []).append(r["at"] / 1e6)
    want = {k: sorted(V.due_times(v)) for k, v in times.items()}
    near = lambda a, b: all(abs(x - y) < 0.01 for x, y in zip(a[:3], b[:3])) and a[3] == b[3]
    assert got.keys() == want.keys() and all(len(got[k]) == len(want[k]) and all(map(near, sorted(got[k]), want[k])) for k in want)


def test_event_codes_of_a_stream_are_those_of_the_batch_form(spark, small):
    from docweave.streaming import events as S

    e = inputs.events(spark, small).select("event_id", "seq", "payload_hash", "occurred_at")
    out = event_queries._streamed(spark, small, e, lambda s: S.event_codes_stream(s, "3650 days"), "event_id string, seq long, code string")
    want = V.dedupe_events(e)
    rows = lambda df: sorted((r["event_id"], r["seq"], r["code"]) for r in df.collect())
    assert rows(out) == rows(want) and {r["code"] for r in want.select("code").distinct().collect()} == {"event_accepted", "event_duplicate", "event_id_conflict"}


def ledger(snapshots):
    """The rule, snapshot by snapshot: fingerprint -> (status, first, last, resolved)."""
    out = {}
    for at in sorted(snapshots):
        for f in snapshots[at]:
            out[f] = ("open", out[f][1] if f in out else at, at, None)
        for f, v in out.items():
            if v[0] == "open" and f not in snapshots[at]:
                out[f] = ("closed", v[1], v[2], at)
    return out


def test_ledger_of_a_stream_however_it_is_cut(spark, tmp_path):
    """Snapshots reach the stream whole or in pieces, in order or not: the ledger is the same."""
    from datetime import datetime, timedelta

    from docweave.streaming import events as S

    start = datetime(2024, 1, 1)
    at = lambda i: start + timedelta(minutes=i)
    snapshots = {at(0): {"a", "b"}, at(1): {"b", "c"}, at(2): set(), at(3): {"a"}, at(4): {"a", "c"}, at(5): {"c"}}
    rows = [(t, None) for t in snapshots] + [(t, f) for t, names in snapshots.items() for f in sorted(names)] + [(at(2), "")]
    cuts = {"one": [rows], "pieces": [rows[3:9], rows[:3], rows[9:]]}
    for name, batches in cuts.items():
        for i, part in enumerate([*batches, [(at(600), None)], [(at(1200), None)]]):
            spark.createDataFrame(part, "at timestamp, fingerprint string").coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            stream = spark.readStream.schema("at timestamp, fingerprint string").parquet(str(tmp_path / name / "in"))
            S.run_available(S.ledger_changes(stream, groups=3), str(tmp_path / name / "out"), str(tmp_path / name / "checkpoint"))
        changes = spark.read.schema(S.LEDGER).parquet(str(tmp_path / name / "out"))
        # the one snapshot of long after, which has no incidents, closes what was open
        want = ledger(snapshots | {at(600): set()})
        got = {r["fingerprint"]: (r["status"], r["first_seen_at"], r["last_seen_at"], r["resolved_at"]) for r in S.current_ledger(changes).collect()}
        assert got == want


def test_budget_against_a_plain_loop(spark, small):
    e = inputs.events(spark, small).select((F.col("package_id") % 3).alias("package_id"), "seq", F.col("occurred_at").alias("created_at"), F.lit("candidate_requested").alias("status"))
    got = {(r["package_id"], r["seq"]): r["status"] for r in V.impact_budget(e).collect()}
    by = {}
    for r in e.select("package_id", "seq", F.unix_micros("created_at").alias("at")).orderBy("seq").collect():
        by.setdefault(r["package_id"], []).append((r["seq"], r["at"]))
    for package, rows in by.items():
        taken = []
        for seq, at in rows:
            full = sum(t >= at - 86_400_000_000 for t in taken) >= 4
            assert got[package, seq] == ("backlog" if full else "candidate_requested")
            taken += [] if full else [at]
    assert set(got.values()) == {"backlog", "candidate_requested"}


def test_event_codes_call_python_a_group_and_forget_by_id(spark, tmp_path):
    """5,000 ids in one micro-batch touch 7 states; ids of one group are forgotten each at its own time, and null payloads are never duplicates."""
    from datetime import datetime, timedelta

    from docweave.streaming import events as S

    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    many = [(f"e{i}", i, "x", at(0)) for i in range(5000)]
    batches = [many, [("e1", 5001, "x", at(50)), ("e2", 5002, "y", at(50)), (None, 5003, None, at(50)), (None, 5004, None, at(50))], [("z", 6000, "x", at(130))], [("z", 6001, "x", at(131))], [("e1", 7000, "x", at(100)), ("e3", 7001, "x", at(100))]]
    schema = "event_id string, seq long, payload_hash string, occurred_at timestamp"
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = S.event_codes_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 hour", groups=7)
        query = query.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        if part is many:
            assert max(s["numRowsUpdated"] for p in query.recentProgress for s in p["stateOperators"]) <= 7
    got = {r["seq"]: r["code"].removeprefix("event_") for r in spark.read.schema("event_id string, seq long, code string").parquet(str(tmp_path / "out")).collect()}
    assert len(got) == sum(map(len, batches)) and {got[i] for i in range(5000)} == {"accepted"}
    # e1 was last seen at 50 and is known until 110, e3 at 0 and until 60: the watermark is 71 when both come again
    assert {s: c for s, c in got.items() if s > 5000} == {5001: "duplicate", 5002: "id_conflict", 5003: "accepted", 5004: "id_conflict", 6000: "accepted", 6001: "duplicate", 7000: "duplicate", 7001: "accepted"}


def test_feedback_of_no_value(spark, small, tmp_path):
    """A value of 0 or less is below 5 like any other: its number is invalid, as in the SQL."""
    from pathlib import Path

    for f in Path(small).glob("*.parquet"):
        if f.name != "events.parquet":
            (tmp_path / f.name).symlink_to(f)
    e = spark.read.parquet(f"{small}/events.parquet")
    e.withColumn("value", F.when(F.col("event_id") % 3 == 0, 0.0).when(F.col("event_id") % 3 == 1, -2.5).otherwise(F.col("value"))).toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    assert_same(entry.QUERIES["l1_normalize_feedback"](spark, str(tmp_path)), entry.ORACLES["l1_normalize_feedback"], str(tmp_path))
