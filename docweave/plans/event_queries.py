"""Queries of events, feedback, learning and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import events as V
from ..operators import feedback as B
from ..operators.graph import cut, shared_dir
from ..streaming import events as S
from . import inputs as I
from .registry import query

T0 = f"TIMESTAMP '{I.NOW}'"


def now():
    return F.lit(I.NOW).cast("timestamp")


# --- events ---------------------------------------------------------------------------------------------------------


@query(
    "t1_dedupe_events",
    f"WITH {I.EVENTS}, f AS (SELECT event_id, min(seq) AS s, arg_min(payload_hash, seq) AS h FROM ev GROUP BY 1) SELECT event_id, seq, CASE WHEN seq = s THEN 'event_accepted' WHEN payload_hash = h THEN 'event_duplicate' ELSE 'event_id_conflict' END AS code FROM ev JOIN f USING (event_id)",
)
def t1(spark, d):
    return V.dedupe_events(I.events(spark, d))


_JOBS = f"""WITH {I.EVENTS}, k AS (SELECT *, coalesce(policy_revision, '') AS pr FROM ev), fl AS (SELECT package_id, type, observed_revision, pr, path, max(done) AS done FROM (SELECT package_id, type, observed_revision, pr, unnest(completed) AS path, 1 AS done FROM k UNION ALL SELECT package_id, type, observed_revision, pr, unnest(deferred), 0 FROM k) GROUP BY 1, 2, 3, 4, 5),
g AS (SELECT package_id, type, observed_revision, pr, coalesce(string_agg(path, '|' ORDER BY path) FILTER (WHERE done = 1), '') AS completed_files, coalesce(string_agg(path, '|' ORDER BY path) FILTER (WHERE done = 0), '') AS deferred_files FROM fl GROUP BY 1, 2, 3, 4),
j AS (SELECT package_id, type, observed_revision, pr, count(*) AS event_count, arg_min(occurred_at, seq) AS first_event_at, max(occurred_at) AS last_event_at FROM k GROUP BY 1, 2, 3, 4),
jb AS (SELECT sha256(package_id || chr(0) || type || chr(0) || observed_revision || chr(0) || pr) AS job_key, event_count, first_event_at, last_event_at, least(last_event_at + INTERVAL 60 SECOND, first_event_at + INTERVAL 300 SECOND) AS due_at, completed_files, deferred_files FROM j JOIN g USING (package_id, type, observed_revision, pr))"""


def _jobs(spark, d):
    return V.coalesce_jobs(I.events(spark, d), now())


@query("t2_coalesce_jobs", _JOBS + f" SELECT job_key, event_count, epoch_us(first_event_at) AS first_us, epoch_us(last_event_at) AS last_us, epoch_us(due_at) AS due_us, completed_files, deferred_files, due_at <= {T0} AND completed_files <> '' AS ready FROM jb")
def t2(spark, d):
    us = lambda c: F.unix_micros(c)
    return _jobs(spark, d).select("job_key", "event_count", us("first_event_at").alias("first_us"), us("last_event_at").alias("last_us"), us("due_at").alias("due_us"), F.array_join("completed_files", "|").alias("completed_files"), F.array_join("deferred_files", "|").alias("deferred_files"), "ready")


@query("o4_remaining_files", _JOBS + " SELECT job_key, unnest(string_split(deferred_files, '|')) AS path FROM jb WHERE deferred_files <> ''")
def o4(spark, d):
    return V.remaining_files(_jobs(spark, d))


_IMPACT = f"""WITH {I.EVENTS}, o AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1), l AS (SELECT package_id, document_id, arg_max(revision, seq) AS revision, arg_max(base_revision, seq) AS base_revision, arg_max(lower(impact), seq) AS impact, arg_max(revoked, seq) AS revoked FROM o GROUP BY 1, 2),
st AS (SELECT *, NOT revoked AND revision <> base_revision AND impact IN ('conceptual', 'uncertain') AS relevant FROM l)"""


@query("t4_impact_state", _IMPACT + " SELECT package_id, document_id, revision, base_revision, impact, revoked, relevant FROM st")
def t4(spark, d):
    return V.impact_state(I.events(spark, d))


@query("t4_impact_sets", _IMPACT + " SELECT package_id, count(DISTINCT document_id) FILTER (WHERE revision = base_revision) AS reverted, count(DISTINCT document_id) FILTER (WHERE revision <> base_revision AND lower(impact) = 'factual') AS factual, count(DISTINCT document_id) FILTER (WHERE revision <> base_revision AND lower(impact) NOT IN ('factual', 'conceptual')) AS uncertain FROM o WHERE NOT revoked GROUP BY 1")
def t4b(spark, d):
    return V.impact_sets(I.events(spark, d))


@query("t5_impact_batch", _IMPACT + " SELECT package_id, count(*) AS relevant, CASE WHEN package_id % 5 = 0 OR NOT (count(*) >= 40 OR (count(*) >= 3 AND count(*) / 1000 >= 0.1)) THEN 'none' WHEN bool_or(impact = 'uncertain') THEN 'review_required' ELSE 'candidate_requested' END AS status FROM st WHERE relevant GROUP BY 1")
def t5(spark, d):
    s = cut(V.impact_state(I.events(spark, d)))
    none = spark.createDataFrame([], "package_id long, batch_key string")
    seen = V.impact_batch(s, none, 1000, 40).where("package_id % 5 = 0").select("package_id", "batch_key")
    return V.impact_batch(s, seen, 1000, 40).select("package_id", "relevant", "status")


_BUDGET = f"""WITH RECURSIVE {I.EVENTS}, b AS MATERIALIZED (SELECT package_id, seq, epoch_us(occurred_at) AS t, CASE WHEN seq % 3 = 0 THEN 'review_required' ELSE 'candidate_requested' END AS status, row_number() OVER (PARTITION BY package_id ORDER BY seq) AS n FROM ev WHERE type = 'error'),
w AS (SELECT package_id, seq, n, status AS out, [t] AS kept FROM b WHERE n = 1
UNION ALL SELECT b.package_id, b.seq, b.n, CASE WHEN len(kept) = 4 AND kept[1] >= t - 86400000000 THEN 'backlog' ELSE status END, CASE WHEN len(kept) = 4 AND kept[1] >= t - 86400000000 THEN kept ELSE list_slice(list_sort(list_append(kept, t)), -4, -1) END FROM w JOIN b ON b.package_id = w.package_id AND b.n = w.n + 1)
SELECT package_id, seq, out AS status FROM w"""


@query("w8_impact_budget", _BUDGET)
def w8(spark, d):
    status = F.when(F.col("type") != "error", "none").when(F.col("seq") % 3 == 0, "review_required").otherwise("candidate_requested")
    return V.impact_budget(I.events(spark, d).select("package_id", "seq", F.col("occurred_at").alias("created_at"), status.alias("status")))


def _polls(spark, d):
    return I.events(spark, d).select((F.col("user_id") % 50).alias("source_id"), "seq", F.when(F.col("type") != "error", F.concat(F.lit("h"), (F.col("seq") % 3).cast("string"))).alias("hash"))


@query(
    "w7_poll_changes",
    f"""WITH {I.EVENTS}, p AS (SELECT user_id % 50 AS source_id, seq, CASE WHEN type <> 'error' THEN 'h' || (seq % 3) END AS hash FROM ev),
q AS (SELECT *, last_value(hash IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, count(hash) OVER (PARTITION BY source_id ORDER BY seq) AS i FROM p)
SELECT source_id, seq, hash IS NOT NULL AND hash IS DISTINCT FROM b AS changed, CASE WHEN hash IS NOT NULL THEN 0 ELSE count(*) FILTER (WHERE hash IS NULL) OVER (PARTITION BY source_id, i ORDER BY seq) END AS missed, coalesce(CASE WHEN hash IS NULL THEN count(*) FILTER (WHERE hash IS NULL) OVER (PARTITION BY source_id, i ORDER BY seq) END, 0) >= 2 AS threshold_reached FROM q""",
)
def w7(spark, d):
    return V.poll_alarms(_polls(spark, d), 2)


@query(
    "t8_incident_ledger",
    f"""WITH p AS (SELECT s_suppkey AS f, CASE WHEN s_suppkey % 3 = 0 THEN 'closed' ELSE 'open' END AS status FROM supplier WHERE s_suppkey % 4 <> 1), a AS (SELECT s_suppkey AS f FROM supplier WHERE s_suppkey % 5 <> 2)
SELECT coalesce(p.f, a.f) AS fingerprint, CASE WHEN a.f IS NOT NULL THEN 'open' WHEN status = 'open' THEN 'closed' ELSE status END AS status, CASE WHEN p.f IS NULL THEN 1 ELSE 0 END AS first_now, CASE WHEN a.f IS NOT NULL THEN 1 ELSE 0 END AS last_now, CASE WHEN a.f IS NULL AND status = 'open' THEN 1 ELSE 0 END AS resolved_now FROM p FULL JOIN a ON p.f = a.f""",
)
def t8(spark, d):
    k = F.col("s_suppkey")
    s = I.table(spark, d, "supplier")
    old = F.lit("2024-01-01 00:00:00").cast("timestamp")
    prior = s.where(k % 4 != 1).select(k.alias("fingerprint"), F.when(k % 3 == 0, "closed").otherwise("open").alias("status"), old.alias("first_seen_at"), old.alias("last_seen_at"), F.when(k % 3 == 0, old).alias("resolved_at"))
    l = V.incident_ledger(prior, s.where(k % 5 != 2).select(k.alias("fingerprint")), now())
    is_now = lambda c: F.coalesce((F.col(c) == now()).cast("int"), F.lit(0))
    return l.select("fingerprint", "status", is_now("first_seen_at").alias("first_now"), is_now("last_seen_at").alias("last_now"), is_now("resolved_at").alias("resolved_now"))


@query(
    "t7_event_windows",
    f"""WITH {I.EVENTS}, tu AS (SELECT 'tumbling' AS kind, package_id, epoch(time_bucket(INTERVAL 1 HOUR, occurred_at)) AS start, count(*) AS events FROM ev GROUP BY 2, 3),
sl AS (SELECT 'sliding' AS kind, package_id, epoch(time_bucket(INTERVAL 6 HOUR, occurred_at)) - 21600 * unnest([0, 1, 2, 3]) AS start FROM ev),
gp AS (SELECT package_id, occurred_at, CASE WHEN occurred_at - lag(occurred_at) OVER (PARTITION BY package_id ORDER BY occurred_at, seq) < INTERVAL 60 SECOND THEN 0 ELSE 1 END AS b, seq FROM ev), se AS (SELECT package_id, occurred_at, sum(b) OVER (PARTITION BY package_id ORDER BY occurred_at, seq) AS s FROM gp)
SELECT kind, package_id, CAST(floor(start) AS BIGINT) AS start, events FROM tu UNION ALL SELECT kind, package_id, CAST(floor(start) AS BIGINT), count(*) FROM sl GROUP BY 1, 2, 3 UNION ALL SELECT 'session', package_id, CAST(floor(epoch(min(occurred_at))) AS BIGINT), count(*) FROM se GROUP BY package_id, s""",
)
def t7(spark, d):
    return V.event_windows(I.events(spark, d)).select("kind", "package_id", F.col("start").cast("long").alias("start"), "events")


# --- feedback -------------------------------------------------------------------------------------------------------


@query(
    "l1_normalize_feedback",
    f"""WITH {I.EVENTS} SELECT event_id, seq, CASE WHEN seq % 40 = 6 THEN 'feedback_id_invalid' WHEN type NOT IN ('error', 'view') THEN 'feedback_kind_invalid' WHEN user_id % 9 = 4 THEN 'feedback_authentication_required' WHEN user_id % 9 = 5 THEN 'feedback_authentication_subject_mismatch' WHEN value < 5 THEN 'feedback_number_invalid' END AS error, sha256(document_id) AS question_hash,
sha256('{{"generation":"' || observed_revision || '","independence":"u' || user_id || '","kind":"' || (CASE type WHEN 'error' THEN 'wrong_answer' WHEN 'view' THEN 'latency' ELSE type END) || '","package_id":' || package_id || ',"question_hash":"' || sha256(document_id) || '"}}') AS occurrence_hash FROM ev""",
)
def l1(spark, d):
    k, u = F.col("seq"), F.col("user_id")
    who = F.concat(F.lit("u"), u.cast("string"))
    raw = I.events(spark, d).select(
        "event_id", "seq", "package_id", F.when(k % 40 == 6, "../x").otherwise(F.concat(F.lit("fb-"), "event_id")).alias("feedback_id"), F.col("observed_revision").alias("generation"), F.when(F.col("type") == "error", "wrong_answer").when(F.col("type") == "view", "latency").otherwise(F.col("type")).alias("kind"),
        F.concat(F.lit(" "), "document_id").alias("question"), who.alias("reporter_id"), F.lit(None).cast("string").alias("session_id"), (u % 9 != 4).alias("authenticated"), F.lit("sso").alias("source"), F.when(u % 9 == 5, "other").otherwise(who).alias("subject"), F.lit("sig").alias("proof"),
        F.when(F.col("value") < 5, F.col("value") - 5).otherwise(F.col("value")).alias("latency_ms"), F.lit(1.0).alias("cost_units"), "occurred_at",
    )
    return B.normalize_feedback(raw).select("event_id", "seq", "error", "question_hash", "occurrence_hash")


def _greedy(of: str, more: str, subject: str) -> str:
    """Which rows of a table (subject, seq, t in microseconds, n: number in the order of seq for each subject) the limit of 2 in 1,800 seconds accepts, row by row."""
    fits = "len(list_filter(kept, lambda x: t - x BETWEEN 0 AND 1800000000)) < 2"
    return f"""WITH RECURSIVE {I.FEEDBACK}, {more} b AS MATERIALIZED (SELECT feedback_id, subject_hash, seq, epoch_us(occurred_at) AS t, row_number() OVER (PARTITION BY subject_hash ORDER BY seq) AS n FROM {of}),
g AS (SELECT feedback_id, subject_hash, seq, n, true AS accepted, [t] AS kept FROM b WHERE n = 1
UNION ALL SELECT b.feedback_id, b.subject_hash, b.seq, b.n, {fits}, CASE WHEN {fits} THEN list_append(kept, t) ELSE kept END FROM g JOIN b ON b.subject_hash = g.subject_hash AND b.n = g.n + 1)
{subject}"""


_RATED = _greedy(
    "(SELECT * FROM co WHERE code IS NULL)",
    """co AS (SELECT fb.*, CASE WHEN seq > fs AND content_hash = fh THEN 'duplicate' WHEN seq > fs THEN 'feedback_id_conflict' WHEN seq > es THEN 'feedback_replay' END AS code FROM fb JOIN (SELECT feedback_id, min(seq) AS fs, arg_min(content_hash, seq) AS fh FROM fb GROUP BY 1) USING (feedback_id) JOIN (SELECT event_id, min(seq) AS es FROM fb GROUP BY 1) USING (event_id)),""",
    "SELECT feedback_id, seq, code FROM co WHERE code IS NOT NULL UNION ALL SELECT feedback_id, seq, CASE WHEN accepted THEN 'accepted' ELSE 'rate_limited' END FROM g",
)


@query("t6_rate_limit", _RATED)
def t6(spark, d):
    return B.rate_limit(I.feedback(spark, d), limit=2, window=1800)


@query("w9_submission_rate", f"WITH {I.FEEDBACK} SELECT feedback_id, seq, count(*) OVER (PARTITION BY subject_hash ORDER BY epoch_us(occurred_at) RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW) AS recent FROM fb")
def w9(spark, d):
    return B.submission_rate(I.feedback(spark, d), 1800)


_WIN = f"fw AS (SELECT * FROM fb WHERE occurred_at BETWEEN {T0} - INTERVAL 7 DAY AND {T0})"


@query(
    "a7_feedback_report",
    f"WITH {I.FEEDBACK}, {_WIN}, o AS (SELECT package_id, occurrence_hash, count(*) AS n, min(occurred_at) AS f, max(occurred_at) AS l FROM fw GROUP BY 1, 2) SELECT package_id, CAST(sum(n) AS BIGINT) AS submissions, count(*) AS unique_occurrences, CAST(sum(n - 1) AS BIGINT) AS duplicate_submissions, epoch_us(min(f)) AS first_us, epoch_us(max(l)) AS last_us FROM o GROUP BY 1",
)
def a7(spark, d):
    return B.feedback_report(I.feedback(spark, d), now()).select("package_id", "submissions", "unique_occurrences", "duplicate_submissions", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


@query(
    "a8_open_investigations",
    f"""WITH {I.FEEDBACK}, {_WIN}, o AS (SELECT package_id, kind, occurrence_hash, min(occurred_at) AS f, min(question_hash) AS q FROM fw GROUP BY 1, 2, 3)
SELECT package_id, kind, count(*) AS occurrences, 'investigation-' || left(sha256('{{"kind":"' || kind || '","occurrences":["' || string_agg(occurrence_hash, '","' ORDER BY f, occurrence_hash) || '"],"package_id":' || package_id || '}}'), 24) AS investigation_id, count(DISTINCT q) AS questions FROM o GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def a8(spark, d):
    return B.open_investigations(I.feedback(spark, d), now()).withColumn("questions", F.size("questions").cast("long"))


@query(
    "a4_usage_stats",
    f"""WITH {I.FEEDBACK}, m AS (SELECT package_id, 'latency_ms' AS metric, latency_ms AS v FROM fb UNION ALL SELECT package_id, 'cost_units', cost_units FROM fb)
SELECT package_id, metric, count(v) AS count, round(sum(v), 6) AS total, round(avg(v), 6) AS mean, round(quantile_disc(v, 0.5), 6) AS p50, round(quantile_disc(v, 0.95), 6) AS p95 FROM m WHERE v IS NOT NULL GROUP BY 1, 2""",
)
def a4(spark, d):
    return B.usage_stats(I.feedback(spark, d))


def _comparisons(spark, d):
    k = F.col("o_orderkey")
    side = lambda value, den, odd: F.struct(value.alias("value"), den.alias("denominator"), F.lit("ds").alias("dataset_id"), F.when(k % 11 != odd, "c").alias("corpus_revision"), F.lit("i").alias("index_revision"), F.when((k % 13 == 5) & F.lit(odd == 3), "g2").otherwise("g1").alias("golden_revision"), F.lit("h").alias("harness_revision"), F.lit("x").alias("configuration_hash"))
    base = side(F.lit(0.8).cast("double"), F.lit(120).cast("long"), 99)
    cur = side(F.when(k % 17 != 3, F.round(0.8 - (k % 10) / 100, 2)).cast("double"), (60 + k % 90).cast("long"), 3)
    return I.table(spark, d, "orders").select((F.col("o_custkey") % 400).alias("package_id"), k.alias("seq"), F.when(k % 3 == 0, "Abstention_rate").otherwise("recall").alias("metric"), base.alias("baseline"), F.when(k % 19 != 7, cur).alias("current"))


_CMP = """WITH c AS (SELECT o_custkey % 400 AS package_id, o_orderkey AS seq, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'Abstention_rate' ELSE 'recall' END AS metric, CASE WHEN o_orderkey % 17 <> 3 THEN CAST(round(0.8 - (o_orderkey % 10) / 100, 2) AS DOUBLE) END AS v, 60 + o_orderkey % 90 AS den FROM orders),
s AS (SELECT *, CASE WHEN k % 19 = 7 THEN 'not_comparable' WHEN k % 11 = 3 THEN 'not_comparable' WHEN k % 13 = 5 THEN 'not_comparable' WHEN v IS NULL THEN 'insufficient_denominator' WHEN k % 3 = 0 AND den < 100 THEN 'insufficient_denominator' ELSE 'comparable' END AS status,
  CASE WHEN k % 19 = 7 THEN NULL WHEN k % 11 = 3 THEN 'corpus_revision' WHEN k % 13 = 5 THEN 'golden_revision' END AS field FROM c), m AS (SELECT *, CASE WHEN status = 'comparable' THEN round(v - 0.8, 6) END AS delta, coalesce(status = 'comparable' AND v - CAST(0.8 AS DOUBLE) < CASE WHEN k % 3 = 0 THEN CAST(-0.1 AS DOUBLE) ELSE CAST(-0.03 AS DOUBLE) END, false) AS regression FROM s)"""


@query("a9_compare_metrics", _CMP + " SELECT package_id, seq, status, field, delta, regression FROM m")
def a9(spark, d):
    return B.compare_metrics(_comparisons(spark, d)).select("package_id", "seq", "status", F.when(F.col("current").isNotNull(), F.col("field")).alias("field"), "delta", "regression")


@query(
    "a9_metric_regression",
    _CMP + """, g AS (SELECT package_id, count(*) AS samples, count(*) FILTER (WHERE status = 'comparable') AS n, min(seq) FILTER (WHERE status = 'not_comparable') AS no_, min(seq) FILTER (WHERE status = 'insufficient_denominator') AS few, min(seq) FILTER (WHERE regression) AS bad, min(seq) FILTER (WHERE status = 'comparable') AS good FROM m GROUP BY 1),
p AS (SELECT *, CASE WHEN no_ IS NOT NULL THEN 'not_comparable' WHEN n = 0 AND few IS NOT NULL THEN 'insufficient_denominator' ELSE 'comparable' END AS st, CASE WHEN no_ IS NOT NULL THEN no_ WHEN n = 0 AND few IS NOT NULL THEN few ELSE coalesce(bad, good) END AS at FROM g)
SELECT p.package_id, samples, CASE WHEN st = 'comparable' THEN n ELSE 0 END AS comparable, st AS status, metric, CASE WHEN st = 'comparable' THEN regression ELSE false END AS regression, CASE WHEN st = 'comparable' THEN delta END AS delta FROM p JOIN m ON m.package_id = p.package_id AND m.seq = p.at""",
)
def a9b(spark, d):
    return B.metric_regression(_comparisons(spark, d))


# --- learning -------------------------------------------------------------------------------------------------------


def _proposals(spark, d):
    """Conversation turns as proposals: proposal_id, claim_kind, claim_scope, privacy, state, author_id, granted, expires, revoked, text."""
    k = F.col("conv_id") * 10 + F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, B.CLAIM_KINDS)), (k % 8 + 1).cast("int"))
    scope = F.element_at(F.array(*map(F.lit, B.SCOPES)), (k % 3 + 1).cast("int"))
    day = lambda n: F.timestamp_add("DAY", n, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return I.table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).select(
        k.alias("proposal_id"), kind.alias("claim_kind"), scope.alias("claim_scope"), F.when(k % 5 == 0, "private").otherwise(scope).alias("privacy"), F.when(k % 4 == 0, "admitted").otherwise("quarantined").alias("state"), F.concat(F.lit("u"), (k % 7).cast("string")).alias("author_id"),
        day(k % 30).alias("granted"), day(10 + k % 40).alias("expires"), F.when(k % 9 == 0, day(k % 3)).alias("revoked"), "text",
    )


_PROP = """WITH cv AS (SELECT conv_id * 10 + turn AS k, min(text) AS text FROM conversations GROUP BY 1), pr AS (SELECT k AS proposal_id, ['preference', 'project_decision', 'factual_correction', 'observation_experiment', 'hypothesis', 'opinion', 'agent_response', 'question'][k % 8 + 1] AS claim_kind, ['private', 'project', 'shared'][k % 3 + 1] AS claim_scope,
  CASE WHEN k % 5 = 0 THEN 'private' ELSE ['private', 'project', 'shared'][k % 3 + 1] END AS privacy, CASE WHEN k % 4 = 0 THEN 'admitted' ELSE 'quarantined' END AS state, 'u' || (k % 7) AS author_id, TIMESTAMP '2024-01-01' + to_days(CAST(k % 30 AS INTEGER)) AS granted, TIMESTAMP '2024-01-01' + to_days(CAST(10 + k % 40 AS INTEGER)) AS expires,
  CASE WHEN k % 9 = 0 THEN TIMESTAMP '2024-01-01' END AS revoked, text, k FROM cv)"""


@query(
    "l2_submit_proposals",
    _PROP + """, e AS (SELECT proposal_id, CASE WHEN k % 10 = 1 THEN 'capture_not_minimized' WHEN k % 11 = 2 THEN 'capture_not_opted_in' WHEN length(trim(text)) = 0 THEN 'excerpt_required' WHEN length(trim(text)) > 4000 THEN 'excerpt_too_large' WHEN length(trim(text)) > 2000 THEN 'claim_invalid' WHEN claim_kind = 'preference' AND (claim_scope <> 'private' OR privacy <> 'private') THEN 'preference_scope_invalid' WHEN k % 12 = 7 THEN 'source_kind_invalid' END AS error FROM pr)
SELECT proposal_id, CASE WHEN error IS NULL THEN 'quarantined' END AS state, error FROM e""",
)
def l2(spark, d):
    k = F.col("proposal_id")
    p = _proposals(spark, d).withColumns({"fields": F.when(k % 10 == 1, F.array(F.lit("excerpt"), F.lit("messages"))).otherwise(F.array(F.lit("excerpt"))), "opt_in": k % 11 != 2, "excerpt": F.col("text"), "claim_text": F.col("text"), "source_kind": F.when(k % 12 == 7, "crawler").otherwise("conversation")})
    return B.submit_proposals(p)


@query("l3_consent_active", _PROP + f" SELECT proposal_id, revoked IS NULL AND granted <= {T0} AND {T0} < expires AS active FROM pr")
def l3(spark, d):
    return _proposals(spark, d).select("proposal_id", B.consent_active(F.col("granted"), F.col("expires"), F.col("revoked"), now()).alias("active"))


def _evidence(spark, d):
    k = F.col("proposal_id")
    p = _proposals(spark, d).where(k % 6 != 5)
    kind = F.element_at(F.array(*map(F.lit, B.EVIDENCE_KINDS)), (k % 7 + 1).cast("int"))
    ref = F.when(k % 13 == 1, F.lit("RAG:doc")).otherwise(F.concat(F.lit("doi:"), k.cast("string")))
    quote = F.when(k % 2 == 0, F.lit("as said"))
    e = p.select("proposal_id", kind.alias("kind"), ref.alias("reference"), quote.alias("quote"), (k % 3 != 1).alias("independent"), F.when(k % 10 == 3, "unverified").otherwise("verified").alias("status"), F.when(k % 17 == 2, "agent:x").otherwise("lab").alias("verifier"), F.lit(True).alias("supports_claim"))
    return e.withColumn("evidence_hash", F.when(F.col("proposal_id") % 19 == 4, "wrong").otherwise(B.evidence_hash(F.col("kind"), F.col("reference"), F.col("quote"))))


_CHECK = _PROP + """, ev AS (SELECT *, ['primary_source', 'official_record', 'reproducible_experiment', 'decision_record', 'user_confirmation', 'user_statement', 'agent_response'][k % 7 + 1] AS kind, k % 13 = 1 OR k % 17 = 2 AS rec FROM pr WHERE k % 6 <> 5),
ck AS (SELECT pr.proposal_id, coalesce(k2.ind, false) AS independent, coalesce(k2.exc, true) AS response_excluded, coalesce(k2.refs, '') AS refs FROM pr LEFT JOIN (SELECT proposal_id, k % 3 <> 1 AND k % 10 <> 3 AND NOT rec AND k % 19 <> 4 AND CASE WHEN claim_kind = 'preference' THEN kind IN ('user_confirmation', 'user_statement') ELSE kind <> 'agent_response' END AS ind,
  NOT (kind = 'agent_response' OR rec) AS exc, CASE WHEN k % 13 = 1 THEN 'RAG:doc' ELSE 'doi:' || k END AS refs FROM ev) k2 USING (proposal_id))"""


def _checks(spark, d):
    return B.evidence_check(_proposals(spark, d), _evidence(spark, d))


@query("l4_evidence_check", _CHECK + " SELECT proposal_id, independent, response_excluded, refs FROM ck")
def l4(spark, d):
    return _checks(spark, d).select("proposal_id", "independent", "response_excluded", F.array_join("references", "|").alias("refs"))


_ADMIT = _CHECK + """, ad AS (SELECT proposal_id, CASE WHEN NOT response_excluded THEN 'agent_response_is_no_evidence' WHEN claim_kind IN ('hypothesis', 'opinion', 'question', 'agent_response') THEN 'stays_quarantined' WHEN claim_kind = 'preference' AND (claim_scope <> 'private' OR privacy <> 'private') THEN 'preference_must_be_private' WHEN claim_kind = 'preference' AND NOT independent THEN 'preference_needs_confirmation'
  WHEN claim_kind = 'project_decision' AND claim_scope = 'private' THEN 'decision_needs_scope' WHEN claim_kind = 'project_decision' AND NOT independent THEN 'decision_needs_record' WHEN claim_kind = 'factual_correction' AND NOT independent THEN 'correction_needs_source' WHEN claim_kind = 'observation_experiment' AND NOT independent THEN 'observation_needs_evidence' END AS reason FROM pr JOIN ck USING (proposal_id))"""


@query("l5_admission", _ADMIT + " SELECT proposal_id, reason IS NULL AS admitted, reason FROM ad")
def l5(spark, d):
    return B.admission(_proposals(spark, d), _checks(spark, d))


@query(
    "l5_review",
    _ADMIT + """, rv AS (SELECT proposal_id, ['admit', 'reject', 'revoke'][(k // 8) % 3 + 1] AS dec, 'u' || (k % 5) AS rev FROM pr), c AS (SELECT proposal_id, state, dec, CASE WHEN rev = author_id THEN 'reviewer_is_author' WHEN dec IN ('admit', 'reject') AND state <> 'quarantined' THEN 'state_invalid' WHEN dec = 'revoke' AND state <> 'admitted' THEN 'state_invalid' WHEN dec = 'admit' AND reason IS NOT NULL THEN 'not_admissible' ELSE 'applied' END AS code FROM rv JOIN pr USING (proposal_id) JOIN ad USING (proposal_id))
SELECT proposal_id, CASE WHEN code <> 'applied' THEN state WHEN dec = 'admit' THEN 'admitted' WHEN dec = 'reject' THEN 'rejected' ELSE 'revoked' END AS state, code FROM c""",
)
def l5b(spark, d):
    k = F.col("proposal_id")
    p = _proposals(spark, d)
    r = p.select("proposal_id", F.element_at(F.array(F.lit("admit"), F.lit("reject"), F.lit("revoke")), (F.floor(k / 8) % 3 + 1).cast("int")).alias("decision"), F.concat(F.lit("u"), (k % 5).cast("string")).alias("reviewer_id"))
    return B.review(p, r, B.admission(p, _checks(spark, d)))


@query("j13_learning_documents", _PROP + " SELECT 'learn-' || k || '.md' AS destination, proposal_id FROM pr WHERE state = 'admitted' AND privacy <> 'private' AND k % 7 <> 3")
def j13(spark, d):
    k = F.col("proposal_id")
    path = F.concat(F.lit("rag/documents/learn-"), k.cast("string"), F.lit(".md"))
    p = _proposals(spark, d).withColumn("derived", F.array(F.struct(F.lit("active_rag_document").alias("kind"), path.alias("path")), F.struct(F.lit("note").alias("kind"), F.lit("x").alias("path"))))
    return B.learning_documents(p, p.where(k % 7 == 3).select(path.alias("path")))


# --- streams --------------------------------------------------------------------------------------------------------


def _streamed(spark, d, frame, build, schema):
    """Write a derived table as the source of a stream, run the stream over it, and return what it wrote."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    frame.write.parquet(f"{at}/in")
    S.run_available(build(spark.readStream.schema(frame.schema).parquet(f"{at}/in")), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(schema).parquet(f"{at}/out")


@query(
    "t1_event_codes_stream",
    f"WITH {I.EVENTS}, f AS (SELECT event_id, min(seq) AS s, arg_min(payload_hash, seq) AS h FROM ev GROUP BY 1) SELECT event_id, seq, CASE WHEN seq = s THEN 'event_accepted' WHEN payload_hash = h THEN 'event_duplicate' ELSE 'event_id_conflict' END AS code FROM ev JOIN f USING (event_id)",
)
def t1c(spark, d):
    e = I.events(spark, d).select("event_id", "seq", "payload_hash", "occurred_at")
    return _streamed(spark, d, e, S.event_codes_stream, "event_id string, seq long, code string")


#: Every hour of the events is a snapshot; what is active then are the packages with an error in that hour. An hour without errors closes all.
@query(
    "t8_incident_ledger_stream",
    f"""WITH {I.EVENTS}, s AS (SELECT DISTINCT time_bucket(INTERVAL 1 HOUR, occurred_at) AS hour FROM ev), a AS (SELECT DISTINCT time_bucket(INTERVAL 1 HOUR, occurred_at) AS hour, 'package-' || package_id AS f FROM ev WHERE type = 'error'),
c AS (SELECT f, min(hour) AS opened, max(hour) AS seen FROM a GROUP BY 1)
SELECT f AS fingerprint, CASE WHEN seen = (SELECT max(hour) FROM s) THEN 'open' ELSE 'closed' END AS status, epoch_us(opened) AS first_us, epoch_us(seen) AS last_us, epoch_us((SELECT min(hour) FROM s WHERE s.hour > c.seen)) AS resolved_us FROM c""",
)
def t8s(spark, d):
    e = I.events(spark, d).select(F.date_trunc("hour", "occurred_at").alias("at"), F.when(F.col("type") == "error", F.concat(F.lit("package-"), F.col("package_id").cast("string"))).alias("fingerprint"))
    rows = e.select("at", F.lit(None).cast("string").alias("fingerprint")).unionByName(e.where("fingerprint IS NOT NULL")).distinct()
    end = e.agg(F.max("at").alias("m")).select((F.col("m") + F.expr("INTERVAL 1 DAY")).alias("at"), F.lit(None).cast("string").alias("fingerprint"))
    changes = _streamed(spark, d, rows.unionByName(end), S.ledger_changes, S.LEDGER)
    us = lambda c: F.unix_micros(c)
    return S.current_ledger(changes).select("fingerprint", "status", us("first_seen_at").alias("first_us"), us("last_seen_at").alias("last_us"), us("resolved_at").alias("resolved_us"))


@query("t1_dedupe_stream", f"WITH {I.EVENTS} SELECT DISTINCT event_id FROM ev")
def t1s(spark, d):
    e = I.events(spark, d).select("event_id", "occurred_at", "seq")
    return _streamed(spark, d, e, lambda s: S.dedupe_stream(s).select("event_id"), "event_id string")


_DEBOUNCED = f"""WITH RECURSIVE {I.EVENTS}, b AS MATERIALIZED (SELECT job_key, t, row_number() OVER (PARTITION BY job_key ORDER BY t) AS n FROM (SELECT package_id || '/' || type AS job_key, epoch_us(occurred_at) / 1e6 AS t FROM ev)),
g AS (SELECT job_key, n, t AS first, t AS last, least(t + 60, t + 300) AS due, CAST(1 AS BIGINT) AS events FROM b WHERE n = 1
UNION ALL SELECT b.job_key, b.n, CASE WHEN t <= due THEN first ELSE t END, t, least(t + 60, CASE WHEN t <= due THEN first ELSE t END + 300), CASE WHEN t <= due THEN events + 1 ELSE 1 END FROM g JOIN b ON b.job_key = g.job_key AND b.n = g.n + 1)
SELECT job_key, first, max(last) AS last, max(due) AS due, max(events) AS events FROM g GROUP BY 1, 2"""


@query("t3_debounce_stream", _DEBOUNCED)
def t3(spark, d):
    e = I.events(spark, d).select(F.concat_ws("/", F.col("package_id").cast("string"), "type").alias("job_key"), "occurred_at")
    last = e.agg(F.max("occurred_at").alias("m")).select(F.lit("end").alias("job_key"), (F.col("m") + F.expr("INTERVAL 1 DAY")).alias("occurred_at"))
    return _streamed(spark, d, e.unionByName(last), S.debounce_stream, "job_key string, first double, last double, due double, events long").where("job_key <> 'end'")


@query("t6_rate_limit_stream", _greedy("fb", "", "SELECT feedback_id, seq, accepted FROM g"))
def t6s(spark, d):
    f = I.feedback(spark, d).select("subject_hash", "feedback_id", "seq", "occurred_at")
    return _streamed(spark, d, f, lambda s: S.rate_limit_stream(s, limit=2, window=1800), "feedback_id string, seq long, accepted boolean")


@query("t7_windowed_stream", f"WITH {I.EVENTS}, w AS (SELECT package_id, time_bucket(INTERVAL 1 HOUR, occurred_at) AS s FROM ev) SELECT package_id, CAST(epoch(s) AS BIGINT) AS start, count(*) AS events FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(occurred_at) FROM ev) + INTERVAL 1 DAY - INTERVAL 10 MINUTE GROUP BY 1, 2")
def t7s(spark, d):
    e = I.events(spark, d).select("package_id", "occurred_at")
    last = e.agg(F.max("occurred_at").alias("m")).select(F.lit(-1).cast("long").alias("package_id"), (F.col("m") + F.expr("INTERVAL 1 DAY")).alias("occurred_at"))
    out = _streamed(spark, d, e.unionByName(last), S.windowed_counts, "package_id long, start timestamp, events long")
    return out.where("package_id >= 0").select("package_id", F.col("start").cast("long").alias("start"), "events")
