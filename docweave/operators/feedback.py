"""Usage feedback and learning admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R
from .events import Greedy

#: Thresholds and limits.
INVESTIGATION, REGRESSION, ABSTENTION, ABSTENTION_LEAST, RATE_LIMIT, RATE_WINDOW = 3, 0.03, 0.10, 100, 20, 60
KINDS = ("wrong_answer", "retrieval_miss", "unhelpful", "abstention", "latency", "cost")
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
COMPARED = ("dataset_id", "corpus_revision", "index_revision", "golden_revision", "harness_revision", "configuration_hash")


def _blank(c) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def normalize_feedback(raw: DataFrame) -> DataFrame:
    """Submissions with error (first fault, null: accepted), question_hash, subject_hash and occurrence_hash; question and reporter are kept as hashes only.

    raw: (feedback_id, event_id, package_id, generation, kind, question, reporter_id, session_id, authenticated, source, subject, proof, latency_ms, cost_units, occurred_at, seq).
    """
    question = F.coalesce(F.trim("question"), F.lit(""))
    error = (
        F.when(~F.coalesce(F.col("feedback_id").rlike(SAFE_ID), F.lit(False)), "feedback_id_invalid").when(_blank("package_id"), "feedback_invalid").when(~F.coalesce("kind", F.lit("")).isin(*KINDS), "feedback_kind_invalid")
        .when(F.length(question) > 8000, "feedback_field_too_large").when(~F.coalesce(F.col("event_id").rlike(SAFE_ID), F.lit(False)), "event_id_invalid")
        .when(~F.coalesce("authenticated", F.lit(False)), "feedback_authentication_required").when(_blank("source") | _blank("subject") | _blank("proof"), "feedback_authentication_invalid")
        .when(F.col("reporter_id").isNotNull() & (F.col("subject") != F.col("reporter_id")), "feedback_authentication_subject_mismatch")
        .when((F.col("latency_ms") < 0) | (F.col("cost_units") < 0), "feedback_number_invalid")
    )
    question_hash = F.sha2(F.when(question == "", "<missing-question>").otherwise(question), 256)
    who = F.coalesce(F.nullif(F.trim("session_id"), F.lit("")), F.nullif(F.trim("reporter_id"), F.lit("")), F.lit("anonymous"))
    occurrence = R.canonical_hash({"package_id": F.col("package_id"), "generation": F.col("generation"), "kind": F.col("kind"), "question_hash": question_hash, "independence": who})
    return raw.withColumns({"error": error, "question_hash": question_hash, "subject_hash": F.sha2(F.coalesce("subject", F.lit("")), 256), "occurrence_hash": occurrence}).drop("question", "reporter_id", "subject", "proof", "session_id")


def rate_limit(feedback: DataFrame, limit: int = RATE_LIMIT, window: int = RATE_WINDOW) -> DataFrame:
    """feedback_id, seq, code: accepted, duplicate (same id and hash as before), feedback_id_conflict, feedback_replay (event id used before), rate_limited.

    feedback: (feedback_id, event_id, subject_hash, content_hash, occurred_at, seq). Only accepted submissions count towards the limit of ``limit`` a subject in ``window`` seconds (inclusive), so acceptance is sequential for each
    subject: after ids are settled by windows, one linear pass a subject in an Arrow helper. (An id counts as used from its first submission on, whether that was accepted or not.)
    """
    # a window instead of an aggregate and a join: rows are dealt out once for each of the ids, and the hash stays behind with the first of them
    f = feedback.select("feedback_id", "event_id", "subject_hash", "content_hash", "occurred_at", "seq")
    first = F.min(F.struct("seq", "content_hash")).over(Window.partitionBy("feedback_id"))
    later = F.col("seq") > F.col("_first.seq")
    f = f.withColumn("_first", first).withColumn("code", F.when(later & (F.col("content_hash") == F.col("_first.content_hash")), "duplicate").when(later, "feedback_id_conflict")).drop("_first", "content_hash")
    used = F.min("seq").over(Window.partitionBy("event_id"))
    f = f.withColumn("code", F.coalesce("code", F.when(F.col("seq") > used, "feedback_replay"))).where("feedback_id IS NOT NULL AND event_id IS NOT NULL")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, rule = None, None
        for b in frames:
            codes = []
            for key, at, code in zip(b["subject_hash"], b["_at"], b["code"]):
                if isinstance(code, str):  # settled by its ids
                    codes.append(code)
                    continue
                if key != subject:
                    subject, rule = key, Greedy(window, limit)
                codes.append("accepted" if rule.accepts(at) else "rate_limited")
            yield pd.DataFrame({"feedback_id": b["feedback_id"], "seq": b["seq"], "code": codes})

    # subjects are sorted by arrival and run through in Arrow batches; a subject's memory is its accepted times of late
    # settled rows go along, so that nothing above is computed twice
    all_ = f.select("feedback_id", "seq", "subject_hash", "code", (F.unix_micros(F.col("occurred_at").cast("timestamp")) / F.lit(1e6)).alias("_at"))
    return all_.repartition("subject_hash").sortWithinPartitions("subject_hash", "seq").mapInPandas(run, "feedback_id string, seq long, code string")


def submission_rate(feedback: DataFrame, window: int = RATE_WINDOW) -> DataFrame:
    """feedback_id, seq, recent: all submissions of the subject in the ``window`` seconds up to this one (inclusive)."""
    at = F.unix_micros("occurred_at")
    w = Window.partitionBy("subject_hash").orderBy(at).rangeBetween(-window * 1_000_000, 0)
    return feedback.select("feedback_id", "seq", F.count(F.lit(1)).over(w).alias("recent"))


def feedback_report(feedback: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """package_id, submissions, unique_occurrences, duplicate_submissions, first_seen, last_seen in the window of ``days`` up to ``now`` (both ends inclusive). Two levels, so that no occurrence or package is gathered in one task."""
    f = feedback.where(F.col("occurred_at").between(R.window_start(now, days), now))
    o = f.groupBy("package_id", "occurrence_hash").agg(F.count(F.lit(1)).alias("n"), F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"))
    return o.groupBy("package_id").agg(F.sum("n").alias("submissions"), F.count(F.lit(1)).alias("unique_occurrences"), F.sum(F.col("n") - 1).alias("duplicate_submissions"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))


def open_investigations(feedback: DataFrame, now: Column, days: int = 7, threshold: int = INVESTIGATION) -> DataFrame:
    """package_id, kind, occurrences, investigation_id, questions (sorted hashes): kinds with at least ``threshold`` independent occurrences in the window, ordered by when they were first seen."""
    f = feedback.where(F.col("occurred_at").between(R.window_start(now, days), now))
    o = f.groupBy("package_id", "kind", "occurrence_hash").agg(F.min("occurred_at").alias("first"), F.min("question_hash").alias("q"))
    g = o.groupBy("package_id", "kind").agg(F.count(F.lit(1)).alias("occurrences"), F.array_sort(F.collect_list(F.struct("first", "occurrence_hash"))).alias("os"), F.array_sort(F.collect_set("q")).alias("questions"))
    seed = R.canonical_hash({"package_id": F.col("package_id"), "kind": F.col("kind"), "occurrences": F.col("os.occurrence_hash")})
    return g.where(F.col("occurrences") >= threshold).select("package_id", "kind", "occurrences", F.concat(F.lit("investigation-"), F.substring(seed, 1, 24)).alias("investigation_id"), "questions")


def usage_stats(feedback: DataFrame, by: str = "package_id") -> DataFrame:
    """by, metric, count, total, mean, p50, p95 (nearest rank), rounded to six places, of latency_ms and cost_units."""
    m = feedback.select(by, F.explode(F.array(F.struct(F.lit("latency_ms").alias("metric"), F.col("latency_ms").cast("double").alias("v")), F.struct(F.lit("cost_units").alias("metric"), F.col("cost_units").cast("double").alias("v")))).alias("x")).select(by, "x.*").where("v IS NOT NULL")
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY v)")
    return m.groupBy(by, "metric").agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("v"), 6).alias("total"), F.round(F.avg("v"), 6).alias("mean"), F.round(p(0.5), 6).alias("p50"), F.round(p(0.95), 6).alias("p95"))


def compare_metrics(comparisons: DataFrame) -> DataFrame:
    """Each comparison (baseline and current structs with value, denominator and the fields of COMPARED) with status, reason, delta, regression."""
    mismatch = F.lit(None).cast("string")
    for f in reversed(COMPARED):
        b, c = F.col(f"baseline.{f}"), F.col(f"current.{f}")
        mismatch = F.when(b.isNull() | c.isNull() | (b != c), f).otherwise(mismatch)
    value_gone = F.col("baseline.value").isNull() | F.col("current.value").isNull() | (F.least(F.coalesce("baseline.denominator", F.lit(0)), F.coalesce("current.denominator", F.lit(0))) <= 0)
    abstains = F.lower("metric").startswith("abstention")
    enough = ~abstains | (F.coalesce("current.denominator", F.lit(0)) >= ABSTENTION_LEAST)
    delta = F.round(F.col("current.value") - F.col("baseline.value"), 6)
    status = F.when(F.col("baseline").isNull() | F.col("current").isNull() | mismatch.isNotNull(), "not_comparable").when(value_gone, "insufficient_denominator").when(enough, "comparable").otherwise("insufficient_denominator")
    c = comparisons.withColumns({"status": status, "field": mismatch})
    measured = F.col("status") == "comparable"
    fall = F.col("current.value") - F.col("baseline.value") < -F.when(abstains, F.lit(ABSTENTION)).otherwise(F.lit(REGRESSION))
    return c.withColumns({"delta": F.when(measured, delta), "regression": F.coalesce(measured & fall, F.lit(False))})


def metric_regression(comparisons: DataFrame) -> DataFrame:
    """package_id, samples, comparable, status, metric, regression, delta of each package's comparisons (in order of seq): one that is not comparable decides, then insufficient ones if none is comparable, then the first regression or the first comparable one."""
    c = compare_metrics(comparisons)
    pick = lambda cond: F.min(F.when(cond, F.struct("seq", "metric", "regression", "delta")))
    g = c.groupBy("package_id").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("status") == "comparable").alias("n"), pick(F.col("status") == "not_comparable").alias("no"), pick(F.col("status") == "insufficient_denominator").alias("few"),
        pick((F.col("status") == "comparable") & F.col("regression")).alias("bad"), pick(F.col("status") == "comparable").alias("good"),
    )
    status = F.when(F.col("no").isNotNull(), "not_comparable").when((F.col("n") == 0) & F.col("few").isNotNull(), "insufficient_denominator").otherwise("comparable")
    g = g.withColumn("status", status)
    one = F.when(F.col("status") == "not_comparable", F.col("no")).when(F.col("status") == "insufficient_denominator", F.col("few")).otherwise(F.coalesce("bad", "good"))
    ok = F.col("status") == "comparable"
    return g.select("package_id", "samples", F.when(ok, F.col("n")).otherwise(F.lit(0)).alias("comparable"), "status", one["metric"].alias("metric"), F.when(ok, one["regression"]).otherwise(F.lit(False)).alias("regression"), F.when(ok, one["delta"]).alias("delta"))


# --- learning -------------------------------------------------------------------------------------------------------

#: Scopes, kinds of claims and evidence, origins that are no evidence, fields that hold whole conversations, limits.
SCOPES = ("private", "project", "shared")
CLAIM_KINDS = ("preference", "project_decision", "factual_correction", "observation_experiment", "hypothesis", "opinion", "agent_response", "question")
EVIDENCE_KINDS = ("primary_source", "official_record", "reproducible_experiment", "decision_record", "user_confirmation", "user_statement", "agent_response", "conversation")
INDEPENDENT = EVIDENCE_KINDS[:6]
RESPONSES = ("agent_response", "assistant_response", "model_output")
RECURSIVE = ("agent", "assistant", "model", "rag", "conversation")
TRANSCRIPT_FIELDS = ("messages", "transcript", "full_transcript", "conversation_log", "chat_history")
MOST_EXCERPT, MOST_CLAIM = 4000, 2000


def submit_proposals(raw: DataFrame) -> DataFrame:
    """proposal_id, state (quarantined or null), error: the first fault of a proposal (proposal_id, fields array of its field names, opt_in, excerpt, claim_text, claim_kind, claim_scope, privacy, source_kind)."""
    privacy = F.coalesce(F.nullif(F.trim("privacy"), F.lit("")), F.trim("claim_scope"))
    excerpt, claim = F.trim(F.coalesce("excerpt", F.lit(""))), F.trim(F.coalesce("claim_text", F.lit("")))
    kind, scope = F.trim(F.coalesce("claim_kind", F.lit(""))), F.trim(F.coalesce("claim_scope", F.lit("")))
    error = (
        F.when(F.arrays_overlap(F.coalesce("fields", F.array().cast("array<string>")), F.array(*map(F.lit, TRANSCRIPT_FIELDS))), "capture_not_minimized").when(~F.coalesce("opt_in", F.lit(False)), "capture_not_opted_in")
        .when(excerpt == "", "excerpt_required").when(F.length(excerpt) > MOST_EXCERPT, "excerpt_too_large").when((claim == "") | (F.length(claim) > MOST_CLAIM), "claim_invalid")
        .when(~kind.isin(*CLAIM_KINDS), "claim_kind_invalid").when(~scope.isin(*SCOPES), "claim_scope_invalid").when(~F.coalesce(privacy, F.lit("")).isin(*SCOPES), "privacy_invalid")
        .when((kind == "preference") & ((scope != "private") | (privacy != "private")), "preference_scope_invalid").when(~F.coalesce("source_kind", F.lit("conversation")).isin("conversation", "operator", "import"), "source_kind_invalid")
    )
    p = raw.select("proposal_id", error.alias("error"))
    return p.select("proposal_id", F.when(F.col("error").isNull(), "quarantined").alias("state"), "error")


def consent_active(granted: Column, expires: Column, revoked: Column, now: Column) -> Column:
    return F.coalesce(revoked.isNull() & (granted <= now) & (now < expires), F.lit(False))


def evidence_hash(kind: Column, reference: Column, quote: Column) -> Column:
    return R.canonical_hash({"kind": kind, "reference": reference, "quote": quote})


def evidence_check(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """proposal_id, independent, response_excluded, references (sorted).

    evidence: (proposal_id, kind, reference, quote, independent, status, verifier, supports_claim, evidence_hash). Only verified evidence whose hash fits what it cites counts; preferences need the user's own word;
    references or verifiers that are agents, models or retrieval are no evidence and spoil the proposal.
    """
    scheme = lambda c: F.lower(F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), "^([^:]*)", 1))
    recursive = scheme("reference").isin(*RECURSIVE) | scheme("verifier").isin(*RECURSIVE)
    verified = (F.col("status") == "verified") & F.coalesce("supports_claim", F.lit(False)) & ~recursive & (F.col("evidence_hash") == evidence_hash(F.col("kind"), F.col("reference"), F.col("quote")))
    own_word = F.col("kind").isin("user_confirmation", "user_statement")
    counts = F.coalesce(F.col("independent") & verified, F.lit(False)) & F.when(F.col("claim_kind") == "preference", own_word).otherwise(F.col("kind").isin(*INDEPENDENT))
    e = evidence.join(proposals.select("proposal_id", "claim_kind"), "proposal_id")
    g = e.groupBy("proposal_id").agg(F.bool_or(counts).alias("independent"), (~F.bool_or(F.lower("kind").isin(*RESPONSES) | recursive)).alias("response_excluded"), F.array_sort(F.collect_set(F.nullif(F.trim("reference"), F.lit("")))).alias("references"))
    p = proposals.select("proposal_id").join(g, "proposal_id", "left")
    return p.select("proposal_id", F.coalesce("independent", F.lit(False)).alias("independent"), F.coalesce("response_excluded", F.lit(True)).alias("response_excluded"), F.coalesce("references", F.array().cast("array<string>")).alias("references"))


def admission(proposals: DataFrame, checks: DataFrame) -> DataFrame:
    """proposal_id, admitted, reason of quarantined proposals (proposal_id, claim_kind, claim_scope, privacy) and their evidence checks; an ordered table by kind of claim."""
    p = proposals.join(checks, "proposal_id", "left")
    kind, independent = F.col("claim_kind"), F.coalesce("independent", F.lit(False))
    reason = (
        F.when(~F.coalesce("response_excluded", F.lit(False)), "agent_response_is_no_evidence").when(kind.isin("hypothesis", "opinion", "question", "agent_response"), "stays_quarantined")
        .when((kind == "preference") & ((F.col("claim_scope") != "private") | (F.col("privacy") != "private")), "preference_must_be_private").when((kind == "preference") & ~independent, "preference_needs_confirmation")
        .when((kind == "project_decision") & ~F.col("claim_scope").isin("project", "shared"), "decision_needs_scope").when((kind == "project_decision") & ~independent, "decision_needs_record")
        .when((kind == "factual_correction") & ~independent, "correction_needs_source").when((kind == "observation_experiment") & ~independent, "observation_needs_evidence")
        .when(~kind.isin("preference", "project_decision", "factual_correction", "observation_experiment"), "kind_not_admissible")
    )
    return p.select("proposal_id", reason.isNull().alias("admitted"), reason.alias("reason"))


def review(proposals: DataFrame, reviews: DataFrame, admissions: DataFrame) -> DataFrame:
    """proposal_id, state, code after reviews (proposal_id, decision, reviewer_id): admit needs an admissible proposal, reject a quarantined one, revoke an admitted one; nobody reviews their own."""
    r = reviews.join(proposals.select("proposal_id", "state", "author_id"), "proposal_id").join(admissions, "proposal_id", "left")
    d = F.col("decision")
    code = (
        F.when(F.col("reviewer_id").eqNullSafe(F.col("author_id")), "reviewer_is_author").when((d == "admit") & (F.col("state") != "quarantined"), "state_invalid").when((d == "reject") & (F.col("state") != "quarantined"), "state_invalid")
        .when((d == "revoke") & (F.col("state") != "admitted"), "state_invalid").when((d == "admit") & ~F.coalesce("admitted", F.lit(False)), "not_admissible").when(~d.isin("admit", "reject", "revoke"), "decision_invalid").otherwise("applied")
    )
    r = r.withColumn("code", code)
    new = F.when(F.col("code") != "applied", F.col("state")).when(d == "admit", "admitted").when(d == "reject", "rejected").otherwise("revoked")
    return r.select("proposal_id", new.alias("state"), "code")


def learning_documents(proposals: DataFrame, tombstones: DataFrame) -> DataFrame:
    """destination, proposal_id of the documents that admitted proposals that are not private left in the corpus (derived array of struct<kind, path>), minus tombstones (path)."""
    d = proposals.where("state = 'admitted' AND privacy <> 'private'").select("proposal_id", F.explode("derived").alias("x")).where("x.kind = 'active_rag_document' AND x.path LIKE 'rag/documents/%'")
    d = d.select("proposal_id", F.col("x.path").alias("path")).join(tombstones.select("path").distinct(), "path", "left_anti")
    return d.select(F.regexp_replace("path", "^rag/documents/", "").alias("destination"), "proposal_id")
