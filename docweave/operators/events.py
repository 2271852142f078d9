"""Events: idempotence, coalescing into jobs, impact, polls, budgets, incidents. Order of arrival is a column (seq); it is never guessed from times."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R

#: Quiet time and longest wait of a job, in seconds; impact thresholds.
DEBOUNCE, MOST_DEBOUNCE = 60, 300
IMPACT_THRESHOLD, IMPACT_SHARE, IMPACT_LEAST, IMPACT_BUDGET, CORPUS_DOCUMENTS = 10, 0.10, 3, 4, 100


def dedupe_events(events: DataFrame) -> DataFrame:
    """event_id, seq, code: the first event of an id (by seq) is accepted, later ones are duplicates if their payload hash is the same, conflicts if not. One aggregate, one join on the id."""
    first = events.groupBy("event_id").agg(F.min(F.struct("seq", "payload_hash")).alias("f")).select("event_id", F.col("f.seq").alias("first_seq"), F.col("f.payload_hash").alias("first_hash"))
    e = events.select("event_id", "seq", "payload_hash").join(first, "event_id")
    code = F.when(F.col("seq") == F.col("first_seq"), "event_accepted").when(F.col("payload_hash") == F.col("first_hash"), "event_duplicate").otherwise("event_id_conflict")
    return e.select("event_id", "seq", code.alias("code"))


def job_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def coalesce_jobs(events: DataFrame, now: Column) -> DataFrame:
    """One pending job a (package, type, revision, policy): key, count, first arrived and last event, due time, file sets, readiness.

    events: (package_id, type, observed_revision, policy_revision, occurred_at, seq, completed array, deferred array). Due 60 s after the last event, 300 s after the first at most. Counts and times are partial aggregates;
    files are made distinct a task before they are gathered.
    """
    keys = ["package_id", "type", "observed_revision", "policy_revision"]
    e = events.withColumn("policy_revision", F.coalesce("policy_revision", F.lit("")))
    files = e.select(*keys, F.explode(F.concat(F.transform("completed", lambda p: F.struct(F.lit(True).alias("done"), p.alias("path"))), F.transform("deferred", lambda p: F.struct(F.lit(False).alias("done"), p.alias("path"))))).alias("f"))
    files = files.groupBy(*keys, "f.path").agg(F.max("f.done").alias("done")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("done"), F.col("path")))).alias("completed_files"), F.array_sort(F.collect_list(F.when(~F.col("done"), F.col("path")))).alias("deferred_files")
    )
    j = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"), F.min_by("occurred_at", "seq").alias("first_event_at"), F.max("occurred_at").alias("last_event_at"))
    j = j.join(files, keys, "left")
    none = F.array().cast("array<string>")
    j = j.withColumns({"completed_files": F.coalesce("completed_files", none), "deferred_files": F.coalesce("deferred_files", none)})
    due = F.least(F.col("last_event_at") + F.make_dt_interval(secs=F.lit(DEBOUNCE)), F.col("first_event_at") + F.make_dt_interval(secs=F.lit(MOST_DEBOUNCE)))
    j = j.withColumns({"job_key": job_key(*map(F.col, keys)), "due_at": due})
    ready = (F.col("due_at") <= now) & ((F.size("completed_files") + F.size("deferred_files") == 0) | (F.size("completed_files") > 0))
    return j.withColumn("ready", ready).select("job_key", *keys, "event_count", "first_event_at", "last_event_at", "due_at", "completed_files", "deferred_files", "ready")


def remaining_files(jobs: DataFrame) -> DataFrame:
    """job_key, path of the files that are deferred and not completed."""
    return jobs.select("job_key", F.explode(F.array_except("deferred_files", "completed_files")).alias("path"))


def impact_state(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """package_id, document_id, revision, base_revision, impact, revoked, relevant: the last record of each document in order of arrival.

    events: (event_id, seq, package_id, document_id, revision, base_revision, impact, revoked). Event ids count once (first arrival). A revocation without base revision keeps the one before it. prior is such a table, older than all events.
    """
    fields = ["package_id", "document_id", "revision", "base_revision", "impact", "revoked"]
    once = events.groupBy("event_id").agg(F.min_by(F.struct("seq", *fields), "seq").alias("e")).select("e.*")
    impact = F.when(F.lower("impact").isin("conceptual", "factual", "uncertain"), F.lower("impact")).otherwise("uncertain")
    e = once.withColumns({"impact": impact, "revoked": F.coalesce("revoked", F.lit(False)), "revision": F.coalesce("revision", F.lit("")), "base_revision": F.coalesce("base_revision", F.lit(""))})
    if prior is not None:
        e = e.unionByName(prior.select(F.lit(-1).cast("long").alias("seq"), *fields))
    # of a revocation, empty revisions are taken from the records before it
    groups = e.groupBy("package_id", "document_id")
    last = groups.agg(
        F.max_by(F.struct("revision", "base_revision", "impact", "revoked"), "seq").alias("l"),
        F.max_by("revision", F.when(F.col("revision") != "", F.col("seq"))).alias("some_revision"),
        F.max_by("base_revision", F.when(F.col("base_revision") != "", F.col("seq"))).alias("some_base"),
    )
    take = lambda own, other: F.when(F.col("l.revoked") & (own == ""), F.coalesce(other, F.lit(""))).otherwise(own)
    s = last.select("package_id", "document_id", take(F.col("l.revision"), F.col("some_revision")).alias("revision"), take(F.col("l.base_revision"), F.col("some_base")).alias("base_revision"), F.col("l.impact").alias("impact"), F.col("l.revoked").alias("revoked"))
    relevant = ~F.col("revoked") & (F.col("revision") != "") & (F.col("revision") != F.col("base_revision")) & F.col("impact").isin("conceptual", "uncertain")
    return s.withColumn("relevant", relevant)


def impact_sets(events: DataFrame) -> DataFrame:
    """package_id and the numbers of documents seen reverted, factual, uncertain in a batch; a document that is reverted later still counts for what was seen before."""
    once = events.groupBy("event_id").agg(F.min_by(F.struct("package_id", "document_id", "revision", "base_revision", "impact", "revoked"), "seq").alias("e")).select("e.*").where("NOT coalesce(revoked, false)")
    back = (F.col("revision") == F.col("base_revision")) & (F.coalesce("revision", F.lit("")) != "")
    known = F.lower(F.coalesce("impact", F.lit("uncertain")))
    n = lambda c: F.count_distinct(F.when(c, F.col("document_id")))
    return once.groupBy("package_id").agg(n(back).alias("reverted"), n(~F.coalesce(back, F.lit(False)) & (known == "factual")).alias("factual"), n(~F.coalesce(back, F.lit(False)) & ~known.isin("factual", "conceptual")).alias("uncertain"))


#: Parts of a package whose relevant documents are hashed together; keys depend on it.
BATCH_BUCKETS = 1024


def impact_batch(state: DataFrame, seen: DataFrame, corpus_documents: int = CORPUS_DOCUMENTS, threshold: int = IMPACT_THRESHOLD) -> DataFrame:
    """package_id, batch_key, relevant, status (none, candidate_requested, review_required): a batch for packages with enough relevant documents whose key was not seen (package_id, batch_key) before."""
    r = state.where("relevant")
    # the key in two levels: documents are hashed in BATCH_BUCKETS parts of a package, so none holds more than its share of it
    docs = F.array_sort(F.collect_list(F.struct("document_id", "revision", "base_revision", "impact")))
    parts = r.groupBy("package_id", F.pmod(F.xxhash64("document_id"), F.lit(BATCH_BUCKETS)).alias("bucket"))
    parts = parts.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("impact") == "uncertain").alias("some_uncertain"), F.sha2(F.to_json(docs), 256).alias("part"))
    keys = F.array_sort(F.collect_list(F.struct("bucket", "part")))
    b = parts.groupBy("package_id").agg(F.sum("n").alias("relevant"), F.max("some_uncertain").alias("has_uncertain"), F.sha2(F.to_json(keys), 256).alias("batch_key"))
    enough = (F.col("relevant") >= threshold) | ((F.col("relevant") >= IMPACT_LEAST) & (F.col("relevant") / corpus_documents >= IMPACT_SHARE))
    b = b.join(seen.select("package_id", "batch_key", F.lit(True).alias("_seen")), ["package_id", "batch_key"], "left")
    status = F.when(~enough | F.col("_seen").isNotNull(), "none").when(F.col("has_uncertain"), "review_required").otherwise("candidate_requested")
    return b.select("package_id", "batch_key", "relevant", status.alias("status"))


def impact_budget(batches: DataFrame, budget: int = IMPACT_BUDGET) -> DataFrame:
    """package_id, seq, status: batches in order of arrival; one is put on the backlog if the 24 hours before it (inclusive) already hold ``budget`` batches that were not.

    What goes on the backlog does not count, so this is no window frame. Packages are sorted by arrival and run through in Arrow batches; a package's memory is the ``budget`` latest times that were
    taken, whatever its size: of the times taken, ``budget`` reach into the window exactly if the ``budget``-th latest does.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        package, latest = None, []
        for b in frames:
            out = []
            for key, at, status in zip(b["package_id"], b["_at"], b["status"]):
                if key != package:
                    package, latest = key, []
                if len(latest) == budget and latest and latest[0] >= at - 24 * 3600:
                    out.append("backlog")
                elif budget <= 0:
                    out.append("backlog")
                else:
                    out.append(status)
                    latest = sorted([*latest, at])[-budget:]
            yield b.assign(status=out)[["package_id", "seq", "status"]]

    rows = batches.where("status <> 'none'").select("package_id", "seq", (F.unix_micros(F.col("created_at").cast("timestamp")) / F.lit(1e6)).alias("_at"), "status")
    return rows.repartition("package_id").sortWithinPartitions("package_id", "seq").mapInPandas(run, "package_id long, seq long, status string")


def poll_changes(polls: DataFrame) -> DataFrame:
    """source_id, seq, changed, missed, alarm-free rows of polls (source_id, seq, hash; null hash: unavailable): whether the content changed since the last successful poll, and how many polls in a row failed up to now."""
    order = Window.partitionBy("source_id").orderBy("seq")
    before = F.last("hash", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ok = F.col("hash").isNotNull()
    p = polls.withColumn("_island", F.sum(ok.cast("int")).over(order))
    missed = F.sum((~ok).cast("int")).over(Window.partitionBy("source_id", "_island").orderBy("seq"))
    return p.select("source_id", "seq", (ok & ~F.col("hash").eqNullSafe(before)).alias("changed"), F.when(ok, F.lit(0)).otherwise(missed).cast("long").alias("missed"))


def poll_alarms(polls: DataFrame, threshold: int = 3) -> DataFrame:
    return poll_changes(polls).withColumn("threshold_reached", F.col("missed") >= threshold)


def incident_ledger(prior: DataFrame, active: DataFrame, now: Column) -> DataFrame:
    """fingerprint, status, first_seen_at, last_seen_at, resolved_at: new incidents open, seen ones stay or reopen, open ones that are not seen close."""
    a = active.select("fingerprint", F.lit(True).alias("_seen")).distinct()
    both = prior.withColumn("_prior", F.lit(True)).join(a, "fingerprint", "full_outer")
    seen = F.col("_seen").isNotNull()
    closing = ~seen & (F.col("status") == "open")
    return both.select(
        "fingerprint", F.when(seen, "open").when(closing, "closed").otherwise(F.col("status")).alias("status"), F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"), F.when(closing, now).when(~seen, F.col("resolved_at")).alias("resolved_at"),
    )


def accept_greedily(times: Iterator, window_seconds: float, limit: int) -> list[bool]:
    """Which of the submissions, in order of arrival, are accepted: those with fewer than ``limit`` accepted ones in the ``window_seconds`` before them (inclusive). Shared by the batch and streaming forms.

    Times may go back; then what was accepted later does not count, as it lies after the submission.
    """
    rule = Greedy(window_seconds, limit)
    return [rule.accepts(t) for t in times]


class Greedy:
    """The rule of accept_greedily for one subject, submission by submission. ``kept`` are the accepted times that may still count."""

    def __init__(self, window_seconds: float, limit: int):
        self.window, self.limit = window_seconds, limit
        self.kept: deque = deque()

    def accepts(self, t: float) -> bool:
        ok = sum(1 for k in self.kept if 0 <= (t - k) <= self.window) < self.limit
        if ok:
            self.kept.append(t)
            if len(self.kept) > 4 * self.limit:  # far older ones can't count again unless times go back by more than a window
                newest = max(self.kept)
                self.kept = deque(k for k in self.kept if newest - k <= 10 * self.window)
        return ok


def due_times(occurred: list[float], debounce: float = DEBOUNCE, most: float = MOST_DEBOUNCE) -> list[tuple[float, float, float, int]]:
    """Jobs (first, last, due, events) of sorted event times when a job closes at its due time: the capped debounce of the streaming form."""
    jobs: list[list] = []
    for t in sorted(occurred):
        if jobs and t <= jobs[-1][2]:
            j = jobs[-1]
            j[1], j[3] = t, j[3] + 1
            j[2] = min(t + debounce, j[0] + most)
        else:
            jobs.append([t, t, min(t + debounce, t + most), 1])
    return [tuple(j) for j in jobs]


def event_windows(events: DataFrame, time: str = "occurred_at") -> DataFrame:
    """Counts by tumbling hour, sliding 24 hours (by 6) and 60-second session of each package: kind, package_id, start, end, events."""
    parts = []
    for kind, w in (("tumbling", F.window(time, "1 hour")), ("sliding", F.window(time, "24 hours", "6 hours")), ("session", F.session_window(time, "60 seconds"))):
        g = events.groupBy("package_id", w.alias("w")).agg(F.count(F.lit(1)).alias("events"))
        parts.append(g.select(F.lit(kind).alias("kind"), "package_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def hashed(fields: dict[str, Column]) -> Column:
    return R.canonical_hash(fields)
