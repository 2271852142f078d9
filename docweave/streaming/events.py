"""Event operators on streams. State is bounded by a watermark, whereas the batch forms remember all: events later than the watermark are dropped, ids and submissions older than it forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import DEBOUNCE, MOST_DEBOUNCE, Greedy
from ..operators.feedback import RATE_LIMIT, RATE_WINDOW


def dedupe_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first event of each event_id within the watermark of occurred_at."""
    return events.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["event_id"])


#: Groups that share the ids of a stream of events; a checkpoint belongs to one number.
ID_GROUPS = 4096


def event_codes_stream(events: DataFrame, late: str = "1 hour", groups: int = ID_GROUPS) -> DataFrame:
    """event_id, seq, code of every event (event_id, seq, payload_hash, occurred_at): accepted, duplicate or conflict as in the batch form, by the first event of the id. An id is forgotten ``late`` after its newest event.

    Within a micro-batch events go by seq. Ids are dealt to ``groups`` by a hash, so Python is called once a group and not once an id; a group's state is its ids that are not yet forgotten, with the first payload
    and the newest time of each, and its timer stands for the earliest that may go.
    """
    memory = pd.Timedelta(late).total_seconds()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        known = {i: (first, newest, until) for i, first, newest, until in zip(*state.get)} if state.exists else {}
        touched = set()
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("seq")
            out = []
            for i, payload, at in zip(rows["event_id"], rows["payload_hash"], rows["_at"].tolist()):
                first, newest, _ = known.get(i, (payload, 0.0, 0))
                out.append("event_accepted" if i not in known else "event_duplicate" if payload is not None and payload == first else "event_id_conflict")
                newest = max(newest, at)
                known[i] = first, newest, max(int((newest + memory) * 1000), mark + 1)
                touched.add(i)
            yield pd.DataFrame({"event_id": rows["event_id"], "seq": rows["seq"], "code": out})
        known = {i: k for i, k in known.items() if i in touched or k[2] >= mark}
        if known:
            firsts, newest, until = (list(x) for x in zip(*known.values()))
            state.update((list(known), firsts, newest, until))
            state.setTimeoutTimestamp(min(until))
        elif state.exists:
            state.remove()

    rows = _timed(events, late).withColumn("_group", F.pmod(F.xxhash64("event_id"), F.lit(groups)))
    return rows.groupBy("_group").applyInPandasWithState(
        run, "event_id string, seq long, code string", "ids array<string>, firsts array<string>, newest array<double>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def _timed(events: DataFrame, late: str) -> DataFrame:
    """With _at, the time in seconds since the epoch: set by Spark, because times reach Python in the session's zone while watermarks are in UTC."""
    return events.withColumn("_at", F.unix_micros(F.col("occurred_at").cast("timestamp")) / F.lit(1e6)).withWatermark("occurred_at", late)


def debounce_stream(events: DataFrame, late: str = "1 minute", debounce: float = DEBOUNCE, most: float = MOST_DEBOUNCE) -> DataFrame:
    """job_key, first, last, due (seconds), events: a job for each run of events (job_key, occurred_at) of a key. It closes when the watermark passes its due time, 60 s after its last event or 300 s after its first, and is given out then."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = sorted(state.get[0]) if state.exists else []
        for b in batches:
            pending += b["_at"].tolist()
        pending.sort()
        mark = state.getCurrentWatermarkMs() / 1000
        out = []
        while pending:
            first = last = pending[0]
            due, n = min(first + debounce, first + most), 1
            for t in pending[1:]:
                if t > due:
                    break
                last, n = t, n + 1
                due = min(t + debounce, first + most)
            if due > mark:
                break
            out.append((key[0], first, last, due, n))
            pending = pending[n:]
        if pending:
            state.update((pending,))
            state.setTimeoutTimestamp(int(max(due * 1000, mark * 1000 + 1)))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["job_key", "first", "last", "due", "events"])

    return _timed(events, late).groupBy("job_key").applyInPandasWithState(
        run, "job_key string, first double, last double, due double, events long", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


#: Rows that a subject of the rate limit gives out at a time.
ROWS = 10_000


def rate_limit_stream(feedback: DataFrame, late: str = "1 minute", limit: int = RATE_LIMIT, window: float = RATE_WINDOW) -> DataFrame:
    """feedback_id, seq, accepted: the greedy limit of the batch form for each subject_hash. Within a micro-batch submissions go by seq.

    The state of a subject is the accepted times that a submission not yet too late may still count: those of the window and ``late`` before its newest. It goes when the watermark has passed that.
    """
    memory = window + pd.Timedelta(late).total_seconds()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        # a subject may be a large share of the events: ids stay in Arrow, and only what the rule reads is kept, 16 bytes a row besides them
        ids, seqs, times = [], [], []
        for b in batches:
            ids.append(pa.array(b["feedback_id"], pa.large_string(), from_pandas=True))
            seqs.append(b["seq"].to_numpy())
            times.append(b["_at"].to_numpy())
        ids, seqs, times = pa.chunked_array(ids), np.concatenate(seqs), np.concatenate(times)
        order = np.argsort(seqs, kind="stable")
        rule = Greedy(window, limit)
        for t in kept:
            rule.accepts(t)
        newest = max(kept, default=0.0)
        for start in range(0, len(order), ROWS):
            now = order[start : start + ROWS]
            ok = []
            for t in times[now].tolist():
                ok.append(rule.accepts(t))
                if ok[-1]:
                    kept.append(t)
                    newest = max(newest, t)
            yield pd.DataFrame({"feedback_id": ids.take(pa.array(now)).to_pandas(), "seq": seqs[now], "accepted": ok})
        state.update(([t for t in kept if newest - t <= memory],))
        state.setTimeoutTimestamp(max(int((newest + memory) * 1000), state.getCurrentWatermarkMs() + 1))

    return _timed(feedback, late).groupBy("subject_hash").applyInPandasWithState(run, "feedback_id string, seq long, accepted boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


#: Groups that share the fingerprints of a ledger; each hears of every snapshot.
LEDGER_GROUPS = 16
LEDGER = "fingerprint string, status string, first_seen_at timestamp, last_seen_at timestamp, resolved_at timestamp, at timestamp"
#: transformWithState keeps its state in RocksDB.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Ledger(StatefulProcessor):
    """Of one group: the incidents by fingerprint, and what waits for its snapshot to be complete. One timer stands for the earliest snapshot that waits."""

    COLUMNS = ["fingerprint", "status", "first", "last", "resolved", "at"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.incidents = handle.getMapState("incidents", "fingerprint string", "open boolean, first long, last long, resolved long")
        self.waiting = handle.getListState("waiting", "at long, fingerprint string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # an empty name stands for the snapshot itself, which comes to every group
        new = [(int(at), f if isinstance(f, str) else "") for b in rows for at, f in zip(b["micros"].tolist(), b["fingerprint"].tolist())]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0] // 1000 + 1)
        yield pd.DataFrame(columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [(int(at), f) for at, f in self.waiting.get()]
        rest = [x for x in waiting if x[0] >= mark]
        snapshots: dict[int, set] = {}
        for at, f in waiting:
            if at < mark:
                snapshots.setdefault(at, set()).add(f)
        out, changed = [], {}
        if snapshots:
            now = {k[0]: tuple(v) for k, v in self.incidents.iterator()}
            for at in sorted(snapshots):  # in the order of time, whatever micro-batch brought them
                active = snapshots[at] - {""}
                for f in sorted(active):
                    changed[f] = now[f] = (True, now[f][1] if f in now else at, at, None)
                    out.append((f, "open", now[f][1], at, None, at))
                for f in sorted(f for f, v in now.items() if v[0] and f not in active):
                    changed[f] = now[f] = (False, now[f][1], now[f][2], at)
                    out.append((f, "closed", now[f][1], now[f][2], at, at))
            for f, v in changed.items():
                self.incidents.updateValue((f,), v)
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if rest:
            self.handle.registerTimer(min(rest)[0] // 1000 + 1)
        yield pd.DataFrame(out, columns=self.COLUMNS).astype({"resolved": "Int64"})

    def close(self) -> None:
        pass


def ledger_changes(snapshots: DataFrame, late: str = "10 minutes", groups: int = LEDGER_GROUPS) -> DataFrame:
    """The changes of an incident ledger (columns of LEDGER; ``at`` is the snapshot that made the change) of a stream of snapshots (at, fingerprint): a row for every incident that is active at that time, and one
    without fingerprint for the snapshot itself, so that empty snapshots count too.

    New incidents open, seen ones stay open or open again, open ones that a snapshot lacks close. A snapshot is taken when the watermark has passed it, so the ledger is the same however its rows are cut into
    micro-batches; rows that come later than that are dropped. State is kept by fingerprint: only what a snapshot changes is written. Empty fingerprints count as none. Set STATE_STORE where the query is started (``run_available`` does).
    """
    own = F.pmod(F.xxhash64("fingerprint"), F.lit(groups)).cast("int")
    whole = F.sequence(F.lit(0), F.lit(groups - 1))
    rows = snapshots.withWatermark("at", late).withColumn("fingerprint", F.nullif("fingerprint", F.lit(""))).withColumn("micros", F.unix_micros(F.col("at").cast("timestamp")))
    rows = rows.withColumn("group", F.explode(F.when(F.col("fingerprint").isNull(), whole).otherwise(F.array(own)))).select("group", "at", "micros", "fingerprint")
    made = rows.groupBy("group").transformWithStateInPandas(_Ledger(), "fingerprint string, status string, first long, last long, resolved long, at long", "Append", "eventTime")
    time = F.timestamp_micros
    return made.select("fingerprint", "status", time("first").alias("first_seen_at"), time("last").alias("last_seen_at"), time("resolved").alias("resolved_at"), time("at").alias("at"))


def current_ledger(changes: DataFrame) -> DataFrame:
    """The ledger that changes add up to: each incident as its last change left it."""
    columns = [c for c in changes.columns if c != "fingerprint"]
    return changes.groupBy("fingerprint").agg(F.max_by(F.struct(*columns), F.col("at")).alias("_last")).select("fingerprint", *[F.col(f"_last.{c}").alias(c) for c in columns])


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """package_id, start, events of closed tumbling windows."""
    g = events.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", size).alias("w"), "package_id").agg(F.count(F.lit(1)).alias("events"))
    return g.select("package_id", F.col("w.start").alias("start"), "events")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what its source holds now, into Parquet files; state is kept in RocksDB."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
