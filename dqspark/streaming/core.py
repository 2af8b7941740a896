"""Structured Streaming forms of the stateful operators (ST1-ST8).

Sinks are idempotent and restartable: every query has a checkpoint in the
shared checkpoint folder (``spark.checkpoint.dir``); aggregates run in
update mode into a changelog written per micro-batch id (a retried batch
overwrites its own partition), and readers take the latest row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dqspark.functions.exprs import py_strip
from dqspark.session import scratch_path

# --------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# --------------------------------------------------------------------------
CHANGE_TTL_SECONDS = 15 * 60          # a proposal expires when older than this (strictly)
ALERT_THRESHOLD = 95.0                # standard alert condition: score < 95
# --------------------------------------------------------------------------


def file_stream(spark: SparkSession, folder: str, file_name: str, schema) -> DataFrame:
    """A file stream over one parquet file of a folder (tests); on a cluster
    the same code reads a landing folder of new files."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_name)
            .option("maxFilesPerTrigger", 1).parquet(folder))


def run_append(sdf: DataFrame, spark: SparkSession, name: str, arrivals: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """Run an append-mode stream over all there is (availableNow) into a
    parquet sink with a checkpoint; return the sink as a batch DataFrame.
    ``arrivals``: steps that bring further input; after each the query is
    started again from its checkpoint."""
    out, ckpt = scratch_path(spark, name), scratch_path(spark, name + "-ckpt")
    writer = (sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
              .outputMode("append").trigger(availableNow=True))
    for arrive in (None, *arrivals):
        if arrive:
            arrive()
        writer.start().awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)


def run_update(sdf: DataFrame, spark: SparkSession, name: str, keys: Sequence[str],
               arrivals: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """Run an update-mode aggregation over all there is; each micro-batch's
    updated rows are written to ``<out>/_batch=<id>`` (overwrite, so a replayed
    batch is idempotent).  Returns the latest row per key.  ``arrivals`` as in
    :func:`run_append`."""
    out, ckpt = scratch_path(spark, name), scratch_path(spark, name + "-ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    writer = (sdf.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
              .outputMode("update").trigger(availableNow=True))
    for arrive in (None, *arrivals):
        if arrive:
            arrive()
        writer.start().awaitTermination()
    log = spark.read.parquet(out)
    newest = F.max_by(F.struct(*[c for c in log.columns if c not in keys]), F.col("_batch")).alias("_l")
    return log.groupBy(*keys).agg(newest).select(*keys, "_l.*").drop("_batch")


# ST1 -----------------------------------------------------------------------
APPROVAL_EVENT_SCHEMA = ("change_id string, kind string, ts timestamp, event_id long, reason string, "
                         "session_id string")
#: ``rows``: Arrow stream of the group's rows in :data:`APPROVAL_ROW`'s columns.
APPROVAL_STATE_SCHEMA = "rows binary"
#: ``code``: 0 proposal, 1 approval; kept in the state only: 2 a change that is open, 3 one that is gone (``us``: its proposal's time).
#: ``us``: event time in microseconds, UNTIMED for none.
APPROVAL_ROW = ["change_id", "us", "code", "event_id", "no_event", "reasoned"]
CLOCK, UNTIMED = 9, (1 << 63) - 1
#: Groups that the change ids are dealt to by hash; each is settled in one call.  A checkpoint goes on only with the number it began with.
APPROVAL_GROUPS = 256


def _approval_fn(ttl_seconds: int, remember_seconds: int):
    ttl, life = ttl_seconds * 1_000_000, (ttl_seconds + remember_seconds) * 1_000_000

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [pa.ipc.open_stream(bytes(state.get[0])).read_pandas()] if state.exists else []
        if not state.hasTimedOut:
            parts += [pdf[APPROVAL_ROW] for pdf in pdfs]
        rows = pd.concat(parts, ignore_index=True)
        rows = rows[rows["code"] != CLOCK]
        watermark = state.getCurrentWatermarkMs()
        kept = rows["code"] >= 2
        due = ~kept & (rows["us"] <= watermark * 1000)  # nothing earlier can still come
        untimed = ~kept & (rows["us"] == UNTIMED)       # nothing to wait for: settled after all that is here of its change
        if untimed.any():
            due |= ~kept & rows["change_id"].isin(rows.loc[untimed, "change_id"])
        changes = {c: (us, code == 3) for c, us, code in zip(*(rows.loc[kept, n].tolist() for n in APPROVAL_ROW[:3]))}
        out = []
        todo = rows[due].sort_values(["us", "code", "no_event", "event_id", "reasoned"])
        for change, us, code, event, no_event, reasoned in zip(*(todo[n].tolist() for n in APPROVAL_ROW)):
            created, gone = changes.get(change, (None, False))
            if created is not None and us != UNTIMED and us - created > life:
                created, gone = None, False
            if code == 0:
                changes[change] = (us, False) if created is None else (created, gone)
                continue
            if created is None or gone:
                status = "unknown"
            elif us != UNTIMED and us - created > ttl:
                status, gone = "expired", True
            elif not reasoned:
                status = "no_reason"
            else:
                status, gone = "applied", True
            if created is None:
                changes.pop(change, None)
            else:
                changes[change] = (created, gone)
            out.append((change, None if no_event else event, None if us == UNTIMED else us, status))
        live = [(c, us, 2 + gone, 0, True, False) for c, (us, gone) in changes.items() if us + life >= watermark * 1000 and us != UNTIMED]
        waiting = rows[~kept & ~due]
        if live or len(waiting):
            wake = int(waiting["us"].min()) if len(waiting) else min(r[1] for r in live) + life
            held = pa.Table.from_pandas(pd.concat([waiting, pd.DataFrame(live, columns=APPROVAL_ROW)]) if live else waiting,
                                        schema=_approval_arrow(), preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
                stream.write_table(held)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(wake // 1000, watermark) + 1)
        elif state.exists:
            state.remove()
        if out:
            pdf = pd.DataFrame(out, columns=["change_id", "event_id", "us", "status"], dtype=object)
            yield pdf.astype({"event_id": "Int64", "us": "Int64"})
    return fn


def _approval_arrow() -> pa.Schema:
    return pa.schema(list(zip(APPROVAL_ROW, [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()])))


def approve_within_ttl(events: DataFrame, ttl_seconds: int = CHANGE_TTL_SECONDS, watermark: str = "1 hour",
                       remember_seconds: int = 86_400, groups: int = APPROVAL_GROUPS) -> DataFrame:
    """ST1 over a stream of proposal / approval events (APPROVAL_EVENT_SCHEMA).

    Per change_id, in event-time order: an approval is 'applied' when the
    proposal exists, is at most ``ttl_seconds`` old and has not been consumed,
    and the reason is non-blank; 'expired' (and the change dropped) when older;
    'no_reason' leaves it pending; anything else is 'unknown', also an approval
    over ``remember_seconds`` after expiry, when the change is forgotten.

    Events wait in the state until the watermark has passed them, so the
    answers depend on event times alone, not on how events are dealt to
    micro-batches; rows later than ``watermark`` are dropped.  Rows of kind
    'clock' only move the watermark; an approval without a time doesn't wait.
    State is bounded by the events within the watermark's delay and the
    changes not yet forgotten.  It is kept for ``groups`` groups of change ids
    (by hash), so the calls a micro-batch makes don't grow with the ids."""
    from dqspark.session import ship_package
    ship_package(events.sparkSession)
    rows = events.withWatermark("ts", watermark).select(
        F.pmod(F.xxhash64("change_id"), F.lit(groups)).alias("part"), "ts", "change_id",
        F.coalesce(F.unix_micros("ts"), F.lit(UNTIMED)).alias("us"),
        F.when(F.col("kind") == "clock", CLOCK).when(F.col("kind") == "proposal", 0).otherwise(1).alias("code"),
        F.coalesce("event_id", F.lit(0).cast("long")).alias("event_id"), F.col("event_id").isNull().alias("no_event"),
        (F.coalesce(py_strip("reason"), F.lit("")) != "").alias("reasoned"))
    decided = (rows.groupBy("part")
               .applyInPandasWithState(_approval_fn(ttl_seconds, remember_seconds),
                                       "change_id string, event_id long, us long, status string", APPROVAL_STATE_SCHEMA,
                                       "append", GroupStateTimeout.EventTimeTimeout))
    return decided.select("change_id", "event_id", F.timestamp_micros("us").alias("approved_at"), "status")


# ST2 -----------------------------------------------------------------------
def coalesce_updates(updates: DataFrame, fields: Sequence[str], watermark: str, gap: str = "15 minutes",
                     keys: Sequence[str] = ("region", "dataset")) -> DataFrame:
    """ST2: update proposals on the same (region, dataset) at most ``gap``
    apart merge into one change (session window per key); rows that come
    later than ``watermark`` are dropped, so it should be ``gap`` at least.
    For each tracked
    field the latest value wins.  Fields are the tracked-field list, so the
    aggregation buffer per session is one ``max_by`` per field (bounded).
    Append mode: a session is emitted once the watermark passes its end,
    i.e. when it can no longer grow.  Output: session, keys, field, value,
    n_updates (updates in the session)."""
    u = updates.withWatermark("ts", watermark)
    latest = [F.max_by(F.when(F.col("field") == f, F.col("value")),
                       F.when(F.col("field") == f, F.struct("ts", "value"))).alias(f"_f{i}")
              for i, f in enumerate(fields)]
    agg = u.groupBy(F.session_window("ts", gap).alias("session"), *keys).agg(
        F.count(F.lit(1)).alias("n_updates"), *latest)
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_f{i}").alias("value"))
                        for i, f in enumerate(fields)])
    return agg.select("session", *keys, "n_updates", F.inline(entries)).where(F.col("value").isNotNull())


# ST3 -----------------------------------------------------------------------
def stream_upsert(spark: SparkSession, incoming: DataFrame, target: DataFrame, key_cols: Sequence[str],
                  all_cols: Sequence[str], name: str = "stream_upsert", folder: str | None = None, **upsert_kw) -> DataFrame:
    """ST3: each micro-batch of ``incoming`` is upserted (S7) into the target
    snapshot.  Snapshot ``v=<batch_id>`` is built from the one before it and
    written with overwrite, so a replayed batch rebuilds the same version
    (idempotent).  ``folder``, a shared folder that holds the snapshots and
    the checkpoint, lets a later call go on from both; without it each call
    starts anew from ``target``.  Returns the newest snapshot."""
    from dqspark.sources.sinks import upsert, write_snapshot
    base = (folder or scratch_path(spark, name)).rstrip("/")

    def newest() -> int:
        """The last version whose write was committed, -2 if there is none."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/v=*/_SUCCESS")
        done = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return max([int(s.getPath().getParent().getName()[2:]) for s in done], default=-2)

    if newest() == -2:
        write_snapshot(target, f"{base}/v=-1")

    def sink(batch: DataFrame, batch_id: int) -> None:
        cur = spark.read.parquet(f"{base}/v={batch_id - 1}")
        write_snapshot(upsert(cur, batch, key_cols, all_cols, **upsert_kw), f"{base}/v={batch_id}")

    q = (incoming.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/v={newest()}")


# ST4 -----------------------------------------------------------------------
def stream_latest_vote(feedback: DataFrame, keys: Sequence[str] = ("app_user", "assistant_message_id")) -> DataFrame:
    """ST4: latest vote per (user, message) maintained incrementally."""
    return feedback.groupBy(*keys).agg(
        F.max_by(F.struct("vote", "comment"), F.struct("ts", "feedback_id")).alias("_l"),
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.count(F.lit(1)).alias("n_votes")).select(*keys, "_l.vote", "_l.comment", "created_at", "updated_at",
                                                   "n_votes")


# ST5 -----------------------------------------------------------------------
def stream_profile(events: DataFrame, cols: Sequence[str], window: str = "1 day", slide: str | None = None,
                   watermark: str = "1 day", exact: bool = False) -> DataFrame:
    """ST5: run profile per tumbling (or sliding) event-time window; late rows
    beyond the watermark are dropped.  Streaming aggregation supports no
    exact distinct count, so ``unique_cnt`` is HyperLogLog++
    (``approx_count_distinct``)."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    from dqspark.operators.profile import is_numeric
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("sval"),
                        (F.col(c).cast("double") if is_numeric(events, c) else F.lit(None).cast("double"))
                        .alias("nval")) for c in cols]
    long = events.withWatermark("ts", watermark).select(w.alias("run"), F.inline(F.array(*entries)))
    return long.groupBy("run", "column_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("sval").alias("non_null"),
        F.approx_count_distinct("sval").alias("unique_cnt"),
        F.min("nval").alias("min_value"), F.max("nval").alias("max_value"), F.avg("nval").alias("mean_value"))


def stream_profile_states(events: DataFrame, cols: Sequence[str], pane: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """ST5 as mergeable states: one state per pane and column (counts, extremes,
    distinct and quantile sketches), to be merged into windows of any number
    of panes by ``profile_state.sliding_states`` without the events."""
    from dqspark.operators.profile_state import state_aggregates, state_rows
    rows = state_rows(events.withWatermark("ts", watermark), cols, [F.window("ts", pane).alias("run")])
    return rows.groupBy("run", "column_name").agg(*state_aggregates())


# ST6 -----------------------------------------------------------------------
def stream_alerts(scores: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """ST6: stateless filter score < threshold."""
    return scores.where(F.col("score") < threshold)


# ST7 -----------------------------------------------------------------------
def stream_digest(changes: DataFrame, watermark: str, gap: str = "30 minutes",
                  keys: Sequence[str] = ("region", "dataset")) -> DataFrame:
    """ST7: queued change lines per (region, dataset) flushed once per
    session (gap-separated burst of changes), rendered like A15."""
    line = F.concat(F.lit("- ["), F.coalesce("change_category", F.lit("")), F.lit("] "),
                    F.coalesce("change_item", F.lit("")), F.lit(": "), F.coalesce("change_from", F.lit("None")),
                    F.lit(" -> "), F.coalesce("change_to", F.lit("None")))
    c = changes.withWatermark("changed_at", watermark).withColumn("line", line)
    return c.groupBy(F.session_window("changed_at", gap).alias("session"), *keys).agg(
        F.count(F.lit(1)).alias("n_changes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("changed_at", "line"))),
                                 lambda x: x["line"]), "\n").alias("digest"))


# ST8 / T4 --------------------------------------------------------------------
def pending_list(proposals: DataFrame, as_of: str, session_id: str | None = None,
                 ttl_seconds: int = CHANGE_TTL_SECONDS) -> DataFrame:
    """Unexpired proposals (of a session) at ``as_of`` with whole seconds
    left, those with <= 0 left excluded, soonest to expire first."""
    p = proposals if session_id is None else proposals.where(F.col("session_id") == session_id)
    remaining = F.lit(float(ttl_seconds)) - (F.unix_micros(F.lit(as_of).cast("timestamp"))
                                             - F.unix_micros(F.col("created_at"))) / 1e6
    return p.where(remaining > 0).withColumn("seconds_left", remaining.cast("long")) \
        .orderBy("seconds_left", "change_id")
