"""Streaming queries (ST1-ST8): the events arrive in slices, partly out of
order, and each query is started again from its checkpoint after every slice
(availableNow); the sink is returned as a DataFrame; the oracle is the
equivalent batch SQL over the whole table."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from dqspark.plans.catalog import register, table
from dqspark.plans.sync_plans import CUST_COLS, INCOMING_SEGS, TARGET_SEGS
from dqspark.session import scratch_path
from dqspark.streaming import core as ST

_TSF = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_SQLF = "%Y-%m-%d %H:%M:%S.%f"


SLICES = 3
#: Rows whose event id ends in 0 come this late, behind later events; every query's watermark allows for it.
LATE_SECONDS, WATERMARK = 1800, "1 hour"


def events_stream(spark, sf, clock: bool = False):
    """``(stream, arrivals)``: the events as a landing folder that receives
    them in ``SLICES`` slices of arrival time, out of order within the
    watermark.  The first slice is there; each step of ``arrivals`` brings one
    more.  With ``clock`` the last slice ends with a row two days after the
    last event, of type 'clock', that moves the watermark past all events."""
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = ev.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    lo, hi = lo or 0, hi or 0
    arrives = F.unix_micros("ts") + F.when(F.col("event_id") % 10 == 0, LATE_SECONDS * 1_000_000).otherwise(0)
    number = F.least(F.floor((arrives - lo) * SLICES / (hi - lo + 1)), F.lit(SLICES - 1))
    landing = scratch_path(spark, "events-landing")

    def put(n):
        part = ev.where(number == n)
        if clock and n == SLICES - 1:
            end = spark.range(1).select(*[(F.timestamp_micros(F.lit(hi + 2 * 86_400_000_000)) if f.name == "ts" else
                                           F.lit("clock") if f.name == "event_type" else F.lit(None)).cast(f.dataType).alias(f.name)
                                          for f in ev.schema])
            part = part.unionByName(end)
        part.write.mode("append").parquet(landing)

    put(0)
    return (spark.readStream.schema(ev.schema).parquet(landing),
            [functools.partial(put, n) for n in range(1, SLICES)])


# ST1 -----------------------------------------------------------------------
def _plus_micros(ts, micros):
    return F.timestamp_micros(F.unix_micros(ts) + micros)


def approval_events(ev):
    """Proposals from signup events; an approval of each after value*3 s
    (blank reason for values 100-120), a repeated approval 5 s later for values
    above 300, and approvals of unknown ids from error events."""
    delay = (F.round(F.col("value") * 300).cast("long") * 10000)
    su = ev.where(F.col("event_type") == "signup")
    cid = F.concat(F.lit("chg-"), F.col("event_id").cast("string"))
    prop = su.select(cid.alias("change_id"), F.lit("proposal").alias("kind"), F.col("ts"),
                     (F.col("event_id") * 10).alias("event_id"), F.lit(None).cast("string").alias("reason"),
                     F.col("user_id").cast("string").alias("session_id"))
    appr = su.select(cid.alias("change_id"), F.lit("approval").alias("kind"), _plus_micros(F.col("ts"), delay).alias("ts"),
                     (F.col("event_id") * 10).alias("event_id"),
                     F.when(F.col("value").between(100, 120), F.lit(" ")).otherwise(F.lit("ok")).alias("reason"),
                     F.col("user_id").cast("string").alias("session_id"))
    again = su.where(F.col("value") > 300).select(
        cid.alias("change_id"), F.lit("approval").alias("kind"),
        _plus_micros(F.col("ts"), delay + 5_000_000).alias("ts"), (F.col("event_id") * 10 + 1).alias("event_id"),
        F.lit("again").alias("reason"), F.col("user_id").cast("string").alias("session_id"))
    unknown = ev.where(F.col("event_type") == "error").select(
        F.concat(F.lit("chg-x-"), F.col("event_id").cast("string")).alias("change_id"), F.lit("approval").alias("kind"),
        "ts", (F.col("event_id") * 10).alias("event_id"), F.lit("ok").alias("reason"),
        F.col("user_id").cast("string").alias("session_id"))
    clock = ev.where(F.col("event_type") == "clock").select(
        F.lit("clock").alias("change_id"), F.lit("clock").alias("kind"), "ts", "event_id",
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("session_id"))
    return prop.unionByName(appr).unionByName(again).unionByName(unknown).unionByName(clock)


SQL_APPROVALS = """
WITH su AS (SELECT * FROM events WHERE event_type = 'signup'),
p AS (SELECT 'chg-' || event_id AS change_id, ts AS created_at FROM su),
a AS (SELECT 'chg-' || event_id AS change_id, event_id * 10 AS event_id,
             make_timestamp(epoch_us(ts) + round(value * 300)::BIGINT * 10000) AS ts,
             CASE WHEN value BETWEEN 100 AND 120 THEN ' ' ELSE 'ok' END AS reason FROM su
      UNION ALL SELECT 'chg-' || event_id, event_id * 10 + 1,
             make_timestamp(epoch_us(ts) + round(value * 300)::BIGINT * 10000 + 5000000), 'again' FROM su WHERE value > 300
      UNION ALL SELECT 'chg-x-' || event_id, event_id * 10, ts, 'ok' FROM events WHERE event_type = 'error'),
r AS (SELECT a.*, CASE WHEN p.created_at IS NULL OR a.ts < p.created_at THEN 'unknown'
                       WHEN epoch_us(a.ts) - epoch_us(p.created_at) > 900000000 THEN 'expired'
                       WHEN trim(coalesce(reason, '')) = '' THEN 'no_reason' ELSE 'applied' END AS raw
      FROM a LEFT JOIN p USING (change_id)),
t AS (SELECT *, min(CASE WHEN raw IN ('expired', 'applied') THEN epoch_us(ts) * 100 + (event_id % 10) END)
                OVER (PARTITION BY change_id) AS term FROM r)
SELECT change_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS approved_at,
  CASE WHEN term IS NOT NULL AND epoch_us(ts) * 100 + (event_id % 10) > term THEN 'unknown' ELSE raw END AS status
FROM t"""


@register("stream_ttl", SQL_APPROVALS)
def stream_ttl(spark, sf):
    """ST1: approvals applied within the 15-minute TTL, each change once
    (stateful stream operator with event-time state eviction)."""
    ev, arrivals = events_stream(spark, sf, clock=True)
    out = ST.run_append(ST.approve_within_ttl(approval_events(ev), watermark=WATERMARK), spark, "stream_ttl", arrivals)
    return out.select("change_id", "event_id", F.date_format("approved_at", _TSF).alias("approved_at"), "status")


# ST2 -----------------------------------------------------------------------
EVENT_FIELDS = ["click", "error", "purchase", "signup", "view"]


def update_proposals(ev):
    return ev.select(F.when(F.col("user_id") % 2 == 0, "local").otherwise("region").alias("region"),
                     F.concat(F.lit("ds_app_"), (F.col("user_id") % 5).cast("string")).alias("dataset"),
                     F.col("event_type").alias("field"), F.col("value").cast("decimal(12,2)").cast("string").alias("value"),
                     "ts")


SQL_COALESCE = """
WITH u AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'region' END AS region, 'ds_app_' || (user_id % 5) AS dataset,
                  event_type AS field, CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS value, ts FROM events),
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY region, dataset ORDER BY ts)) <= 900000000
                     THEN 0 ELSE 1 END AS nw FROM u),
s AS (SELECT *, sum(nw) OVER (PARTITION BY region, dataset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g),
b AS (SELECT *, min(ts) OVER (PARTITION BY region, dataset, sid) AS s0, max(ts) OVER (PARTITION BY region, dataset, sid) AS s1 FROM s)
SELECT strftime(s0, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(s1 + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
  region, dataset, field, arg_max(value, (ts, value)) AS value, any_value(n_session) AS n_updates
FROM (SELECT *, count(*) OVER (PARTITION BY region, dataset, sid) AS n_session FROM b) GROUP BY region, dataset, sid, s0, s1, field"""


@register("stream_coalesce", SQL_COALESCE)
def stream_coalesce(spark, sf):
    """ST2: update proposals merged per (region, dataset) session of 15-minute gaps."""
    ev, arrivals = events_stream(spark, sf, clock=True)
    agg = ST.coalesce_updates(update_proposals(ev), EVENT_FIELDS, WATERMARK)
    out = ST.run_append(agg, spark, "stream_coalesce", arrivals)
    return out.select(F.date_format("session.start", _TSF).alias("session_start"),
                      F.date_format("session.end", _TSF).alias("session_end"),
                      "region", "dataset", "field", "value", "n_updates")


# ST5 -----------------------------------------------------------------------
@register("stream_profile", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS run_start, c.column_name, count(*) AS row_count,
  count(c.sval) AS non_null, min(c.nval) AS min_value, max(c.nval) AS max_value, avg(c.nval) AS mean_value
FROM events, LATERAL (VALUES ('event_type', event_type, NULL::DOUBLE), ('value', CAST(value AS VARCHAR), value),
                              ('user_id', CAST(user_id AS VARCHAR), user_id::DOUBLE)) c(column_name, sval, nval)
GROUP BY ALL""")
def stream_profile(spark, sf):
    """ST5: daily run profile of the event stream (unique count is HLL++ and
    left out of the comparison)."""
    ev, arrivals = events_stream(spark, sf)
    agg = ST.stream_profile(ev.select("ts", "event_type", "value", "user_id"), ["event_type", "value", "user_id"])
    out = ST.run_update(agg, spark, "stream_profile", ["run", "column_name"], arrivals)
    return out.select(F.date_format("run.start", "yyyy-MM-dd").alias("run_start"), "column_name", "row_count",
                      "non_null", "min_value", "max_value", "mean_value")


# ST3 -----------------------------------------------------------------------
_TS_ = "('" + "','".join(TARGET_SEGS) + "')"
_IS_ = "('" + "','".join(INCOMING_SEGS) + "')"


@register("stream_upsert", f"""
WITH t AS (SELECT * FROM customer WHERE c_mktsegment IN {_TS_}),
i AS (SELECT * FROM customer WHERE c_mktsegment IN {_IS_})
SELECT coalesce(t.c_custkey, i.c_custkey) AS c_custkey, coalesce(i.c_name, t.c_name) AS c_name,
  CASE WHEN i.c_custkey IS NOT NULL THEN i.c_nationkey ELSE t.c_nationkey END AS c_nationkey,
  CASE WHEN i.c_custkey IS NOT NULL THEN i.c_acctbal ELSE t.c_acctbal END AS c_acctbal,
  CASE WHEN i.c_custkey IS NOT NULL THEN i.c_mktsegment ELSE t.c_mktsegment END AS c_mktsegment
FROM t FULL OUTER JOIN i ON t.c_custkey = i.c_custkey""")
def stream_upsert_customers(spark, sf):
    """ST3: a stream of incoming customers upserted into the target snapshot."""
    cust = table(spark, sf, "customer").select(*CUST_COLS)
    target = cust.where(F.col("c_mktsegment").isin(*TARGET_SEGS))
    inc = ST.file_stream(spark, sf, "customer.parquet", table(spark, sf, "customer").schema) \
        .select(*CUST_COLS).where(F.col("c_mktsegment").isin(*INCOMING_SEGS))
    return ST.stream_upsert(spark, inc, target, ["c_custkey"], CUST_COLS)


@register("stream_merge_customers", f"""
SELECT coalesce(t.c_custkey, i.c_custkey) AS c_custkey, coalesce(i.c_name, t.c_name) AS c_name,
  CASE WHEN i.c_custkey IS NOT NULL THEN i.c_nationkey ELSE t.c_nationkey END AS c_nationkey,
  CASE WHEN i.c_custkey IS NOT NULL THEN i.c_acctbal + 1 ELSE t.c_acctbal END AS c_acctbal,
  CASE WHEN i.c_custkey IS NOT NULL THEN i.c_mktsegment ELSE t.c_mktsegment END AS c_mktsegment
FROM (SELECT * FROM customer WHERE c_mktsegment IN {_TS_}) t FULL OUTER JOIN (SELECT * FROM customer WHERE c_mktsegment IN {_IS_}) i ON t.c_custkey = i.c_custkey""")
def stream_merge_customers(spark, sf):
    """ST3, merge on read: customers arrive in four slices, each a delta of its
    own rows; the third compacts; the table is merged when read."""
    from dqspark.sources.merge_table import MergeTable, stream_merge_upsert
    cust = table(spark, sf, "customer").select(*CUST_COLS)
    path = scratch_path(spark, "merge-customers")
    t = MergeTable(spark, f"{path}/table", cust.schema, ["c_custkey"], buckets=8).create(cust.where(F.col("c_mktsegment").isin(*TARGET_SEGS)))
    inc = cust.where(F.col("c_mktsegment").isin(*INCOMING_SEGS)).withColumn("c_acctbal", F.col("c_acctbal") + 1)
    for n in range(4):
        inc.where(F.pmod("c_custkey", F.lit(4)) == n).write.mode("append").parquet(f"{path}/landing")
        stream = spark.readStream.schema(cust.schema).parquet(f"{path}/landing")
        stream_merge_upsert(stream, t, f"{path}/checkpoint", compact_every=3)
    return t.read()


# ST4 -----------------------------------------------------------------------
@register("stream_latest_vote", """
WITH f AS (SELECT 'fb-' || event_id AS feedback_id, 'user_' || user_id AS app_user,
             CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 WHEN 'signup' THEN -1 END AS vote,
             'response-' || (user_id % 100) || '-' || (event_id % 4 * 2 + 1) AS assistant_message_id,
             nullif(trim(CASE WHEN value > 400 THEN '   ' ELSE ' ' || props || ' ' END), '') AS comment, ts FROM events)
SELECT app_user, assistant_message_id, arg_max(vote, (ts, feedback_id)) AS vote,
  arg_max({'c': comment}, (ts, feedback_id)).c AS comment,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at,
  count(*) AS n_votes
FROM f WHERE vote IS NOT NULL GROUP BY ALL""")
def stream_latest_vote(spark, sf):
    """ST4: the latest vote per (user, message) maintained incrementally."""
    from dqspark.functions.exprs import py_strip, vote_from_label
    from dqspark.plans.traces_plans import LABELS
    ev, arrivals = events_stream(spark, sf)
    lab = None
    for k, v in LABELS.items():
        lab = F.when(F.col("event_type") == k, v) if lab is None else lab.when(F.col("event_type") == k, v)
    fb = ev.select(F.concat(F.lit("fb-"), F.col("event_id").cast("string")).alias("feedback_id"),
                   F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("app_user"),
                   vote_from_label(lab).alias("vote"),
                   F.concat(F.lit("response-"), (F.col("user_id") % 100).cast("string"), F.lit("-"),
                            (F.col("event_id") % 4 * 2 + 1).cast("string")).alias("assistant_message_id"),
                   F.when(F.col("value") > 400, F.lit(None)).otherwise(py_strip(F.col("props"))).alias("comment"), "ts") \
        .where(F.col("vote").isNotNull())
    out = ST.run_update(ST.stream_latest_vote(fb), spark, "stream_latest_vote", ["app_user", "assistant_message_id"],
                        arrivals)
    return out.select("app_user", "assistant_message_id", "vote", "comment",
                      F.date_format("created_at", _TSF).alias("created_at"),
                      F.date_format("updated_at", _TSF).alias("updated_at"), "n_votes")


# ST6 -----------------------------------------------------------------------
@register("stream_alerts", """
SELECT event_id, 'ds_app_' || (user_id % 5) AS dataset, 100.0 - value / 5.0 AS score FROM events
WHERE 100.0 - value / 5.0 < 95""")
def stream_alerts(spark, sf):
    """ST6: stateless alert filter score < 95 over a score stream."""
    ev, arrivals = events_stream(spark, sf)
    s = ev.select("event_id", F.concat(F.lit("ds_app_"), (F.col("user_id") % 5).cast("string")).alias("dataset"),
                  (100.0 - F.col("value") / 5.0).alias("score"))
    return ST.run_append(ST.stream_alerts(s), spark, "stream_alerts", arrivals)


# ST7 -----------------------------------------------------------------------
@register("stream_digest", f"""
WITH c AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'region' END AS region, 'ds_app_' || (user_id % 5) AS dataset,
             event_type AS change_category, 'k' AS change_item, json_extract_string(props, '$.k') AS change_from,
             CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS change_to, ts AS changed_at FROM events),
l AS (SELECT *, '- [' || coalesce(change_category, '') || '] ' || coalesce(change_item, '') || ': '
             || coalesce(change_from, 'None') || ' -> ' || coalesce(change_to, 'None') AS line,
             CASE WHEN epoch_us(changed_at) - epoch_us(lag(changed_at) OVER (PARTITION BY region, dataset ORDER BY changed_at))
                       <= 1800000000 THEN 0 ELSE 1 END AS nw FROM c),
s AS (SELECT *, sum(nw) OVER (PARTITION BY region, dataset ORDER BY changed_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM l)
SELECT strftime(min(changed_at), '{_SQLF}') AS session_start, region, dataset, count(*) AS n_changes,
  string_agg(line, chr(10) ORDER BY changed_at, line) AS digest
FROM s GROUP BY region, dataset, sid""")
def stream_digest(spark, sf):
    """ST7: change lines flushed as one digest per (region, dataset) burst
    (30-minute session gap)."""
    from dqspark.plans.audit_plans import event_changes
    ev, arrivals = events_stream(spark, sf, clock=True)
    ch = event_changes(ev).withColumn("changed_at", F.col("changed_at").cast("timestamp"))
    out = ST.run_append(ST.stream_digest(ch, WATERMARK), spark, "stream_digest", arrivals)
    return out.select(F.date_format("session.start", _TSF).alias("session_start"), "region", "dataset", "n_changes",
                      "digest")


# ST8 / T4 --------------------------------------------------------------------
@register("pending_list", """
SELECT 'chg-' || event_id AS change_id, user_id AS session_id,
  trunc(900.0 - (epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts)) / 1e6)::BIGINT AS seconds_left
FROM events WHERE event_type = 'signup'
  AND 900.0 - (epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts)) / 1e6 > 0""")
def pending_list(spark, sf):
    """ST8 + T4: proposals still pending at 2024-01-15 12:00, soonest to expire first."""
    ev = table(spark, sf, "events").where(F.col("event_type") == "signup")
    prop = ev.select(F.concat(F.lit("chg-"), F.col("event_id").cast("string")).alias("change_id"),
                     F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("created_at"))
    return ST.pending_list(prop, "2024-01-15 12:00:00").select("change_id", "session_id", "seconds_left")
