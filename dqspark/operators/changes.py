"""Ordered application of lists of proposed changes (ST1 over a list).

A request names changes in the order in which they are to be applied, and
stops at its first failure.  What a request does depends on the requests
before it: a change can be taken once, and a change whose rules were partly
refused comes back as a new one.  All of that is found for whole tables at
once, by rounds of aggregations and joins until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqspark.functions.exprs import py_strip
from dqspark.session import scratch_path
from dqspark.streaming.core import CHANGE_TTL_SECONDS

def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder: later rounds read only the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _digest(df: DataFrame, *cols: str) -> tuple:
    """Number of rows and a hash over them, by one aggregation."""
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*cols)), F.sum(F.pmod(F.xxhash64(*cols), F.lit(1 << 40)))).first())


def apply_in_order(proposals: DataFrame, requests: DataFrame, ttl_seconds: int = CHANGE_TTL_SECONDS) -> DataFrame:
    """``request_id, position`` (from 0), ``change_id, status, outcome, n_rules,
    n_failed, retry_id`` for every change of every request.

    ``proposals``: ``change_id, created_at, error, rules``.  ``error``: what an
    attempt fails with, or null; ``rules``: the change's rules, each with the
    errors of its first, second, ... attempt (null or beyond the end: accepted).
    ``requests``: ``request_id`` (unique), ``requested_at, reason, change_ids``.
    Requests take effect in order of time, then id; a change in its place in the list.

    ``status``: ``applied``; ``unknown`` (no such change yet, or taken before);
    ``expired`` (older than ``ttl_seconds``; it is taken); ``error`` (taken);
    ``not_attempted`` (after a failure in its request, or the request has a
    blank reason).  An applied change with refused rules does not stop its
    request: ``outcome`` is ``partially applied``, or ``not applied`` if all
    were refused, and the refused rules come back as the change ``retry_id``
    (``<id>~1``, then ``~2``, ...), proposed at that time.

    Every row is settled by rows before it, so the rounds end in the one
    right answer; there are as many as the longest chain of requests of
    which each changes what the next one does.  Which rules each retry would
    have does not depend on the rounds and is found once (``_attempts``), and
    so is what becomes of an item that names no retry if none takes its change
    before; items after the first of a request that fails whatever the others
    do take no part in the rounds.  A round holds no rules.  A change that very
    many requests name is met by an aggregation with map-side combine, never by
    a list of its requests.  Of proposals with one id the first counts."""
    late = (lambda since: F.unix_micros("requested_at") - F.unix_micros(since) > ttl_seconds * 1_000_000)
    items = requests.select("request_id", "requested_at", (F.coalesce(py_strip("reason"), F.lit("")) != "").alias("valid"),
                            F.posexplode("change_ids").alias("position", "change_id"))
    there = F.coalesce(F.col("requested_at") >= F.col("created_at"), F.lit(False))
    alone = (F.when(F.col("attempt").isNull(), "unknown").when(F.col("attempt") > 0, None)
             .when(~there, "unknown").when(late("created_at"), "expired").when(F.col("fails"), "error").otherwise("applied"))
    items = items.join(_attempts(proposals), "change_id", "left").select(*items.columns, alone.alias("alone"), "n_rules", "n_failed", "retry_id")
    items = _stored(items.withColumn("attempted", F.col("valid") & _before_stop(F.col("alone") != "applied")), "change-items")

    at = F.struct("requested_at", "request_id", "position")
    rest, todo = items.where(~F.col("attempted")), items.where("attempted")
    made = todo.select(F.col("change_id"), at.alias("made")).limit(0)
    seen = _digest(made, "change_id", "made")
    while True:
        # a retry is there for what follows the item that made it, in the same request too
        now = todo.join(made, "change_id", "left").withColumn("at", at)
        will = (F.when(F.col("alone").isNotNull(), F.col("alone")).when(F.col("made").isNull() | (F.col("at") <= F.col("made")), "unknown")
                .when(late("made.requested_at"), "expired").otherwise("applied"))
        now = now.withColumn("will", will)
        takes = F.struct("at", F.when(F.col("will") == "applied", F.col("retry_id")).alias("gives"))
        taken = _stored(now.where((F.col("will") != "unknown") & F.col("attempted")).groupBy("change_id").agg(F.min(takes).alias("taken")), "changes-taken")
        mine = F.col("taken").isNull() | (F.col("at") <= F.col("taken.at"))
        judged = now.join(taken, "change_id", "left").withColumn("status", F.when(mine, F.col("will")).otherwise("unknown"))
        judged = _stored(judged.select(*items.columns[:-1], "status", F.col("attempted").alias("was"),
                                       _before_stop(F.col("status") != "applied").alias("attempted")), "changes-judged")
        made = taken.where("taken.gives is not null").select(F.col("taken.gives").alias("change_id"), F.col("taken.at").alias("made"))
        last, seen = seen, _digest(made, "change_id", "made")
        if seen == last and judged.where("attempted <> was").isEmpty():
            break
        todo = judged.drop("status", "was")
    done = judged.unionByName(rest.select("*", F.lit(None).cast("string").alias("status"), F.lit(False).alias("was")))
    done = done.withColumn("status", F.when(F.col("attempted"), F.col("status")).otherwise("not_attempted"))
    applied = (lambda c: F.when(F.col("status") == "applied", c))
    n, failed = F.col("n_rules"), F.col("n_failed")
    outcome = F.when(failed == 0, "applied").when(failed < n, "partially applied").otherwise("not applied")
    return done.select("request_id", "position", "change_id", "status", applied(outcome).alias("outcome"), applied(n).alias("n_rules"),
                       applied(failed).alias("n_failed"), applied(F.col("retry_id")).alias("retry_id"))


def _before_stop(fails: Column) -> Column:
    """Whether an item is its request's first one that ``fails`` or lies before it."""
    stop = F.min(F.when(fails, F.col("position"))).over(Window.partitionBy("request_id"))
    return F.coalesce((F.col("position") <= stop) | F.col("request_id").isNull(), F.lit(True))


def _attempts(proposals: DataFrame) -> DataFrame:
    """``change_id, attempt, created_at, fails, n_rules, n_failed, retry_id`` of
    every proposal (attempt 0) and of every retry that it may come back as: the
    ``k``-th has the rules that were refused ``k`` times."""
    refused = F.transform(F.coalesce("rules", F.array().cast("array<struct<name:string,errors:array<string>>>")), lambda r: F.coalesce(
        F.array_min(F.transform(r["errors"], lambda e, i: F.when(e.isNull(), i))), F.greatest(F.size(r["errors"]), F.lit(0)), F.lit(0)))
    p = proposals.where(F.col("change_id").isNotNull()).select(F.col("change_id").alias("root"), "created_at", F.col("error").isNotNull().alias("fails"),
                                                               refused.alias("refused"))
    # the first of each id, those without a time last
    first = F.struct(F.col("created_at").isNull().alias("_0"), "created_at", "fails", "refused")
    p = p.groupBy("root").agg(F.min(first).alias("p")).select("root", "p.created_at", "p.fails", "p.refused")
    last = F.when(F.col("fails"), 0).otherwise(F.coalesce(F.array_max("refused"), F.lit(0)))
    a = p.select("*", F.explode(F.sequence(F.lit(0), last)).alias("attempt"))
    a = a.select(F.when(F.col("attempt") == 0, F.col("root")).otherwise(F.concat("root", F.lit("~"), F.col("attempt").cast("string"))).alias("change_id"),
                 "root", "attempt", "created_at", (F.col("fails") & (F.col("attempt") == 0)).alias("fails"),
                 F.size(F.filter("refused", lambda n: n >= F.col("attempt"))).alias("n_rules"),
                 F.size(F.filter("refused", lambda n: n > F.col("attempt"))).alias("n_failed"))
    retry = F.when(F.col("n_failed") > 0, F.concat("root", F.lit("~"), (F.col("attempt") + 1).cast("string"))).alias("retry_id")
    # a proposal that is itself named like a retry counts in place of it
    one = F.min(F.struct("attempt", "created_at", "fails", "n_rules", "n_failed", retry)).alias("a")
    return a.groupBy("change_id").agg(one).select("change_id", "a.*")


def request_summary(applied: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: ``requested`` and ``applied`` numbers of changes, ``status``
    (``applied``, ``stopped_on_error``, ``invalid`` for a blank reason or an empty
    list) and the change it stopped at."""
    n = applied.groupBy("request_id").agg(
        F.count_if(F.col("status") == "applied").alias("applied"),
        F.min_by("change_id", F.when(~F.col("status").isin("applied", "not_attempted"), F.col("position"))).alias("stopped_at"))
    invalid = (F.coalesce(py_strip("reason"), F.lit("")) == "") | (F.coalesce(F.size("change_ids"), F.lit(0)) <= 0)
    return requests.join(n, "request_id", "left").select(
        "request_id", F.greatest(F.coalesce(F.size("change_ids"), F.lit(0)), F.lit(0)).cast("long").alias("requested"), F.coalesce("applied", F.lit(0)).alias("applied"),
        F.when(invalid, "invalid").when(F.col("stopped_at").isNotNull(), "stopped_on_error").otherwise("applied").alias("status"), "stopped_at")
