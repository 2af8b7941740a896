"""Conversation / trace / feedback operators:
W1 W3 W4 W7 J2 J14 A13 A16 E28 (F11 F12 E17-E23 live in ``functions``).

Messages are rows ``(conv_id, turn, role, text, ...)``; window functions
partitioned by conversation replace the reference's per-list loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.functions.exprs import py_strip, vote_from_label
from dqspark.operators.windows import run_ids

# --------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# --------------------------------------------------------------------------
CONTINUE_TEXT = "Continue."
RESPONSE_PREFIX = "response-"
MAX_UNRESOLVED_CONTENT = 20000
# --------------------------------------------------------------------------


def _ordered_join(text: str, order: str, sep: str) -> Column:
    """Text of a group joined in ``order`` (sorted list of (order, text))."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))),
                                    lambda x: x[text]), sep)


def ordered_concat(df: DataFrame, keys: Sequence[str], order: str, text: str, sep: str,
                   block: int = 10_000, block_of: Column | None = None) -> DataFrame:
    """``keys..., text, n_parts``: the texts of each group joined with ``sep``
    in ``order`` (ties broken by the text).

    Two levels, so no single list holds a hot group: the pieces of one block
    of the order column - ``block`` consecutive values of a numeric order, or
    the value of ``block_of`` (an expression monotonic in ``order``, such as
    ``date_trunc('hour', ts)``) - are joined first, in parallel, then the
    pieces of a group are joined in block order."""
    blk = F.floor(F.col(order) / block) if block_of is None else block_of
    part = df.groupBy(*keys, blk.alias("_blk")).agg(
        # a block without any non-null text adds no piece (array_join skips nulls)
        F.when(F.count(text) > 0, _ordered_join(text, order, sep)).alias("_piece"), F.count(F.lit(1)).alias("_n"))
    return part.groupBy(*keys).agg(_ordered_join("_piece", "_blk", sep).alias(text),
                                   F.sum("_n").alias("n_parts"))


# W3 ------------------------------------------------------------------------
def merge_consecutive_roles(messages: DataFrame, conv: str = "conv_id", turn: str = "turn",
                            sep: str = "\n\n") -> DataFrame:
    """Roles other than user/assistant become user; empty messages are
    dropped; adjacent messages with the same role merge (gaps-and-islands:
    blocked run numbering -> ``groupBy(conv, island)``); a conversation
    that starts with the assistant gets a user "Continue." first.
    Output: conv_id, seq (0 for the prepended message), role, text, n_parts."""
    m = messages.where(F.coalesce(F.col("text"), F.lit("")) != "").select(
        conv, turn, F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("user").alias("role"),
        "text")
    # skew-safe gaps-and-islands; the rows stay partitioned by (conv, block of
    # turns), so the first level of the text join below needs no shuffle
    m = run_ids(m, conv, turn, "role", out="seq", keep_block="_rblk")
    merged = ordered_concat(m, [conv, "seq", "role"], turn, "text", sep, block_of=F.col("_rblk"))
    # the prepended user message comes out of the same rows (no second pass over the input)
    row = F.struct(F.col("seq").cast("long").alias("seq"), F.col("role").alias("role"), F.col("text").alias("text"),
                   F.col("n_parts").alias("n_parts"))
    lead = F.struct(F.lit(0).cast("long").alias("seq"), F.lit("user").alias("role"), F.lit(CONTINUE_TEXT).alias("text"),
                    F.lit(0).cast("long").alias("n_parts"))
    first_is_assistant = (F.col("seq") == 1) & (F.col("role") == "assistant")
    return merged.select(conv, F.inline(F.when(first_is_assistant, F.array(lead, row)).otherwise(F.array(row))))


# W4 ------------------------------------------------------------------------
def feedback_target(messages: DataFrame, clicks: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Resolve the assistant message id a feedback click refers to.

    * a clicked message with a ``response-`` id is its own target;
    * else the last ``response-`` id inside its contiguous assistant run;
    * else the latest assistant message of the conversation with identical
      text that has a ``response-`` id; otherwise null.
    ``messages``: conv_id, turn, role, msg_id, text; ``clicks``: conv_id, turn.
    """
    is_asst = F.col("role") == "assistant"
    # consecutive assistant messages share a run; every other message is its own run
    runv = F.when(is_asst, F.lit("assistant")).otherwise(F.concat(F.lit("#"), F.col(turn).cast("string")))
    m = run_ids(messages.withColumn("_rv", runv), conv, turn, "_rv", out="_run").drop("_rv")
    resp = F.startswith(F.coalesce(F.col("msg_id"), F.lit("")), F.lit(RESPONSE_PREFIX))
    # identical-text fallback keyed by a digest of the text: only 64-char keys are shuffled
    m = m.withColumn("_th", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    # both targets in ONE aggregation over the response rows (grouping sets
    # (conv, run) and (conv, text digest)), so the run-numbered messages are
    # consumed twice (targets, clicks) rather than three times
    tg = m.where(is_asst & resp).groupingSets([[conv, "_run"], [conv, "_th"]], conv, "_run", "_th").agg(
        F.max_by("msg_id", turn).alias("_tgt"), F.grouping("_run").alias("_g_run"))
    run_target = tg.where(F.col("_g_run") == 0).select(conv, "_run", F.col("_tgt").alias("_run_tgt"))
    by_text = tg.where(F.col("_g_run") == 1).select(conv, "_th", F.col("_tgt").alias("_text_tgt"))
    c = clicks.join(m, [conv, turn], "left")
    c = c.join(run_target, [conv, "_run"], "left").join(by_text, [conv, "_th"], "left")
    own = F.when(resp, F.col("msg_id"))
    in_run = F.when(is_asst, F.col("_run_tgt"))
    return c.select(*clicks.columns, F.coalesce(own, in_run, F.col("_text_tgt")).alias("assistant_message_id"))


# W1 ------------------------------------------------------------------------
def latest_session(history: DataFrame, by: Sequence[str] = ("app_user",), region: str | None = None) -> DataFrame:
    """Most recently updated session per user (optionally within a region);
    ties broken by the smallest session_id (the session key, never null).
    Rows without an update time are not candidates.

    One aggregation: ``min_by(row, (-update time, session_id))`` is a
    partial aggregate, so a user with a huge history is reduced map-side and
    the table is read once.  (For an update time that is neither a time nor a
    number: the latest time per user, then the rows at that time.)"""
    h = history if region is None else history.where(F.col("region") == region.strip().lower())
    cols = [c for c in h.columns if c not in by]
    h = h.where(F.col("updated_at").isNotNull() & F.col("session_id").isNotNull())
    t = h.schema["updated_at"].dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        recency = -F.unix_micros(F.col("updated_at").cast("timestamp"))
    elif isinstance(t, T.NumericType):
        recency = -F.col("updated_at")
    else:
        mx = h.groupBy(*by).agg(F.max("updated_at").alias("_mx"))
        at_max = h.join(mx, [*by]).where(F.col("updated_at") == F.col("_mx")).drop("_mx")
        best = at_max.groupBy(*by).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col("session_id")).alias("_b"))
        return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in cols])
    order = F.struct(recency.alias("r"), F.col("session_id").alias("s"))
    best = h.groupBy(*by).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in cols])


# W7 ------------------------------------------------------------------------
def latest_vote(feedback: DataFrame, keys: Sequence[str] = ("app_user", "assistant_message_id"),
                ts: str = "ts") -> DataFrame:
    """One vote per (user, message): the last one wins; comment trimmed and
    blank -> null; created_at is the first vote's time, updated_at the last;
    only votes -1 / 1 count."""
    f = feedback.where(F.col("vote").isin(-1, 1))
    last = F.max_by(F.struct(F.col("vote").alias("vote"), F.col("comment").alias("comment")),
                    F.struct(F.col(ts), F.col("feedback_id")))
    g = f.groupBy(*keys).agg(last.alias("_l"), F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"),
                             F.count(F.lit(1)).alias("n_votes"))
    c = py_strip(F.col("_l.comment"))
    return g.select(*keys, F.col("_l.vote").alias("vote"), F.when(c != "", c).alias("comment"),
                    "created_at", "updated_at", "n_votes")


# E28 / J2 ------------------------------------------------------------------
def route_feedback(events: DataFrame, label: str = "label") -> DataFrame:
    """Vote from the like/dislike label (other labels dropped); rows with a
    ``response-`` message id are 'resolvable', the rest 'unresolved' (comment
    trimmed, response content cut to 20,000 characters)."""
    v = events.withColumn("vote", vote_from_label(F.col(label))).where(F.col("vote").isNotNull())
    resolvable = F.startswith(F.coalesce(F.col("assistant_message_id"), F.lit("")), F.lit(RESPONSE_PREFIX))
    return v.withColumn("route", F.when(resolvable, "resolvable").otherwise("unresolved")) \
        .withColumn("comment", py_strip("comment")) \
        .withColumn("response_content", F.when(~resolvable, F.substring("response_content", 1,
                                                                         MAX_UNRESOLVED_CONTENT)))


def feedback_status(routed: DataFrame, turns: DataFrame) -> DataFrame:
    """E28 + J2 in one pass: every routed vote with status 'accepted' (a turn
    with that message id and user exists; turn_id / session_id attached),
    'rejected' (no such turn) or 'unresolved' (no response- id)."""
    t = turns.select("assistant_message_id", "app_user", "turn_id", "session_id")
    j = routed.join(t, ["assistant_message_id", "app_user"], "left")
    return j.withColumn("status", F.when(F.col("route") == "unresolved", "unresolved")
                        .when(F.col("turn_id").isNotNull(), "accepted").otherwise("rejected"))


def feedback_resolve(feedback: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A vote is stored only when a turn with that assistant_message_id AND
    the same user exists; it then takes the turn's id and session.  Returns
    (accepted, rejected)."""
    t = turns.select("assistant_message_id", "app_user", "turn_id", "session_id")
    acc = feedback.join(t, ["assistant_message_id", "app_user"], "inner")
    rej = feedback.join(t, ["assistant_message_id", "app_user"], "left_anti")
    return acc, rej


# J14 -----------------------------------------------------------------------
def feedback_evaluation(votes: DataFrame, turns: DataFrame, tools: DataFrame) -> DataFrame:
    """Votes joined with their request, response, timing and the ordered tool
    calls of the turn (tool calls pre-aggregated per turn before the join)."""
    tool_seq = ordered_concat(tools, ["turn_id"], "sequence_number", "tool_name", ">").select(
        "turn_id", F.col("n_parts").alias("n_tools"), F.col("tool_name").alias("tool_sequence"))
    t = turns.select("turn_id", "user_message", "assistant_response", "duration_ms")
    return votes.join(t, "turn_id", "left").join(tool_seq, "turn_id", "left") \
        .withColumn("n_tools", F.coalesce("n_tools", F.lit(0)))


# A13 -----------------------------------------------------------------------
def token_usage(responses: DataFrame, json_col: str = "response", keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Input / output tokens (null -> 0) and their total per response, rolled
    up by ``keys``."""
    i = F.coalesce(F.get_json_object(json_col, "$.usage.input_tokens").cast("long"), F.lit(0))
    o = F.coalesce(F.get_json_object(json_col, "$.usage.output_tokens").cast("long"), F.lit(0))
    per = responses.select(*keys, i.alias("input_tokens"), o.alias("output_tokens"))
    return per.groupBy(*keys).agg(F.sum("input_tokens").alias("input_tokens"),
                                  F.sum("output_tokens").alias("output_tokens"),
                                  F.count(F.lit(1)).alias("n_responses")) \
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


# A16 -----------------------------------------------------------------------
def prompt_catalog(templates: DataFrame) -> DataFrame:
    """Templates grouped by category (categories sorted, titles sorted)."""
    return templates.groupBy("category").agg(F.array_sort(F.collect_list("title")).alias("titles"),
                                             F.count(F.lit(1)).alias("n_templates")).orderBy("category")
