"""Trace / feedback queries.

Turns and messages come from ``conversations``; feedback events, sessions
and tool inputs from ``events``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.functions import exprs as X
from dqspark.functions import text as TX
from dqspark.operators import traces as TR
from dqspark.plans.catalog import register, table
from dqspark.sources.sinks import tool_rows


# W3 ------------------------------------------------------------------------
@register("merge_roles", """
WITH m AS (SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'user' END AS role, text
           FROM conversations WHERE coalesce(text, '') <> ''),
f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS nw FROM m),
s AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seq FROM f),
g AS (SELECT conv_id, seq::BIGINT AS seq, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n_parts
      FROM s GROUP BY conv_id, seq, role)
SELECT * FROM g
UNION ALL SELECT conv_id, 0, 'user', 'Continue.', 0 FROM g WHERE seq = 1 AND role = 'assistant'""")
def merge_roles(spark, sf):
    """System -> user, adjacent same-role messages merged."""
    return TR.merge_consecutive_roles(table(spark, sf, "conversations"))


# F12 -----------------------------------------------------------------------
def _refusal_text():
    return (F.when(F.col("turn") == 2, F.concat(F.lit("I cannot answer that. "), F.col("text")))
            .when(F.col("turn") == 4, F.lit("Sorry, the model cannot answer this question.!! "))
            .when(F.col("turn") == 6, F.concat(F.col("text"), F.lit(" I'm unable to answer more.")))
            .otherwise(F.col("text")))


_SQL_REFUSAL_TEXT = """CASE WHEN turn = 2 THEN 'I cannot answer that. ' || text
  WHEN turn = 4 THEN 'Sorry, the model cannot answer this question.!! '
  WHEN turn = 6 THEN text || ' I''m unable to answer more.' ELSE text END"""


def _sql_refusal():
    phrases = TX.REFUSAL_PHRASES
    looks = " OR ".join(f"contains(lower(trim(t)), '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases)
    alt = "|".join(TX.regex_escape(p).replace("'", "''") for p in phrases)
    stripped = f"trim(regexp_replace(t, '^\\s*(?:{alt})[.!]*\\s*', '', 'i'))"
    return f"""
SELECT conv_id, turn, ({looks}) AS looks_like_refusal, ({looks}) AND {stripped} = '' AS pure_refusal,
  length(CASE WHEN {stripped} = '' THEN t ELSE {stripped} END) AS stripped_length
FROM (SELECT conv_id, turn, {_SQL_REFUSAL_TEXT} AS t FROM conversations)"""


@register("refusal_flags", _sql_refusal())
def refusal_flags(spark, sf):
    """F12 over every message (some prefixed / replaced by refusal phrases)."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", _refusal_text().alias("t"))
    looks, pure, stripped = TX.classify_refusal(F.col("t"))
    return c.select("conv_id", "turn", looks, pure, F.length(stripped).cast("long").alias("stripped_length"))


# E17 -----------------------------------------------------------------------
def _tool_input():
    return F.when(F.col("event_type") == "signup", F.concat(
        F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "API-Token": "t'), F.col("user_id").cast("string"),
        F.lit('", "password_hint": "x", "Region": "apac"}'))).otherwise(F.col("props"))


@register("redact_props", """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN '{"k": ' || json_extract_string(props, '$.k')
             || ', "API-Token": "t' || user_id || '", "password_hint": "x", "Region": "apac"}' ELSE props END AS j FROM events),
k AS (SELECT event_id, j, json_keys(j) AS ks FROM e)
SELECT event_id, len(ks) AS n_keys,
  len(list_filter(ks, lambda x: contains(replace(lower(x), '-', '_'), 'password') OR contains(replace(lower(x), '-', '_'), 'secret')
       OR contains(replace(lower(x), '-', '_'), 'token') OR contains(replace(lower(x), '-', '_'), 'authorization')
       OR contains(replace(lower(x), '-', '_'), 'api_key'))) AS n_redacted,
  json_extract_string(j, '$.k') AS k
FROM k""")
def redact_props(spark, sf):
    """E17 (flat form): credential-like keys of tool inputs redacted."""
    ev = table(spark, sf, "events").select("event_id", _tool_input().alias("j"))
    m = X.redact_flat_json(F.col("j"))
    return ev.select("event_id", F.size(m).cast("long").alias("n_keys"),
                     F.size(F.filter(F.map_values(m), lambda v: v == X.REDACTED)).cast("long").alias("n_redacted"),
                     m["k"].alias("k"))


# A13 -----------------------------------------------------------------------
def with_previous_text(conv):
    """Previous message's text via an equi-join on (conv_id, turn - 1): turns
    are consecutive, and a hash join on (conversation, turn) spreads a huge
    conversation over many tasks (a per-conversation window would not)."""
    prev = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("_prev_text"))
    return conv.join(prev, ["conv_id", "turn"], "left")


def _responses(conv):
    conv = with_previous_text(conv)
    prev = F.col("_prev_text")
    usage = F.when(F.col("turn") == 1, F.lit(None)).otherwise(F.struct(
        F.floor(F.length(F.coalesce(prev, F.lit(""))) / 4).cast("long").alias("input_tokens"),
        F.floor(F.length("text") / 4).cast("long").alias("output_tokens")))
    return conv.withColumn("_u", usage).where(F.col("role") == "assistant").select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.to_json(F.struct(F.col("_u").alias("usage"), F.lit("m1").alias("model"))).alias("response"))


@register("token_usage", """
WITH c AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT 's' || conv_id AS session_id,
  sum(CASE WHEN turn = 1 THEN 0 ELSE floor(length(coalesce(prev, '')) / 4) END)::BIGINT AS input_tokens,
  sum(CASE WHEN turn = 1 THEN 0 ELSE floor(length(text) / 4) END)::BIGINT AS output_tokens,
  count(*) AS n_responses,
  (sum(CASE WHEN turn = 1 THEN 0 ELSE floor(length(coalesce(prev, '')) / 4) END)
   + sum(CASE WHEN turn = 1 THEN 0 ELSE floor(length(text) / 4) END))::BIGINT AS total_tokens
FROM c WHERE role = 'assistant' GROUP BY conv_id""")
def token_usage(spark, sf):
    """Token usage per session from response JSON (missing usage -> 0)."""
    return TR.token_usage(_responses(table(spark, sf, "conversations")))


# E18 / E19 -------------------------------------------------------------------
@register("extract_responses", """
SELECT conv_id, turn, length(text) AS text_length, turn AS json_turn FROM conversations WHERE role = 'assistant'""")
def extract_responses(spark, sf):
    """E19 text extraction from response JSON, and E18 JSON-object extraction
    from a refusal-prefixed, fenced model answer."""
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    resp = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
                              .alias("content")))
    answer = F.concat(F.lit("I cannot provide a full answer. ```json\n"),
                      F.to_json(F.struct(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"))),
                      F.lit("\n```"))
    return c.select("conv_id", "turn", F.length(X.extract_text(resp)).cast("long").alias("text_length"),
                    F.get_json_object(X.extract_json_text(answer), "$.turn").cast("long").alias("json_turn"))


# F11 -----------------------------------------------------------------------
@register("real_messages", """
WITH m AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN text ELSE replace(text, chr(10), '') END AS t,
                  turn % 5 = 3 AS pending FROM conversations)
SELECT conv_id, turn, role, length(t) AS text_length FROM m
WHERE role IN ('user', 'assistant') AND NOT pending AND coalesce(t, '') <> ''""")
def real_messages(spark, sf):
    """F11 over history entries (odd turns stored as text blocks, pending
    status rows are display-only), applied to each message row."""
    c = table(spark, sf, "conversations")
    blocks = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text")))
    entry = F.struct(
        F.col("role").alias("role"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("content"),
        F.when(F.col("turn") % 2 == 1, blocks).alias("blocks"),
        F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), F.lit(None).cast("string").alias("title"),
                 F.when(F.col("turn") % 5 == 3, F.lit("pending")).alias("status"),
                 F.lit(None).cast("string").alias("parent_id")).alias("metadata"),
        F.col("turn").alias("turn"))
    # per message row: no conversation is gathered into one array
    e = c.select("conv_id", entry.alias("e"))
    m = e.where(TX.is_real_message(F.col("e"))).select("conv_id", TX.real_message(F.col("e"), extra=("turn",)).alias("m"))
    return m.select("conv_id", F.col("m.turn").alias("turn"), F.col("m.role").alias("role"),
                    F.length("m.text").cast("long").alias("text_length"))


# sessions / feedback from events ----------------------------------------------
def sessions_from_events(ev):
    return ev.groupBy(F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
                      .alias("session_id")).agg(
        F.concat(F.lit("user_"), F.first("user_id").cast("string")).alias("app_user"),
        F.when(F.first("user_id") % 2 == 0, "local").otherwise("region").alias("region"),
        F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("turn_count"))


@register("latest_session", """
WITH s AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, 'user_' || user_id AS app_user,
                  max(ts) AS updated_at, count(*) AS turn_count FROM events GROUP BY ALL)
SELECT app_user, session_id, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at, turn_count FROM (
  SELECT *, row_number() OVER (PARTITION BY app_user ORDER BY updated_at DESC, session_id) AS rn FROM s) WHERE rn = 1""")
def latest_session(spark, sf):
    """Each user's most recently updated session."""
    s = TR.latest_session(sessions_from_events(table(spark, sf, "events")))
    return s.select("app_user", "session_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
                    .alias("updated_at"), "turn_count")


LABELS = {"click": "like", "purchase": "Thumbs Up", "error": "dislike", "signup": " Downvote ", "view": "meh"}


def feedback_events(ev):
    lab = None
    for k, v in LABELS.items():
        lab = F.when(F.col("event_type") == k, v) if lab is None else lab.when(F.col("event_type") == k, v)
    msg = F.when(F.col("value") < 480, F.concat(
        F.lit("response-"), (F.col("user_id") % 100).cast("string"), F.lit("-"),
        (F.col("event_id") % 4 * 2 + 1).cast("string")))
    return ev.select(F.concat(F.lit("fb-"), F.col("event_id").cast("string")).alias("feedback_id"),
                     F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("app_user"),
                     lab.alias("label"), msg.alias("assistant_message_id"),
                     F.when(F.col("value") > 400, F.lit("   ")).otherwise(F.concat(F.lit(" "), F.col("props"), F.lit(" ")))
                     .alias("comment"), F.lit("some response").alias("response_content"), "ts")


def turns_from_conversations(conv):
    return with_previous_text(conv).withColumnRenamed("_prev_text", "user_message") \
        .where(F.col("role") == "assistant").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.concat(F.lit("user_"), F.col("conv_id").cast("string")).alias("app_user"),
        F.concat(F.lit("response-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("assistant_message_id"),
        "user_message", F.col("text").alias("assistant_response"), (F.length("text") * 3).alias("duration_ms"))


_SQL_FB = """SELECT 'fb-' || event_id AS feedback_id, 'user_' || user_id AS app_user,
  CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 WHEN 'signup' THEN -1 END AS vote,
  CASE WHEN value < 480 THEN 'response-' || (user_id % 100) || '-' || (event_id % 4 * 2 + 1) END AS assistant_message_id,
  trim(CASE WHEN value > 400 THEN '   ' ELSE ' ' || props || ' ' END) AS comment, ts, event_id FROM events"""
_SQL_TURNS = """SELECT conv_id || '-' || turn AS turn_id, 's' || conv_id AS session_id, 'user_' || conv_id AS app_user,
  'response-' || conv_id || '-' || turn AS assistant_message_id, prev AS user_message, text AS assistant_response,
  length(text) * 3 AS duration_ms, turn
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE role = 'assistant'"""


def routed_feedback(spark, sf):
    return TR.route_feedback(feedback_events(table(spark, sf, "events")))


@register("feedback_join", f"""
WITH f AS ({_SQL_FB}), t AS ({_SQL_TURNS})
SELECT f.feedback_id, f.vote, CASE WHEN f.assistant_message_id IS NULL THEN 'unresolved'
       WHEN t.turn_id IS NULL THEN 'rejected' ELSE 'accepted' END AS status, t.turn_id, t.session_id
FROM f LEFT JOIN t ON f.assistant_message_id = t.assistant_message_id AND f.app_user = t.app_user
WHERE f.vote IS NOT NULL""")
def feedback_join(spark, sf):
    """E28 + J2: votes routed by label; resolvable ones accepted only when the
    turn exists for the same user."""
    turns = turns_from_conversations(table(spark, sf, "conversations"))
    out = TR.feedback_status(routed_feedback(spark, sf), turns)
    return out.select("feedback_id", "vote", "status", "turn_id", "session_id")


def accepted_votes(spark, sf, turns=None):
    fb = routed_feedback(spark, sf).where(F.col("route") == "resolvable")
    turns = turns if turns is not None else turns_from_conversations(table(spark, sf, "conversations"))
    acc, _ = TR.feedback_resolve(fb, turns)
    return TR.latest_vote(acc.withColumn("turn_key", F.col("turn_id")),
                          keys=("app_user", "assistant_message_id", "turn_id"))


_SQL_LATEST_VOTE = f"""
WITH f AS ({_SQL_FB}), t AS ({_SQL_TURNS}),
a AS (SELECT f.*, t.turn_id FROM f JOIN t ON f.assistant_message_id = t.assistant_message_id AND f.app_user = t.app_user
      WHERE f.vote IS NOT NULL)
SELECT app_user, assistant_message_id, turn_id, arg_max(vote, (ts, feedback_id)) AS vote,
  nullif(arg_max(comment, (ts, feedback_id)), '') AS comment,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at,
  count(*) AS n_votes
FROM a GROUP BY ALL"""


@register("latest_vote", _SQL_LATEST_VOTE)
def latest_vote(spark, sf):
    """The last vote per (user, message); blank comments -> null."""
    v = accepted_votes(spark, sf)
    return v.select("app_user", "assistant_message_id", "turn_id", "vote", "comment",
                    F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
                    F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"), "n_votes")


def tools_from_turns(turns):
    calls = turns.select("turn_id", F.transform(F.split("assistant_response", "\n"), lambda l: F.struct(
        F.when(F.instr(l, ",") > 0, F.lit("search")).otherwise(F.lit("profile")).alias("tool_name"),
        F.lit("completed").alias("status"))).alias("tool_executions"))
    return tool_rows(calls)


@register("feedback_evaluation", f"""
WITH v AS ({_SQL_LATEST_VOTE}), t AS ({_SQL_TURNS}),
tl AS (SELECT turn_id, count(*) AS n_tools, string_agg(tool, '>' ORDER BY seq) AS tool_sequence FROM (
         SELECT turn_id, generate_subscripts(string_split(assistant_response, chr(10)), 1) AS seq,
                CASE WHEN position(',' IN unnest(string_split(assistant_response, chr(10)))) > 0 THEN 'search' ELSE 'profile' END AS tool
         FROM t) GROUP BY turn_id)
SELECT v.app_user, v.assistant_message_id, v.vote, length(t.user_message) AS request_length,
  length(t.assistant_response) AS response_length, t.duration_ms, coalesce(tl.n_tools, 0) AS n_tools, tl.tool_sequence
FROM v LEFT JOIN t ON v.turn_id = t.turn_id LEFT JOIN tl ON v.turn_id = tl.turn_id""")
def feedback_evaluation(spark, sf):
    """J14 + W2: votes with request, response, timing and ordered tool calls."""
    turns = turns_from_conversations(table(spark, sf, "conversations"))
    ev = TR.feedback_evaluation(accepted_votes(spark, sf, turns), turns, tools_from_turns(turns))
    return ev.select("app_user", "assistant_message_id", "vote",
                     F.length("user_message").cast("long").alias("request_length"),
                     F.length("assistant_response").cast("long").alias("response_length"),
                     F.col("duration_ms").cast("long").alias("duration_ms"), "n_tools",
                     "tool_sequence")


# W4 ------------------------------------------------------------------------
def _msg_id():
    return F.when(F.col("role") != "assistant", F.concat(F.lit("u-"), F.col("turn").cast("string"))) \
        .when(F.length("text") > 700, F.concat(F.lit("response-"), F.col("conv_id").cast("string"), F.lit("-"),
                                               F.col("turn").cast("string"))) \
        .otherwise(F.concat(F.lit("activity-"), F.col("turn").cast("string")))


@register("feedback_target", """
WITH m AS (SELECT conv_id, turn, role, text,
             CASE WHEN role <> 'assistant' THEN 'u-' || turn WHEN length(text) > 700 THEN 'response-' || conv_id || '-' || turn
                  ELSE 'activity-' || turn END AS msg_id FROM conversations),
l AS (SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn)
                     IS NOT DISTINCT FROM 'assistant' THEN 0 ELSE 1 END AS brk FROM m),
r AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM l),
rt AS (SELECT conv_id, run, arg_max(msg_id, turn) AS run_tgt FROM r
       WHERE role = 'assistant' AND starts_with(msg_id, 'response-') GROUP BY ALL),
tt AS (SELECT conv_id, text, arg_max(msg_id, turn) AS text_tgt FROM r
       WHERE role = 'assistant' AND starts_with(msg_id, 'response-') GROUP BY ALL)
SELECT r.conv_id, r.turn, coalesce(CASE WHEN starts_with(r.msg_id, 'response-') THEN r.msg_id END,
                                   CASE WHEN r.role = 'assistant' THEN rt.run_tgt END, tt.text_tgt) AS assistant_message_id
FROM r LEFT JOIN rt ON r.conv_id = rt.conv_id AND r.run = rt.run LEFT JOIN tt ON r.conv_id = tt.conv_id AND r.text = tt.text
WHERE r.role = 'assistant'""")
def feedback_target(spark, sf):
    """The response id each clicked assistant message resolves to."""
    c = table(spark, sf, "conversations")
    msgs = c.select("conv_id", "turn", "role", "text", _msg_id().alias("msg_id"))
    clicks = c.where(F.col("role") == "assistant").select("conv_id", "turn")
    return TR.feedback_target(msgs, clicks)


# E20 / A16 -------------------------------------------------------------------
TEMPLATE = "Check {p_name} of brand {p_brand} ({p_type}) for {owner}"
FIELDS = [("p_name", True), ("p_brand", True), ("p_type", False), ("owner", True)]


@register("render_templates", """
SELECT p_partkey, CASE WHEN p_size > 45 THEN '' ELSE 'Check ' || p_name || ' of brand ' || p_brand || ' ('
       || coalesce(CASE WHEN p_size % 2 = 0 THEN p_type END, '') || ') for team ' || p_size END AS prompt,
  CASE WHEN p_size > 45 THEN 'owner' ELSE '' END AS missing FROM part""")
def render_templates(spark, sf):
    """One prompt per part (optional type left out on odd sizes, the
    required owner missing for the largest sizes)."""
    p = table(spark, sf, "part")
    vals = F.map_from_arrays(F.array(F.lit("p_name"), F.lit("p_brand"), F.lit("p_type"), F.lit("owner")),
                             F.array("p_name", "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_type")),
                                     F.when(F.col("p_size") <= 45,
                                            F.concat(F.lit("team "), F.col("p_size").cast("string")))))
    prompt, missing = X.render_template(F.lit(TEMPLATE), vals, FIELDS)
    return p.select("p_partkey", prompt, F.array_join(missing, ",").alias("missing"))


@register("prompt_catalog", """
SELECT p_type AS category, array_to_string(list_sort(list(p_name)), '|') AS titles, count(*) AS n_templates
FROM (SELECT DISTINCT p_type, p_name FROM part) GROUP BY p_type""")
def prompt_catalog(spark, sf):
    """Templates (distinct type / name pairs) grouped by category."""
    t = table(spark, sf, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("title")).distinct()
    return TR.prompt_catalog(t).select("category", F.array_join("titles", "|").alias("titles"), "n_templates")


# E10 E22 E24 E27 ------------------------------------------------------------
@register("text_helpers_pages", r"""
SELECT page_id,
  regexp_replace(replace(lower(url), '-', '_'), '[^a-z0-9_]+', '_', 'g') AS normalized,
  trim(regexp_replace(url, '[+\-&|!(){}\[\]^~*?\\:]', ' ', 'g')) AS sanitized,
  regexp_replace(regexp_replace(url, '^https?://', 's3://'), '^s3://', 's3a://') AS s3a_path,
  CASE WHEN contains(lower(url), 'local') THEN 'local' WHEN contains(lower(url), 'region') THEN 'region' END AS cluster
FROM pages""")
def text_helpers_pages(spark, sf):
    """E10, E22, E24, E27 over every page URL."""
    p = table(spark, sf, "pages")
    return p.select("page_id", X.normalize_name(F.col("url")).alias("normalized"),
                    X.sanitize_text_query(F.col("url")).alias("sanitized"),
                    X.s3_to_s3a(F.regexp_replace("url", "^https?://", "s3://")).alias("s3a_path"),
                    X.resolve_cluster(F.col("url")).alias("cluster"))


@register("merge_descriptions", rf"""
SELECT conv_id, turn, 'Investigation ' || turn || CASE WHEN d = '' THEN ''
   WHEN starts_with(d, chr(10)) THEN d ELSE chr(10) || chr(10) || regexp_replace(d, '^\s+|\s+$', '', 'g') END AS description,
  CASE WHEN turn % 3 = 0 THEN 'error' WHEN turn % 3 = 1 THEN 'interrupted' ELSE 'completed' END AS status
FROM (SELECT conv_id, turn, CASE WHEN position('{X.DESCRIPTION_MARKER}' IN o) > 0
        THEN regexp_replace(split_part(o, '{X.DESCRIPTION_MARKER}', 1), '\s+$', '') ELSE o END AS d
      FROM (SELECT conv_id, turn, coalesce(CASE WHEN turn % 2 = 0 THEN text || chr(10) || '{X.DESCRIPTION_MARKER}' || chr(10) || 'old log' ELSE text END, '') AS o
            FROM conversations))""")
def merge_descriptions(spark, sf):
    """E21 (description cut at the 70-dash marker, new text first) and E23
    (turn status) over every message."""
    c = table(spark, sf, "conversations")
    old = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("\n" + X.DESCRIPTION_MARKER + "\nold log"))) \
        .otherwise(F.col("text"))
    new = F.concat(F.lit("Investigation "), F.col("turn").cast("string"))
    err = F.when(F.col("turn") % 3 == 0, F.lit("boom"))
    stop = F.when(F.col("turn") % 3 == 1, F.lit("interrupt"))
    return c.select("conv_id", "turn", X.merge_description(old, new).alias("description"),
                    X.turn_status(err, stop).alias("status"))


# S10 / S11 -----------------------------------------------------------------
@register("upsert_sessions_conversations", """
WITH c AS (SELECT conv_id, count(*) AS n, bool_or(role = 'system') AS has_sys,
                  count(*) FILTER (WHERE turn < 2) AS tn FROM conversations GROUP BY conv_id)
SELECT 's' || conv_id AS session_id,
  CASE WHEN n > 3 AND has_sys THEN 'cn' ELSE 'apac' END AS region, 'user_' || conv_id AS app_user,
  (CASE WHEN n > 3 THEN n ELSE tn END)::INTEGER AS turn_count,
  CASE WHEN n > 3 THEN '2024-02-01 00:00:00' ELSE '2024-01-15 00:00:00' END AS updated_at
FROM c""")
def upsert_sessions_conversations(spark, sf):
    """Stored sessions (first two turns of every conversation) upserted
    with the full histories of the longer conversations.  Sessions are kept
    in row form: messages per (session, turn), turn counts by aggregate - no
    conversation is gathered into one row."""
    from dqspark.sources.sinks import session_counts, upsert_sessions
    conv = table(spark, sf, "conversations")
    sid = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    user = F.concat(F.lit("user_"), F.col("conv_id").cast("string"))
    early = session_counts(conv.where(F.col("turn") < 2), "conv_id")
    target = early.select(F.lit("apac").alias("region"), sid.alias("session_id"), user.alias("app_user"),
                          "turn_count", F.lit("2024-01-15 00:00:00").cast("timestamp").alias("updated_at"))
    full = conv.groupBy("conv_id").agg(F.max(F.col("role") == "system").alias("_has_system"),
                                       F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 3)
    inc = full.select(F.when(F.col("_has_system"), F.lit(" CN ")).alias("region"), sid.alias("session_id"),
                      user.alias("app_user"), F.col("_n").alias("turn_count"))
    out = upsert_sessions(target, inc, as_of=F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.select("session_id", "region", "app_user", "turn_count",
                      F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@register("upsert_turns_conversations", """
WITH c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
t AS (SELECT conv_id || '-' || turn AS turn_id, 's' || conv_id AS session_id, length(text) AS len, turn, prev
      FROM c WHERE role = 'assistant')
SELECT turn_id, session_id, length(prev)::BIGINT AS request_length,
  CASE WHEN len > 700 AND turn <> 3 THEN 'error' ELSE 'completed' END AS status,
  (CASE WHEN len > 700 AND turn <> 3 THEN 0 ELSE len * 3 END)::INTEGER AS duration_ms,
  CASE WHEN len > 700 AND turn <> 3 THEN 5 ELSE len END::BIGINT AS response_length
FROM t""")
def upsert_turns_conversations(spark, sf):
    """Agent turns re-logged (long answers failed and were retried; a
    status outside the three allowed values is rejected); only the mutable
    columns change, message fields keep their first value."""
    from dqspark.sources.sinks import upsert_turns
    turns = turns_from_conversations(table(spark, sf, "conversations")).select(
        "turn_id", "session_id", "app_user", F.lit("apac").alias("region"),
        F.concat(F.lit("u-"), F.col("turn_id")).alias("user_message_id"), "assistant_message_id", "user_message",
        "assistant_response", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("stop_reason"),
        F.col("duration_ms").cast("int").alias("duration_ms"),
        F.lit("2024-01-15 00:00:00").cast("timestamp").alias("created_at"),
        F.lit("2024-01-15 00:00:00").cast("timestamp").alias("completed_at"))
    retry = turns.where(F.length("assistant_response") > 700).select(
        "turn_id", F.lit("other-session").alias("session_id"), "app_user", "region", "user_message_id",
        "assistant_message_id", F.lit("changed").alias("user_message"), F.lit("retry").alias("assistant_response"),
        F.when(F.col("turn_id").endswith("-3"), F.lit("weird")).otherwise(F.lit("error")).alias("status"),
        F.lit("Boom").alias("stop_reason"), F.lit(-5).alias("duration_ms"), "created_at", "completed_at")
    out = upsert_turns(turns, retry, as_of=F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.select("turn_id", "session_id", F.length("user_message").cast("long").alias("request_length"), "status",
                      "duration_ms", F.length("assistant_response").cast("long").alias("response_length"))


@register("upsert_tools_conversations", """
WITH t AS (SELECT conv_id || '-' || turn AS turn_id, turn, length(text) AS len FROM conversations WHERE role = 'assistant'),
e AS (SELECT turn_id || '/' || k AS execution_id, turn_id, k, len, turn FROM t, unnest([1, 2, 3]) AS u(k)),
old AS (SELECT * FROM e WHERE turn % 4 = 1 AND k < 3),
new AS (SELECT *, CASE WHEN k = 1 THEN 'completed' WHEN len % 3 = 0 AND k = 2 THEN 'running' WHEN len % 3 = 1 AND k = 2 THEN 'interrupted' END AS st,
               len % 2 = 0 AS failed FROM e WHERE len > 200)
SELECT coalesce(o.execution_id, n.execution_id) AS execution_id, coalesce(o.turn_id, n.turn_id) AS turn_id,
  CAST(CASE WHEN o.k IS NULL THEN n.k ELSE o.k + 10 END AS INTEGER) AS sequence_number,
  CASE WHEN o.k IS NULL THEN 'search' ELSE 'stored' END AS tool_name,
  CASE WHEN n.k IS NULL THEN '{"q":0}' WHEN n.k = 3 THEN '{}' ELSE '{"q":' || n.len || '}' END AS tool_input,
  CASE WHEN n.k IS NULL THEN 'running' WHEN n.failed AND n.st IS DISTINCT FROM 'completed' THEN 'error'
       ELSE coalesce(n.st, 'completed') END AS status
FROM old o FULL JOIN new n ON o.execution_id = n.execution_id""")
def upsert_tools_conversations(spark, sf):
    """S11 + E23: tool executions of long answers, half of whose turns failed,
    logged again over the stored ones of every second answer."""
    from dqspark.sources.sinks import tool_rows, upsert_tool_executions
    size = F.length("text")
    turns = table(spark, sf, "conversations").where(F.col("role") == "assistant").select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "turn", size.alias("len"),
        F.when(size % 2 == 0, "Boom").alias("error"))
    call = (lambda k, status: F.struct(
        F.concat(F.col("turn_id"), F.lit(f"/{k}")).alias("execution_id"), F.lit("search").alias("tool_name"),
        (F.lit(None).cast("string") if k == 3 else F.format_string('{"q":%d}', "len")).alias("tool_input"), status.alias("status")))
    middle = F.when(F.col("len") % 3 == 0, "running").when(F.col("len") % 3 == 1, "interrupted")
    turns = turns.withColumn("tool_executions", F.array(call(1, F.lit("completed")), call(2, middle),
                                                        call(3, F.lit(None).cast("string"))))
    stored = tool_rows(turns.where(F.col("turn") % 4 == 1)).where(F.col("sequence_number") < 3).select(
        "execution_id", "turn_id", (F.col("sequence_number") + 10).alias("sequence_number"), F.lit("stored").alias("tool_name"),
        F.lit('{"q":0}').alias("tool_input"), F.lit("running").alias("status"))
    return upsert_tool_executions(stored, turns.where(F.col("len") > 200))
