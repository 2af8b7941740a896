"""Diffs of rule texts (E25 A15) and ordered application of changes (ST1 over a list)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dqspark.operators import audit as A
from dqspark.operators import changes as C
from dqspark.plans.catalog import register, table

# Rule texts: the sentences of every turn, one a line; the new text drops,
# doubles and marks some lines, and every third turn is turned round.
SQL_RULE_TEXTS = """
SELECT conv_id, turn, role, bl, CASE WHEN turn % 3 = 2 THEN list_reverse(al) ELSE al END AS al FROM (
  SELECT *, flatten(list_transform(bl, lambda x, i: CASE WHEN i % 5 = 2 THEN [] WHEN i % 7 = 4 THEN [x, x] WHEN i % 6 = 3 THEN ['~ ' || x] ELSE [x] END)) AS al
  FROM (SELECT *, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) AS bl FROM conversations WHERE text <> ''))"""


def rule_texts(conversations):
    lines = F.split(F.replace(F.col("text"), F.lit(". "), F.lit(".\n")), "\n")
    edited = F.flatten(F.transform("_b", lambda x, i: F.when(i % 5 == 1, F.array().cast("array<string>")).when(i % 7 == 3, F.array(x, x))
                                   .when(i % 6 == 2, F.array(F.concat(F.lit("~ "), x))).otherwise(F.array(x))))
    d = conversations.where("text <> ''").select("conv_id", "turn", "role", lines.alias("_b"))
    after = F.when(F.col("turn") % 3 == 2, F.reverse(edited)).otherwise(edited)
    return d.select("conv_id", "turn", "role", F.array_join("_b", "\n").alias("before"), F.array_join(after, "\n").alias("after"))


# Row i of the subsequence table is the running maximum of: the row before,
# and its diagonal plus one where the lines are equal.
SQL_DIFF_COUNTS = f"""
WITH RECURSIVE t AS ({SQL_RULE_TEXTS}),
dp AS (
  SELECT conv_id, turn, bl, al, 0 AS i, list_transform(al, lambda x: 0) AS r FROM t
  UNION ALL
  SELECT conv_id, turn, bl, al, i + 1, list_transform(range(1, len(al) + 1), lambda j: list_max(c[1:j]))
  FROM (SELECT *, list_transform(r, lambda x, k: CASE WHEN al[k] = bl[i + 1] THEN coalesce(r[k - 1], 0) + 1 ELSE x END) AS c FROM dp WHERE i < len(bl)))
SELECT conv_id, turn, coalesce(list_max(r), 0)::INTEGER AS n_common, (len(bl) - coalesce(list_max(r), 0))::INTEGER AS n_removed,
  (len(al) - coalesce(list_max(r), 0))::INTEGER AS n_added
FROM dp WHERE i = len(bl)"""


@register("rule_text_diff_conversations", SQL_DIFF_COUNTS)
def rule_text_diff_conversations(spark, sf):
    """Minimal line diff of every rule text against its edited form: lines
    kept, removed and added."""
    return A.diff_counts(rule_texts(table(spark, sf, "conversations")), ["conv_id", "turn"], "before", "after")


@register("rule_change_digest_conversations", f"""
WITH n AS ({SQL_DIFF_COUNTS}),
t AS (SELECT t.*, n.n_removed, n.n_added FROM ({SQL_RULE_TEXTS}) t JOIN n USING (conv_id, turn))
SELECT 'r' || conv_id % 3 AS region, 'conv_' || conv_id AS dataset, count(*) AS n_batches,
  count(*) FILTER (WHERE turn % 4 <> 1) AS n_diffs, coalesce(sum(n_removed) FILTER (WHERE turn % 4 <> 1), 0)::BIGINT AS n_removed,
  coalesce(sum(n_added) FILTER (WHERE turn % 4 <> 1), 0)::BIGINT AS n_added,
  coalesce(sum(len(al)) FILTER (WHERE turn % 4 = 1 AND len(al) > 1), 0)::BIGINT AS n_new_lines
FROM t GROUP BY ALL""")
def rule_change_digest_conversations(spark, sf):
    """Digests of rule-text changes with diff blocks (a turn in four is a
    new rule, shown whole); counted from the rendered text."""
    t = rule_texts(table(spark, sf, "conversations"))
    changes = t.select(
        F.concat(F.lit("r"), (F.col("conv_id") % 3).cast("string")).alias("region"), F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("dataset"),
        F.timestamp_add("HOUR", F.col("turn"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("changed_at"), F.col("role").alias("change_by"),
        F.lit(None).cast("string").alias("change_reason"), F.lit("Rule").alias("change_category"),
        F.concat(F.lit("rule"), F.col("turn").cast("string"), F.lit(".Rule_value")).alias("change_item"),
        F.when(F.col("turn") % 4 != 1, F.col("before")).alias("change_from"), F.col("after").alias("change_to"))
    d = A.change_digest(changes, rule_text=".Rule_value")
    n = (lambda pattern: F.regexp_count("digest", F.lit(pattern)).cast("long"))
    new = F.regexp_extract_all("digest", F.lit(r"(?m)\(new\):\n((?:  .*(?:\n|$))*)"), 1)
    return d.select("region", "dataset", "n_batches", n(r"(?m)\(diff\):$").alias("n_diffs"), n(r"(?m)^  -").alias("n_removed"),
                    n(r"(?m)^  \+").alias("n_added"), F.regexp_count(F.array_join(new, "\n"), F.lit(r"(?m)^  .")).cast("long").alias("n_new_lines"))


# ST1 over a list ---------------------------------------------------------------
TTL_HOURS = 48


def change_proposals(events):
    """Every event but errors proposes a change; purchases propose rules of
    which some are refused once or twice."""
    n = (F.col("event_id") % 3 + 1).cast("int")
    rules = F.transform(F.sequence(F.lit(1), n), lambda r: F.struct(
        F.concat(F.lit("rule"), r.cast("string")).alias("name"),
        F.array_repeat(F.lit("refused"), ((F.col("event_id") + r) % 3).cast("int")).alias("errors")))
    return events.where("event_type <> 'error'").select(
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("change_id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("event_id") % 11 == 0, "rejected").alias("error"), F.when(F.col("event_type") == "purchase", rules).alias("rules"))


def change_requests(events):
    """Every error event of a user asks for the changes of the six events
    before it, the newest first, each purchase's with its retries."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-6, -1)
    name = (lambda e, tail="": F.concat(F.lit("c"), e["event_id"].cast("string"), F.lit(tail)))
    ids = F.flatten(F.transform(F.reverse("_before"), lambda e: F.when(e["event_type"] == "purchase", F.array(name(e), name(e, "~1"), name(e, "~2")))
                                .when(e["event_type"] == "error", F.array().cast("array<string>")).otherwise(F.array(name(e)))))
    d = events.withColumn("_before", F.collect_list(F.struct("event_id", "event_type")).over(w)).where("event_type = 'error'")
    return d.select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("requested_at"),
                    F.when(F.col("event_id") % 13 != 0, "asked").otherwise(" ").alias("reason"), ids.alias("change_ids"))


# The same one item after the other: a step takes the next item of every user,
# with the changes taken and the retries made so far in lists.
SQL_APPLY = f"""
WITH RECURSIVE w AS (SELECT *, list({{'e': event_id, 't': event_type}}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS b FROM events),
q AS (SELECT user_id, event_id AS request_id, ts AS t0, event_id % 13 <> 0 AS valid,
        flatten(list_transform(list_reverse(coalesce(b, [])), lambda x: CASE WHEN x.t = 'purchase' THEN [{{'e': x.e, 'k': 0}}, {{'e': x.e, 'k': 1}}, {{'e': x.e, 'k': 2}}]
          WHEN x.t = 'error' THEN [] ELSE [{{'e': x.e, 'k': 0}}] END)) AS ids
      FROM w WHERE event_type = 'error'),
i0 AS (SELECT user_id, request_id, t0, valid, unnest(range(len(ids))) AS position, unnest(ids) AS c FROM q),
i AS (SELECT i0.*, row_number() OVER (PARTITION BY i0.user_id ORDER BY t0, request_id, position) AS n, c.e AS e, c.k AS k,
        'c' || c.e || CASE WHEN c.k > 0 THEN '~' || c.k ELSE '' END AS change_id, p.ts AS created, c.e % 11 = 0 AS bad,
        CASE WHEN p.event_type = 'purchase' THEN list_transform(range(1, 2 + (c.e % 3)::INT), lambda r: (c.e + r) % 3) ELSE [] END AS f
      FROM i0 JOIN events p ON p.event_id = c.e),
s AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS request_id, NULL::BIGINT AS position, NULL::VARCHAR AS change_id, NULL::VARCHAR AS status,
    NULL::INTEGER AS n_rules, NULL::INTEGER AS n_failed, NULL::VARCHAR AS retry_id, []::VARCHAR[] AS taken, []::VARCHAR[] AS made, []::TIMESTAMP[] AS made_at, -1::BIGINT AS halted
  FROM (SELECT DISTINCT user_id FROM i)
  UNION ALL
  SELECT user_id, n, request_id, position, change_id, status, CASE WHEN status = 'applied' THEN n_rules END, CASE WHEN status = 'applied' THEN n_failed END,
    CASE WHEN again THEN 'c' || e || '~' || (k + 1) END,
    CASE WHEN status IN ('applied', 'expired', 'error') THEN list_append(taken, change_id) ELSE taken END,
    CASE WHEN again THEN list_append(made, 'c' || e || '~' || (k + 1)) ELSE made END, CASE WHEN again THEN list_append(made_at, t0) ELSE made_at END,
    CASE WHEN status IN ('applied', 'not_attempted') THEN halted ELSE request_id END
  FROM (SELECT *, status = 'applied' AND n_failed > 0 AS again FROM (
    SELECT i.user_id, i.n, i.request_id, i.position, i.change_id, i.e, i.k, i.t0, s.taken, s.made, s.made_at, s.halted,
      len(list_filter(f, lambda x: x >= k))::INTEGER AS n_rules, len(list_filter(f, lambda x: x > k))::INTEGER AS n_failed,
      CASE WHEN NOT valid OR s.halted = i.request_id THEN 'not_attempted'
           WHEN (k > 0 AND NOT list_contains(s.made, i.change_id)) OR list_contains(s.taken, i.change_id) THEN 'unknown'
           WHEN epoch_us(t0) - epoch_us(CASE WHEN k = 0 THEN created ELSE s.made_at[list_position(s.made, i.change_id)] END) > {TTL_HOURS} * 3600000000 THEN 'expired'
           WHEN k = 0 AND bad THEN 'error' ELSE 'applied' END AS status
    FROM s JOIN i ON i.user_id = s.user_id AND i.n = s.n + 1)))
SELECT request_id, position::INTEGER AS position, change_id, status,
  CASE WHEN status = 'applied' THEN CASE WHEN n_failed = 0 THEN 'applied' WHEN n_failed < n_rules THEN 'partially applied' ELSE 'not applied' END END AS outcome,
  n_rules, n_failed, retry_id
FROM s WHERE n > 0"""


@register("ordered_apply_events", SQL_APPLY)
def ordered_apply_events(spark, sf):
    """ST1 over lists: requests apply their changes in order, stop at the
    first failure, and refused rules come back as new changes."""
    ev = table(spark, sf, "events")
    return C.apply_in_order(change_proposals(ev), change_requests(ev), TTL_HOURS * 3600)


@register("ordered_apply_summary_events", f"""
WITH a AS ({SQL_APPLY}),
r AS (SELECT event_id AS request_id, event_id % 13 <> 0 AS valid FROM events WHERE event_type = 'error'),
n AS (SELECT request_id, count(*) AS requested, count(*) FILTER (WHERE status = 'applied') AS applied,
        arg_min(change_id, position) FILTER (WHERE status NOT IN ('applied', 'not_attempted')) AS stopped_at FROM a GROUP BY 1)
SELECT request_id, coalesce(requested, 0) AS requested, coalesce(applied, 0) AS applied,
  CASE WHEN NOT valid OR requested IS NULL THEN 'invalid' WHEN stopped_at IS NOT NULL THEN 'stopped_on_error' ELSE 'applied' END AS status, stopped_at
FROM r LEFT JOIN n USING (request_id)""")
def ordered_apply_summary_events(spark, sf):
    ev = table(spark, sf, "events")
    requests = change_requests(ev)
    return C.request_summary(C.apply_in_order(change_proposals(ev), requests, TTL_HOURS * 3600), requests)
