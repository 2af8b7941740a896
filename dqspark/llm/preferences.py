"""Preference formatting of chosen and rejected conversations.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turns(df: DataFrame, side: str, pair: str, turn: str, role: str, text: str) -> DataFrame:
    """A conversation's turns in order as one array (a conversation is one
    record of the output, so its turns are gathered)."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    return (df.groupBy(F.col(pair).alias(f"_{side}")).agg(F.sort_array(F.collect_list(one)).alias("_t"))
            .select(f"_{side}", F.transform("_t", lambda t: F.struct(t["role"], t["text"])).alias(side)))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(t["text"], F.lit("<|end|>"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def _spans(turns: Column, trained_role: str) -> Column:
    """``[start, end)`` character spans of the rendered turns that are trained
    on: the trained role's text and its end mark.  All else is masked."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))

    def step(a, t):
        first = a["at"] + F.length(_head(t))
        last = first + F.length(_body(t))
        span = F.array(F.struct(first.alias("first"), last.alias("last")))
        return F.struct((last + 1).alias("at"), F.when(t["role"] == trained_role, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda a: a["out"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "conv_id", turn: str = "turn", role: str = "role",
                       text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """``(pair, n_prompt_turns, prompt, chosen, rejected, chosen_spans,
    rejected_spans)``, one row for each pair id found on both sides.

    The longest common prefix of turns (equal role and text) is rendered once
    as the prompt; what follows on either side is its completion, with the
    spans that a loss is taken on.  If both sides are equal, both completions
    are empty.

    Null roles and texts count as empty; turns with equal numbers are ordered
    by role and text; repeated turns stay; the null pair id is a pair like
    any other; an empty side gives no rows; other columns are not read."""
    c, r = _turns(chosen, "chosen", pair, turn, role, text), _turns(rejected, "rejected", pair, turn, role, text)
    d = c.join(r, c["_chosen"].eqNullSafe(r["_rejected"]))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(F.concat(same, F.array(F.lit(False))), False)
    d = d.withColumn("_p", (first - 1).cast("int"))
    rest = (lambda side: F.slice(side, F.col("_p") + 1, F.greatest(F.size(side) - F.col("_p"), F.lit(0))))
    d = d.withColumn("_c", rest("chosen")).withColumn("_r", rest("rejected"))
    return d.select(F.col("_chosen").alias(pair), F.col("_p").cast("long").alias("n_prompt_turns"),
                    _render(F.slice("chosen", F.lit(1), F.col("_p"))).alias("prompt"), _render(F.col("_c")).alias("chosen"),
                    _render(F.col("_r")).alias("rejected"), _spans(F.col("_c"), trained_role).alias("chosen_spans"),
                    _spans(F.col("_r"), trained_role).alias("rejected_spans"))


def weaker_answers(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   answer_role: str = "assistant") -> DataFrame:
    """Rejected sides for conversations that have none: each one again, its
    last answer replaced by the answer before it (a repeated answer), or by
    an empty one if there is none.  Without answers it stays as it is."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the last two answers in turn order, aggregated without gathering a conversation
    answers = (conversations.filter(F.col(role) == answer_role).groupBy(F.col(conv).alias("_c"))
               .agg(F.max(one).alias("_last")))
    d = conversations.join(answers, F.col(conv).eqNullSafe(F.col("_c")), "left")
    before = (d.filter((F.col(role) == answer_role) & (one < F.col("_last"))).groupBy(F.col(conv).alias("_b"))
              .agg(F.max(one).alias("_before")))
    d = d.join(before, F.col(conv).eqNullSafe(F.col("_b")), "left")
    weaker = F.when(one == F.col("_last"), F.coalesce("_before.text", F.lit(""))).otherwise(F.col(text))
    return d.select(F.col(conv).alias(conv), F.col(turn).alias(turn), F.col(role).alias(role), weaker.alias(text))
