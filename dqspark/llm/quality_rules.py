"""Quality rules with adaptive thresholds per language and source.

DataFrame operations only.  Each rule's ratio is kept as whole thousandths;
a count per thousandth is the quantile sketch of a group: sketches of parts
merge by adding counts, so partial ones are built before the shuffle, and a
quantile read from one is within a thousandth of the exact one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqspark.llm.common import written

_SPACE = "[\\x20\\x09-\\x0D]+"

#: Rule -> the count it bounds, what that is counted in, and by how many the
#: count goes up at a time (a window found twice brings two times three words).
#: ``word_length`` is a mean and is bounded on both sides.
RULES = {
    "symbols": ("n_symbols", "n_words", 1),
    "dup_lines": ("n_dup_lines", "n_lines", 1),
    "repeats": ("n_repeat_words", "n_words", 6),
    "word_length": ("word_chars", "n_words", None),
}
#: Tenths of the rows at which a group's sketch is read.
TENTHS = (1, 5, 9)
#: A (language, source) group's quantiles are averaged with its language's,
#: and these with all rows', as if that many rows more had the wider group's.
PRIOR_ROWS = 100
#: A row is out of range beyond this many standard deviations (counts) or
#: spreads between quantiles (mean lengths).
FENCE = 3


def base_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_lines (lines with a
    word), n_dup_lines, n_repeat_words (long) and base_failed; null text counts as empty.

    n_repeat_words: hashes of the three-word windows, their low bits replaced
    by their place (as many bits as the text needs), are sorted, so equal
    windows become neighbours; neighbours are confirmed on whole hashes.  It
    makes no rows and costs one sort of longs a text."""
    d = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    d = d.withColumn("_w", F.filter(F.split("_t", _SPACE), lambda w: w != ""))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    d = (d.withColumn("n_words", F.size("_w").cast("long"))
         .withColumn("word_chars", F.length(F.regexp_replace("_t", _SPACE, "")).cast("long"))
         .withColumn("n_symbols", F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long"))
         .withColumn("n_lines", F.size("_l").cast("long"))
         .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
         .withColumn("_low", F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin("n_words"))) - 1)
         .withColumn("_h", F.when(F.col("n_words") > 2, F.transform(
             F.slice("_w", 1, F.size("_w") - 2), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))))))
    place = (lambda p: p.bitwiseAND(F.col("_low")).cast("int"))
    same = (lambda p, k: F.coalesce(F.get("_h", place(p)) == F.get("_h", place(F.get("_p", k))), F.lit(False)))
    d = d.withColumn("_p", F.sort_array(F.transform(
        "_h", lambda h, i: h.bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long")))))
    d = d.withColumn("_at", F.sort_array(F.transform(F.filter("_p", lambda p, k: same(p, k - 1) | same(p, k + 1)), place)))
    # each window found twice or more covers its three words, overlaps once
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("_at", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
                          lambda a: a["n"])
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.drop("_t", "_w", "_l", "_h", "_low", "_p", "_at")


def thousandths(rule: str) -> Column:
    """A row's ratio in ``rule``, in whole thousandths."""
    count, unit, _ = RULES[rule]
    return F.floor(F.try_divide(1000 * F.col(count), F.col(unit)))


def sketch(stats: DataFrame) -> DataFrame:
    """``(lang, source, rule, value, c)``: rows of each group per thousandth
    of each rule's ratio, from rows that passed the base."""
    each = F.array(*[F.struct(F.lit(r).alias("rule"), thousandths(r).alias("value")) for r in RULES])
    return (stats.filter(~F.col("base_failed")).select("_lang", "_source", F.explode(each).alias("_v"))
            .groupBy("_lang", "_source", "_v.rule", "_v.value").agg(F.count("*").alias("c")))


def quantiles(sketches: DataFrame) -> DataFrame:
    """``(level, lang, source, rule, n, q<tenths>, ...)`` of the sketches
    merged per language and source (level 2), language (1) and overall (0):
    the least value that many tenths of the rows don't exceed."""
    none = (lambda c: F.lit(None).cast(sketches.schema[c].dataType))
    levels = F.array(*[F.struct(F.lit(level).alias("level"), (F.col("_lang") if level else none("_lang")).alias("lang"),
                                (F.col("_source") if level == 2 else none("_source")).alias("source")) for level in (0, 1, 2)])
    keys = ["level", "lang", "source", "rule"]
    merged = (sketches.select(F.inline(levels), "rule", "value", "c").groupBy(*keys, "value").agg(F.sum("c").alias("c")))
    group = Window.partitionBy(*keys)
    upto = F.sum("c").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return (merged.withColumn("_n", F.sum("c").over(group)).withColumn("_upto", upto)
            .groupBy(*keys).agg(F.max("_n").alias("n"), *[
                F.min(F.when(10 * F.col("_upto") >= t * F.col("_n"), F.col("value"))).alias(f"q{t}") for t in TENTHS]))


def thresholds(quantile_rows: DataFrame) -> DataFrame:
    """``(_glang, _gsource, q<tenths>_<rule>, ...)`` for every group: its
    quantiles, pooled by row counts with its language's and all rows'."""
    group, lang, every = (quantile_rows.filter(F.col("level") == level).alias(name)
                          for level, name in ((2, "g"), (1, "l"), (0, "a")))
    g = (group.join(lang, F.col("g.lang").eqNullSafe(F.col("l.lang")) & (F.col("g.rule") == F.col("l.rule")))
         .join(every, F.col("g.rule") == F.col("a.rule")))

    def pooled(own, t, wider):
        n = F.col(f"{own}.n")
        return F.floor((n * F.col(f"{own}.q{t}") + PRIOR_ROWS * wider) / (n + PRIOR_ROWS))

    limits = []
    for t in TENTHS:
        q = pooled("g", t, pooled("l", t, F.col(f"a.q{t}")))
        limits += [F.max(F.when(F.col("g.rule") == r, q)).alias(f"q{t}_{r}") for r in RULES]
    return g.groupBy(F.col("g.lang").alias("_glang"), F.col("g.source").alias("_gsource")).agg(*limits)


def within_limits(rule: str) -> Column:
    """Whether a row joined with its group's quantiles keeps within ``rule``.

    Counts: the rate that nine tenths of the group keep to (the upper end of
    its thousandth) gives the count to expect in a text as long as this one;
    the row may exceed it by ``FENCE`` standard deviations of such a count,
    one more step included.  Mean word length: ``FENCE`` times the distance
    from the median to the outer tenth, or the standard error of a mean over
    this many words if that is more, beyond the outer tenth."""
    count, unit, step = RULES[rule]
    q = {t: F.col(f"q{t}_{rule}") for t in TENTHS}
    if step:
        expected = (q[9] + 1) * F.col(unit) / F.lit(1000.0)
        return F.col(count) <= expected + FENCE * F.sqrt(step * (expected + step))
    noise = F.try_divide(q[5], F.sqrt(unit))
    return thousandths(rule).between(q[1] - FENCE * F.greatest((q[5] - q[1]).cast("double"), noise),
                                     q[9] + FENCE * F.greatest((q[9] - q[5]).cast("double"), noise))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     source_col: str = "source") -> DataFrame:
    """``id_col``, the base counts, ``base_failed`` and ``kept`` of every row.

    A row that passes the base is kept if it keeps within every rule's limits
    (:func:`within_limits`), which come from the quantile sketches of its
    language and source alone; no rule has a fixed cutoff.  Quantiles of small
    groups are pooled with those of their language and of all rows, by row
    counts, so there is no size at which the rule changes.

    Null text has no words and fails the base; null languages or sources are
    groups of their own; null or repeated ids and repeated rows each keep a
    row; an empty table gives no rows; other columns are not read.  Counts are
    stored once; sketches are partial before the shuffle, so a source with a
    third of all rows sends no more than any other."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"),
                       F.col(source_col).alias("_source"))
    stats = written(base_stats(slim, "_text").drop("_text"), "quality-counts")
    limits = thresholds(written(quantiles(sketch(stats)), "quality-quantiles"))
    d = stats.join(limits, stats["_lang"].eqNullSafe(limits["_glang"]) & stats["_source"].eqNullSafe(limits["_gsource"]), "left")
    kept = ~F.col("base_failed")
    for rule in RULES:
        kept = kept & F.coalesce(within_limits(rule), F.lit(False))
    return d.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", kept.alias("kept"))
