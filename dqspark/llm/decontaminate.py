"""Benchmark decontamination by a distributed positional inverted index.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqspark.llm.common import join_on_keys, on_keys, with_keys, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII other than letters and digits separates words.
_GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Terms of a window whose posting lists are intersected, rarest first.
ANCHORS = 3
#: Words of a window that a near match may lack, in windows of this many words at least.
MISSING, LEAST_NEAR = 1, 5


def benchmark_words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased (no other letter is), then runs of
    ASCII letters, digits and anything outside ASCII."""
    text = F.coalesce(text, F.lit(""))
    # lower() is right, and much cheaper, where no letter outside ASCII changes
    other = text.rlike("[\\p{Lu}\\p{Lt}\\p{Nl}\\p{So}&&[^\\x00-\\x7F]]")
    lowered = F.when(other, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(lowered, _GAPS), lambda w: w != "")


def windows_of(benchmark: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text"):
    """``(wid, terms)`` of the distinct windows and ``(wid, item)`` of the
    items they occur in.  A shorter item is one window; one without words has
    none."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), benchmark_words(F.col(text_col)).alias("_w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1)))
    rows = (items.filter(F.size("_w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, size))).alias("terms"))
            .withColumn("wid", F.xxhash64(F.array_join("terms", " "))))
    rows = written(rows, "benchmark-windows")
    return written(rows.groupBy("wid").agg(F.first("terms").alias("terms")), "benchmark-distinct"), rows.select("wid", "item").distinct()


def build_index(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Posting lists ``(term, _id, _h, pos)`` of the given terms over all
    texts of ``rows``, stored sorted by term so that a look-up skips most
    row groups."""
    words = rows.select("_id", "_h", F.posexplode(benchmark_words(F.col("_text"))).alias("pos", "term"))
    return written(words.join(terms, "term", "left_semi").sortWithinPartitions("term"), "postings")


def find_windows(rows: DataFrame, windows: DataFrame, slop: int = 2, proximity: bool = True):
    """``(exact, near)`` matches of ``windows`` (``wid, terms``) in ``rows``:
    ``(_id, _h, wid, start, n)``.

    Term frequencies over all texts rank each window's terms.  The postings of
    the ``ANCHORS`` rarest are stored; a window's starts are its rarest
    term's positions less the term's offset, intersected with the next two
    lists, each less its own offset.  What is left, nearly all true matches,
    is compared word by word.  ``near``: starts given by one of the window's
    two rarest terms that occur at all, from which every word of the window
    but ``MISSING`` (none in windows of under ``LEAST_NEAR``) lies up to
    ``slop`` places from where an exact match would have it.  Two of the three
    rarest terms then lie near each other, which gives the candidates; windows
    of one word have no near matches.

    A term's postings are spread over all partitions that hold it, so a
    frequent term is no hot key; frequent terms are read only for windows
    that have no rarer ones."""
    counts = (rows.select(F.explode(benchmark_words(F.col("_text"))).alias("term"))
              .join(written(windows.select(F.explode("terms").alias("term")).distinct(), "benchmark-terms"), "term", "left_semi")
              .groupBy("term").agg(F.count("*").alias("_f")))
    placed = windows.select("wid", "terms", F.posexplode("terms").alias("off", "term"))
    ranked = (placed.join(written(counts, "term-counts"), "term", "left")
              .groupBy("wid").agg(F.first("terms").alias("terms"),
                                  F.sort_array(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), "off", "term"))).alias("_r")))
    # a window with a word that no text has can't occur exactly
    missing = F.when(F.size("terms") >= LEAST_NEAR, F.lit(MISSING)).otherwise(F.lit(0))
    ranked = (ranked.withColumn("_r", F.filter("_r", lambda r: r["f"] > 0))
              .withColumn("whole", F.size("_r") == F.size("terms"))
              .filter((F.size("_r") >= F.size("terms") - missing) & (F.size("_r") > 0)))
    if not proximity:
        ranked = ranked.filter("whole")
    ranked = ranked.select("wid", F.size("terms").alias("n"), "whole", *[
        F.get("_r", F.lit(i))[c].alias(f"{c}{i}") for i in range(ANCHORS) for c in ("term", "off")])
    ranked = written(ranked, "window-anchors")
    anchors = ranked.select(F.explode(F.array(*[f"term{i}" for i in range(ANCHORS)])).alias("term")).filter("term is not null").distinct()
    index = build_index(rows, written(anchors, "anchor-terms"))

    if proximity:
        return _compared(rows, windows, _near_candidates(index, ranked, slop), slop)

    exactly = ranked.filter("whole")
    starts = (index.join(exactly, index["term"] == exactly["term0"]).withColumn("start", F.col("pos") - F.col("off0"))
              .select("_id", "_h", "wid", "n", "start", *[f"{c}{i}" for i in range(1, ANCHORS) for c in ("term", "off")]))
    hits = starts.filter("start >= 0")
    for i in range(1, ANCHORS):
        p = index.select(F.col("_id").alias("_pid"), F.col("_h").alias("_ph"), F.col("term").alias("_pt"), "pos")
        at = (hits["_id"].eqNullSafe(p["_pid"]) & (hits["_h"] == p["_ph"]) & (hits[f"term{i}"] == p["_pt"])
              & (hits["start"] + hits[f"off{i}"] == p["pos"]))
        hits = (hits.filter(f"term{i} is not null").join(p, at, "left_semi")
                .unionByName(hits.filter(f"term{i} is null")))
    hits = written(hits.select("_id", "_h", "wid", "start", "n").distinct(), "window-candidates")

    # word by word, on the texts that still have a candidate
    asked = (hits.join(windows, "wid").groupBy("_id", "_h")
             .agg(F.collect_list(F.struct("wid", "start", "n", "terms")).alias("_asked")))
    found = (join_on_keys(rows, asked, "inner").withColumn("_w", benchmark_words(F.col("_text")))
             .select("_id", "_h", F.explode(F.filter("_asked", lambda m: F.slice("_w", m["start"] + 1, m["n"]) == m["terms"])).alias("m")))
    return found.select("_id", "_h", "m.wid", "m.start", "m.n").distinct(), None


def _near_candidates(index: DataFrame, ranked: DataFrame, slop: int) -> DataFrame:
    """``(_id, _h, wid, start, n, exact, near)``: where all anchors of a window
    give one start (``exact``), and the starts of its two rarest terms with one
    of another anchor up to ``slop`` places away (``near``).

    Every posting is met once, with the windows that its term anchors; the
    starts of one text and window are sorted and each looks at its neighbours,
    so pairs of postings are never listed."""
    anchors = ranked.withColumn("_all", sum((F.when(F.col(f"term{i}").isNotNull(), 1 << i).otherwise(0) for i in range(ANCHORS)), F.lit(0)))
    anchors = anchors.select("wid", "n", "whole", "_all", F.posexplode(F.array(*[
        F.struct(F.col(f"term{i}").alias("term"), F.col(f"off{i}").alias("off"), F.lit(1 << i).alias("bit")) for i in range(ANCHORS)])).alias("anchor", "_a"))
    anchors = anchors.filter("_a.term is not null").select("wid", "n", "whole", "_all", "anchor", F.col("_a.term").alias("_t"), "_a.off", "_a.bit")
    starts = (index.join(anchors, index["term"] == anchors["_t"])
              .select("_id", "_h", "wid", "n", "whole", "_all", "anchor", "bit", (F.col("pos") - F.col("off")).alias("start")))
    places = Window.partitionBy("_id", "_h", "wid").orderBy("start")
    same = F.bit_or("bit").over(places.rangeBetween(0, 0))
    around = F.bit_or("bit").over(places.rangeBetween(-slop, slop))
    found = starts.select("_id", "_h", "wid", "start", "n", ((F.col("anchor") == 0) & F.col("whole") & (F.col("start") >= 0) & (same == F.col("_all"))).alias("exact"),
                          ((F.col("anchor") < 2) & (around != F.col("bit"))).alias("near"))
    return written(found.filter("exact or near").groupBy("_id", "_h", "wid", "start", "n")
                   .agg(F.bool_or("exact").alias("exact"), F.bool_or("near").alias("near")), "near-candidates")


def _compared(rows: DataFrame, windows: DataFrame, candidates: DataFrame, slop: int):
    """The ``(exact, near)`` matches among the candidates, word by word; the
    texts that have a candidate are read once for both."""
    asked = (candidates.join(windows, "wid").groupBy("_id", "_h")
             .agg(F.collect_list(F.struct("wid", "start", "n", "terms", "exact", "near")).alias("_asked")))

    def lies_near(m):
        first = (lambda i: F.greatest(m["start"] + i + 1 - slop, F.lit(1)))
        there = F.transform(m["terms"], lambda t, i: F.array_contains(
            F.slice("_w", first(i), F.greatest(m["start"] + i + 2 + slop - first(i), F.lit(0))), t))
        lacks = F.size(F.filter(there, lambda x: ~x))
        return lacks <= F.when(m["n"] >= LEAST_NEAR, F.lit(MISSING)).otherwise(F.lit(0))

    def verdict(m):
        is_exact = F.when(m["exact"], F.slice("_w", m["start"] + 1, m["n"]) == m["terms"]).otherwise(False)
        is_near = F.when(m["near"], lies_near(m)).otherwise(False)
        return F.struct(m["wid"].alias("wid"), m["start"].alias("start"), m["n"].alias("n"), is_exact.alias("exact"), is_near.alias("near"))

    found = (join_on_keys(rows, asked, "inner").withColumn("_w", benchmark_words(F.col("_text")))
             .select("_id", "_h", F.explode(F.transform("_asked", verdict)).alias("m"))
             .filter("m.exact or m.near").select("_id", "_h", "m.*"))
    found = written(found, "near-matches")
    match = (lambda which: found.filter(which).select("_id", "_h", "wid", "start", "n").distinct())
    return match("exact"), match("near")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", slop: int = 2, proximity: bool = True) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, _h`` (the text's hash)
    ``, n_words, n_hit, n_items, items_sha256, contaminated`` and, with ``proximity``, ``n_near`` (windows
    whose words lie near their places in it, but for one of five or more;
    exact ones of two words or more included).

    A word is hit if it lies in an occurrence of a window of ``size``
    consecutive item words.  Null text has no words; null or repeated ids
    keep a row each; an item with a null id counts its hits but isn't listed;
    an empty table of either kind gives rows without hits (or no rows); other
    columns are not read."""
    rows = with_keys(docs, id_col, text_col)
    windows, items = windows_of(benchmark, size, item_col, item_text_col)
    exact, near = find_windows(rows, windows, slop, proximity)
    exact = written(exact, "window-matches")
    order = Window.partitionBy("_id", "_h").orderBy("start", "end")
    spans = exact.select("_id", "_h", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    reached = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = (spans.withColumn("_new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)))
           .groupBy("_id", "_h").agg(F.sum("_new").cast("long").alias("n_hit")))
    found = (exact.select("_id", "_h", "wid").distinct().join(items, "wid").groupBy("_id", "_h")
             .agg(F.array_sort(F.collect_set("item")).alias("_items")))
    out = join_on_keys(rows.select("_id", "_h", F.size(benchmark_words(F.col("_text"))).cast("long").alias("n_words")), hit, "left")
    out = join_on_keys(out, found, "left")
    listed = F.coalesce("_items", F.array().cast("array<string>"))
    cols = [F.col("_id").alias(id_col), "_h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")]
    if proximity:
        out = join_on_keys(out, near.groupBy("_id", "_h").agg(F.countDistinct("wid").alias("n_near")), "left")
        cols.append(F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    return out.select(*cols)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their
    columns, whatever these are called."""
    found = contamination(docs, benchmark, size, id_col, text_col, proximity=False)
    bad = written(found.filter("contaminated").select(F.col(id_col).alias("_id"), "_h").distinct(), "contaminated")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"))
    return keyed.join(bad, on_keys(keyed, bad), "left_anti").select("_row.*")
