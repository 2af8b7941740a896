"""Toxicity by class-conditional Kneser-Ney models.

Two models of the letters of words, one for toxic and one for ordinary text,
both of order ``ORDER`` within word bounds.  They differ only in the
highest-order counts of their class; what a class has seen rarely or never it
takes from one shared backoff distribution, Kneser-Ney estimates from the
counts and continuation counts of all documents, labelled or not.  A text's
score compares its log-likelihoods under both models, per word.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import bounded_labels, crc_fold, join_on_keys, logistic_fit, tidy, with_keys, written

ORDER = 6
#: Discount of corpus counts, and of class counts.
DISCOUNT, CLASS_DISCOUNT = 0.75, 1.5
#: Further weight of the shared distribution, in occurrences of the context.
SHARED = 8.0
#: Log-likelihoods of a word that differ by less count as equal: small
#: differences, which a language's share of a class also makes, don't add up.
DEAD_ZONE = 2.5
#: Mean log-ratios a word around which the calibrated scale turns from linear
#: to logarithmic (a few decisive words in a long text count, many don't count more).
KNEE = 0.005
#: Symbols that the uniform distribution below the lowest order stands for.
ALPHABET = 256
#: Labelled rows of each class that counts and calibration are learned from.
PER_CLASS = 10_000
#: Marks that tasks get of the words that score: a word without its mark scores
#: zero, one with it is looked up in the stored scores, which no size bounds.
SLOTS = 1 << 22
#: N-grams in one piece of a word; longer words are cut.
PIECE = 64
#: Letters up to which a word is one piece and stands for itself; longer ones go by their digest.
LONG = PIECE - 1
#: Log-ratios that a task holds at once (24 bytes each); a larger model is
#: applied in as many slices as it has, one after the other.
SLICE = 1 << 21
#: Runs between spaces whose words one Python worker remembers (about 150 bytes each).
WORD_CACHE = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(chunk: str) -> list[str]:
    """The runs of letters, lower-cased."""
    w = chunk.lower().rstrip(".,!?;:")
    return [w] if w.isalpha() else _WORD.findall(w)


def pieces(word: str) -> list[str]:
    """The word between bounds, cut so that the n-grams of its pieces are
    those that predict each letter and the end of the word, once each."""
    w = "^" * (ORDER - 1) + word + "$"
    return [w[i:i + PIECE + ORDER - 1] for i in range(0, len(w) - ORDER + 1, PIECE)]


def word_key(word: str) -> str:
    """What a word is joined by: the word, or 128 bits of a long one."""
    return word if len(word) <= LONG else "#" + hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=16).hexdigest()


_COUNTS = ("t0", "t2", "o0", "o2")


def word_counts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(word, piece, m, n, t0, t2, o0, o2)``: the pieces of each distinct
    word, how often each lies in it, and the word's occurrences in all
    documents and, by fold, in labelled toxic and ordinary ones.  Words are
    counted within each task first, so a task sends each word once, however
    hot its source."""
    rows = docs.select(F.col(id_col).alias("_did"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    marked = (rows.join(F.broadcast(sample), rows["_did"] == sample["_id"], "left")
              .select("_text", F.col("_label"), F.col("_fold")))

    def count(batches):
        chunks = [Counter() for _ in range(5)]

        def flush():
            total = [Counter() for _ in range(5)]
            for kind, counter in enumerate(chunks):
                for chunk, n in counter.items():
                    for w in words_of(chunk):
                        total[kind][w] += n
                counter.clear()
            rows = [(w, None, 1, w) for w in total[0] if len(w) <= LONG]
            rows += [(word_key(w), piece, m, w) for w in total[0] if len(w) > LONG for piece, m in Counter(pieces(w)).items()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                               pa.array([r[2] for r in rows], pa.int64()),
                                               *(pa.array([t[r[3]] for r in rows], pa.int64()) for t in total)],
                                              ["word", "piece", "m", "n", *_COUNTS])

        for b in batches:
            for text, label, fold in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                parts = text.as_py().split()
                chunks[0].update(parts)
                if label is not None:
                    chunks[1 + 2 * (label == 0) + (fold == 2)].update(parts)
                if len(chunks[0]) > 300_000:  # bounds the task's memory
                    yield flush()
        yield flush()

    sums = [F.sum(c).alias(c) for c in ("n", *_COUNTS)]
    types = "word string, piece string, m bigint, " + ", ".join(f"{c} bigint" for c in ("n", *_COUNTS))
    words = marked.mapInArrow(tidy(count), types).groupBy("word", "piece", "m").agg(*sums)
    whole = F.concat(F.lit("^" * (ORDER - 1)), "word", F.lit("$"))
    return written(words.withColumn("piece", F.coalesce("piece", whole)), "word-counts")


def _grams(col: str) -> Column:
    """The n-grams of a piece."""
    return F.transform(F.sequence(F.lit(1), F.length(col) - (ORDER - 1)), lambda i: F.substring(F.col(col), i, F.lit(ORDER)))


def gram_counts(words: DataFrame) -> DataFrame:
    """``(gram, n, t0, t2, o0, o2)`` of the counted words."""
    each = words.select(F.explode(_grams("piece")).alias("gram"), *[(F.col("m") * F.col(c)).alias(c) for c in ("n", *_COUNTS)])
    return written(each.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", *_COUNTS)]), "gram-counts")


def _interpolated(count: Column, total: Column, kinds: Column, lower: Column) -> Column:
    """Interpolated Kneser-Ney: the discounted share, the rest by ``lower``."""
    return (F.greatest(count - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * lower) / total


def shared_backoff(counts: DataFrame) -> DataFrame:
    """``counts`` plus ``q``: the shared probability of each gram's last letter
    after the letters before it.  The highest order uses the corpus counts,
    the lower ones (4, then 2 letters) the numbers of different texts that
    their grams continue."""
    four = counts.groupBy(F.substring("gram", ORDER - 3, 4).alias("g4")).agg(F.count("*").alias("k4"))
    two = four.groupBy(F.substring("g4", 3, 2).alias("g2")).agg(F.count("*").alias("k2"))
    after1 = two.groupBy(F.substring("g2", 1, 1).alias("c1")).agg(F.sum("k2").alias("s1"), F.count("*").alias("v1"))
    two = (two.join(after1, F.substring("g2", 1, 1) == F.col("c1"))
           .select("g2", _interpolated(F.col("k2"), F.col("s1"), F.col("v1"), F.lit(1.0 / ALPHABET)).alias("p2")))
    after3 = four.groupBy(F.substring("g4", 1, 3).alias("c3")).agg(F.sum("k4").alias("s3"), F.count("*").alias("v3"))
    four = (four.join(after3, F.substring("g4", 1, 3) == F.col("c3")).join(two, F.substring("g4", 3, 2) == F.col("g2"))
            .select("g4", _interpolated(F.col("k4"), F.col("s3"), F.col("v3"), F.col("p2")).alias("p4")))
    context = F.substring("gram", 1, ORDER - 1)
    after = counts.groupBy(context.alias("c")).agg(F.sum("n").alias("s"), F.count("*").alias("v"))
    return (counts.join(after, context == F.col("c")).join(four, F.substring("gram", ORDER - 3, 4) == F.col("g4"))
            .select(*counts.columns, _interpolated(F.col("n"), F.col("s"), F.col("v"), F.col("p4")).alias("q")))


def log_ratios(counts: DataFrame) -> DataFrame:
    """``(gram, weight, first, full)``: log toxic over ordinary probability,
    learned from the first fold and from all labelled rows."""
    counted = {"t_first": F.col("t0"), "o_first": F.col("o0"),
               "t_full": F.col("t0") + F.col("t2"), "o_full": F.col("o0") + F.col("o2")}
    context = F.substring("gram", 1, ORDER - 1)
    after = counts.groupBy(context.alias("_c")).agg(
        *[F.sum(n).alias(f"{m}_sum") for m, n in counted.items()],
        *[F.sum(F.least(n, F.lit(CLASS_DISCOUNT))).alias(f"{m}_off") for m, n in counted.items()])
    d = shared_backoff(counts).join(after, context == F.col("_c"))

    def p(m):  # what the discount takes from a context's letters goes to the shared distribution
        own = F.greatest(counted[m] - CLASS_DISCOUNT, F.lit(0.0))
        return (own + (F.col(f"{m}_off") + SHARED) * F.col("q")) / (F.col(f"{m}_sum") + SHARED)

    return d.select("gram", *[(F.log(p(f"t_{m}")) - F.log(p(f"o_{m}"))).alias(m) for m in ("first", "full")])


def _keyed(ratios: DataFrame):
    """``(salt, n)``: a salt by which no two grams have the same 64-bit key,
    so that a key stands for one gram, and the number of grams."""
    salt = 0
    while True:
        n, keys = ratios.agg(F.count("*"), F.count_distinct(F.xxhash64("gram", F.lit(salt)))).first()
        if n == keys:
            return salt, n
        salt += 1


def word_scores(words: DataFrame, ratios: DataFrame) -> DataFrame:
    """``(word, first, full)`` of the words that score: the sums of the
    log-ratios of all their grams, less the dead zone.  Every gram has its own
    key; tasks hold at most ``SLICE`` log-ratios at a time."""
    salt, n = _keyed(ratios)
    slices = max(1, -(-n // SLICE))
    key = F.xxhash64("gram", F.lit(salt))
    model = ratios.filter("first <> 0 or full <> 0").select(key.alias("key"), "first", "full")
    keys = F.transform(_grams("piece"), lambda g: F.xxhash64(g, F.lit(salt)))
    sums = words.select("word", "piece", "m", F.lit(0.0).alias("first"), F.lit(0.0).alias("full"))
    for k in range(slices):
        part = model.filter(F.pmod("key", F.lit(slices)) == k).sort("key").toArrow()
        table = words.sparkSession.sparkContext.broadcast([part.column(c).to_numpy() for c in ("key", "first", "full")])

        def add(batches, table=table):
            known, *values = table.value
            for b in batches:
                lists = b.column(5)
                flat, start = lists.flatten().to_numpy(), lists.offsets.to_numpy()
                start = start[:-1] - start[0]
                at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
                hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
                out = [b.column(i).to_numpy() for i in (3, 4)]
                if len(start):
                    found = [np.add.reduceat(np.where(hit, v[at], 0.0) if len(v) else np.zeros(len(flat)), start) for v in values]
                    out = [o + f for o, f in zip(out, found, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(o, pa.float64()) for o in out)],
                                                 ["word", "piece", "m", "first", "full"])

        sums = sums.withColumn("keys", keys).mapInArrow(tidy(add), sums.schema)
        if k < slices - 1:
            sums = written(sums, "word-sums")
    both = ("first", "full")
    beyond = (lambda r: F.greatest(r - DEAD_ZONE, F.lit(0.0)) - F.greatest(-r - DEAD_ZONE, F.lit(0.0)))
    sums = written(sums.filter(F.substring("word", 1, 1).eqNullSafe("#") | (F.greatest(F.abs("first"), F.abs("full")) > DEAD_ZONE)), "word-sums")
    cut = sums.filter(F.substring("word", 1, 1) == "#").groupBy("word").agg(*[F.sum(F.col("m") * F.col(c)).alias(c) for c in both])
    plain = sums.filter(F.substring("word", 1, 1) != "#").select("word", *both)
    scores = plain.unionByName(cut).select("word", *[beyond(F.col(c)).alias(c) for c in both])
    return written(scores.filter("first <> 0 or full <> 0"), "word-scores")


def _marks(scores: DataFrame) -> np.ndarray:
    """A mark for the hash of every word that scores."""
    slot = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(SLOTS)).cast("int").alias("slot")
    out = np.zeros(SLOTS, np.bool_)
    out[scores.select(slot).distinct().toArrow().column("slot").to_numpy()] = True
    return np.packbits(out)


def _mean_ratios(rows: DataFrame, scores: DataFrame, marks, which: str) -> DataFrame:
    """``(_id, _h, _x)`` of the distinct ``_id, _h``: mean log-ratio a word of
    ``_text``, on the calibrated scale (empty: 0).

    A task counts the words of each text and sends those that have a mark;
    the stored scores are joined to them.  Rows that repeat add alike to the
    sum and to the number of words, so they leave the mean as it is."""
    id_type = rows.schema["_id"].dataType.simpleString()

    def count(batches):
        bits = marks.value
        known: dict[str, tuple[int, tuple[str, ...]]] = {}

        def look(chunk):
            words = words_of(chunk)
            keys = [word_key(w) for w in words]
            slots = [zlib.crc32(k.encode("utf-8", "replace")) & (SLOTS - 1) for k in keys]
            found = (len(words), tuple(k for k, at in zip(keys, slots, strict=True) if bits[at >> 3] >> (7 - (at & 7)) & 1))
            if len(known) >= WORD_CACHE:
                known.clear()
            if len(chunk) <= LONG:
                known[chunk] = found
            return found

        for b in batches:
            row, word, times, words = [], [], [], []
            for i, text in enumerate(b.column(2)):
                n, sent = 0, Counter()
                for chunk, c in Counter(text.as_py().split()).items():
                    many, keys = known.get(chunk) or look(chunk)
                    n += c * many
                    for k in keys:
                        sent[k] += c
                row += [i] * (1 + len(sent))
                word += [None, *sent]
                times += [0, *sent.values()]
                words += [n] + [0] * len(sent)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(word, pa.string()),
                                              pa.array(times, pa.int64()), pa.array(words, pa.int64())], ["_id", "_h", "_word", "_c", "_n"])

    sent = written(rows.select("_id", "_h", "_text").mapInArrow(tidy(count), f"_id {id_type}, _h bigint, _word string, _c bigint, _n bigint"), "text-words")
    # stored, so that Spark can split the join at a word that many texts have
    scored = (sent.filter("_word is not null").join(scores, F.col("_word") == F.col("word"))
              .select("_id", "_h", (F.col("_c") * F.col(which)).alias("_r"), F.lit(0).cast("long").alias("_n")))
    every = sent.filter("_word is null").select("_id", "_h", F.lit(0.0).alias("_r"), "_n").unionByName(scored)
    mean = F.sum("_r") / F.greatest(F.sum("_n"), F.lit(1))
    return (every.groupBy("_id", "_h").agg(mean.alias("_m"))
            .select("_id", "_h", (F.signum("_m") * F.log1p(F.abs("_m") / KNEE)).alias("_x")))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", label_id_col: str = "doc_id", per_class: int = PER_CLASS,
                    carry_row: bool = False) -> DataFrame:
    """``(id_col, held_out, score)`` of every row of ``docs``, and with
    ``carry_row`` the row itself as the struct ``_row``.

    Learns from at most about ``per_class`` labelled rows of each class whose
    crc32 fold is not the held-out one; backoff counts come from all texts.
    The map from mean log-ratio to probability is fitted on the second fold's
    rows as the first fold's model scores them; the final model learns from
    both.  Without labelled rows of both classes every score is 0.5 or the
    one class's rate.

    Null text counts as empty and scores as a log-ratio of zero; null and
    repeated ids and repeated rows each keep a row; an empty table gives no
    rows; other columns are not read.  What reaches the driver and every task
    is ``SLOTS`` bits, whatever the input's size; counts, log-ratios and scores
    of words are stored tables that grow with the corpus and are joined."""
    spark = docs.sparkSession
    sample = written(bounded_labels(labels, label_col, per_class, label_id_col), "toxic-labels")
    words = word_counts(docs, sample, id_col, text_col)
    scores = word_scores(words, written(log_ratios(gram_counts(words)), "gram-ratios"))
    marks = spark.sparkContext.broadcast(_marks(scores))
    rows = with_keys(docs, id_col, text_col)

    marked = written(rows.join(F.broadcast(sample.filter("_fold = 2").select(F.col("_id").alias("_lid"), "_label", "_weight")),
                               rows["_id"] == F.col("_lid")).drop("_lid"), "toxic-calibration")
    known = join_on_keys(marked.drop("_text"), _mean_ratios(marked, scores, marks, "first"), "inner").toArrow()
    x, y, w = (known.column(c).to_numpy() for c in ("_x", "_label", "_weight"))
    if len(set(y)) == 2:
        unit = max(float(x.std()), 1e-6)
        a, b = logistic_fit(x / unit, y, w)
        a /= unit
    else:
        a, b = 0.0, 0.0 if not len(y) else (3.0 if y[0] else -3.0)
    a, b = max(float(a), 0.0), float(b)
    means = written(_mean_ratios(rows, scores, marks, "full"), "toxic-means")
    row = [F.struct(*docs.columns).alias("_row")] if carry_row else []
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), *row)
    return join_on_keys(keyed, means, "inner").select(
        F.col("_id").alias(id_col), (crc_fold(F.col("_id")) == 1).alias("held_out"),
        (1 / (1 + F.exp(-(F.col("_x") * a + b)))).alias("score"), *(["_row"] if carry_row else []))
