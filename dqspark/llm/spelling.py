"""Spelling variants: words one edit apart, found by blocked Gram matrices.

Two words one insertion, deletion or replacement apart have equal or adjacent
lengths, and the squared distance of their letter counts is at most two.
Words are put in blocks by length and by how many letters they have of each
of a few classes; a block meets those blocks that one edit can lead to.  The
squared distances of two blocks come from one matrix product of their letter
counts; pairs at most two apart are then verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import written

#: Letters that runs are made of.
LETTERS = "A-Za-zÀ-ÿ"
#: Letter classes of a block, columns of the letter counts, and words of a block about.
CLASSES, COLUMNS, BLOCK = 5, 64, 512
#: Words a task counts at once; code points of a text whose runs are listed at once.
WORDS_HELD, LISTED = 500_000, 1 << 20


def _count_batches(letters: str, min_chars: int, typo_every: int | None):
    names = ["word", "n"]

    def run(batches):
        runs = re.compile(f"[{letters}]+")
        total: Counter = Counter()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py().encode().lower().decode()  # bytes: only A-Z change
                found = Counter(runs.findall(text) if len(text) < LISTED else (m.group() for m in runs.finditer(text)))
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in found.items():
                    if len(word) >= min_chars:
                        if typo_every:
                            h = zlib.crc32(word.encode(), start)
                            if h % typo_every == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1:]
                                if len(word) < min_chars:
                                    continue
                        total[word] += n
                if len(total) > WORDS_HELD:
                    yield batch()
                    total.clear()
        if total:
            yield batch()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, min_chars: int = 6,
                min_count: int = 5, typo_every: int | None = None) -> DataFrame:
    """``(word, n)``: runs of ``letters``, A-Z lower-cased, of ``min_chars``
    code points at least, that occur ``min_count`` times at least in all
    whole texts.  With ``typo_every`` a word in a document loses one letter
    if the crc32 of ``<id>:<word>`` divides by it (for tests of what a real
    corpus holds).

    Counted in the tasks first, so a word of every text is no hot key.  Null
    texts have no words; a null id is written as nothing; repeated rows count
    each; other columns, whatever their names, are not read."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    partial = rows.mapInArrow(_count_batches(letters, min_chars, typo_every), "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _profile(word: str) -> tuple[int, ...]:
    counts = [0] * CLASSES
    for c in word:
        counts[ord(c) % CLASSES] += 1
    return tuple(counts)


def _key(profile) -> str:
    return " ".join(map(str, profile))


def reachable(profile: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The profiles, itself included, that one replacement or insertion can
    lead to; of two equal-length profiles only the lesser lists the other."""
    found = {profile}
    for i in range(len(profile)):
        more = tuple(c + (j == i) for j, c in enumerate(profile))
        found.add(more)
        for j in range(len(profile)):
            other = tuple(c - (k == j) for k, c in enumerate(more))
            if other[j] >= 0 and other > profile:
                found.add(other)
    return sorted(found)


def _keyed(batches):
    for b in batches:
        keys = [_key(_profile(w)) for w in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), b.column(0), b.column(1)], ["key", "word", "n"])


def _reached(batches):
    for b in batches:
        pairs = [(key, _key(p)) for key in b.column(0).to_pylist() for p in reachable(tuple(map(int, key.split())))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pairs, strict=True)] if pairs
                                         else [pa.array([], pa.string())] * 2, ["key", "other"])


class _Words:
    """The words of a block: their letters and letter counts."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = np.array(words, object), np.array(n, np.int64)
        self.length = len(words[0])
        self.codes = np.array(words, f"<U{self.length}").view("<u4").reshape(len(words), self.length)
        at = np.arange(len(words))[:, None] * COLUMNS + self.codes % COLUMNS
        exact = np.float32 if self.length < 4096 else np.float64  # squares under 2^24, or 2^53
        self.counts = np.bincount(at.ravel(), minlength=len(words) * COLUMNS).reshape(-1, COLUMNS).astype(exact)
        self.squares = (self.counts * self.counts).sum(1)


def one_edit_pairs(a: _Words, b: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the words one edit apart; ``b`` is as long as ``a`` or
    one letter longer."""
    apart = a.squares[:, None] + b.squares[None, :] - 2 * (a.counts @ b.counts.T)
    i, j = np.nonzero(apart <= 2)
    if not len(i):
        return i, j
    keep = []
    for s in range(0, len(i), 1 << 16):
        x, y = a.codes[i[s:s + (1 << 16)]], b.codes[j[s:s + (1 << 16)]]
        if a.length == b.length:
            keep.append((x != y).sum(1) == 1)
        else:
            before = np.cumprod(x == y[:, :-1], 1).sum(1)
            after = np.cumprod((x == y[:, 1:])[:, ::-1], 1).sum(1)
            keep.append(before + after >= a.length)
    keep = np.concatenate(keep)
    return i[keep], j[keep]


def _pair_batches(batches):
    """Rows sorted by cell, a cell's own block first: its words against those
    of each block that visits (both directions of every pair)."""
    cell, own = None, None
    for b in batches:
        out = [[], [], []]
        for name, visits, words, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            block = _Words(words, n)
            if name != cell:
                assert not visits
                cell, own = name, block
            i, j = one_edit_pairs(own, block)
            if not visits:  # a block with itself: each pair once
                i, j = i[i < j], j[i < j]
            for one, two, x, y in ((own, block, i, j), (block, own, j, i)):
                for col, v in zip(out, (one.words[x], two.words[y], two.n[y]), strict=True):
                    col.extend(v.tolist())
            if len(out[0]) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _PAIR, strict=True)], ["word", "near", "near_n"])
                out = [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _PAIR, strict=True)], ["word", "near", "near_n"])


_PAIR = (pa.string(), pa.string(), pa.int64())


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)``: every pair of different ``words`` (``word,
    n``; each word once) one edit apart, in both directions."""
    spark = words.sparkSession
    keyed = written(words.mapInArrow(_keyed, "key string, word string, n bigint"), "spelling-keys")
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    blocks = written(keyed.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
                     .groupBy("key", "part").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("n")), "spelling-blocks")
    pairs = sizes.select("key").mapInArrow(_reached, "key string, other string")
    own = blocks.select("key", F.col("part").alias("own_part"))
    visits = (own.join(pairs, "key").join(blocks.withColumnRenamed("key", "other"), "other")
              .filter((F.col("key") != F.col("other")) | (F.col("own_part") < F.col("part"))))
    name = (lambda part: F.concat_ws("/", "key", F.col(part).cast("string")))
    cells = (blocks.select(name("part").alias("cell"), F.lit(False).alias("visits"), "words", "n")
             .unionByName(visits.select(name("own_part").alias("cell"), F.lit(True).alias("visits"), "words", "n")))
    # dealt to a fixed number of tasks: the blocks are few bytes but much work
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (cells.repartition(tasks, "cell").sortWithinPartitions("cell", "visits")
            .mapInArrow(_pair_batches, "word string, near string, near_n bigint"))


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of all ``words`` (``word,
    n``): ``n_near`` words are one edit apart; ``form`` is the most frequent of
    these (ties: first in code-point order) if it occurs at least ``ratio``
    times as often, else null, and ``form_n`` its count; ``root`` is where the
    forms lead.

    A form occurs ``ratio`` times as often as its word, so no chain is longer
    than the logarithm of the largest count; roots are found by doubling,
    each round written to the shared folder.  A word has as many near words at
    most as there are edits of it, so no key is hot."""
    words = written(words, "spelling-words")
    best = (near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("b")))
    is_form = -F.col("b.n") >= ratio * F.col("n")
    formed = written(words.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -F.col("b.n")).alias("form_n")), "spelling-forms")
    steps = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                        "spelling-roots")
        if not steps.filter("moved").limit(1).count():
            break
        steps = steps.drop("moved")
    return formed.join(steps.drop("moved"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
