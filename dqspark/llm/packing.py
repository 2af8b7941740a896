"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Pieces of equal length are interchangeable, so a packing is planned on the
counts of each length (at most ``max_len`` numbers whatever the input's size)
and the pieces are then dealt to the planned places by joins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqspark.llm.common import tidy, written
from dqspark.llm.tokens import tokenizer

#: Groups that the pieces of one length are numbered in.
NUMBERING_GROUPS = 256


def plan_two_fit(counts: dict[int, int], max_len: int) -> list[tuple[list[int], int]]:
    """Bins for ``counts[length]`` pieces of each length, as ``(lengths in
    the bin, number of such bins)``.

    A bin starts with the longest piece left and is filled greedily with the
    longest that fits.  Then its smallest piece is exchanged for the two
    unpacked pieces that fill the gap it leaves most tightly, if they fill it
    better than it did; this is repeated until no exchange helps.  While
    there are enough pieces of every length of a bin, the next bins come out
    the same, so they are planned at once."""
    left = np.zeros(max_len + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while True:
        here = np.flatnonzero(left)
        if not len(here):
            return plan
        bin_, gap = [], max_len
        free = left.copy()
        while gap:
            fits = here[: np.searchsorted(here, gap, "right")]
            fits = fits[free[fits] > 0]
            if not len(fits):
                break
            length = int(fits[-1])
            n = int(min(free[length], gap // length))
            bin_ += [length] * n
            free[length] -= n
            gap -= n * length
        while gap and len(bin_) > 1:
            smallest = bin_[-1]
            free[smallest] += 1  # the exchanged piece is unpacked again
            pair = _two_tightest(free, gap + smallest)
            if pair is None or sum(pair) <= smallest:
                free[smallest] -= 1
                break
            bin_ = sorted(bin_[:-1] + list(pair), reverse=True)
            for length in pair:
                free[length] -= 1
            gap = max_len - sum(bin_)
        lengths, uses = np.unique(bin_, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= uses * times
        plan.append((bin_, times))


def _two_tightest(free: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum up to ``room`` (of equal
    sums the one with the longest piece), or None."""
    have = np.flatnonzero(free[: room + 1])
    if not len(have):
        return None
    other = np.searchsorted(have, room - have, "right") - 1  # largest partner that fits
    same = (other >= 0) & (have[np.maximum(other, 0)] == have) & (free[have] < 2)
    other = other - same  # a lone piece can't be its own partner
    ok = other >= 0
    if not ok.any():
        return None
    sums = np.where(ok, have + have[np.maximum(other, 0)], -1)
    i = len(sums) - 1 - int(np.argmax(sums[::-1]))
    return int(have[i]), int(have[other[i]])


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, max_len: int, end_id: int = 0, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(_id, piece, start, length, ids_crc32[, ids])`` of every document:
    its ids followed by ``end_id``, cut every ``max_len`` ids."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = (f"_id {rows.schema['_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
              + (", ids binary" if with_ids else ""))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        tok = tokenizer(tokenizer_path)
        step = 4 * max_len
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                data = tok.ids(text.as_py()) + end
                for n, at in enumerate(range(0, len(data), step)):
                    part = data[at:at + step]
                    row.append(i)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + ([pa.array(ids, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(cols, ["_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return rows.mapInArrow(tidy(cut, "tokens"), schema)


def pack_best_two_fit(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0,
                      id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``.

    Only the counts of each length (at most ``max_len`` rows) reach the
    driver.  Pieces of one length are numbered in ``NUMBERING_GROUPS`` hashed
    groups, so a length that holds a third of all pieces is still numbered by
    many tasks; a piece's number gives its bin and place by range.

    Null text is an empty document (one piece, the end id alone).  Null and
    repeated ids and repeated rows each keep their own pieces; an empty table
    gives no rows; other columns are not read."""
    spark = docs.sparkSession
    group = F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(NUMBERING_GROUPS)).cast("int")
    pieces = written(tokenised_pieces(docs, tokenizer_path, max_len, end_id, id_col, text_col, with_ids)
                     .withColumn("_g", group), "token-pieces")
    sizes = pieces.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}

    # for each length its runs of bins, which take len(offsets) pieces each
    runs, next_bin, dealt = {}, 0, dict.fromkeys(counts, 0)
    for bin_, times in plan_two_fit(counts, max_len):
        offset, at = {}, 0
        for length in bin_:
            offset.setdefault(length, []).append(at)
            at += length
        for length, offsets in offset.items():
            upto = dealt[length] + len(offsets) * times
            runs.setdefault(length, []).append((dealt[length], upto, next_bin, offsets))
            dealt[length] = upto
        next_bin += times
    runs = spark.createDataFrame(list(runs.items()), "_len bigint, _runs array<struct<_from: bigint, _to: bigint, _bin: bigint, "
                                 "_offsets: array<int>>>")

    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("length", "_g").orderBy("_id", "piece", "ids_crc32")
    numbered = (pieces.withColumn("_r", F.row_number().over(order) - 1).join(bases, ["length", "_g"])
                .withColumn("_n", F.col("_base") + F.col("_r")))
    run = F.filter("_runs", lambda x: (x["_from"] <= F.col("_n")) & (F.col("_n") < x["_to"]))[0]
    placed = numbered.join(runs, numbered["length"] == runs["_len"]).withColumn("_run", run)
    uses = F.size("_run._offsets")
    within = F.col("_n") - F.col("_run._from")
    return placed.select(
        F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("_run._bin") + F.floor(within / uses)).cast("long").alias("sequence_id"),
        F.get("_run._offsets", (within % uses).cast("int")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []))
