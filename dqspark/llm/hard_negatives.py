"""Hard negatives by exact integer inner products, several to a multiplication.

Kronecker packing: the components of several candidates, made non-negative
by a bias, sit in separate fields of one wide integer.  One multiplication of
an anchor's (biased) component with the wide integer multiplies all fields
at once, and sums over the components stay within their fields if these are
wide enough for the largest sum; then the fields are cut apart and the
biases taken off again.  Where the fields of at least one candidate fit into
53 bits the wide integers are whole numbers held in doubles, whose matrix
product is exact; else they are Python integers of any width.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqspark.llm.common import written

#: Candidates of one packed block; anchors that one task holds (their scores with a block in slices).
BLOCK, ANCHORS, SLICE = 1024, 16_384, 1024
#: Parts that the candidate blocks are dealt to, for each group of anchors.
SLABS = 32
#: Candidates to a wide Python integer.
WIDE_FIELDS = 64
#: Scores beyond this count as this.
LARGEST = 1 << 62


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x rows, int64) of integer vectors."""
    n, dim = len(rows), rows.shape[1]
    if not dim or not n or not len(anchors):
        return np.zeros((len(anchors), n), np.int64)
    bias_a, bias_r = -min(int(anchors.min()), 0), -min(int(rows.min()), 0)
    top_a, top_r = int(anchors.max()) + bias_a, int(rows.max()) + bias_r
    width = max(1, (dim * max(top_a, bias_a) * max(top_r, bias_r)).bit_length())
    # sum (a + A)(r + R) = sum a r + R sum a + A sum r + dim A R
    if width <= 53:
        off = bias_r * anchors.sum(1)[:, None] + bias_a * rows.sum(1)[None, :] + dim * bias_a * bias_r
        fields = 53 // width
        wide = np.zeros((-(-n // fields), dim))
        for f in range(fields):
            part = rows[f::fields]
            wide[:len(part)] += (part + bias_r) * float(1 << (f * width))
        product = ((anchors + bias_a).astype(np.float64) @ wide.T).astype(np.int64)
        out = np.empty((len(anchors), n), np.int64)
        mask = (1 << width) - 1
        for f in range(fields):
            cut = out[:, f::fields]
            cut[:] = (product[:, :cut.shape[1]] >> (f * width)) & mask
        return out - off
    size = -(-width // 8)  # bytes of a field
    a = [[int(x) for x in row] for row in anchors]
    out = np.empty((len(anchors), n), np.int64)
    for at in range(0, n, WIDE_FIELDS):
        part = [[int(x) for x in row] for row in rows[at:at + WIDE_FIELDS]]
        wide = [int.from_bytes(b"".join((row[j] + bias_r).to_bytes(size, "little") for row in part), "little") for j in range(dim)]
        sums = [sum(row) for row in part]
        for i, row in enumerate(a):
            total = sum((x + bias_a) * w for x, w in zip(row, wide, strict=True)).to_bytes(size * len(part), "little")
            fixed = bias_r * sum(row) + dim * bias_a * bias_r
            for k in range(len(part)):
                score = int.from_bytes(total[k * size:(k + 1) * size], "little") - fixed - bias_a * sums[k]
                out[i, at + k] = max(-LARGEST, min(LARGEST, score))
    return out


def _narrow(values: np.ndarray) -> tuple[bytes, int]:
    """Integers in the fewest bytes that hold them all, and that number of bytes."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    size = next(s for s in (2, 4, 8) if -(1 << (8 * s - 1)) <= low and high < 1 << (8 * s - 1))
    return np.ascontiguousarray(values, f"<i{size}").tobytes(), size


def _matrix(vectors) -> np.ndarray:
    """An Arrow list column as a matrix, shorter vectors filled up with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(np.asarray(vectors.offsets))
    dim = int(sizes.max()) if len(sizes) else 0
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


_BLOCK_TYPE = "ids binary, places binary, labels binary, dim int, width int, vectors binary, first bigint"
_BLOCK_FIELDS = ["ids", "places", "labels", "dim", "width", "vectors"]


def _block_batch(ids, places, labels, vectors, step):
    """Blocks of at most ``step`` rows, in rows of binary columns."""
    out = {n: [] for n in [*_BLOCK_FIELDS, "first"]}
    for at in range(0, len(ids), step):
        s = slice(at, at + step)
        body, width = _narrow(vectors[s])
        row = (ids[s].tobytes(), places[s].tobytes(), labels[s].tobytes(), vectors.shape[1], width, body, int(places[at]))
        for name, value in zip(out, row, strict=True):
            out[name].append(value)
    types = {"dim": pa.int32(), "width": pa.int32(), "first": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.binary())) for n, v in out.items()], list(out))


def _block_maker(step: int, copies: int):
    """Rows (id, place, label, vector) to blocks.  With ``copies``, of rows
    with equal label and vector in a batch only the first so many by id stay:
    all others come after them in every list of fewer than ``copies`` rows."""

    def run(batches):
        for b in batches:
            ids, places, labels = (np.asarray(b.column(i)).astype("<i8") for i in range(3))
            vectors = _matrix(b.column(3))
            order = np.lexsort((places, ids))
            if copies and len(order):
                seen: dict[tuple, int] = {}
                keep = []
                for i in order.tolist():
                    key = (int(labels[i]), xxhash.xxh3_128_digest(vectors[i].tobytes()))
                    seen[key] = seen.get(key, 0) + 1
                    if seen[key] <= copies:
                        keep.append(i)
                order = np.array(keep)
            yield _block_batch(ids[order], places[order], labels[order], vectors[order], step)

    return run


def _read_block(row: dict):
    ids, places, labels = (np.frombuffer(row[n], "<i8") for n in ("ids", "places", "labels"))
    return ids, places, labels, np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(len(ids), row["dim"]).astype(np.int64)


def _best(parts: list[tuple], k: int) -> tuple:
    """Of entries (key, score, id, place) the first ``k`` of each key: higher
    scores first, ties by smaller id, then place."""
    key, score, ids, places = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((places, ids, -score, key))
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    rank = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    order = order[rank < k]
    return key[rank < k], score[order], ids[order], places[order]


class _Cell:
    """One group of anchors against one slab of candidates: the best ``k``
    entries of each anchor and window so far.  An entry counts in window w of
    an anchor if its score is between ``low`` and ``high`` and its label is
    (``same``) or is not the anchor's."""

    def __init__(self, blocks: list[dict], same: bool, k: int):
        parts = [_read_block(b) for b in blocks]
        self.ids, self.places, self.labels = (np.concatenate([p[i] for p in parts]) for i in range(3))
        dim = max(p[3].shape[1] for p in parts)
        self.vectors = np.concatenate([np.pad(p[3], ((0, 0), (0, dim - p[3].shape[1]))) for p in parts])
        self.windows = max(len(b["low"]) for b in blocks)
        shape = (len(self.ids), self.windows)
        self.low, self.high = np.full(shape, LARGEST), np.full(shape, -LARGEST)  # absent windows take nothing
        for i, b in enumerate(blocks):
            self.low[i, :len(b["low"])], self.high[i, :len(b["low"])] = b["low"], b["high"]
        self.same, self.k = same, k
        none = np.zeros(0, np.int64)
        self.found = [(none, none, none, none)] * -(-len(self.ids) // SLICE)

    def meet(self, block: dict) -> None:
        ids, places, labels, rows = _read_block(block)
        dim = min(rows.shape[1], self.vectors.shape[1])
        for s in range(len(self.found)):
            a = slice(s * SLICE, (s + 1) * SLICE)
            scores = packed_scores(self.vectors[a, :dim], rows[:, :dim])
            right = self.labels[a, None] == labels[None, :]
            right = right & (self.places[a, None] != places[None, :]) if self.same else ~right
            new = []
            for w in range(self.windows):
                anchor, row = np.nonzero(right & (scores >= self.low[a, w, None]) & (scores <= self.high[a, w, None]))
                new.append(((anchor + s * SLICE) * self.windows + w, scores[anchor, row], ids[row], places[row]))
            if not any(len(p[0]) for p in new):
                continue
            key, score, *rest = self.found[s] = _best([self.found[s], *new], self.k)
            # a window with k entries takes nothing below the last of them
            last = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
            full = last[np.diff(np.r_[-1, last]) == self.k]
            self.low[key[full] // self.windows, key[full] % self.windows] = score[full]

    def result(self) -> pa.RecordBatch:
        key, score, ids, places = (np.concatenate(c) for c in zip(*self.found, strict=True))
        a = key // self.windows
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (self.places[a], self.ids[a], (key % self.windows).astype(np.int32), score, ids, places)],
            ["anchor_place", "anchor", "window", "score", "id", "place"])


_FOUND = "anchor_place bigint, anchor bigint, window int, score bigint, id bigint, place bigint"


def _cells(same: bool, k: int):
    """The rows come sorted by cell, its anchors before its candidates."""

    def run(batches):
        number, blocks, cell = None, [], None
        for b in batches:
            for row in b.to_pylist():
                if row["cell"] != number:
                    if cell is not None:
                        yield cell.result()
                    number, blocks, cell = row["cell"], [], None
                if row["low"] is not None:
                    blocks.append(row)
                elif blocks or cell:
                    if cell is None:
                        cell, blocks = _Cell(blocks, same, k), []
                    cell.meet(row)
        if cell is not None:
            yield cell.result()

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of an anchor's window, over all slabs (at most
    ``SLABS * k`` rows each)."""
    order = Window.partitionBy("anchor_place", "window").orderBy(F.desc("score"), "id", "place")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", scale: int = 256, n_positives: int = 5, n_negatives: int = 10,
                   low: int = 3, high: int = 9) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``: for each row that ``anchors`` holds for and each of its
    ``n_positives`` best rows of its own label, the ``n_negatives`` best rows
    of other labels whose score is between ``low`` and ``high`` tenths of the
    positive's.  Components become ``floor(scale * x)``; scores are integer
    inner products; ties go to the smaller id (copies of an id: any order).

    Anchors and candidates are stored in blocks.  Each group of at most about
    ``ANCHORS`` anchors meets all candidate blocks, dealt to ``SLABS`` tasks;
    a task streams its blocks and keeps the best entries of its anchors, so
    what is shuffled per anchor is bounded and no list of scores is ever
    stored.  The first pass finds positives, the second their negatives.
    Labels are compared, never grouped by: a label that holds a third of
    all rows needs nothing special.

    Rows with a null id, label or vector or a null or non-finite component
    take no part.  Vectors of unequal length are compared as if filled up
    with zeros.  Repeated rows are rows of their own (an anchor's copy can be
    its positive).  Components beyond 64 bits, and scores beyond 2^62, count
    as the largest.  No row, no anchor or no positive gives no rows; other
    columns, whatever their names, are not read."""
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(math.inf), F.lit(False)) & ~F.isnan(x.cast("double")))
    rows = embeddings.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("place"), F.col(label_col).cast("bigint").alias("label"),
        F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vector"), anchors.alias("asked"))
    rows = written(rows, "vectors")
    block = written(rows.select("id", "place", "label", "vector")
                    .mapInArrow(_block_maker(BLOCK, max(n_positives, n_negatives) + 1), _BLOCK_TYPE), "vector-blocks")
    asked = rows.filter("asked").select("id", "place", "label", "vector").mapInArrow(_block_maker(1, 0), _BLOCK_TYPE)
    asked = asked.withColumnRenamed("first", "anchor_place")
    n_groups = max(1, -(-rows.filter("asked").count() // ANCHORS))
    slab = F.pmod(F.xxhash64("first"), F.lit(SLABS))
    group = F.pmod(F.xxhash64("anchor_place"), F.lit(n_groups))
    every = block.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("_g"))
    every = every.select(*_BLOCK_FIELDS, (F.col("_g") * SLABS + slab).cast("int").alias("cell"), F.lit(None).cast("array<bigint>").alias("low"), F.lit(None).cast("array<bigint>").alias("high"))

    def scored(anchor_rows, same, k):
        dealt = anchor_rows.select(*_BLOCK_FIELDS, F.explode(F.sequence(F.lit(0), F.lit(SLABS - 1))).alias("_s"), group.alias("_g"), "low", "high")
        dealt = dealt.select(*_BLOCK_FIELDS, (F.col("_g") * SLABS + F.col("_s")).cast("int").alias("cell"), "low", "high")
        both = dealt.unionByName(every).repartition(n_groups * SLABS, "cell").sortWithinPartitions("cell", F.col("low").isNull())
        return _first(both.mapInArrow(_cells(same, k), _FOUND), k)

    whole = (F.array(F.lit(-LARGEST)).alias("low"), F.array(F.lit(LARGEST)).alias("high"))
    positives = written(scored(asked.select("*", *whole), True, n_positives), "positives")
    tens, ones = F.expr("(score - pmod(score, 10)) div 10"), F.pmod(F.col("score"), F.lit(10))
    span = F.struct((F.col("rank") - 1).alias("window"), (tens * low + F.ceil(ones * low / 10)).alias("low"),
                    (tens * high + F.floor(ones * high / 10)).alias("high"))
    spans = positives.groupBy("anchor_place").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    asked = asked.join(spans, "anchor_place").select("*", F.col("spans.low").alias("low"), F.col("spans.high").alias("high"))
    negatives = scored(asked, False, n_negatives)
    kept = positives.select("anchor_place", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"),
                            F.col("score").alias("positive_score"))
    return negatives.join(kept, ["anchor_place", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
