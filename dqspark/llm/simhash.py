"""SimHash near-duplicates found through pivot distance tables."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqspark.llm.common import join_on_keys, tidy, with_keys, written
from dqspark.llm.components import connected_components

#: Reference fingerprints; 16 distances of up to 15 fit one long per group of bits.
PIVOTS = 16
#: Members above which a table cell is split again before pairs are formed.
CELL_LIMIT = 64


def simhash64(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles (repeats included): a bit is set if
    it is set in over half of the shingles' XXH64 values; no words: 0."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = len(words) - shingle + 1
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    body = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    h = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    first, last = starts[:n].tolist(), ends[shingle - 1:].tolist()
    for at in range(0, n, 1 << 16):  # a long text by slices
        hashes = np.fromiter([h(body[i:j], seed) for i, j in zip(first[at:at + (1 << 16)], last[at:at + (1 << 16)], strict=True)],
                             "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, _h, fp)`` of every row (``_h``: its text's hash); the
    fingerprint as a signed long."""
    rows = with_keys(docs, id_col, text_col)

    def prints(batches):
        for b in batches:
            fp = np.array([simhash64(t.as_py(), shingle) for t in b.column(2)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["_id", "_h", "fp"])

    return rows.mapInArrow(tidy(prints), f"_id {rows.schema['_id'].dataType.simpleString()}, _h bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bit_groups(n: int) -> list[int]:
    """Masks that deal the 64 bits to ``n`` groups."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def _pivots() -> list[int]:
    rng = random.Random(64)
    return [rng.getrandbits(64) for _ in range(PIVOTS)]


def _distance_tables(groups: int) -> list[tuple[int, int, np.ndarray]]:
    """For each group of bits its shift, mask and table: the packed distances
    (four bits each) from every value of the group to all pivots."""
    out = []
    for mask in _bit_groups(groups):
        shift = (mask & -mask).bit_length() - 1
        values = np.arange((mask >> shift) + 1, dtype=np.uint64)
        row = np.zeros(len(values), np.uint64)
        for i, p in enumerate(_pivots()):
            apart = np.bitwise_count(values ^ np.uint64((p & mask) >> shift)).astype(np.uint64)
            row |= apart << np.uint64(4 * i)
        out.append((shift, mask >> shift, row))
    return out


def pivot_table(prints: DataFrame, groups: int) -> DataFrame:
    """``(fp, _d0, _d1, ...)``: each fingerprint's distances to all pivots
    within each of ``groups`` groups of bits, packed to one long a group."""
    names = [f"_d{i}" for i in range(groups)]

    def look_up(batches):
        tables = _distance_tables(groups)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
            rows = [row[(fp >> np.uint64(shift)) & np.uint64(mask)].view("<i8") for shift, mask, row in tables]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(r, pa.int64()) for r in rows)], ["fp", *names])

    return prints.select("fp").mapInArrow(tidy(look_up), "fp bigint, " + ", ".join(f"{c} bigint" for c in names))


def _cells(prints: DataFrame, groups: int, max_distance: int) -> DataFrame:
    """``(cell, fp)``: a fingerprint once for each choice of ``max_distance``
    groups left out; its cell is its row of pivot distances in the other
    groups.  Fingerprints within ``max_distance`` bits differ in that many
    groups at most, so their table rows agree on the others and they share a
    cell: no pair is missed."""
    rows = [f"_d{i}" for i in range(groups)]
    choices = [F.xxhash64(F.lit(n), *[r for r in rows if r not in out]) for n, out in enumerate(combinations(rows, max_distance))]
    return pivot_table(prints, groups).select(F.explode(F.array(*choices)).alias("cell"), "fp")


def near_pairs(prints: DataFrame, max_distance: int = 2, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """``(a, b)`` pairs of distinct fingerprints that link all fingerprints
    within ``max_distance`` bits of each other (``prints``: one column ``fp``
    without repeats).

    The pivot table keeps every fingerprint's distances to ``PIVOTS``
    reference fingerprints, by group of bits.  Candidates share a cell of the
    table (see :func:`_cells`); those whose distances to some pivot differ by
    more than ``max_distance`` are discarded, for by the triangle inequality
    they can't be near; the rest are verified on the fingerprints.

    A cell with over ``cell_limit`` members is dealt out again by the table
    of 16 narrower groups: what shares such a cell differs in 4 * max_distance
    bits at most (256 members for 2 bits), so no group, however many near
    copies it has, forms all its pairs."""
    coarse, fine = max_distance + 4, 16
    cells = _cells(prints, coarse, max_distance)
    sizes = Window.partitionBy("cell")
    cells = written(cells.withColumn("_n", F.count("*").over(sizes)).filter("_n > 1"), "pivot-cells")
    small = cells.filter(F.col("_n") <= cell_limit).select("cell", "fp")
    crowded = cells.filter(F.col("_n") > cell_limit).select("fp").distinct()
    finer = _cells(crowded, fine, max_distance)
    members = small.unionByName(finer)
    a, b = members.withColumnRenamed("fp", "a"), members.withColumnRenamed("fp", "b")
    apart = F.greatest(*[F.abs(F.bit_count(F.col("a").bitwiseXOR(F.lit(_signed(p))))
                               - F.bit_count(F.col("b").bitwiseXOR(F.lit(_signed(p))))) for p in _pivots()])
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    return (a.join(b, "cell").filter(F.col("a") < F.col("b")).filter(apart <= max_distance).filter(near)
            .select("a", "b").distinct())


def simhash_components(docs: DataFrame, shingle: int = 3, max_distance: int = 2, id_col: str = "doc_id",
                       text_col: str = "text", cell_limit: int = CELL_LIMIT) -> DataFrame:
    """``(id_col, fp, component_id, root, _h)`` of every row (``root``: the
    component's smallest fingerprint; ``_h``: the text's hash).

    Copies share a fingerprint and are one node whatever their number: nodes
    are pre-aggregated before any shuffle by fingerprint, and only nodes of
    different fingerprints are paired.  ``component_id`` is the smallest id
    reachable over links of at most ``max_distance`` differing bits, the
    row's own included.

    Null text counts as empty; texts without words have fingerprint zero and
    are linked like any other.  Rows with a null id belong to components but
    never name them (a component of null ids only has a null component_id);
    repeated rows each keep a row; an empty table gives an empty result;
    other columns are not read."""
    prints = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("_id").alias("_min"))
    pairs = near_pairs(nodes.select("fp"), max_distance, cell_limit)
    roots = connected_components(pairs)
    labels = written(nodes.join(roots, nodes["fp"] == roots["node"], "left")
                     .select("fp", F.coalesce("root", "fp").alias("root"), "_min"), "fingerprint-roots")
    named = labels.groupBy("root").agg(F.min("_min").alias("component_id"))
    by_fp = labels.join(named, "root").select(F.col("fp").alias("_fp"), "component_id", "root")
    return (prints.join(by_fp, prints["fp"] == by_fp["_fp"])
            .select(F.col("_id").alias(id_col), "fp", "component_id", "root", "_h"))


def keep_one_each(docs: DataFrame, shingle: int = 3, max_distance: int = 2, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row
    with the smallest id stays (null ids last, then by text hash; of fully
    repeated rows one), with all its columns, whatever these are called."""
    found = simhash_components(docs, shingle, max_distance, id_col, text_col)
    rows = found.groupBy("root", F.col(id_col).alias("_id"), "_h").agg(F.count("*").alias("_n"))
    first = F.min(F.struct(F.isnull("_id").alias("none"), "_id", "_h", "_n"))
    stay = written(rows.groupBy("root").agg(first.alias("m")).select("m._id", "m._h", "m._n"), "simhash-kept")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"))
    kept = join_on_keys(keyed, stay, "inner")
    once = kept.filter("_n = 1").select("_row")
    return once.unionByName(kept.filter("_n > 1").dropDuplicates(["_id", "_h"]).select("_row")).select("_row.*")
