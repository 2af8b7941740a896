"""Repeated passages found by enhanced suffix arrays, and their removal.

Matching is on UTF-8 bytes and never crosses documents.  Work is dealt out
by *anchors*: of every window of ``min_len`` bytes the smallest-hashed gram
(leftmost on ties) is its anchor.  Equal windows have equal anchors at equal
places, so every repeat of ``min_len`` bytes is seen within the group of one
anchor gram.  In a group the sampled suffixes that start at the anchor are
sorted; a stack scan over their common-prefix lengths gives the interval
tree; within each interval the texts before the anchor, sorted and scanned
in the same way, show where occurrences have different left extensions.  An
interval that can be extended neither way by all its members is a maximal
repeat, with all its occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dqspark.llm.common import REMEMBERED, join_on_keys, tidy, utf8, with_keys, written

#: Bytes of the gram that anchors a window.
GRAM = 64
#: Bytes handled at once; longer texts in overlapping segments.
SEGMENT = 1 << 20
#: Distinct contexts of one anchor up to which its interval tree is scanned.
TREE_LIMIT = 256
#: Distinct contexts of one anchor that one task takes; the windows of more are counted by Spark.
TASK_LIMIT = 50_000

_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    up[0] = 1
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: tuple[np.ndarray, np.ndarray] | None = None


def _forget_powers() -> None:
    global _POWERS
    _POWERS = None


REMEMBERED["repeats"] = _forget_powers


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of every ``gram`` bytes."""
    global _POWERS
    if _POWERS is None or len(_POWERS[0]) < len(data) + 1:
        _POWERS = _powers(len(data) + 1)
    up, down = _POWERS
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    n = len(data) - gram + 1
    h = (total[gram:] - total[:n]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_anchors(data: bytes, starts: np.ndarray, sizes: np.ndarray, min_len: int, gram: int):
    """Anchor runs of the texts laid end to end in ``data``: arrays (text
    number, anchor hash, anchor place, first and last window start), places
    within the text."""
    buf = np.frombuffer(data, np.uint8)
    empty = np.zeros(0, np.int64)
    if len(buf) < min_len:
        return empty, empty, empty, empty, empty
    h = gram_hashes(buf, gram)
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span, width = 1, min_len - gram + 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    n = len(buf) - min_len + 1
    place = (np.minimum(key[:n], key[width - span:width - span + n]) & low).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    inside = np.arange(n) + min_len <= (starts + sizes)[text]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty, empty, empty, empty, empty
    place, text = place[at], text[at]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    t, x = text[first], place[first]
    return t, h[x].view(np.int64), x - starts[t], at[first] - starts[t], at[last] - starts[t]


def _anchor_batches(min_len: int, gram: int):
    names = ["_id", "_h", "anchor", "context", "x", "lo", "hi"]

    def run(batches):
        for b in batches:
            texts = b.column(2)
            pending, sizes, rows, offsets = [], [], [], []

            def flush():
                if not pending:
                    return None
                data = b"".join(pending)
                size = np.array(sizes, np.int64)
                start = np.cumsum(size) - size
                t, anchor, x, lo, hi = window_anchors(data, start, size, min_len, gram)
                view = memoryview(data)
                base = start[t]
                digest = [xxhash.xxh3_64_intdigest(view[i:j]) for i, j in
                          zip((base + lo).tolist(), (base + hi + min_len).tolist(), strict=True)]
                row, off = np.array(rows, np.int64)[t], np.array(offsets, np.int64)[t]
                take = pa.array(row)
                return pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(anchor),
                     pa.array(np.array(digest, np.uint64).view(np.int64)),
                     pa.array(x + off), pa.array(lo + off), pa.array(hi + off)], names)

            held = 0
            for i, text in enumerate(texts):
                text = text.as_py()
                for off in range(0, max(1, len(text) - min_len + 1), SEGMENT):
                    part = text[off:off + SEGMENT + min_len - 1]
                    if len(part) < min_len:
                        continue
                    pending.append(part)
                    sizes.append(len(part))
                    rows.append(i)
                    offsets.append(off)
                    held += len(part)
                    if held >= SEGMENT:
                        yield flush()
                        pending, sizes, rows, offsets, held = [], [], [], [], 0
            if pending:
                yield flush()

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 1:
        mid = (lo + n) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            n = mid
    return lo


def lcp_intervals(lcp: list[int], least: int):
    """The interval tree of a sorted list by a stack scan: ``(depth, first,
    last)`` for each maximal interval whose members share ``depth >= least``;
    ``lcp[i]`` is what members i - 1 and i share."""
    stack: list[list[int]] = []  # open intervals: depth, first member
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i - 1
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append([depth, first])


def maximal_repeats(contexts: list[tuple[bytes, int]], min_len: int):
    """Maximal repeats around the anchors of ``contexts`` (bytes, place of the
    anchor): ``(left, right, members)`` for every string that reaches ``left``
    bytes before and ``right`` bytes from the anchor, is shared by exactly
    these members, has ``min_len`` bytes at least, and can be extended neither
    to the left nor to the right for all of them."""
    right = [c[at:] for c, at in contexts]
    left = [c[:at][::-1] for c, at in contexts]
    order = sorted(range(len(contexts)), key=right.__getitem__)
    lcp = [0] + [_common(right[i], right[j]) for i, j in zip(order, order[1:], strict=False)]
    by_left = sorted(range(len(contexts)), key=left.__getitem__)
    shared = np.array([0] + [_common(left[i], left[j]) for i, j in zip(by_left, by_left[1:], strict=False)])
    rank = np.empty(len(contexts), np.int64)
    rank[by_left] = np.arange(len(contexts))
    place = np.empty(len(contexts), np.int64)
    place[order] = np.arange(len(contexts))
    depth_of = np.array(lcp)
    longest = max(map(len, left))
    for depth, first, last in lcp_intervals(lcp, max(1, min_len - longest)):
        members = np.array(order[first:last + 1])
        members = members[np.argsort(rank[members], kind="stable")]
        ranks = rank[members]
        ext = [0, *(int(shared[a + 1:b + 1].min()) for a, b in zip(ranks[:-1], ranks[1:], strict=True))]
        for reach, i, j in lcp_intervals(ext, max(0, min_len - depth)):
            group = members[i:j + 1]
            spots = place[group]
            # left-extension diversity holds by the interval; the same on the
            # right: if all went on alike, a deeper interval reports them
            if int(depth_of[spots.min() + 1:spots.max() + 1].min()) == depth:
                yield reach, depth, group.tolist()


def repeated_windows(contexts: list[tuple[bytes, int]], min_len: int):
    """For many contexts of one anchor: ``(member, first, last)`` runs of
    window starts, counted from the anchor, whose window another member has at
    the same place.  Linear in the members: one hashed column a start."""
    spans: dict[int, list[int]] = {}
    starts = range(-max(at for _, at in contexts), min(0, max(len(c) - at for c, at in contexts) - min_len) + 1)
    for s in starts:
        seen: dict[bytes, int] = {}
        for m, (c, at) in enumerate(contexts):
            if at + s < 0 or at + s + min_len > len(c):
                continue
            d = hashlib.blake2b(memoryview(c)[at + s:at + s + min_len], digest_size=16).digest()
            first = seen.setdefault(d, m)
            if first != m:
                spans.setdefault(m, []).append(s)
                if not spans.get(first) or spans[first][-1] != s:
                    spans.setdefault(first, []).append(s)
    for m, at in spans.items():
        at.sort()
        run = at[0]
        for a, b in zip(at, at[1:] + [None], strict=True):
            if b != a + 1:
                yield m, run, a
                run = b


def _context_batches(min_len: int):
    """Cuts the contexts that a document's anchors need out of its text."""
    names = ["anchor", "_id", "_h", "x", "lo", "single", "bytes"]

    def run(batches):
        for b in batches:
            row, out = [], {n: [] for n in names if n not in ("_id", "_h")}
            held = 0

            def batch():
                take = pa.array(row, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [pa.array(out["anchor"], pa.int64()), b.column(0).take(take), b.column(1).take(take),
                     pa.array(out["x"], pa.int64()), pa.array(out["lo"], pa.int64()),
                     pa.array(out["single"], pa.bool_()), pa.array(out["bytes"], pa.binary())], names)

            for i, (text, needs) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                text = text.as_py()
                for n in needs.as_py():
                    row.append(i)
                    body = text[n["lo"]:n["hi"] + min_len]
                    for name, v in (("anchor", n["anchor"]), ("x", n["x"]), ("lo", n["lo"]), ("single", n["single"]), ("bytes", body)):
                        out[name].append(v)
                    held += len(body)
                    if held > 1 << 24:
                        yield batch()
                        row, out, held = [], {n: [] for n in out}, 0
            yield batch()

    return run


def _window_batches(min_len: int):
    """The windows of contexts, one row each: a 128-bit hash of the window's
    bytes and its start, also counted from the anchor."""
    names = ["anchor", "at", "window", "_id", "_h", "first", "single"]

    def run(batches):
        for b in batches:
            row, out = [], {n: [] for n in names if n not in ("_id", "_h")}

            def batch():
                take = pa.array(row, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [pa.array(out["anchor"], pa.int64()), pa.array(out["at"], pa.int64()), pa.array(out["window"], pa.binary()),
                     b.column(0).take(take), b.column(1).take(take), pa.array(out["first"], pa.int64()),
                     pa.array(out["single"], pa.bool_())], names)

            for i, (text, needs) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                view = memoryview(text.as_py())
                for n in needs.as_py():
                    for s in range(n["lo"], n["hi"] + 1):
                        row.append(i)
                        digest = hashlib.blake2b(view[s:s + min_len], digest_size=16).digest()
                        for name, v in (("anchor", n["anchor"]), ("at", s - n["x"]), ("window", digest), ("first", s), ("single", n["single"])):
                            out[name].append(v)
                    if len(row) > 50_000:
                        yield batch()
                        row, out = [], {n: [] for n in out}
            yield batch()

    return run


def _counted_windows(asked: DataFrame, min_len: int, id_type: str) -> DataFrame:
    """Repeated windows of contexts of very common anchors: counted with
    map-side combine, and the hashes counted twice or more joined back, both
    sides stored so that Spark can split the join at a hot window.  No task
    gathers an anchor's bytes."""
    each = written(asked.mapInArrow(tidy(_window_batches(min_len), "repeats"), f"anchor bigint, at bigint, window binary, _id {id_type}, _h bigint, "
                                    "first bigint, single boolean"), "repeat-windows")
    keys = ["anchor", "at", "window"]
    again = written(each.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys), "repeat-again")
    return (each.filter("single").join(again, keys, "left_semi")
            .select("_id", "_h", "first", (F.col("first") + min_len).alias("last"), F.xxhash64("window").alias("repeat")))


def _span_batches(min_len: int, tree_limit: int):
    """Repeats of each anchor's group; the rows come sorted by group."""
    names = ["_id", "_h", "first", "last", "repeat"]

    def of_group(rows):
        by_bytes: dict[tuple, list] = {}
        for r in rows:  # a row: id, h, x, lo, single, bytes
            by_bytes.setdefault((r[5], r[2] - r[3]), []).append(r)
        contexts = list(by_bytes)
        for same in by_bytes.values():
            places = {(r[0], r[1], r[3]) for r in same}
            if len(places) > 1:
                for r in same:
                    yield r[0], r[1], r[3], r[3] + len(r[5]), _name(r[5])
        if len(contexts) < 2:
            return
        if len(contexts) <= tree_limit:
            found = ((m, -left, right) for left, right, members in maximal_repeats(contexts, min_len) for m in members)
        else:
            found = ((m, first, last + min_len) for m, first, last in repeated_windows(contexts, min_len))
        for m, first, end in found:
            body, at = contexts[m]
            for r in by_bytes[contexts[m]]:
                if r[4]:
                    yield r[0], r[1], r[2] + first, r[2] + end, _name(body[at + first:at + end])

    def batch(out, types):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def run(batches):
        key, rows, out = None, [], []
        types = None
        for b in batches:
            types = [b.schema.field("_id").type, *[pa.int64()] * 4]
            for anchor, *r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if anchor != key:
                    if len(rows) > 1:
                        out.extend(of_group(rows))
                    key, rows = anchor, []
                rows.append(r)
            if len(out) > 10_000:
                yield batch(out, types)
                out = []
        if len(rows) > 1:
            out.extend(of_group(rows))
        if out:
            yield batch(out, types)

    return run


def _name(body: bytes) -> int:
    """Names a repeat by its bytes."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(body)).view(np.int64))


def find_repeats(rows: DataFrame, min_len: int = 400, gram: int = GRAM, tree_limit: int = TREE_LIMIT,
                 task_limit: int = TASK_LIMIT) -> DataFrame:
    """``(_id, _h, first, last, repeat)``: occurrences ``[first, last)`` of
    repeats of at least ``min_len`` bytes in ``rows`` (``_id, _h, _text``);
    together they cover every byte of every repeated window.

    1. Anchors of all windows; one small row for each run of windows.
    2. Grams that occur once are dropped by a count with map-side combine.
    3. Contexts that are equal byte for byte are counted, not compared: all
       their occurrences are repeats whole, however many there are.
    4. The others, and one member of each set of equal ones, are cut out of
       their texts and compared by the interval tree, group by group.  Groups
       beyond ``tree_limit`` distinct contexts are compared by one hash a
       window, in linear time; beyond ``task_limit`` no task takes the group:
       its windows' hashes are counted by Spark and joined back."""
    id_type = rows.schema["_id"].dataType.simpleString()
    body = rows.select("_id", "_h", utf8(F.col("_text")).alias("_b")).filter(F.octet_length("_b") >= min_len)
    runs = written(body.mapInArrow(tidy(_anchor_batches(min_len, gram), "repeats"), f"_id {id_type}, _h bigint, anchor bigint, context bigint, "
                                   "x bigint, lo bigint, hi bigint"), "repeat-anchors")
    # stored, so that the joins read both sides by shuffles that Spark can split at a hot key
    again = written(runs.groupBy("anchor").agg(F.count("*").alias("_n")).filter("_n > 1").select("anchor"), "repeat-grams")
    runs = written(runs.join(again, "anchor", "left_semi"), "repeat-runs")
    place = F.struct("_h", "x", "_id", "lo", "hi")
    contexts = written(runs.groupBy("anchor", "context").agg(F.count("*").alias("_n"), F.min(place).alias("_at")), "repeat-contexts")
    equal = contexts.filter("_n > 1").select("anchor", "context")
    whole = (runs.join(equal, ["anchor", "context"], "left_semi")
             .select("_id", "_h", F.col("lo").alias("first"), (F.col("hi") + min_len).alias("last"), F.col("context").alias("repeat")))
    mixed = (contexts.groupBy("anchor").agg(F.count("*").alias("members"), F.min("_n").alias("_least"))
             .filter("members > 1 and _least = 1").select("anchor", "members"))
    needs = written(contexts.join(mixed, "anchor").select("_at._id", "_at._h", "members", F.struct(
        "anchor", F.col("_at.x").alias("x"), F.col("_at.lo").alias("lo"), F.col("_at.hi").alias("hi"),
        (F.col("_n") == 1).alias("single")).alias("n")), "repeat-needs")

    def asked(some):
        return join_on_keys(body, needs.filter(some).groupBy("_id", "_h").agg(F.collect_list("n").alias("needs")), "inner")

    cut = asked(F.col("members") <= task_limit).mapInArrow(
        tidy(_context_batches(min_len), "repeats"), f"anchor bigint, _id {id_type}, _h bigint, x bigint, lo bigint, single boolean, bytes binary")
    spans = (cut.repartition("anchor").sortWithinPartitions("anchor")
             .mapInArrow(tidy(_span_batches(min_len, tree_limit), "repeats"), f"_id {id_type}, _h bigint, first bigint, last bigint, repeat bigint"))
    many = needs.filter(F.col("members") > task_limit)
    if not many.isEmpty():
        spans = spans.unionByName(_counted_windows(asked(F.col("members") > task_limit), min_len, id_type))
    return whole.unionByName(spans)


def _cut_batches(keep_text: bool):
    def run(batches):
        for b in batches:
            out = []
            for i, (text, spans) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                body = text.as_py() or b""
                kept, runs, at, removed = [], 0, 0, 0
                end = -1
                for s in sorted((s["first"], s["last"]) for s in (spans.as_py() or [])):
                    if s[0] > end:
                        if end >= 0:
                            removed += end - at
                        kept.append(body[max(end, 0):s[0]])
                        at, end = s
                        runs += 1
                    else:
                        end = max(end, s[1])
                if end >= 0:
                    removed += end - at
                kept.append(body[max(end, 0):])
                rest = b"".join(kept)
                row = [i, len(body), removed, runs, hashlib.sha256(rest).hexdigest()]
                out.append(row + [rest.decode("utf-8", "ignore")] * keep_text)
            cols = list(zip(*out, strict=True)) or [()] * (5 + keep_text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:4]),
                 *(pa.array(c, pa.string()) for c in cols[4:])],
                ["_row", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["_kept"] * keep_text)
    return run


def remove_repeats(docs: DataFrame, min_len: int = 400, id_col: str = "doc_id", text_col: str = "text",
                   keep_text: bool = False, gram: int = GRAM, tree_limit: int = TREE_LIMIT,
                   task_limit: int = TASK_LIMIT) -> DataFrame:
    """One row for each row of ``docs``: ``_row`` (a struct of its other
    columns), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and,
    with ``keep_text``, ``_kept``: the text without every byte of a repeated
    window (judged on the input; a character that loses a byte goes whole).

    Null text is empty; a repeated row counts as another document, so both
    lose what they share; texts shorter than ``min_len`` bytes keep all; an
    empty table gives no rows."""
    rows = with_keys(docs, id_col, text_col)
    spans = (find_repeats(rows, min_len, gram, tree_limit, task_limit)
             .groupBy("_id", "_h").agg(F.collect_set(F.struct("first", "last")).alias("_spans")))
    others = [c for c in docs.columns if c != text_col]
    full = docs.select(F.struct(*others).alias("_row"), F.col(id_col).alias("_id"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), utf8(F.col(text_col)).alias("_b"))
    joined = join_on_keys(full, spans, "left").select("_row", "_b", "_spans")
    schema = StructType([joined.schema["_row"]])
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    for name in ["kept_sha256"] + ["_kept"] * keep_text:
        schema = schema.add(name, "string")
    return joined.mapInArrow(tidy(_cut_batches(keep_text), "repeats"), schema)
