"""Merge on read: equal to batch upserts, O(k) writes, replay and restart."""

import random

import pytest

from dqspark.session import scratch_path
from dqspark.sources.merge_table import MergeTable, stream_merge_upsert
from tests.conftest import rows

SCHEMA = "k long, j string, v long, s string"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def as_set(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def expected(batches):
    keyed, free = {}, []
    for batch in batches:
        for r in batch:
            if r[0] is None or r[1] is None:
                free.append(r)
            else:
                keyed[r[0], r[1]] = r
    return sorted(map(str, [*keyed.values(), *free]))


def made(rng, n, tag):
    keys = rng.sample([(k, j) for k in range(40) for j in "ab"], n)
    return [(k, j, rng.randint(0, 9), rng.choice([tag, None])) for k, j in keys] + [(None, "a", 1, tag), (3, None, 2, tag)]


def test_equals_upserts_in_order_and_writes_only_its_rows(spark):
    rng = random.Random(1)
    schema = frame(spark, []).schema
    t = MergeTable(spark, scratch_path(spark, "mt"), schema, ["k", "j"], buckets=5)
    history = [made(rng, 60, "base")]
    t.create(frame(spark, history[0]))
    assert as_set(t.read()) == expected(history)
    for i in range(6):
        history.append(made(rng, rng.randint(1, 6), f"b{i}"))
        t.append(frame(spark, history[-1]), i)
        assert spark.read.parquet(f"{t.path}/delta/_batch={i}").count() == len(history[-1])
        assert as_set(t.read()) == expected(history)
        if i in (1, 4):
            before = {m.bucket: m.version for m in t.manifest()}
            n = t.compact()
            after = {m.bucket: m.version for m in t.manifest()}
            assert n == sum(after[b] != before.get(b) for b in after) and as_set(t.read()) == expected(history)
            assert t.compact() == 0


def test_replay_and_restart(spark):
    schema = frame(spark, []).schema
    path = scratch_path(spark, "mt")
    t = MergeTable(spark, path, schema, ["k", "j"], buckets=4).create(frame(spark, [(1, "a", 1, "x"), (2, "a", 1, "x")]))
    t.append(frame(spark, [(1, "a", 2, "half")]), 0)
    t.append(frame(spark, [(1, "a", 3, "whole"), (9, "b", 1, "new"), (None, "b", 1, "free")]), 0)    # the batch again
    want = expected([[(1, "a", 1, "x"), (2, "a", 1, "x")], [(1, "a", 3, "whole"), (9, "b", 1, "new"), (None, "b", 1, "free")]])
    assert as_set(t.read()) == want
    t.compact()
    t.append(frame(spark, [(1, "a", 3, "whole"), (9, "b", 1, "new"), (None, "b", 1, "free")]), 0)    # and after it was folded in
    assert as_set(MergeTable(spark, path, schema, ["k", "j"], buckets=4).read()) == want
    # a write that was not committed is not read
    frame(spark, [(2, "a", 7, "torn")]).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/delta/_batch=1/_bucket=0")
    assert as_set(t.read()) == want


def test_stream(spark):
    schema = frame(spark, []).schema
    base = scratch_path(spark, "mt")
    t = MergeTable(spark, f"{base}/t", schema, ["k"], buckets=3).create(frame(spark, [(k, "a", 0, None) for k in range(20)]))
    for n in range(5):
        frame(spark, [(n, "b", n, "s"), (n, "c", n + 1, "s"), (100 + n, "b", n, "s")]).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream_merge_upsert(spark.readStream.schema(schema).parquet(f"{base}/in"), t, f"{base}/ckpt", compact_every=2, order_by="v")
    got = {r["k"]: r["v"] for r in rows(t.read())}
    assert len(got) == 25 and all(got[n] == n + 1 and got[100 + n] == n for n in range(5)) and got[7] == 0


def test_empty_and_names(spark):
    schema = frame(spark, []).schema
    t = MergeTable(spark, scratch_path(spark, "mt"), schema, ["k"])
    assert t.create(frame(spark, [])).read().collect() == [] and t.compact() == 0
    t.append(frame(spark, []), 0)
    t.append(frame(spark, [(1, "a", 1, "x")]), 1)
    assert len(t.read().collect()) == 1 and t.compact() == 1 and len(t.read().collect()) == 1
    with pytest.raises(ValueError):
        MergeTable(spark, "x", spark.createDataFrame([], "k int, _batch int").schema, ["k"])
