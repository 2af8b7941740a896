"""Sinks (S6-S8 S12 S13, J1), diffs (J11 E25) and registry joins (J3-J8) incl.
brute-force checks of the set-based rewrites."""

import difflib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from dqspark.operators import audit as A
from dqspark.operators import registry as G
from dqspark.operators.joins import filter_new_rows
from dqspark.sources import sinks as S

from conftest import rows


def keyset(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in rows(df)), key=str)


def test_filter_new_rows_partition(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "x"), (3, "c")], "k int, v string")
    ex = spark.createDataFrame([(1,), (None,)], "k int")
    new = filter_new_rows(df, ex, ["k"])
    matched = df.join(ex, df["k"].eqNullSafe(ex["k"]), "left_semi")
    assert keyset(new, ["k"]) == [(2,), (3,)]                     # missing matches missing
    assert sorted(keyset(new, ["k", "v"]) + keyset(matched, ["k", "v"]), key=str) == \
        sorted(keyset(df, ["k", "v"]), key=str)


def test_insert_or_ignore_semantics(spark):
    t = spark.createDataFrame([(1, "old")], "k int, v string")
    inc = spark.createDataFrame([(1, "new", 1), (2, "first", 1), (2, "second", 2), (None, "n1", 1), (None, "n2", 2)],
                                "k int, v string, seq int")
    out = sorted(((r["k"], r["v"]) for r in rows(S.insert_or_ignore(t, inc, ["k", "v", "extra"], ["k"], order_by="seq"))),
                 key=str)
    assert out == sorted([(1, "old"), (2, "first"), (None, "n1"), (None, "n2")], key=str)


def test_upsert_change_detect_and_idempotent(spark):
    t = spark.createDataFrame([(1, "a", 10, "r1"), (2, "b", 20, "r1"), (3, "c", 30, "r1")], "k int, v string, x int, run string")
    inc = spark.createDataFrame([(1, "a", 10, "r2"), (2, "B", 21, "r2"), (4, "d", 40, "r2")], t.schema)
    out = S.upsert(t, inc, ["k"], ["k", "v", "x", "run"], change_detect_cols=["v", "x"], with_action=True)
    got = {r["k"]: (r["v"], r["x"], r["run"], r["_action"]) for r in rows(out)}
    assert got == {1: ("a", 10, "r1", "unchanged"), 2: ("B", 21, "r2", "update"), 3: ("c", 30, "r1", "keep"),
                   4: ("d", 40, "r2", "insert")}
    once = S.upsert(t, inc, ["k"], ["k", "v", "x", "run"])
    twice = S.upsert(once, inc, ["k"], ["k", "v", "x", "run"])
    assert keyset(once, ["k", "v", "x", "run"]) == keyset(twice, ["k", "v", "x", "run"])
    # key-only table: behaves as insert-or-ignore
    kt = spark.createDataFrame([(1,)], "k int")
    assert keyset(S.upsert(kt, spark.createDataFrame([(1,), (5,)], "k int"), ["k"], ["k"]), ["k"]) == [(1,), (5,)]


def _not_in_bruteforce(target, incoming, group, key):
    """SQL: DELETE FROM t WHERE group = g AND (rest) NOT IN (tuples of g), per group of incoming."""
    rest = [c for c in key if c not in group]
    groups = {}
    for r in incoming:
        g = tuple(r[c] for c in group)
        if any(v is None for v in g):
            continue
        groups.setdefault(g, []).append(tuple(r[c] for c in rest))
    if len(rest) == 1:
        groups = {g: [t for t in ts if t[0] is not None] for g, ts in groups.items()}
        groups = {g: ts for g, ts in groups.items() if ts}

    def neq(a, b):  # three-valued a <> b for row values
        res = False
        for x, y in zip(a, b):
            if x is None or y is None:
                res = None if res is False else res
            elif x != y:
                return True
        return res
    kept = []
    for r in target:
        g = tuple(r[c] for c in group)
        if g not in groups:
            kept.append(r)
            continue
        mine = tuple(r[c] for c in rest)
        vals = [neq(mine, t) for t in groups[g]]
        not_in = False if any(v is False for v in vals) else (None if any(v is None for v in vals) else True)
        if not_in is not True:
            kept.append(r)
    return kept


@pytest.mark.parametrize("key", [["g", "a"], ["g", "a", "b"]])
def test_prune_missing_matches_sql_not_in(spark, key):
    vals = [None, 1, 2]
    target = [dict(g=g, a=a, b=b, id=i) for i, (g, a, b) in enumerate(itertools.product(["x", "y", None], vals, vals))]
    incoming = [dict(g="x", a=1, b=None), dict(g="x", a=None, b=2), dict(g="y", a=2, b=2), dict(g=None, a=1, b=1),
                dict(g="z", a=1, b=1)]
    schema = "g string, a int, b int"
    t = spark.createDataFrame([(r["g"], r["a"], r["b"], r["id"]) for r in target], schema + ", id int")
    inc = spark.createDataFrame([(r["g"], r["a"], r["b"]) for r in incoming], schema)
    got = sorted(r["id"] for r in rows(S.prune_missing(t, inc, ["g"], key)))
    want = sorted(r["id"] for r in _not_in_bruteforce(target, incoming, ["g"], key))
    assert got == want
    assert keyset(S.prune_missing(t, inc, ["g"], ["g"]), ["id"]) == keyset(t, ["id"])   # no non-group key


def test_split_and_clean(spark):
    df = spark.createDataFrame([("ds", "r1", "b_col", "int", [1, 2], float("nan")), ("ds", "r1", "a_col", "str", None, 1.5)],
                               "dataset string, `Run Id` string, col_name string, `Data Type` string, arr array<int>, x double")
    info, cols = S.split_definitions(df)
    assert rows(info) == [{"dataset": "ds", "Run Id": "r1"}] and len(rows(cols)) == 2
    c = {r["col_name"]: r for r in rows(S.clean_for_write(df))}
    assert c["b_col"]["arr"] == "[1,2]" and c["b_col"]["x"] is None and c["a_col"]["x"] == 1.5


def test_snapshot_diff_and_line_diff(spark):
    b = spark.createDataFrame([(1, "a", [1]), (2, "b", None)], "k int, v string, t array<int>")
    a = spark.createDataFrame([(1, "a", [1, 2]), (3, "c", None)], b.schema)
    got = {(r["k"], r["change_item"]): (r["change_from"], r["change_to"]) for r in rows(A.snapshot_diff(b, a, ["k"], ["v", "t"]))}
    assert got == {(1, "t"): ("[1]", "[1,2]"), (2, "v"): ("b", None), (3, "v"): (None, "c")}
    d = spark.createDataFrame([(1, "x\ny\nz", "x\nz\nw"), (2, None, "new")], "k int, b string, a string")
    ld = sorted((r["k"], r["op"], r["line"]) for r in rows(A.line_diff(d, ["k"], "b", "a")))
    assert ld == [(1, "+", "w"), (1, "-", "y"), (2, "+", "new")]


# J5 ------------------------------------------------------------------------
def _bruteforce_similar(targets, registry, n, w_ratio=0.4):
    def toks(s):
        return {t for t in re.split(r"[^a-z0-9]+", (s or "").lower()) if len(t) > 1}
    out = {}
    for t in targets:
        nt = toks(t["dataset"]) | toks(t["table_nm"])
        scored = []
        for r in registry:
            rt = toks(r["dataset"]) | toks(r["table_nm"])
            j = len(nt & rt) / len(nt | rt) if (nt | rt) else 0.0
            s = 0.6 * j + w_ratio * difflib.SequenceMatcher(None, t["dataset"].lower(), r["dataset"].lower()).ratio()
            if t["connectionName"] and (r["connectionName"] or "").lower() == t["connectionName"].lower():
                s += 0.15
            if t["db_nm"] and (r["db_nm"] or "").lower() == t["db_nm"].lower():
                s += 0.10
            scored.append((-s, r["dataset"]))
        out[t["target_id"]] = [(d, round(-s, 3)) for s, d in sorted(scored)[:n]]
    return out


@pytest.mark.parametrize("max_rows", [1000, 7])      # broadcast path and chunked cogroup path
def test_similar_datasets_matches_bruteforce(spark, max_rows):
    words = ["sales", "orders", "kr", "cn", "daily", "hcp", "vod__c", "emp"]
    registry = [dict(dataset=f"ds_redshift_local_{a}_{b}", table_nm=f"{b}_{a}", connectionName=f"conn{i % 3}",
                     db_nm=a) for i, (a, b) in enumerate(itertools.permutations(words, 2)) if i % 2 == 0][:25]
    targets = [dict(target_id=i, dataset=f"ds_conn_s3_{a}_{b}", table_nm=b, connectionName=f"CONN{i % 4}",
                    db_nm=None if i % 5 == 0 else a) for i, (a, b) in enumerate(itertools.combinations(words, 2))]
    targets.append(dict(target_id=999, dataset=targets[3]["dataset"], table_nm=targets[3]["table_nm"],
                        connectionName=targets[3]["connectionName"], db_nm=targets[3]["db_nm"]))  # duplicate key
    rs = "dataset string, table_nm string, connectionName string, db_nm string"
    reg_df = spark.createDataFrame([(r["dataset"], r["table_nm"], r["connectionName"], r["db_nm"]) for r in registry], rs)
    tg_df = spark.createDataFrame([(t["target_id"], t["dataset"], t["table_nm"], t["connectionName"], t["db_nm"])
                                   for t in targets], "target_id long, " + rs)
    got_df = G.similar_datasets(spark, tg_df, reg_df, top_n=4, max_registry_rows=max_rows)
    got = {}
    for r in rows(got_df, ["target_id", "rank"]):
        got.setdefault(r["target_id"], []).append((r["match_dataset"], r["similarity"]))
    assert got == _bruteforce_similar(targets, registry, 4)


# J6 ------------------------------------------------------------------------
def test_resolve_connection_bruteforce(spark):
    conns = [(1, "c1", "s3://bucket-a/"), (2, "c2", "s3://bucket-a/raw"), (3, "c3", "S3://Bucket-A/raw/"),
             (4, "c4", "s3://bucket-b"), (5, "c5", "s3://bucket-a/raw2")]
    paths = ["s3://bucket-a/raw/x/file.csv", "s3://bucket-a/raw2/y.tar.gz", "s3://BUCKET-A/other/z", "s3://bucket-c/q/r",
             "gs://bucket-a/raw/f", "s3://bucket-b", "s3://bucket-bb/k/v.txt"]
    cdf = spark.createDataFrame(conns, "ordinal int, connName string, location string")
    pdf = spark.createDataFrame(list(enumerate(paths)), "path_id int, path string")
    got = {r["path_id"]: (r["connection_name"], r["schema"], r["table"], r["error"])
           for r in rows(G.resolve_connection(spark, pdf, cdf))}
    for i, p in enumerate(paths):
        norm = p.strip().rstrip("/").lower()
        cands = [c for c in conns if norm.startswith(c[2].rstrip("/").lower())]
        cands.sort(key=lambda c: len(c[2]), reverse=True)
        assert got[i][0] == (cands[0][1] if cands else None), p
    assert got[0][1:] == ("x", "file", None) and got[1][1:] == ("raw2", "y.tar", None)
    assert got[4][3] == "unsupported scheme" and got[5][3] == "path has no file name"
    strict = {r["path_id"]: r["connection_name"] for r in rows(G.resolve_connection(spark, pdf, cdf, strict=True))}
    assert strict[6] is None and got[6][0] == "c4"           # prefix is not segment-aware unless strict


def test_name_candidates_and_hierarchy(spark):
    req = spark.createDataFrame([("ds_a",), ("ds_b",)], "base_name string")
    ex = spark.createDataFrame([("DS_A",), ("ds_a_2",), ("ds_a_4",), ("ds_b_3",)], "dataset string")
    got = {}
    for r in rows(G.name_candidates(req, ex), ["base_name", "rank"]):
        got.setdefault(r["base_name"], []).append(r["candidate"])
    assert got == {"ds_a": ["ds_a_3", "ds_a_5", "ds_a_6"], "ds_b": ["ds_b", "ds_b_2", "ds_b_4"]}
    units = spark.createDataFrame([(1, "CN", None), (44, "CN - ANGen MAF", 1), (45, "CN - E.AI ", 1), (46, "KR - X", 2),
                                   (2, "KR", None), (47, "bad", 1)], "id long, name string, subId long")
    h = {r["market"]: r["projects"] for r in rows(G.bu_hierarchy(units))}
    assert h == {"CN": ["ANGen MAF", "E.AI"], "KR": ["X"]}


def test_search_limits_and_wildcards(spark):
    cat = spark.createDataFrame([("local", "s", "t1", "a_b", 1, "int"), ("local", "s", "t1", "axb", 2, "int"),
                                 ("region", "s", "t2", "ab", 1, "int")], G.CATALOG_SCHEMA)
    assert keyset(G.search_columns(cat, "A_B"), ["column_name"]) == [("a_b",), ("axb",)]
    assert len(rows(G.search_columns(cat, "a", limit=0))) == 2             # clamp to 1 per cluster
    with pytest.raises(ValueError):
        G.search_columns(cat, "  ")
    d = rows(G.detect_cluster(spark.createDataFrame([("s", "t1"), ("s", "zz")], "table_schema string, table_name string"),
                              cat), ["table_name"])
    assert [(r["table_name"], r["cluster"]) for r in d] == [("t1", "local"), ("zz", None)]


def test_run_ids_across_blocks(spark):
    import random
    from dqspark.operators.windows import run_ids
    rnd = random.Random(7)
    data = []
    for conv in range(4):
        for turn in range(rnd.randint(1, 40)):
            if rnd.random() < 0.2:
                continue                                   # gaps in the order column
            data.append((conv, turn, rnd.choice(["user", "assistant", None])))
    df = spark.createDataFrame(data, "conv int, turn int, role string")
    got = {(r["conv"], r["turn"]): r["run_id"] for r in rows(run_ids(df, "conv", "turn", "role", block=3))}
    want = {}
    for conv in range(4):
        prev, run = object(), 0
        for c, t, role in sorted(x for x in data if x[0] == conv):
            if role != prev:
                run += 1
            prev = role
            want[(c, t)] = run
    assert got == want


def test_reconcile_sources_matches_except_all(spark):
    """Signed-count reconciliation equals exceptAll both ways, including
    surpluses larger than the chunk (spread path) and null values."""
    from collections import Counter

    from dqspark.sources.tables import reconcile_sources
    src = [("a", 1)] * 10 + [("b", 2)] * 2 + [(None, 3)] * 1 + [("c", None)] * 4
    tgt = [("a", 1)] * 3 + [("b", 2)] * 9 + [("d", 4)] * 2 + [("c", None)] * 4
    s = spark.createDataFrame(src, "k string, v int")
    t = spark.createDataFrame(tgt, "k string, v int")
    got = Counter((r["k"], r["v"], r["side"]) for r in rows(reconcile_sources(s, t, chunk=3)))
    exp = Counter((r["k"], r["v"], "source_only") for r in rows(s.exceptAll(t))) + \
        Counter((r["k"], r["v"], "target_only") for r in rows(t.exceptAll(s)))
    assert got == exp
    assert got[("a", 1, "source_only")] == 7 and got[("b", 2, "target_only")] == 7


def test_ordinal_equals_global_row_number(spark):
    from pyspark.sql import Window

    from dqspark.operators.windows import ordinal
    df = spark.createDataFrame([(f"k{i:04d}",) for i in range(0, 3000, 7)], "v string").repartition(5)
    got = {r["v"]: r["ordinal"] for r in rows(ordinal(df, "v", partitions=6))}
    exp = {r["v"]: r["rn"] for r in rows(df.select("v", F.row_number().over(Window.orderBy("v")).alias("rn")))}
    assert got == exp


def test_reconcile_sources_property(spark):
    """Random multisets (with nulls) and chunk sizes: one signed-count pass
    equals exceptAll in both directions."""
    from collections import Counter

    from hypothesis import given, settings
    from hypothesis import strategies as st

    from dqspark.sources.tables import reconcile_sources
    val = st.tuples(st.one_of(st.none(), st.sampled_from(["a", "b"])), st.integers(0, 2))

    @settings(max_examples=10, deadline=None)
    @given(st.lists(val, max_size=30), st.lists(val, max_size=30), st.integers(1, 4))
    def check(src, tgt, chunk):
        s = spark.createDataFrame(src, "k string, v int")
        t = spark.createDataFrame(tgt, "k string, v int")
        got = Counter((r["k"], r["v"], r["side"]) for r in rows(reconcile_sources(s, t, chunk=chunk)))
        cs, ct = Counter(src), Counter(tgt)
        exp = Counter({(*k, "source_only"): n for k, n in (cs - ct).items()}) + \
            Counter({(*k, "target_only"): n for k, n in (ct - cs).items()})
        assert got == exp

    check()
