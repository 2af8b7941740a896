"""Profiling (A1-A3 A7-A9 A17 A18) and drift (E6 E7 W5 Q10 J10 J12) operators."""

import math

import pytest
from pyspark.sql import functions as F

from dqspark.operators import drift as D
from dqspark.operators import profile as P

from conftest import rows


@pytest.fixture(scope="module")
def edge(spark):
    data = [(1, 1.0, "a", None), (2, float("nan"), "", None), (2, -0.0, " ", None), (None, 0.0, None, None),
            (3, None, "a", None)]
    return spark.createDataFrame(data, "k int, x double, s string, allnull double")


def test_profile_columns_edge_cases(spark, edge):
    out = {r["column_name"]: r for r in rows(P.profile_columns(edge, ["k", "x", "allnull"]))}
    assert out["k"]["row_count"] == 5 and out["k"]["null_count"] == 1 and out["k"]["distinct_count"] == 3
    # reference formula: null / (distinct + null), not null / rows
    assert out["k"]["null_fraction_ref"] == pytest.approx(1 / 4)
    assert out["k"]["null_ratio"] == pytest.approx(1 / 5)
    # NaN is a value (not missing); -0.0 and 0.0 are one value
    assert out["x"]["null_count"] == 1 and out["x"]["distinct_count"] == 3
    assert out["allnull"]["distinct_count"] == 0 and out["allnull"]["null_fraction_ref"] == 1.0
    assert out["allnull"]["min_value"] is None


def test_profile_columns_empty_table(spark):
    empty = spark.createDataFrame([], "a int")
    assert rows(P.profile_columns(empty, ["a"])) == []
    assert rows(P.profile_table(empty, "t"))[0]["row_count"] == 0


def test_profile_columns_approx_close(spark):
    df = spark.range(0, 20000).select((F.col("id") % 997).alias("v"))
    exact = rows(P.profile_columns(df, ["v"]))[0]["distinct_count"]
    approx = rows(P.profile_columns(df, ["v"], exact=False))[0]["distinct_count"]
    assert exact == 997 and abs(approx - exact) / exact < 0.05


def test_profile_table(spark, edge):
    r = rows(P.profile_table(edge, "edge"))[0]
    assert r["row_count"] == 5 and r["column_count"] == 4 and r["data_types"]["x"] == "double"


def test_key_uniqueness_null_keys_group_together(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, None), (2, "b")], "a int, b string")
    s = rows(P.key_uniqueness(df, ["a", " b ", ""]))[0]
    assert (s["total_rows"], s["distinct_keys"], s["duplicate_keys"], s["duplicate_rows"], s["is_unique"]) == \
        (5, 3, 2, 4, False)
    with pytest.raises(ValueError):
        P.key_uniqueness(df, ["", " "])
    ex = rows(P.duplicate_examples(df, ["a", "b"], examples=1))
    assert ex == [{"a": None, "b": None, "n": 2}]     # ties by key, nulls first


def test_duplicate_check_digest_matches_plain(spark):
    df = spark.createDataFrame([(1, "x" * 100), (2, "x" * 100), (3, "y"), (4, None), (5, None)], "id int, t string")
    plain = rows(P.duplicate_check(df, ["t"], "id"), ["first_id"])
    dig = rows(P.duplicate_check(df, ["t"], "id", digest=True), ["first_id"])
    assert [(r["n_copies"], r["first_id"], r["last_id"]) for r in plain] == \
           [(r["n_copies"], r["first_id"], r["last_id"]) for r in dig] == [(2, 1, 2), (2, 4, 5)]
    with pytest.raises(ValueError):
        P.duplicate_check(df, [f"c{i}" for i in range(11)], "id")


def test_topn_bottomn_ties_and_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,), (None,)], "v string")
    out = rows(P.topn_bottomn(df, ["v"], n=2), ["profile_type", "rank"])
    top = [(r["value"], r["count"]) for r in out if r["profile_type"] == "TOPN"]
    bot = [(r["value"], r["count"]) for r in out if r["profile_type"] == "BOTTOMN"]
    assert top == [(None, 2), ("a", 2)] and bot == [("b", 1), ("c", 1)]


def test_normalize_topn_golden(spark):
    recs = [(1, "ds", "2024-01-01", "col", "TOPN", "null", 5, "t1"), (2, "ds", "2024-01-01", "col", "TOPN", "x", 3, "t1"),
            (3, "ds", "2024-01-01", "col", "BOTTOMN", "", 1, "t1")]
    df = spark.createDataFrame(recs, "id long, dataset string, runId string, fieldNm string, fieldFunc string, "
                                     "fieldValue string, uniqueCnt long, updtTs string")
    r = rows(P.normalize_topn(df))[0]
    assert r["profile_type"] == "TOPN" and r["generated_at"] == "t1"
    assert [(v["profile_type"], v["value"], v["count"]) for v in r["values"]] == \
        [("TOPN", None, 5), ("TOPN", "x", 3), ("BOTTOMN", None, 1)]


def test_run_profile_and_shape(spark):
    df = spark.createDataFrame([("r1", "Ab-12", 1.0), ("r1", "", 3.0), ("r1", None, None), ("r2", "xY", 2.0)],
                               "run string, s string, x double")
    out = {(r["run_id"], r["column_name"]): r for r in rows(P.run_profile(df, "run", ["s", "x"]))}
    s1 = out[("r1", "s")]
    assert (s1["row_count"], s1["null_count"], s1["empty_count"], s1["unique_cnt"]) == (3, 1, 1, 2)
    assert s1["filled_pct"] == pytest.approx(100 / 3) and s1["mean_value"] is None
    assert out[("r1", "x")]["mean_value"] == 2.0 and out[("r1", "x")]["unique_ratio"] == pytest.approx(2 / 3)
    shp = {r["shape"]: r for r in rows(P.shape_check(df, ["s"], sensitivity=0.3))}
    assert set(shp) == {"Aa-9", "", "aA"} and shp["Aa-9"]["is_rare"] is False
    g = rows(df.select(P.shape_of(F.lit("Customer#000000001"), granular=True, max_len=40).alias("s")))[0]["s"]
    assert g == "Aaaaaaaa#999999999"


def test_assess_unknown_when_no_baseline(spark):
    df = spark.createDataFrame([(None, None, 1.0, None, 2.0, None, 0.5, None, 3.0, None)],
                               "historical_type string, data_type string, null_pct double, avg_null_pct double, "
                               "empty_pct double, avg_empty_pct double, unique_ratio double, avg_unique_ratio double, "
                               "unique_cnt double, avg_unique_cnt double").withColumn("filled_pct", F.lit(None)) \
        .withColumn("avg_filled_pct", F.lit(None))
    a = rows(D.assess_drift(df))[0]
    assert (a["schema_severity"], a["completeness_severity"], a["uniqueness_severity"], a["overall_severity"]) == \
        ("UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN")


def test_rolling_baseline_uses_only_earlier_runs(spark):
    runs = spark.createDataFrame([(f"2024-0{i}", "c", "int", float(i), 0.0, 100.0 - i, float(10 * i), 0.1 * i,
                                   None, None, None) for i in range(1, 6)],
                                 "run_id string, column_name string, data_type string, null_pct double, empty_pct double, "
                                 "filled_pct double, unique_cnt double, unique_ratio double, min_value double, "
                                 "max_value double, mean_value double")
    b = {r["run_id"]: r for r in rows(D.rolling_baseline(runs, lookback=2))}
    assert b["2024-01"]["baseline_runs"] == 0 and b["2024-01"]["avg_null_pct"] is None
    assert b["2024-04"]["avg_null_pct"] == 2.5 and b["2024-04"]["median_unique_cnt"] == 25.0
    assert b["2024-05"]["median_unique_cnt"] == 35.0


def test_adaptive_check_and_suppression(spark):
    m = spark.createDataFrame([("ds", f"r{i}", "c", "NULL", v) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, 9.0])],
                              "dataset string, run_id string, item string, metric_type string, value double")
    chk = {r["run_id"]: r for r in rows(D.adaptive_check(m, lookback=4, k=2.0, min_runs=3))}
    assert chk["r2"]["is_break"] is False and chk["r4"]["is_break"] is True
    sup = spark.createDataFrame([("ds", "c", "NULL", 1, 1), ("ds", "c", "NULL", 0, 2), ("ds", "x", "ROW_COUNT", 1, 1)],
                                "dataset string, item string, metricType string, suppress int, ts int")
    latest = {(r["item"], r["metric_type"]): r["suppress"] for r in rows(D.latest_suppressions(sup))}
    assert latest == {("c", "NULL"): 0, ("Row Count", "ROW_COUNT"): 1}
    brk = D.adaptive_check(m, lookback=4, k=2.0, min_runs=3).where("is_break")
    assert len(rows(D.suppress_findings(brk, sup))) == 1
    # suppress then unsuppress is the identity
    sup2 = sup.unionByName(spark.createDataFrame([("ds", "c", "NULL", 1, 3), ("ds", "c", "NULL", 0, 4)],
                                                 sup.schema))
    assert len(rows(D.suppress_findings(brk, sup2))) == 1


def test_audit_suppressions(spark):
    req = spark.createDataFrame([("NULL", 1, "c"), ("ROW_COUNT", 1, "c"), ("TIME", 0, "Load Time"), ("BAD", 2, "")],
                                "metricType string, suppress int, item string")
    out = [r["valid"] for r in rows(D.audit_suppressions(req))]
    assert out == [True, False, True, False]


def test_value_distribution_drift_nulls(spark):
    a = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "v string")
    b = spark.createDataFrame([("x",), (None,), (None,), ("z",)], "v string")
    out = {r["value"]: (r["count_a"], r["count_b"], r["status"]) for r in rows(D.value_distribution_drift(a, b, "v"))}
    assert out == {"x": (2, 1, "changed"), None: (1, 2, "changed"), "y": (1, 0, "disappeared"),
                   "z": (0, 1, "appeared")}
    assert not math.isnan(1.0)


def test_value_drift_by_run_equals_two_sided(spark):
    """One-scan multi-column drift equals the two-input form per column."""
    data = [("a", "x", None), ("a", "y", "1"), ("a", None, "1"), ("b", "x", "2"), ("b", "z", None),
            ("b", "x", "1"), ("c", "x", "9")]
    df = spark.createDataFrame(data, "run string, c1 string, c2 string")
    got = rows(D.value_drift_by_run(df, F.col("run"), "a", "b", ["c1", "c2"]), ["column_name", "value"])
    exp = []
    for c in ("c1", "c2"):
        two = D.value_distribution_drift(df.where("run = 'a'").select(c), df.where("run = 'b'").select(c), c)
        exp += [dict(r, column_name=c) for r in rows(two)]
    exp.sort(key=lambda r: (r["column_name"], r["value"] is None, r["value"]))
    assert got == exp
    st = {(r["column_name"], r["value"]): r["status"] for r in got}
    assert st[("c1", "z")] == "appeared" and st[("c1", "y")] == "disappeared" and st[("c2", None)] == "unchanged"


def test_value_drift_by_run_property(spark):
    """Random rows of three runs (the third is ignored) and null values: the
    one-scan drift equals counting each column's values per run."""
    from collections import Counter

    from hypothesis import given, settings
    from hypothesis import strategies as st

    row = st.tuples(st.sampled_from(["r1", "r2", "r3"]), st.one_of(st.none(), st.sampled_from(["x", "y", "z"])),
                    st.one_of(st.none(), st.integers(0, 3)))

    @settings(max_examples=10, deadline=None)
    @given(st.lists(row, max_size=40))
    def check(data):
        df = spark.createDataFrame(data, "run string, c1 string, c2 int")
        got = {(r["column_name"], r["value"]): (r["count_a"], r["count_b"], r["status"])
               for r in rows(D.value_drift_by_run(df, F.col("run"), "r1", "r2", ["c1", "c2"]))}
        exp = {}
        for i, c in ((1, "c1"), (2, "c2")):
            a = Counter(None if d[i] is None else str(d[i]) for d in data if d[0] == "r1")
            b = Counter(None if d[i] is None else str(d[i]) for d in data if d[0] == "r2")
            for v in set(a) | set(b):
                st_ = "appeared" if a[v] == 0 else "disappeared" if b[v] == 0 else \
                    "changed" if a[v] != b[v] else "unchanged"
                exp[(c, v)] = (a[v], b[v], st_)
        assert got == exp

    check()
