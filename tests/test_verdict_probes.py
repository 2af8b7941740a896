"""Cases off the happy path: null keys, long values, patterns, repeated names."""

import json

import pytest
from pyspark.sql import functions as F

from dqspark.functions import exprs as X
from dqspark.operators import audit as A
from dqspark.operators import profile as P
from dqspark.operators import registry as G
from dqspark.operators import rules as R
from dqspark.operators.windows import ordinal
from dqspark.sources import sinks as S
from tests.conftest import rows


def test_upsert_keeps_target_rows_with_null_keys(spark):
    t = spark.createDataFrame([(None, "a", 1), ("k", "b", 2)], "k string, v string, x int")
    i = spark.createDataFrame([("k", "c", 3)], "k string, v string, x int")
    got = {(r["k"], r["v"], r["x"], r["_action"]) for r in rows(S.upsert(t, i, ["k"], ["k", "v", "x"], with_action=True))}
    assert got == {(None, "a", 1, "keep"), ("k", "c", 3, "update")}


@pytest.mark.parametrize("order,expected", [([None], "x"), ([None, 2], "y")])
def test_null_order_does_not_erase_rows(spark, order, expected):
    i = spark.createDataFrame([(1, "xy"[n], o) for n, o in enumerate(order)], "k int, v string, o int")
    t = spark.createDataFrame([], "k int, v string")
    assert [r["v"] for r in rows(S.insert_or_ignore(t, i, ["k", "v"], ["k"], order_by="o"))] == [expected]


def test_ordinal_with_further_columns(spark):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_021).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("w"))
    got = ordinal(df.repartition(8), "v", partitions=8).agg(F.countDistinct("ordinal").alias("n"), F.max("ordinal").alias("m")).first()
    assert (got["n"], got["m"]) == (50_000, 50_000)


def test_rule_templates_take_values_not_text(spark):
    df = spark.createDataFrame([("123",), ("abc",), ("ddd",), (None,), ("it's {x}",)], "c string")
    breaks = (lambda t, **p: [r["c"] for r in rows(R.rule_condition(df, R.template_condition(t, "c", **p)))])
    assert breaks("regex", pattern=r"^\d+$") == ["abc", "ddd", "it's {x}"]
    assert breaks("regex", pattern=r"^it's \{x\}$|^\d+$") == ["abc", "ddd"]
    assert breaks("not_in_set", values=["abc", "it's {x}"]) == ["123", "ddd"]
    assert breaks("length", max_len=3) == ["it's {x}"]


def test_profile_longs_beyond_double_and_mixed_types(spark):
    big = 9007199254740992
    df = spark.createDataFrame([(big, "a"), (big + 1, None)], "n long, s string")
    out = {r["column_name"]: r for r in rows(P.profile_columns(df))}
    assert out["n"]["distinct_count"] == 2 and out["n"]["max_value"] == str(big + 1)
    assert out["s"]["null_count"] == 1 and out["s"]["min_value"] == "a"


def test_similar_datasets_with_repeated_names(spark):
    key = "dataset string, table_nm string, connectionName string, db_nm string"
    reg = spark.createDataFrame([("ds_x", "x", "c", "d", "One"), ("ds_x", "x", "c", "d", "Two")], key + ", `Data Domain` string")
    t = spark.createDataFrame([(1, "ds_x", "x", "c", "d")], "target_id int, " + key)
    out = rows(G.similar_datasets(spark, t, reg, top_n=2), ["rank"])
    assert [r["rank"] for r in out] == [1, 2] and {r["Data Domain"] for r in out} == {"One", "Two"}


def test_rule_change_without_new_text_needs_no_validation(spark):
    e = spark.createDataFrame([("ds", "if_a", "x > 1")], "dataset string, ruleNm string, ruleValue string")
    p = spark.createDataFrame([("ds", "if_a", None, None), ("ds", "if_b", None, None)],
                              "dataset string, ruleNm string, ruleValue string, old_rule_nm string")
    got = {r["ruleNm"]: r["requires_validation"] for r in rows(R.plan_rule_changes(e, p))}
    assert got == {"if_a": False, "if_b": True}


def test_flat_redaction_reaches_nested_credentials(spark):
    j = {"a": {"password": "p1", "n": 1}, "b": [{"api-key": {"x": "s3"}}], "c": {"user": "u"}, "t": "{literal"}
    m = spark.createDataFrame([(json.dumps(j),)], "j string").select(X.redact_flat_json("j").alias("m")).first()["m"]
    assert "p1" not in m["a"] and json.loads(m["a"]) == {"password": "[REDACTED]", "n": 1}
    assert m["b"] == "[REDACTED]" and json.loads(m["c"]) == {"user": "u"} and m["t"] == "{literal"


def test_template_values_are_not_filled_in_again(spark):
    df = spark.createDataFrame([({"a": "{b}", "b": "B"},)], "v map<string,string>")
    prompt, _ = X.render_template(F.lit("T {a} {b}"), F.col("v"), [("a", True), ("b", True)])
    assert df.select(prompt).first()[0] == "T {b} B"


def test_snapshot_diff_null_keys_and_all_null_rows(spark):
    b = spark.createDataFrame([(None, "x"), (1, None), (2, "y")], "k int, v string")
    a = spark.createDataFrame([(None, "x"), (2, "z")], "k int, v string")
    got = {(r["k"], r["change_from"], r["change_to"]) for r in rows(A.snapshot_diff(b, a, ["k"], ["v"]))}
    assert got == {(2, "y", "z"), (1, None, None)}


def test_empty_change_log_batch_writes_nothing(spark, tmp_path):
    S.append_change_log(spark.createDataFrame([], "dataset string, changed_at timestamp"), str(tmp_path / "log"))
    assert not (tmp_path / "log").exists()
