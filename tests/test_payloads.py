"""Payload ingestion, profile-delta normalisation and assessment."""

import json

import pytest
from pyspark.sql import functions as F

from dqspark.functions.exprs import delta_pct
from dqspark.operators import profile as P
from dqspark.operators import profile_delta as PD
from dqspark.plans.payload_plans import profile_delta_orders
from dqspark.sources import payloads as S
from tests.conftest import SF_SMALL, rows


def record(**kw):
    rec = {"dataset": "ds", "colName": "c", "datasetField": {"runId": "2024-01-10", "nullRatio": "10", "emptyRatio": "0",
           "filledRatio": "90", "uniqueCnt": 10, "uniqueRatio": "0.5", "meanAbsNum": None, "meanAbs": "4.5",
           "actualDataType": "", "passFail": 0},
           "baseline": {"avg_nulls": 9, "avg_empties": "---", "avg_filled_ratio": "91", "avg_unique_cnt": 9,
                        "avg_uniques": "0.25"},
           "historicalSchema": {"colSchema": "int"}, "currentSchema": {"colSchema": "string", "isKey": True}}
    rec.update(kw)
    return rec


def assessed(spark, *records):
    df = spark.createDataFrame([(json.dumps(list(records)),)], "json string")
    a = PD.assess_records(PD.normalize_records(S.accepted(S.checked_records(df)).orderBy("place")))
    return rows(a)


def test_golden_record(spark):
    a = assessed(spark, record())[0]
    d = a["drift"]
    assert a["data_type"]["detected"] == "string"        # an empty actual type is skipped
    assert a["current_profile"]["mean"] == 4.5 and a["passed"] is False and a["adaptive_break"] is True
    assert a["baseline_profile"]["average_empty_percent"] is None and a["schema_metadata"]["is_key"] is True
    assert d["schema_severity"] == "CRITICAL" and d["schema_reason"] == "type went from int to string"
    assert d["null_change_pp"] == pytest.approx(1.0) and d["completeness_severity"] == "LOW"
    assert d["completeness_reason"] == "largest change: null percentage, 1.00000 pp"
    assert d["distinct_ratio_change_pp"] == pytest.approx(25.0) and d["uniqueness_severity"] == "HIGH"
    assert d["overall_severity"] == "CRITICAL" and d["triggered_dimensions"] == "schema,completeness,uniqueness"
    assert d["overall_reason"] == "highest severity CRITICAL in schema,completeness,uniqueness"
    df = spark.createDataFrame([(10.0, 9.0)], "cur double, avg double")     # 10 against 9 on average
    assert rows(df.select(*delta_pct("cur", "avg"))) == [{"delta": 1.0, "delta_pct": 11.11}]


def test_schema_branches_and_numbers(spark):
    field = record()["datasetField"]
    high = record(historicalSchema={"colSchema": "string"}, datasetField={**field, "actualDataType": "date", "passFail": 1,
                  "minAbsNum": 1.5, "minAbs": "a", "maxAbs": "z", "meanAbsNum": " 1_0.5 ", "nullRatio": 9.0, "filledRatio": None})
    unknown = record(historicalSchema=None, currentSchema={}, baseline=None, datasetField={"uniqueRatio": "?"})
    calm = record(historicalSchema={"colSchema": "string"}, baseline={"avg_nulls": "10", "avg_uniques": 0.5}, currentSchema={"colSchema": "string"})
    a, b, c = assessed(spark, high, unknown, calm)
    assert a["drift"]["schema_severity"] == "HIGH" and a["drift"]["schema_reason"] == "values look like date, the schema says string"
    assert (a["current_profile"]["minimum"], a["current_profile"]["maximum"], a["current_profile"]["mean"]) == ("1.5", "z", 10.5)
    assert a["passed"] and not a["adaptive_break"] and a["drift"]["completeness_severity"] == "NONE"
    assert b["data_type"] == {"historical": None, "current": None, "detected": None, "changed": False}
    assert {b["drift"][f"{k}_severity"] for k in ("schema", "completeness", "uniqueness", "overall")} == {"UNKNOWN"}
    assert b["drift"]["schema_reason"] == "no schema type on either side" and b["drift"]["overall_reason"] == "too little is known to judge"
    assert c["drift"]["overall_severity"] == "NONE" and c["drift"]["overall_reason"] == "no dimension above the noise threshold"
    assert c["drift"]["schema_reason"] == "same schema type" and c["drift"]["triggered_dimensions"] == ""


def test_rejects_are_kept_with_a_reason(spark):
    texts = [None, " \n", "{oops", "[]", "7", "[null, {}, [1]]", '{"dataset": " "}', '{"dataset": "d"}', '[{"dataset": 5}]']
    df = spark.createDataFrame(list(enumerate(texts)), "reason_no int, json string")
    checked = S.checked_records(df)
    got = [(r["reason_no"], r["place"], r["reason"]) for r in rows(S.rejected(checked), ["reason_no", "place"])]
    assert got == [(0, None, "no payload"), (1, None, "no payload"), (2, None, "not json"), (4, 0, "no record"), (5, 0, "no record"),
                   (5, 1, "missing dataset"), (5, 2, "no record"), (6, 0, "missing dataset")]
    kept = S.accepted(checked).select("reason_no", S.field("record", "dataset").alias("d"))
    assert rows(kept, ["reason_no"]) == [{"reason_no": 7, "d": "d"}, {"reason_no": 8, "d": "5"}]
    assert rows(S.checked_records(df.limit(0))) == []


def test_topn_payload(spark):
    recs = [{"dataset": "d", "runId": "r", "fieldNm": "f", "fieldFunc": "TOPN", "fieldValue": v, "uniqueCnt": c} for v, c in
            [("a", 5), ("NULL", "4"), ("", None), (None, 1.5), (7, " 2 ")]]
    df = spark.createDataFrame([(json.dumps(recs),)], "json string")
    out = rows(P.normalize_topn(S.topn_records(S.accepted(S.checked_records(df)))))[0]
    assert [(v["value"], v["count"]) for v in out["values"]] == [("a", 5), (None, 4), (None, None), (None, None), ("7", 2)]


def test_query_reaches_every_branch(spark):
    a = profile_delta_orders(spark, SF_SMALL)
    seen = {r[0] for r in a.select("schema_severity").distinct().collect()}
    assert seen == {"CRITICAL", "HIGH", "UNKNOWN", "NONE"}
    assert {r[0] for r in a.select("overall_severity").distinct().collect()} >= {"CRITICAL", "HIGH"}
    assert a.where("completeness_reason is null or schema_reason is null or uniqueness_reason is null or overall_reason is null").count() == 0
    assert a.select(F.count_if("passed"), F.count_if("adaptive_break")).first()[0] > 0
