"""DATA_TYPE and TIME checks, duplicate share, unit lists."""

import datetime as dt

from pyspark.sql import functions as F

from dqspark.operators import drift as D
from dqspark.operators import profile as P
from dqspark.operators import registry as G
from tests.conftest import rows


def test_detected_types(spark):
    values = {"int": ["1", " -2 ", None, "+3"], "dec": ["1.5", "2", ".5", "1e3"], "day": ["2024-01-01", "2024-01-02 10:00:00"], "flag": ["true", "FALSE"],
              "text": ["a", "1"], "mixed": ["a", "1", "2", "3"], "none": [None, " "]}
    data = [(k, v) for k, vs in values.items() for v in vs] + [("text", "b")] * 40 + [("mixed", "2.5")] * 8
    df = spark.createDataFrame(data, "r string, c string")
    got = {r["run_id"]: r["category"] for r in rows(P.detected_types(df, F.col("r"), ["c"], "d"))}
    assert got == {"int": "integer", "dec": "decimal", "day": "date", "flag": "boolean", "text": "text", "mixed": "mixed", "none": "empty"}


def test_categorical_check(spark):
    cats = ["a", "b", "b", "c", "a", "d", None, "c"]
    df = spark.createDataFrame([("d", f"r{i}", "x", "DATA_TYPE", c) for i, c in enumerate(cats)],
                               "dataset string, run_id string, item string, metric_type string, category string")
    got = [(r["run_id"], r["usual"], r["seen"], r["is_break"]) for r in rows(D.categorical_check(df, lookback=3, min_runs=2), ["run_id"])]
    assert got == [("r0", None, [], False), ("r1", "a", ["a"], False), ("r2", "a", ["a", "b"], False), ("r3", "b", ["a", "b"], True),
                   ("r4", "b", ["b", "c"], True), ("r5", "a", ["a", "b", "c"], True), ("r7", "a", ["a", "c", "d"], False)]


def test_load_time(spark):
    t = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([("d", "r1", t, t + dt.timedelta(seconds=2.5)), ("d", "r2", t, None)],
                                 "dataset string, run_id string, started_at timestamp, finished_at timestamp")
    assert rows(D.load_time_metrics(jobs)) == [{"dataset": "d", "run_id": "r1", "item": "Load Time", "metric_type": "TIME", "value": 2.5}]


def test_duplicate_share(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "a", "a", "b", None, None, "c"])], "id int, v string")
    r = rows(P.duplicate_share(df, ["v"], "id"))[0]
    assert (r["row_count"], r["n_groups"], r["rows_in_groups"], r["surplus_rows"]) == (7, 2, 5, 3) and abs(r["duplicate_share"] - 3 / 7) < 1e-12
    assert rows(P.duplicate_share(df.limit(0), ["v"], "id"))[0]["duplicate_share"] == 0.0


def test_unit_lists(spark):
    units = spark.createDataFrame([(1, "JP", None), (2, "KR", None), (3, "JP - b", 1), (4, "JP - a - x", 1), (5, "loose", 1)], "id long, name string, subId long")
    got = {r["market"]: r for r in rows(G.unit_lists(units))}
    assert set(got) == {"JP", "KR", None} and got["JP"]["projects_in_market"] == ["a - x", "b"] and got[None]["projects_in_market"] == []
    assert got["KR"]["available_projects"] == ["JP - a - x", "JP - b", "loose"] and got["KR"]["available_markets"] == ["JP", "KR"]
