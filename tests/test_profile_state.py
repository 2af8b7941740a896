"""Mergeable profile states against exact figures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dqspark.operators import profile_state as PS
from dqspark.session import scratch_path
from tests.conftest import rows

SCHEMA = "run string, s string, x double, n int, gone string"


def data(spark, n=4000):
    rng = random.Random(6)
    out = []
    for i in range(n):
        s = rng.choice([None, "", " \t", f"v{rng.randint(0, 900)}"])
        x = rng.choice([None, 0.0, -0.0, math.nan, rng.gauss(5, 20)])
        out.append((f"r{i % 4}", s, x, rng.randint(0, 3000), None))
    return out, spark.createDataFrame(out, SCHEMA)


def test_merged_states_say_what_the_data_says(spark):
    raw, df = data(spark)
    states = PS.profile_state(df, F.col("run"), ["s", "x", "n", "gone"], "d")
    m = {r["column_name"]: r for r in rows(PS.metrics(PS.merge_states(states, ["dataset", "column_name"])))}
    n = len(raw)
    s, x, k = [r[1] for r in raw], [r[2] for r in raw], [r[3] for r in raw]
    assert m["s"]["null_pct"] == pytest.approx(100 * s.count(None) / n)
    assert m["s"]["empty_pct"] == pytest.approx(100 * sum(v is not None and not v.strip() for v in s) / n)
    assert m["s"]["filled_pct"] == pytest.approx(100 - m["s"]["null_pct"] - m["s"]["empty_pct"])
    assert m["s"]["unique_cnt"] == pytest.approx(len(set(s) - {None}), rel=0.03) and m["s"]["mean_value"] is None and m["s"]["quantiles"] is None
    assert m["x"]["unique_cnt"] == pytest.approx(len({0.0 if v == 0 else v for v in x if v is not None and not math.isnan(v)}) + 1, rel=0.03)
    assert m["n"]["unique_cnt"] == pytest.approx(len(set(k)), rel=0.03) and m["n"]["mean_value"] == pytest.approx(sum(k) / n)
    assert (m["n"]["min_value"], m["n"]["max_value"]) == (min(k), max(k))
    for q, v in zip((0.25, 0.5, 0.75), m["n"]["quantiles"]):
        assert sum(y <= v for y in k) / n == pytest.approx(q, abs=0.02)
    assert m["gone"]["null_pct"] == 100 and m["gone"]["unique_cnt"] == 0 and m["gone"]["filled_pct"] == 0
    # merging in two steps gives the same sketches' estimates as one pass
    one = PS.profile_state(df, F.lit("all"), ["n"], "d")
    assert rows(PS.metrics(one))[0]["unique_cnt"] == pytest.approx(m["n"]["unique_cnt"], rel=0.01)


def test_rolling_and_replaced_runs(spark):
    raw, df = data(spark, 400)
    path = scratch_path(spark, "states")
    PS.write_states(PS.profile_state(df.where("run = 'r1'").limit(7), F.col("run"), ["n"], "d"), path)
    PS.write_states(PS.profile_state(df, F.col("run"), ["n"], "d"), path)         # r1 is profiled again
    PS.write_states(PS.profile_state(df.where("run = 'r0'"), F.lit("r9"), ["n"], "d"), path)
    states = PS.read_states(spark, path)
    assert {r["run_id"]: r["row_count"] for r in rows(states)} == {"r0": 100, "r1": 100, "r2": 100, "r3": 100, "r9": 100}
    roll = {r["run_id"]: r for r in rows(PS.metrics(PS.rolling_states(states, -2, -1)))}
    assert set(roll) == {"r1", "r2", "r3", "r9"} and roll["r1"]["row_count"] == 100 and roll["r9"]["row_count"] == 200
    k = [r[3] for r in raw if r[0] in ("r2", "r3")]
    assert roll["r9"]["unique_cnt"] == pytest.approx(len(set(k)), rel=0.03) and roll["r9"]["max_value"] == max(k)
    day = F.regexp_extract("run_id", "[0-9]", 0).cast("int")
    slide = {r["run_id"]: r["n_panes"] for r in rows(PS.sliding_states(states, day, 3))}
    assert slide == {"r0": 1, "r1": 2, "r2": 3, "r3": 3, "r9": 1}              # days without a pane count nothing


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    states = PS.profile_state(empty, F.col("run"), ["s", "x"], "d")
    assert rows(states) == [] and rows(PS.metrics(PS.rolling_states(states, -1, 0))) == []
