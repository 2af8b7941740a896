"""Result payloads: JSON made from the tables, ingested, normalised and assessed."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import drift as D
from dqspark.operators import profile as P
from dqspark.operators import profile_delta as PD
from dqspark.plans.catalog import register, table
from dqspark.plans.drift import _SQL_RUNS, LOOKBACK, _rank, _sev, orders_runs
from dqspark.plans.profiling import _TOPN_PART_COLS, _sql_topn
from dqspark.sources import payloads as S

# What a producer writes for a (run, column); the same texts for Spark and DuckDB.
_MONTH = "CAST(substr(run_id, 6, 2) AS INT)"
_CURRENT = (f"CASE WHEN column_name = 'o_orderstatus' AND {_MONTH} % 5 = 0 THEN 'int' "
            f"WHEN column_name = 'o_totalprice' AND {_MONTH} % 6 = 2 THEN NULL ELSE data_type END")
_HISTORICAL = f"CASE WHEN column_name = 'o_totalprice' AND {_MONTH} % 6 = 2 THEN NULL ELSE historical_type END"
_ACTUAL = (f"CASE WHEN column_name = 'o_totalprice' AND {_MONTH} % 6 = 2 THEN NULL WHEN column_name = 'o_orderpriority' AND {_MONTH} % 4 = 1 "
           f"THEN 'int' WHEN {_MONTH} % 3 = 0 THEN '' ELSE data_type END")
_PASS = f"CASE {_MONTH} % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END"


def delta_payloads(spark, sf):
    """One payload per run of ``orders``: a list with a record per column,
    numbers partly as text; and for some runs another payload that is cut
    off, blank, no object, or lacks what a record needs."""
    b = D.rolling_baseline(orders_runs(spark, sf), LOOKBACK, ("column_name",))
    text = (lambda c, c2=None: F.coalesce(F.col(c).cast("string"), F.lit("---")).alias(c2 or c))
    record = F.struct(
        F.lit("orders").alias("dataset"), F.col("column_name").alias("colName"),
        F.expr(f"{_MONTH} % 4").alias("dtcntDelta"), F.lit(" 1_0 ").alias("ncntDelta"), F.lit("---").alias("ecntDelta"),
        (F.col("unique_cnt") - F.col("avg_unique_cnt")).alias("uniqueDelta"), F.lit("n/a").alias("uniqueDeltaPercent"),
        F.expr("row_count % 100 / 4").alias("changePercent"),
        F.concat("column_name", F.lit(" IS NULL")).alias("validValuesRule"),
        F.struct(F.col("run_id").alias("runId"), text("null_pct", "nullRatio"), F.col("empty_pct").alias("emptyRatio"),
                 F.col("filled_pct").alias("filledRatio"), F.col("unique_cnt").alias("uniqueCnt"), F.col("unique_ratio").alias("uniqueRatio"),
                 F.lit("least").alias("minAbs"), F.expr("CAST(floor(min_value) AS BIGINT)").alias("minAbsNum"),
                 F.expr("CAST(floor(max_value) AS BIGINT)").alias("maxAbsNum"), F.lit("7.5").alias("meanAbs"),
                 F.col("mean_value").alias("meanAbsNum"), F.expr(_ACTUAL).alias("actualDataType"),
                 F.expr(_PASS).alias("passFail")).alias("datasetField"),
        F.struct(F.col("avg_null_pct").alias("avg_nulls"), text("avg_empty_pct", "avg_empties"), F.col("avg_filled_pct").alias("avg_filled_ratio"),
                 F.col("avg_unique_cnt"), F.col("median_unique_cnt"), F.col("avg_unique_ratio").alias("avg_uniques"),
                 F.col("median_unique_ratio"), text("avg_min_value", "avg_min_abs_num"), F.col("avg_max_value").alias("avg_max_abs_num"),
                 F.col("avg_mean_value").alias("avg_mean_abs_num")).alias("baseline"),
        F.struct(F.expr(_HISTORICAL).alias("colSchema")).alias("historicalSchema"),
        F.struct(F.expr(_CURRENT).alias("colSchema"), (F.col("column_name") == "o_custkey").alias("isKey"), F.expr(f"{_MONTH} % 2 = 0").alias("isPii"),
                 F.lit(False).alias("isMnpi"), F.lit(None).cast("boolean").alias("isMasked"), F.lit("true").alias("enabled")).alias("currentSchema"))
    good = b.groupBy("run_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("column_name", record.alias("r"))))["r"]).alias("json"))
    bad = F.expr(f"CASE {_MONTH} % 7 WHEN 3 THEN substr(json, 1, 40) WHEN 4 THEN '  ' WHEN 5 THEN '\"text\"' "
                 "WHEN 6 THEN '[1, {\"colName\": \"x\"}, {\"dataset\": \"orders\", \"colName\": null}]' WHEN 0 THEN '[]' END")
    # stored order is not relied on: a payload is named by its run and kind
    both = good.select(F.concat("run_id", F.lit("/1")).alias("payload"), "json").unionByName(
        good.select(F.concat("run_id", F.lit("/2")).alias("payload"), F.coalesce(bad, F.lit("[]")).alias("json")))
    return S.checked_records(both, required=("dataset", "colName"))


SQL_PROFILE_DELTA = f"""
WITH b AS (
  SELECT *, avg(null_pct) OVER w AS an, avg(empty_pct) OVER w AS ae, avg(filled_pct) OVER w AS af,
    avg(unique_cnt) OVER w AS auc, median(unique_cnt) OVER w AS muc, avg(unique_ratio) OVER w AS aur, median(unique_ratio) OVER w AS mur,
    avg(min_value) OVER w AS amin, avg(max_value) OVER w AS amax, avg(mean_value) OVER w AS amean,
    lag(data_type) OVER (PARTITION BY column_name ORDER BY run_id) AS historical_type
  FROM ({_SQL_RUNS})
  WINDOW w AS (PARTITION BY column_name ORDER BY run_id ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, {_MONTH} AS m, {_HISTORICAL} AS ht, {_CURRENT} AS ct, {_ACTUAL} AS act, {_PASS} AS pf FROM b),
c AS (SELECT *, coalesce(nullif(act, ''), ct, ht) AS dt, coalesce(ht <> ct, false) AS changed,
    abs(null_pct - an) AS npp, abs(empty_pct - ae) AS epp, abs(filled_pct - af) AS fpp, abs(unique_ratio - aur) * 100.0 AS rpp FROM t),
d AS (SELECT *, greatest(npp, epp, fpp) AS cpp, coalesce(dt <> ct, false) AS mismatch,
    CASE WHEN changed THEN 'CRITICAL' WHEN dt <> ct THEN 'HIGH' WHEN ht IS NULL AND ct IS NULL THEN 'UNKNOWN' ELSE 'NONE' END AS ss FROM c),
e AS (SELECT *, {_sev('cpp')} AS cs, {_sev('rpp')} AS us FROM d),
f AS (SELECT *, greatest({_rank('ss')}, {_rank('cs')}, {_rank('us')}) AS r,
    concat_ws(',', CASE WHEN {_rank('ss')} > 0 THEN 'schema' END, CASE WHEN {_rank('cs')} > 0 THEN 'completeness' END,
              CASE WHEN {_rank('us')} > 0 THEN 'uniqueness' END) AS trig FROM e),
g AS (SELECT *, CASE r WHEN -1 THEN 'UNKNOWN' WHEN 0 THEN 'NONE' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS os FROM f)
SELECT 'orders' AS dataset, column_name AS "column", run_id, ht AS historical, ct AS current, dt AS detected, changed,
  null_pct AS null_percent, empty_pct AS empty_percent, filled_pct AS filled_percent, CAST(unique_cnt AS DOUBLE) AS distinct_count,
  unique_ratio AS distinct_ratio, coalesce(CAST(CAST(floor(min_value) AS BIGINT) AS VARCHAR), 'least') AS minimum,
  CAST(CAST(floor(max_value) AS BIGINT) AS VARCHAR) AS maximum, coalesce(mean_value, 7.5) AS mean, act AS actual_data_type, pf AS pass_fail,
  an AS average_null_percent, ae AS average_empty_percent, af AS average_filled_percent, auc AS average_distinct_count,
  muc AS median_distinct_count, aur AS average_distinct_ratio, mur AS median_distinct_ratio, amin AS average_numeric_min,
  amax AS average_numeric_max, amean AS average_numeric_mean,
  CAST(m % 4 AS DOUBLE) AS datatype, 10.0::DOUBLE AS "null", NULL::DOUBLE AS "empty", unique_cnt - auc AS delta_distinct_count, NULL::DOUBLE AS distinct_percent,
  row_count % 100 / 4 AS overall, NULL::DOUBLE AS overall_with_uniques, column_name || ' IS NULL' AS generated_failure_condition,
  column_name = 'o_custkey' AS is_key, m % 2 = 0 AS is_pii, false AS is_mnpi, NULL::BOOLEAN AS is_masked, true AS enabled,
  coalesce(pf = 1, false) AS passed, NOT coalesce(pf = 1, false) AS adaptive_break,
  changed AS schema_changed, mismatch AS detected_type_mismatch, ss AS schema_severity,
  CASE WHEN changed THEN 'type went from ' || ht || ' to ' || ct WHEN mismatch THEN 'values look like ' || dt || ', the schema says ' || ct
       WHEN ss = 'UNKNOWN' THEN 'no schema type on either side' ELSE 'same schema type' END AS schema_reason,
  npp AS null_change_pp, epp AS empty_change_pp, fpp AS filled_change_pp, cpp AS completeness_max_pp, cs AS completeness_severity,
  CASE WHEN cpp IS NULL THEN 'completeness metrics unavailable' WHEN cs = 'NONE' THEN 'below 1.0 pp noise threshold'
       ELSE 'largest change: ' || CASE WHEN npp = cpp THEN 'null percentage' WHEN epp = cpp THEN 'empty percentage' ELSE 'filled percentage' END
            || ', ' || printf('%.5f', cpp) || ' pp' END AS completeness_reason,
  abs(unique_cnt - auc) AS distinct_count_change,
  CASE WHEN auc = 0 THEN CASE WHEN unique_cnt = 0 THEN 0.0 END ELSE abs((unique_cnt - auc) / auc * 100.0) END AS distinct_count_rel_pct,
  rpp AS distinct_ratio_change_pp, us AS uniqueness_severity,
  CASE WHEN rpp IS NULL THEN 'distinct ratio unavailable' WHEN us = 'NONE' THEN 'below 1.0 pp noise threshold'
       ELSE 'distinct ratio moved by ' || printf('%.5f', rpp) || ' pp' END AS uniqueness_reason,
  os AS overall_severity, trig AS triggered_dimensions,
  CASE os WHEN 'UNKNOWN' THEN 'too little is known to judge' WHEN 'NONE' THEN 'no dimension above the noise threshold'
       ELSE 'highest severity ' || os || ' in ' || trig END AS overall_reason
FROM g"""


@register("profile_delta_orders", SQL_PROFILE_DELTA)
def profile_delta_orders(spark, sf):
    """Profile-delta payloads of every run of ``orders``,
    read as VARIANT, normalised to every field and assessed with all reasons."""
    a = PD.assess_records(PD.normalize_records(S.accepted(delta_payloads(spark, sf))))
    return a.select("dataset", "column", "run_id", "data_type.*", "current_profile.*", "baseline_profile.*",
                    *[F.col(f"delta.{c}").alias("delta_distinct_count" if c == "distinct_count" else c) for c in PD.DELTA_FIELDS],
                    "generated_failure_condition", "schema_metadata.*", "passed", "adaptive_break", "drift.*")


@register("profile_delta_rejects_orders", f"""
WITH r AS (SELECT DISTINCT run_id, {_MONTH} % 7 AS k FROM ({_SQL_RUNS}))
SELECT run_id || '/2' AS payload, NULL::INTEGER AS place, CASE k WHEN 4 THEN 'no payload' ELSE 'not json' END AS reason FROM r WHERE k IN (3, 4)
UNION ALL SELECT run_id || '/2', 0, 'no record' FROM r WHERE k IN (5, 6)
UNION ALL SELECT run_id || '/2', 1, 'missing dataset' FROM r WHERE k = 6
UNION ALL SELECT run_id || '/2', 2, 'missing colName' FROM r WHERE k = 6""")
def profile_delta_rejects_orders(spark, sf):
    """The reject table of the same payloads."""
    return S.rejected(delta_payloads(spark, sf)).select("payload", "place", "reason")


@register("topn_payloads_part", f"""
WITH t AS ({_sql_topn("part", _TOPN_PART_COLS, 5)})
SELECT 'part' AS dataset, '2024-01-31' AS run_id, column_name,
  (row_number() OVER (PARTITION BY column_name ORDER BY CASE WHEN profile_type = 'TOPN' THEN 0 ELSE 100 END + rank) - 1)::INTEGER AS pos,
  profile_type, CASE WHEN rank = 2 THEN NULL ELSE value END AS value, CASE WHEN rank = 3 THEN NULL ELSE count END AS count
FROM t""")
def topn_payloads_part(spark, sf):
    """Top-N payloads (one JSON list per column of ``part``; counts as
    text, some of them no number, some values spelled ``null`` or blank)."""
    lists = P.topn_bottomn(table(spark, sf, "part"), _TOPN_PART_COLS, n=5)
    count = F.when(F.col("rank") == 3, "many").otherwise(F.col("count").cast("string"))
    value = F.when(F.col("rank") == 2, F.when(F.col("profile_type") == "TOPN", "null").otherwise("")).otherwise(F.col("value"))
    record = F.struct((F.when(F.col("profile_type") == "TOPN", 0).otherwise(100) + F.col("rank")).alias("id"), F.lit("part").alias("dataset"),
                      F.lit("2024-01-31").alias("runId"), F.col("column_name").alias("fieldNm"), F.col("profile_type").alias("fieldFunc"),
                      value.alias("fieldValue"), count.alias("uniqueCnt"), F.lit("2024-01-31 06:00:00").alias("updtTs"))
    payloads = lists.groupBy("column_name").agg(F.to_json(F.collect_list(record)).alias("json"))
    records = S.topn_records(S.accepted(S.checked_records(payloads, required=("dataset", "fieldNm"))))
    norm = P.normalize_topn(records).select("dataset", "run_id", "column_name", F.posexplode("values").alias("pos", "e"))
    return norm.select("dataset", "run_id", "column_name", "pos", "e.profile_type", "e.value", "e.count")
