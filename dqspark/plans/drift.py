"""Drift queries: flagship drift report, adaptive breaks, value drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import drift as D
from dqspark.operators import profile as P
from dqspark.plans.catalog import register, table
from dqspark.plans.profiling import (
    ORDERS_COLS, RUN_PROFILE_SELECT, orders_run, sql_run_profile_orders,
)

LOOKBACK = 6


def orders_runs(spark, sf):
    return P.run_profile(table(spark, sf, "orders"), orders_run(), ORDERS_COLS)


def _sev(x):
    return (f"CASE WHEN {x} IS NULL THEN 'UNKNOWN' WHEN {x} < 1.0 THEN 'NONE' WHEN {x} < 5.0 THEN 'LOW' "
            f"WHEN {x} < 10.0 THEN 'MEDIUM' ELSE 'HIGH' END")


def _rank(x):
    return (f"CASE {x} WHEN 'UNKNOWN' THEN -1 WHEN 'NONE' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 "
            f"WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 END")


_SQL_RUNS = f"SELECT {RUN_PROFILE_SELECT} FROM ({sql_run_profile_orders()})"

SQL_DRIFT_REPORT = f"""
WITH runs AS ({_SQL_RUNS}),
b AS (
  SELECT *,
    count(*) OVER w AS baseline_runs,
    avg(null_pct) OVER w AS avg_null_pct, avg(empty_pct) OVER w AS avg_empty_pct,
    avg(filled_pct) OVER w AS avg_filled_pct, avg(unique_cnt) OVER w AS avg_unique_cnt,
    avg(unique_ratio) OVER w AS avg_unique_ratio,
    lag(data_type) OVER (PARTITION BY column_name ORDER BY run_id) AS historical_type
  FROM runs
  WINDOW w AS (PARTITION BY column_name ORDER BY run_id ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING)),
c AS (
  SELECT *,
    abs(null_pct - avg_null_pct) AS null_change_pp, abs(empty_pct - avg_empty_pct) AS empty_change_pp,
    abs(filled_pct - avg_filled_pct) AS filled_change_pp,
    abs(unique_ratio - avg_unique_ratio) * 100.0 AS distinct_ratio_change_pp,
    abs(unique_cnt - avg_unique_cnt) AS distinct_count_change,
    CASE WHEN avg_unique_cnt IS NULL OR unique_cnt IS NULL THEN NULL
         WHEN avg_unique_cnt = 0 THEN CASE WHEN unique_cnt = 0 THEN 0.0 END
         ELSE abs((unique_cnt - avg_unique_cnt) / avg_unique_cnt * 100.0) END AS distinct_count_rel_pct,
    CASE WHEN historical_type IS NOT NULL AND data_type IS NOT NULL AND historical_type <> data_type THEN 'CRITICAL'
         WHEN historical_type IS NULL AND data_type IS NULL THEN 'UNKNOWN' ELSE 'NONE' END AS schema_severity
  FROM b),
d AS (
  SELECT *, greatest(null_change_pp, empty_change_pp, filled_change_pp) AS completeness_max_pp FROM c),
e AS (
  SELECT *, {_sev('completeness_max_pp')} AS completeness_severity,
         {_sev('distinct_ratio_change_pp')} AS uniqueness_severity FROM d),
f AS (
  SELECT *, greatest({_rank('schema_severity')}, {_rank('completeness_severity')},
                     {_rank('uniqueness_severity')}) AS overall_rank FROM e)
SELECT run_id, column_name, baseline_runs, null_change_pp, empty_change_pp, filled_change_pp,
  completeness_max_pp, completeness_severity, distinct_ratio_change_pp, uniqueness_severity,
  distinct_count_change, distinct_count_rel_pct, schema_severity,
  CASE overall_rank WHEN -1 THEN 'UNKNOWN' WHEN 0 THEN 'NONE' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM'
       WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' ELSE 'UNKNOWN' END AS overall_severity,
  concat_ws(',', CASE WHEN {_rank('schema_severity')} > 0 THEN 'schema' END,
                 CASE WHEN {_rank('completeness_severity')} > 0 THEN 'completeness' END,
                 CASE WHEN {_rank('uniqueness_severity')} > 0 THEN 'uniqueness' END) AS triggered_dimensions
FROM f"""


@register("drift_report_orders", SQL_DRIFT_REPORT)
def drift_report_orders(spark, sf):
    """FLAGSHIP: monthly run profile of orders -> rolling 6-run baseline ->
    schema / completeness / uniqueness severity per (run, column)."""
    return D.drift_report(orders_runs(spark, sf), lookback=LOOKBACK)


# Q10 + J10 -------------------------------------------------------------------
ITEMS = ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey", "Row Count"]
COL_METRICS = ["NULL", "EMPTY", "CARDINALITY", "MEAN VALUE", "MIN VALUE", "MAX VALUE"]


def suppressions_from_nation(nation):
    """Suppression requests derived from the nation rows: each nation key writes
    one (item, metric) state; later keys (ts) overwrite earlier ones."""
    items = F.array(*[F.lit(i) for i in ITEMS])
    mets = F.array(*[F.lit(m) for m in COL_METRICS])
    item = F.element_at(items, (F.col("n_nationkey") % len(ITEMS) + 1).cast("int"))
    metric = F.when(item == "Row Count", F.lit("ROW_COUNT")).otherwise(
        F.element_at(mets, (F.col("n_nationkey") % len(COL_METRICS) + 1).cast("int")))
    return nation.select(
        F.lit("orders").alias("dataset"), item.alias("item"), metric.alias("metricType"),
        F.when(F.col("n_regionkey") < 3, 1).otherwise(0).alias("suppress"),
        F.col("n_nationkey").cast("long").alias("ts"))


SQL_SUPPRESSIONS = f"""
SELECT 'orders' AS dataset, item,
  CASE WHEN item = 'Row Count' THEN 'ROW_COUNT' ELSE ['{"','".join(COL_METRICS)}'][n_nationkey % {len(COL_METRICS)} + 1] END AS metric_type,
  CASE WHEN n_regionkey < 3 THEN 1 ELSE 0 END AS suppress, n_nationkey::BIGINT AS ts
FROM (SELECT *, ['{"','".join(ITEMS)}'][n_nationkey % {len(ITEMS)} + 1] AS item FROM nation)"""

SQL_METRICS = f"""
SELECT 'orders' AS dataset, run_id, column_name AS item, m.metric_type, m.value FROM ({_SQL_RUNS}) r,
  (VALUES ('NULL'), ('EMPTY'), ('CARDINALITY'), ('MIN VALUE'), ('MAX VALUE'), ('MEAN VALUE')) m0(metric_type),
  LATERAL (SELECT m0.metric_type, CASE m0.metric_type WHEN 'NULL' THEN null_pct WHEN 'EMPTY' THEN empty_pct
     WHEN 'CARDINALITY' THEN unique_cnt::DOUBLE WHEN 'MIN VALUE' THEN min_value WHEN 'MAX VALUE' THEN max_value
     ELSE mean_value END AS value) m
WHERE m.value IS NOT NULL
UNION ALL
SELECT 'orders', run_id, 'Row Count', 'ROW_COUNT', max(row_count)::DOUBLE FROM ({_SQL_RUNS}) GROUP BY run_id"""

SQL_ADAPTIVE = f"""
WITH m AS ({SQL_METRICS}),
b AS (SELECT *, count(*) OVER w AS baseline_runs, avg(value) OVER w AS baseline_mean,
             coalesce(stddev_samp(value) OVER w, 0.0) AS sd
      FROM m WINDOW w AS (PARTITION BY dataset, item, metric_type ORDER BY run_id
                          ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING)),
s AS (SELECT dataset, item, metric_type, max_by(suppress, (ts, suppress)) AS suppress
      FROM ({SQL_SUPPRESSIONS}) GROUP BY ALL)
SELECT b.dataset, run_id, b.item, b.metric_type, value, baseline_runs, baseline_mean,
       baseline_mean - 2.0 * sd AS lower_bound, baseline_mean + 2.0 * sd AS upper_bound
FROM b
WHERE baseline_runs >= 3 AND NOT (value BETWEEN baseline_mean - 2.0 * sd AND baseline_mean + 2.0 * sd)
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.suppress = 1 AND s.dataset = b.dataset AND s.item = b.item
                  AND s.metric_type = b.metric_type)"""


@register("adaptive_breaks_orders", SQL_ADAPTIVE)
def adaptive_breaks_orders(spark, sf):
    """Adaptive-rule breaks (mean +- 2 sd over the previous 6 monthly runs,
    at least 3 runs) minus the currently suppressed (item, metric) pairs."""
    runs = orders_runs(spark, sf)
    checked = D.adaptive_check(D.metrics_long(runs, "orders"), lookback=LOOKBACK, k=2.0, min_runs=3)
    breaks = checked.where("is_break")
    sup = suppressions_from_nation(table(spark, sf, "nation"))
    kept = D.suppress_findings(breaks, sup)
    return kept.select("dataset", "run_id", "item", "metric_type", "value", "baseline_runs",
                       "baseline_mean", "lower_bound", "upper_bound")


@register("latest_suppressions_nation", f"""
SELECT dataset, item, metric_type, max_by(suppress, (ts, suppress)) AS suppress, max(ts) AS ts
FROM ({SQL_SUPPRESSIONS}) GROUP BY ALL""")
def latest_suppressions_nation(spark, sf):
    return D.latest_suppressions(suppressions_from_nation(table(spark, sf, "nation")))


# J12 -----------------------------------------------------------------------
WEEK1 = ("2024-01-01", "2024-01-08")
WEEK4 = ("2024-01-22", "2024-01-29")


def _sql_vdrift(expr, name):
    return f"""
SELECT '{name}' AS column_name, coalesce(a.value, b.value) AS value, coalesce(count_a, 0) AS count_a,
  coalesce(count_b, 0) AS count_b, coalesce(count_b, 0) - coalesce(count_a, 0) AS count_change,
  CASE WHEN count_a IS NULL THEN 'appeared' WHEN count_b IS NULL THEN 'disappeared'
       WHEN count_a <> count_b THEN 'changed' ELSE 'unchanged' END AS status
FROM (SELECT CAST({expr} AS VARCHAR) AS value, count(*) AS count_a FROM events
      WHERE ts >= TIMESTAMP '{WEEK1[0]}' AND ts < TIMESTAMP '{WEEK1[1]}' GROUP BY 1) a
FULL OUTER JOIN
     (SELECT CAST({expr} AS VARCHAR) AS value, count(*) AS count_b FROM events
      WHERE ts >= TIMESTAMP '{WEEK4[0]}' AND ts < TIMESTAMP '{WEEK4[1]}' GROUP BY 1) b
ON a.value IS NOT DISTINCT FROM b.value"""


@register("value_drift_events", _sql_vdrift("event_type", "event_type") + "\nUNION ALL\n"
          + _sql_vdrift("json_extract_string(props, '$.k')", "props.k"))
def value_drift_events(spark, sf):
    """Value-distribution drift of events between week 1 and week 4: both
    weeks and both columns in one scan and one grouped aggregation."""
    ev = table(spark, sf, "events").select(
        "ts", "event_type", F.get_json_object("props", "$.k").alias("props.k"))
    def within(w):
        return (F.col("ts") >= F.lit(w[0]).cast("timestamp_ntz")) & (F.col("ts") < F.lit(w[1]).cast("timestamp_ntz"))
    week = F.when(within(WEEK1), F.lit("week1")).when(within(WEEK4), F.lit("week4"))
    ev = ev.where(within(WEEK1) | within(WEEK4))            # plain range predicates: pushed into the scan
    return D.value_drift_by_run(ev, week, "week1", "week4", ["event_type", "props.k"])
