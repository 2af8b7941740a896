"""Drift operators: A10 W5 E7 E26 Q10 J10 J12 (E6: ``profile_delta``).

The run-metrics table these operate on has one row per (dataset, column,
run): tiny next to the scanned data, so windows partitioned by
(dataset, column) are cheap.  The expensive part - the run profile - is one
scan (see ``profile.run_profile``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.exprs import (
    py_strip,
    SEVERITY_RANK, abs_diff, highest_severity, relative_change_pct, severity,
    severity_rank, validate_thresholds,
)
from dqspark.operators.profile import unpivot

# --------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# --------------------------------------------------------------------------
# Adaptive-rule metric types accepted for boundary suppression.
COLUMN_METRIC_TYPES = ["NULL", "EMPTY", "CARDINALITY", "MEAN VALUE", "MIN VALUE", "MAX VALUE", "DATA_TYPE"]
DATASET_METRIC_TYPES = ["ROW_COUNT", "TIME"]
METRIC_TYPES = COLUMN_METRIC_TYPES + DATASET_METRIC_TYPES
# Pseudo-items for the dataset-level metrics.
GENERIC_ITEM_NAMES = {"ROW_COUNT": "Row Count", "TIME": "Load Time"}
# --------------------------------------------------------------------------


# W5 / A10 -----------------------------------------------------------------
def _frame_median(c: str, w) -> Column:
    """Median over a bounded window frame (at most ``lookback`` values):
    ``median`` itself cannot take a frame, so sort the frame's values."""
    a = F.array_sort(F.collect_list(F.col(c).cast("double")).over(w))
    n = F.size(a)
    lo = F.element_at(a, F.floor((n + 1) / 2).cast("int"))
    hi = F.element_at(a, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, lo).otherwise((lo + hi) / 2.0)


def rolling_baseline(runs: DataFrame, lookback: int = 6, keys: Sequence[str] = ("column_name",),
                     order: str = "run_id") -> DataFrame:
    """Add baseline columns computed over the ``lookback`` runs strictly before
    each run (``rowsBetween(-lookback, -1)``): averages of null/empty/filled
    percent, distinct count and ratio, numeric min/max/mean; medians of
    distinct count and ratio; the previous run's data type; and the number of
    runs in the baseline."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-lookback, -1)
    prev = Window.partitionBy(*keys).orderBy(order)
    return runs.select(
        "*",
        F.count(F.lit(1)).over(w).alias("baseline_runs"),
        F.avg("null_pct").over(w).alias("avg_null_pct"),
        F.avg("empty_pct").over(w).alias("avg_empty_pct"),
        F.avg("filled_pct").over(w).alias("avg_filled_pct"),
        F.avg("unique_cnt").over(w).alias("avg_unique_cnt"),
        _frame_median("unique_cnt", w).alias("median_unique_cnt"),
        F.avg("unique_ratio").over(w).alias("avg_unique_ratio"),
        _frame_median("unique_ratio", w).alias("median_unique_ratio"),
        F.avg("min_value").over(w).alias("avg_min_value"),
        F.avg("max_value").over(w).alias("avg_max_value"),
        F.avg("mean_value").over(w).alias("avg_mean_value"),
        F.lag("data_type").over(prev).alias("historical_type"))


# E7 ------------------------------------------------------------------------
def assess_drift(df: DataFrame, thresholds: Mapping[str, float] | None = None,
                 historical_type: str = "historical_type", current_type: str = "data_type",
                 detected_type: str = "data_type") -> DataFrame:
    """Schema, completeness and uniqueness drift per row of current-vs-baseline
    metrics, in one projection.

    * schema: CRITICAL if the type changed between baseline and current; HIGH
      if the detected type differs from the current schema type; UNKNOWN if
      both schema types are missing; else NONE.
    * completeness: severity of the largest of the null / empty / filled
      percentage-point changes.
    * uniqueness: severity of the distinct-ratio change (a fraction, x100 to
      get percentage points); the distinct-count change is context only.
    * overall: the highest of the three; triggered dimensions are those above
      NONE.
    """
    t = validate_thresholds(thresholds)
    ht, ct, dt = F.col(historical_type), F.col(current_type), F.col(detected_type)
    changed = ht.isNotNull() & ct.isNotNull() & (ht != ct)
    mismatch = dt.isNotNull() & ct.isNotNull() & (dt != ct)
    schema_sev = (F.when(changed, "CRITICAL").when(mismatch, "HIGH")
                  .when(ht.isNull() & ct.isNull(), "UNKNOWN").otherwise("NONE"))

    # inputs are typed doubles here (E6 applies safe_float to raw payloads)
    null_pp = abs_diff("null_pct", "avg_null_pct")
    empty_pp = abs_diff("empty_pct", "avg_empty_pct")
    filled_pp = abs_diff("filled_pct", "avg_filled_pct")
    ratio_pp = abs_diff("unique_ratio", "avg_unique_ratio") * 100.0

    out = df.select(
        "*",
        changed.alias("schema_changed"), mismatch.alias("detected_type_mismatch"),
        schema_sev.alias("schema_severity"),
        null_pp.alias("null_change_pp"), empty_pp.alias("empty_change_pp"),
        filled_pp.alias("filled_change_pp"),
        ratio_pp.alias("distinct_ratio_change_pp"),
        abs_diff("unique_cnt", "avg_unique_cnt").alias("distinct_count_change"),
        relative_change_pct("unique_cnt", "avg_unique_cnt").alias("distinct_count_rel_pct"))
    mx = F.greatest("null_change_pp", "empty_change_pp", "filled_change_pp")
    out = out.withColumn("completeness_max_pp", mx)
    largest = (F.when(F.col("null_change_pp") == mx, "null percentage")
               .when(F.col("empty_change_pp") == mx, "empty percentage")
               .when(F.col("filled_change_pp") == mx, "filled percentage"))
    out = out.withColumn("completeness_severity", severity("completeness_max_pp", t)) \
             .withColumn("uniqueness_severity", severity("distinct_ratio_change_pp", t))
    overall = highest_severity("schema_severity", "completeness_severity", "uniqueness_severity")
    trig = F.concat_ws(",", *[F.when(severity_rank(c) > SEVERITY_RANK["NONE"], F.lit(n))
                             for n, c in (("schema", "schema_severity"),
                                          ("completeness", "completeness_severity"),
                                          ("uniqueness", "uniqueness_severity"))])
    return out.select(
        "*",
        overall.alias("overall_severity"),
        trig.alias("triggered_dimensions"),
        F.when(F.col("completeness_max_pp").isNull(), "completeness metrics unavailable")
         .when(F.col("completeness_severity") == "NONE", F.lit(f"below {t['none_upper']} pp noise threshold"))
         .otherwise(F.format_string("largest change: %s, %.5f pp", largest, F.col("completeness_max_pp")))
         .alias("completeness_reason"),
        F.when(F.col("schema_changed"), F.format_string("type went from %s to %s", ht, ct))
         .when(F.col("detected_type_mismatch"), F.format_string("values look like %s, the schema says %s", dt, ct))
         .when(F.col("schema_severity") == "UNKNOWN", "no schema type on either side")
         .otherwise("same schema type").alias("schema_reason"),
        F.when(F.col("distinct_ratio_change_pp").isNull(), "distinct ratio unavailable")
         .when(F.col("uniqueness_severity") == "NONE", F.lit(f"below {t['none_upper']} pp noise threshold"))
         .otherwise(F.format_string("distinct ratio moved by %.5f pp", F.col("distinct_ratio_change_pp")))
         .alias("uniqueness_reason"),
        F.when(overall == "UNKNOWN", "too little is known to judge")
         .when(overall == "NONE", "no dimension above the noise threshold")
         .otherwise(F.format_string("highest severity %s in %s", overall, trig)).alias("overall_reason"))


def drift_report(runs: DataFrame, lookback: int = 6, thresholds: Mapping[str, float] | None = None,
                 keys: Sequence[str] = ("column_name",)) -> DataFrame:
    """Run profile -> rolling baseline -> assessment (the flagship chain)."""
    assessed = assess_drift(rolling_baseline(runs, lookback, keys), thresholds)
    return assessed.select(
        "run_id", *keys, "baseline_runs", "null_change_pp", "empty_change_pp", "filled_change_pp",
        "completeness_max_pp", "completeness_severity", "distinct_ratio_change_pp",
        "uniqueness_severity", "distinct_count_change", "distinct_count_rel_pct",
        "schema_severity", "overall_severity", "triggered_dimensions")


# Q10 -----------------------------------------------------------------------
def metrics_long(runs: DataFrame, dataset: str | Column = "dataset") -> DataFrame:
    """Run profile -> (dataset, run_id, item, metric_type, value) for the
    adaptive metrics NULL, EMPTY, CARDINALITY, MIN/MAX/MEAN VALUE (numeric
    columns) and the dataset-level ROW_COUNT (item 'Row Count').

    ROW_COUNT comes out of the same projection as the column metrics (every
    column row carries the run's row count; the tiny metrics table is then
    deduplicated), so the profiled table is scanned once."""
    ds = F.lit(dataset) if isinstance(dataset, str) and dataset not in runs.columns else (
        F.col(dataset) if isinstance(dataset, str) else dataset)
    base = runs.select(ds.alias("dataset"), "*") if "dataset" not in runs.columns else runs
    per_col = [("NULL", "null_pct"), ("EMPTY", "empty_pct"), ("CARDINALITY", "unique_cnt"),
               ("MIN VALUE", "min_value"), ("MAX VALUE", "max_value"), ("MEAN VALUE", "mean_value")]
    entries = [F.struct(F.col("column_name").alias("item"), F.lit(m).alias("metric_type"),
                        F.col(c).cast("double").alias("value")) for m, c in per_col]
    entries.append(F.struct(F.lit(GENERIC_ITEM_NAMES["ROW_COUNT"]).alias("item"), F.lit("ROW_COUNT").alias("metric_type"),
                            F.col("row_count").cast("double").alias("value")))
    long = base.select("dataset", "run_id", F.inline(F.array(*entries))).where(F.col("value").isNotNull())
    return long.groupBy("dataset", "run_id", "item", "metric_type").agg(F.max("value").alias("value"))


def adaptive_check(metrics: DataFrame, lookback: int = 6, k: float = 2.0, min_runs: int = 3,
                   enabled: Sequence[str] | None = None) -> DataFrame:
    """Adaptive bounds per (dataset, item, metric): mean +- k * stddev of the
    previous ``lookback`` runs, evaluated once at least ``min_runs`` earlier
    runs exist.  ``is_break`` is the failure condition
    ``value NOT BETWEEN lower_bound AND upper_bound``.  (Bounds formula is ours;
    the reference reads them from an external service.)"""
    m = metrics if enabled is None else metrics.where(F.col("metric_type").isin(*enabled))
    w = Window.partitionBy("dataset", "item", "metric_type").orderBy("run_id").rowsBetween(-lookback, -1)
    b = m.select("*", F.count(F.lit(1)).over(w).alias("baseline_runs"),
                 F.avg("value").over(w).alias("baseline_mean"),
                 F.stddev_samp("value").over(w).alias("baseline_std"))
    sd = F.coalesce(F.col("baseline_std"), F.lit(0.0))
    b = b.select("*", (F.col("baseline_mean") - k * sd).alias("lower_bound"),
                 (F.col("baseline_mean") + k * sd).alias("upper_bound"))
    ready = F.col("baseline_runs") >= min_runs
    return b.withColumn("is_break", ready & ~F.col("value").between(F.col("lower_bound"), F.col("upper_bound")))


def load_time_metrics(jobs: DataFrame) -> DataFrame:
    """TIME: seconds from ``started_at`` to ``finished_at`` of each run of a
    dataset, as rows for :func:`adaptive_check` (unfinished runs: none)."""
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return jobs.select("dataset", "run_id", F.lit(GENERIC_ITEM_NAMES["TIME"]).alias("item"), F.lit("TIME").alias("metric_type"),
                       seconds.alias("value")).where(F.col("value").isNotNull())


def categorical_check(metrics: DataFrame, lookback: int = 6, min_runs: int = 3) -> DataFrame:
    """Adaptive check of a metric without order, as DATA_TYPE (``dataset,
    run_id, item, metric_type, category``): ``seen`` are the categories of the
    ``lookback`` runs before, ``usual`` the most frequent of them (ties: the
    first in order); a run breaks if its category is not among them, once
    ``min_runs`` earlier runs exist."""
    w = Window.partitionBy("dataset", "item", "metric_type").orderBy("run_id").rowsBetween(-lookback, -1)
    b = metrics.where(F.col("category").isNotNull()).withColumn("_a", F.collect_list("category").over(w))  # at most lookback values
    counted = F.transform(F.array_distinct("_a"), lambda v: F.struct((-F.size(F.filter("_a", lambda x: x == v))).alias("n"), v.alias("v")))
    return b.select(*metrics.columns, F.size("_a").cast("long").alias("baseline_runs"), F.array_min(counted)["v"].alias("usual"),
                    F.array_sort(F.array_distinct("_a")).alias("seen"),
                    ((F.size("_a") >= min_runs) & ~F.array_contains("_a", F.col("category"))).alias("is_break"))


# J10 -----------------------------------------------------------------------
def latest_suppressions(suppressions: DataFrame) -> DataFrame:
    """Latest write wins per (dataset, item, metric_type); ties on ts go to
    the larger suppress value.  Dataset-level metrics use their pseudo-item."""
    s = suppressions.withColumn(
        "item", F.when(F.col("metricType") == "ROW_COUNT", GENERIC_ITEM_NAMES["ROW_COUNT"])
        .when(F.col("metricType") == "TIME", GENERIC_ITEM_NAMES["TIME"]).otherwise(F.col("item")))
    return (s.groupBy("dataset", "item", F.col("metricType").alias("metric_type"))
            .agg(F.max_by("suppress", F.struct("ts", "suppress")).alias("suppress"),
                 F.max("ts").alias("ts")))


def suppress_findings(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Drop findings whose (dataset, item, metric_type) is currently
    suppressed (anti join on the latest state)."""
    active = latest_suppressions(suppressions).where(F.col("suppress") == 1) \
        .select("dataset", "item", "metric_type")
    return findings.join(active, ["dataset", "item", "metric_type"], "left_anti")


def audit_suppressions(req: DataFrame) -> DataFrame:
    """Q6: validation issues of suppression requests (metric in the 9 types,
    suppress 0/1, item present, dataset-level metrics on their pseudo-item)."""
    mt, item = F.col("metricType"), F.col("item")
    issues = F.array_compact(F.array(
        F.when(~F.coalesce(mt.isin(*METRIC_TYPES), F.lit(False)), F.lit("unknown metric type")),
        F.when(~F.coalesce(F.col("suppress").isin(0, 1), F.lit(False)), F.lit("suppress must be 0 or 1")),
        F.when(F.coalesce(py_strip(item), F.lit("")) == "", F.lit("item is required")),
        F.when((mt == "ROW_COUNT") & (item != GENERIC_ITEM_NAMES["ROW_COUNT"]),
               F.lit("ROW_COUNT applies to item 'Row Count'")),
        F.when((mt == "TIME") & (item != GENERIC_ITEM_NAMES["TIME"]),
               F.lit("TIME applies to item 'Load Time'"))))
    return req.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


# J12 -----------------------------------------------------------------------
def _drift_status(ca: Column, cb: Column) -> Column:
    return (F.when(ca == 0, "appeared").when(cb == 0, "disappeared")
            .when(ca != cb, "changed").otherwise("unchanged"))


def value_distribution_drift(run_a: DataFrame, run_b: DataFrame, col: str) -> DataFrame:
    """Which values appeared, disappeared or changed count between two runs.

    The two runs are unioned with a side flag and counted in ONE grouped
    aggregation (partial per partition, one row per value and partition), so
    there is a single shuffle and no join; null is a value like any other."""
    a = run_a.select(F.col(col).cast("string").alias("value"), F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = run_b.select(F.col(col).cast("string").alias("value"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    g = a.unionByName(b).groupBy("value").agg(F.sum("_a").cast("long").alias("count_a"),
                                              F.sum("_b").cast("long").alias("count_b"))
    ca, cb = F.col("count_a"), F.col("count_b")
    return g.select("value", "count_a", "count_b", (cb - ca).alias("count_change"),
                    _drift_status(ca, cb).alias("status"))


def value_drift_by_run(df: DataFrame, run: Column, run_a, run_b, cols: Sequence[str]) -> DataFrame:
    """J12 for several columns of one table in ONE scan: rows of run ``run_a``
    and run ``run_b`` (values of the ``run`` expression; the filter reaches the
    scan) are unpivoted to (column_name, value) and counted per side with
    conditional counts in a single grouped aggregation.
    Output: column_name, value, count_a, count_b, count_change, status."""
    side = F.when(run == F.lit(run_a), F.lit("a")).when(run == F.lit(run_b), F.lit("b"))
    d = df.select(side.alias("_side"), *[F.col(f"`{c}`") for c in cols]).where(F.col("_side").isNotNull())
    long = unpivot(d, cols, ids=["_side"], value="string")
    g = long.groupBy("column_name", "value").agg(F.count_if(F.col("_side") == "a").alias("count_a"),
                                                  F.count_if(F.col("_side") == "b").alias("count_b"))
    ca, cb = F.col("count_a"), F.col("count_b")
    return g.select("column_name", "value", "count_a", "count_b", (cb - ca).alias("count_change"),
                    _drift_status(ca, cb).alias("status"))


# E26 -----------------------------------------------------------------------
def metric_deltas(runs: DataFrame, metric: str, base_col: str) -> DataFrame:
    """Current minus baseline and the percent of the baseline, rounded to 2."""
    from dqspark.functions.exprs import delta_pct
    return runs.select("*", *delta_pct(metric, base_col))
