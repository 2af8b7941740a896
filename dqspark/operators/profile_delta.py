"""Profile-delta records: every field, then schema, completeness and uniqueness drift."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.functions.exprs import adaptive_break
from dqspark.operators.drift import assess_drift
from dqspark.sources.payloads import field, number_field

#: Payload field of each baseline average.
BASELINE_FIELDS = {
    "average_null_percent": "avg_nulls", "average_empty_percent": "avg_empties", "average_filled_percent": "avg_filled_ratio",
    "average_distinct_count": "avg_unique_cnt", "median_distinct_count": "median_unique_cnt",
    "average_distinct_ratio": "avg_uniques", "median_distinct_ratio": "median_unique_ratio",
    "average_numeric_min": "avg_min_abs_num", "average_numeric_max": "avg_max_abs_num", "average_numeric_mean": "avg_mean_abs_num",
}
#: Payload field of each reported delta.
DELTA_FIELDS = {
    "datatype": "dtcntDelta", "null": "ncntDelta", "empty": "ecntDelta", "distinct_count": "uniqueDelta",
    "distinct_percent": "uniqueDeltaPercent", "overall": "changePercent", "overall_with_uniques": "changePercentWithUniques",
}
#: Payload field of each flag of the current schema.
METADATA_FIELDS = {"is_key": "isKey", "is_pii": "isPii", "is_mnpi": "isMnpi", "is_masked": "isMasked", "enabled": "enabled"}


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_records(records: DataFrame, record: str = "record") -> DataFrame:
    """E6 for VARIANT records: nested, typed columns ``dataset, column, run_id,
    data_type, current_profile, baseline_profile, delta,
    generated_failure_condition, schema_metadata, passed``.

    The detected type is the first that is given of actual, current and
    historical type; extremes and the mean prefer their numeric form.  A
    nested object that is absent or null gives nulls."""
    r = record
    historical, current = field(r, "historicalSchema.colSchema"), field(r, "currentSchema.colSchema")
    actual = field(r, "datasetField.actualDataType")
    has_mean = field(r, "datasetField.meanAbsNum").isNotNull()
    pass_fail = field(r, "datasetField.passFail", "int")
    return records.select(
        field(r, "dataset").alias("dataset"), field(r, "colName").alias("column"), field(r, "datasetField.runId").alias("run_id"),
        F.struct(historical.alias("historical"), current.alias("current"),
                 F.coalesce(_given(actual), _given(current), historical).alias("detected"),
                 F.coalesce(historical != current, F.lit(False)).alias("changed")).alias("data_type"),
        F.struct(number_field(r, "datasetField.nullRatio").alias("null_percent"),
                 number_field(r, "datasetField.emptyRatio").alias("empty_percent"),
                 number_field(r, "datasetField.filledRatio").alias("filled_percent"),
                 number_field(r, "datasetField.uniqueCnt").alias("distinct_count"),
                 number_field(r, "datasetField.uniqueRatio").alias("distinct_ratio"),
                 F.coalesce(field(r, "datasetField.minAbsNum"), field(r, "datasetField.minAbs")).alias("minimum"),
                 F.coalesce(field(r, "datasetField.maxAbsNum"), field(r, "datasetField.maxAbs")).alias("maximum"),
                 F.when(has_mean, number_field(r, "datasetField.meanAbsNum"))
                 .otherwise(number_field(r, "datasetField.meanAbs")).alias("mean"),
                 actual.alias("actual_data_type"), pass_fail.alias("pass_fail")).alias("current_profile"),
        F.struct(*[number_field(r, f"baseline.{f}").alias(n) for n, f in BASELINE_FIELDS.items()]).alias("baseline_profile"),
        F.struct(*[number_field(r, f).alias(n) for n, f in DELTA_FIELDS.items()]).alias("delta"),
        field(r, "validValuesRule").alias("generated_failure_condition"),
        F.struct(*[field(r, f"currentSchema.{f}", "boolean").alias(n) for n, f in METADATA_FIELDS.items()]).alias("schema_metadata"),
        F.coalesce(pass_fail == 1, F.lit(False)).alias("passed"))


#: Columns that the drift assessment reads, and where a normalised record has them.
_ASSESSED = {
    "historical_type": "data_type.historical", "current_type": "data_type.current", "detected_type": "data_type.detected",
    "null_pct": "current_profile.null_percent", "avg_null_pct": "baseline_profile.average_null_percent",
    "empty_pct": "current_profile.empty_percent", "avg_empty_pct": "baseline_profile.average_empty_percent",
    "filled_pct": "current_profile.filled_percent", "avg_filled_pct": "baseline_profile.average_filled_percent",
    "unique_cnt": "current_profile.distinct_count", "avg_unique_cnt": "baseline_profile.average_distinct_count",
    "unique_ratio": "current_profile.distinct_ratio", "avg_unique_ratio": "baseline_profile.average_distinct_ratio",
}


def assess_records(normalized: DataFrame, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """E7 on normalised records: adds ``adaptive_break`` (F13) and the struct
    ``drift`` with a severity and a reason for each dimension and over all.
    One projection; no shuffle."""
    kept = normalized.columns
    flat = normalized.select(F.struct(*kept).alias("_row"), *[F.col(src).alias(c) for c, src in _ASSESSED.items()])
    a = assess_drift(flat, thresholds, historical_type="historical_type", current_type="current_type", detected_type="detected_type")
    return a.select("_row.*", adaptive_break(F.col("_row.current_profile.pass_fail")).alias("adaptive_break"), F.struct(
        "schema_changed", "detected_type_mismatch", "schema_severity", "schema_reason",
        "null_change_pp", "empty_change_pp", "filled_change_pp", "completeness_max_pp", "completeness_severity", "completeness_reason",
        "distinct_count_change", "distinct_count_rel_pct", "distinct_ratio_change_pp", "uniqueness_severity", "uniqueness_reason",
        "overall_severity", "triggered_dimensions", "overall_reason").alias("drift"))
