"""Stored, mergeable profile states (A9 A10 ST5).

A state is what a run leaves of a column: counts, extremes, a sum, a
distinct-count sketch and a quantile sketch, a few kilobytes whatever the
number of rows.  States of days make weeks, states of partitions make
tables: a baseline or a sliding window merges stored states and never reads
the data again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from dqspark.functions.exprs import py_strip

#: Size parameters: 2^LG_K registers of the distinct sketch (about 0.8 % standard
#: error) and K of the quantile sketch (rank error about 0.7 %).
LG_K, K = 14, 400

STATE_COLUMNS = ["row_count", "null_count", "empty_count", "min_value", "max_value", "sum_value", "numeric_count",
                 "distinct_sketch", "quantile_sketch"]


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def state_rows(df: DataFrame, cols: Sequence[str], ids: Sequence[Column]) -> DataFrame:
    """One row per cell of ``cols``: its hash (null: null), whether it is empty
    text, and its number.  No cell is turned into text."""
    cells = []
    for c in cols:
        t = df.schema[c].dataType
        v = F.col(_q(c))
        number = v.cast("double") if isinstance(t, NumericType) else F.lit(None).cast("double")
        if t.simpleString() in ("double", "float"):
            v = F.when(v == 0, F.lit(0.0)).otherwise(v)  # 0.0 and -0.0 are one value
        cells.append(F.struct(F.lit(c).alias("column_name"), F.lit(t.simpleString()).alias("data_type"),
                              F.when(v.isNotNull(), F.xxhash64(v)).alias("h"),
                              (F.coalesce(py_strip(v) == "", F.lit(False)) if isinstance(t, StringType) else F.lit(False)).alias("is_empty"),
                              number.alias("x")))
    return df.select(*ids, F.inline(F.array(*cells)))


def state_aggregates() -> list[Column]:
    """The aggregates of a state, over :func:`state_rows`; all combine on the
    map side, and in streaming state too."""
    finite = F.when(~F.isnan("x"), F.col("x"))
    return [F.count("*").alias("row_count"), F.count_if(F.col("h").isNull()).alias("null_count"), F.count_if("is_empty").alias("empty_count"),
            F.min("x").alias("min_value"), F.max("x").alias("max_value"), F.sum("x").alias("sum_value"), F.count("x").alias("numeric_count"),
            F.hll_sketch_agg("h", LG_K).alias("distinct_sketch"), F.kll_sketch_agg_double(finite, F.lit(K)).alias("quantile_sketch")]


def profile_state(df: DataFrame, run: Column, cols: Sequence[str], dataset: str) -> DataFrame:
    """``dataset, run_id, column_name, data_type`` and the state of every run
    and column, in one pass and one shuffle of partial states."""
    rows = state_rows(df, cols, [F.lit(dataset).alias("dataset"), run.alias("run_id")])
    return rows.groupBy("dataset", "run_id", "column_name", "data_type").agg(*state_aggregates())


def write_states(states: DataFrame, path: str) -> None:
    """Store states by dataset and run; a run that is profiled again replaces
    its states."""
    (states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "run_id").parquet(path))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).withColumns({"run_id": F.col("run_id").cast("string")})


def merge_aggregates(over=None) -> list[Column]:
    """Aggregates that merge states, in a group or over a window frame."""
    plain = [F.sum("row_count"), F.sum("null_count"), F.sum("empty_count"), F.min("min_value"), F.max("max_value"), F.sum("sum_value"),
             F.sum("numeric_count"), F.hll_union_agg("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch")]
    return [(p if over is None else p.over(over)).alias(n) for p, n in zip(plain, STATE_COLUMNS, strict=True)]


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    return states.groupBy(*keys).agg(*merge_aggregates())


def rolling_states(states: DataFrame, first: int, last: int, keys: Sequence[str] = ("dataset", "column_name"), order: str = "run_id") -> DataFrame:
    """Each run's merged state of the runs ``first`` to ``last`` places from it
    (-6, -1: the six before it), with ``n_runs`` merged.  Frames hold a few
    stored states each; no data is read."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(first, last)
    others = [c for c in states.columns if c not in STATE_COLUMNS]
    return states.select(*others, F.count("*").over(w).alias("n_runs"), *merge_aggregates(w)).where("n_runs > 0")


def sliding_states(states: DataFrame, day: Column, days: int, keys: Sequence[str] = ("column_name",)) -> DataFrame:
    """Each pane's merged state of the ``days`` days that end with it."""
    w = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-(days - 1), 0)
    others = [c for c in states.columns if c not in STATE_COLUMNS]
    return states.withColumn("_day", day).select(*others, F.count("*").over(w).alias("n_panes"), *merge_aggregates(w))


def metrics(states: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """What a state says: percents, distinct count and ratio, extremes, mean
    and quantiles (null where a column has no numbers)."""
    n = F.col("row_count")
    q = F.array(*[F.lit(float(x)) for x in quantiles])
    has = F.kll_sketch_get_n_double("quantile_sketch") > 0
    others = [c for c in states.columns if c not in STATE_COLUMNS]
    return states.select(
        *others, "row_count", (F.col("null_count") * 100.0 / n).alias("null_pct"), (F.col("empty_count") * 100.0 / n).alias("empty_pct"),
        ((n - F.col("null_count") - F.col("empty_count")) * 100.0 / n).alias("filled_pct"),
        F.hll_sketch_estimate("distinct_sketch").alias("unique_cnt"), (F.hll_sketch_estimate("distinct_sketch") / n).alias("unique_ratio"),
        "min_value", "max_value", F.try_divide("sum_value", "numeric_count").alias("mean_value"),
        F.when(has, F.kll_sketch_get_quantile_double("quantile_sketch", q)).alias("quantiles"))
