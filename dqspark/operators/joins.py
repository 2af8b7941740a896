"""Join helpers: null-aware key joins (J1).  Broadcasts are left to the planner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def key_condition(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool):
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k]) if null_safe else (left[k] == right[k])
        cond = c if cond is None else (cond & c)
    return cond


def filter_new_rows(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key tuple is not in ``existing``.  Missing
    matches missing (null-safe equality), as pandas ``isin`` does."""
    ex = existing.select(*keys).distinct()
    return df.join(ex, key_condition(df, ex, keys, null_safe=True), "left_anti")
