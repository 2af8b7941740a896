"""Ingestion of result payloads as VARIANT, with a table of what was refused.

A payload is JSON text that holds one record or a list of records.  Fields
are read by path, whatever type the producer gave them, so one odd value
costs its field and not its record; text that is no JSON, and entries that
are no records, become rows of the reject table instead of vanishing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.functions.exprs import py_strip, safe_float


def field(record: str | Column, path: str, dtype: str = "string") -> Column:
    """The value at ``path`` of a VARIANT record as ``dtype``; absent, JSON null
    or not convertible: null."""
    return F.try_variant_get(F.col(record) if isinstance(record, str) else record, f"$.{path}", dtype)


def number_field(record: str | Column, path: str) -> Column:
    """A number, given as such or as text."""
    return safe_float(field(record, path))


def checked_records(payloads: DataFrame, json_col: str = "json", required: Sequence[str] = ("dataset",)) -> DataFrame:
    """One row per record of every payload: the payload's other columns,
    ``place`` (0-based in its list; null if there is no record), ``record``
    (VARIANT) and ``reason``: null if the record can be used, else

    * ``no payload``: null or blank text
    * ``not json``: text that does not parse
    * ``no record``: an entry that is no object
    * ``missing <field>``: a ``required`` field is absent, null or blank

    An empty list has no records and gives no row."""
    others = [c for c in payloads.columns if c != json_col]
    v = payloads.select(*others, F.col(json_col).alias("_json"), F.try_parse_json(json_col).alias("_v"))
    text = F.coalesce(py_strip("_json"), F.lit(""))
    listed = F.when(F.col("_v").isNotNull(), F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), F.array("_v")))
    # a payload that cannot be read keeps one row, a list without entries none
    rows = v.withColumn("_bad", F.when(text == "", "no payload").when(F.col("_v").isNull(), "not json"))
    rows = rows.withColumn("_list", F.when(F.col("_bad").isNotNull(), F.array(F.col("_v"))).otherwise(listed))
    rows = rows.select(*others, "_bad", F.posexplode("_list").alias("place", "record"))
    missing = F.lit(None).cast("string")
    for name in reversed(required):
        missing = F.when(F.coalesce(py_strip(field("record", name)), F.lit("")) == "", f"missing {name}").otherwise(missing)
    is_record = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    return rows.select(*others, F.when(F.col("_bad").isNull(), F.col("place")).alias("place"), "record",
                       F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(~is_record, "no record").otherwise(missing).alias("reason"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNull()).drop("reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNotNull()).drop("record")


def topn_records(records: DataFrame, record: str = "record") -> DataFrame:
    """Top-N / bottom-N records as the columns that ``profile.normalize_topn``
    reads; ``uniqueCnt`` that is no whole number becomes null."""
    count = number_field(record, "uniqueCnt")
    return records.select(
        F.coalesce(number_field(record, "id").cast("long"), F.col("place").cast("long")).alias("id"),
        *[field(record, c).alias(c) for c in ("dataset", "runId", "fieldNm", "fieldFunc", "fieldValue")],
        F.when(count == F.floor(count), count.cast("long")).alias("uniqueCnt"), field(record, "updtTs").alias("updtTs"))
