"""Readers and result ingestion: S1-S5, S14 (S15 lives in ``operators.rules``).

Everything returns a lazy DataFrame; limits are applied with ``limit`` so
Spark stops reading early (CollectLimit / local limit per partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def clamp(n, lo, hi) -> int:
    return max(lo, min(hi, int(n)))


# S1 ------------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """All columns, or the listed ones (names may hold spaces, e.g.
    "Data Domain"); Catalyst prunes the scan to the selected columns."""
    df = spark.read.format(fmt).load(path)
    return df.select(*[F.col(_q(c)) for c in columns]) if columns else df


# S2 ------------------------------------------------------------------------
def sample_table(df: DataFrame, limit: int = 10, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """Up to ``limit`` rows (clamped 1..50).  The reference takes arbitrary
    rows; pass ``order_by`` for a deterministic sample (TakeOrderedAndProject,
    a per-partition top-k, never a full sort)."""
    n = clamp(limit, 1, 50)
    return (df.orderBy(*order_by) if order_by else df).limit(n)


# S3 ------------------------------------------------------------------------
def sample_csv(spark: SparkSession, path: str, limit: int = 10, max_bytes: int = 256 * 1024,
               schema: str | None = None) -> DataFrame:
    """First rows of a CSV object: header row, 1..50 rows, permissive parsing
    (short rows get nulls, extra cells dropped), multi-line quoted fields kept
    whole (the reference's line splitting breaks them - not copied), UTF-8.
    ``max_bytes`` (4 KiB..5 MiB) bounds the bytes considered: rows starting
    beyond the budget are not returned, like the reference's ranged read that
    drops the cut-off last line."""
    n = clamp(limit, 1, 50)
    budget = clamp(max_bytes, 4 * 1024, 5 * 1024 * 1024)
    r = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True) \
        .option("encoding", "UTF-8")
    df = (r.schema(schema) if schema else r).csv(path)
    # cumulative size of the rendered rows is computed on at most n rows
    head = df.limit(n)
    line_len = F.length(F.concat_ws(",", *[F.coalesce(F.col(_q(c)).cast("string"), F.lit("")) for c in df.columns])) + 1
    from pyspark.sql import Window
    # one-partition window over the <= 50 rows of ``head`` (bounded by the limit)
    w = Window.orderBy(F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, 0)
    return head.withColumn("_bytes", F.sum(line_len).over(w)).where(F.col("_bytes") <= budget).drop("_bytes")


# S4 ------------------------------------------------------------------------
def list_objects(spark: SparkSession, prefix: str, max_keys: int = 50, glob: str | None = None) -> DataFrame:
    """key, size, last_modified, is_truncated for up to ``max_keys`` (1..200)
    objects under ``prefix`` (binaryFile source with only metadata columns
    selected, so file contents are never read)."""
    n = clamp(max_keys, 1, 200)
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    meta = r.load(prefix).select(F.col("path").alias("key"), F.col("length").alias("size"),
                                 F.col("modificationTime").alias("last_modified"))
    first = meta.orderBy("key").limit(n + 1)                       # n+1 rows tell whether more exist
    from pyspark.sql import Window
    w = Window.orderBy("key")                                       # over <= n+1 (<= 201) rows
    ranked = first.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(
        Window.partitionBy()))
    return ranked.where(F.col("_rn") <= n).select("key", "size", "last_modified",
                                                   (F.col("_n") > n).alias("is_truncated"))


# S14 -----------------------------------------------------------------------
FINDINGS_SCHEMA = (
    "dataset string, run_date string, job_id long, rows long, passFail int, "
    "rules array<struct<ruleNm:string,breakMsg:string,score:double,perc:double,exception:string>>, "
    "dqItems array<struct<item:string,metric:string,score:double>>, "
    "outliers array<struct<item:string,value:string,score:double>>, "
    "sources array<struct<item:string,score:double>>, patterns array<struct<item:string,score:double>>, "
    "datashapes array<struct<item:string,shape:string,score:double>>, dupes array<struct<key:string,score:double>>, "
    "behaviorScore double, schemaScore double, ruleScore double, outlierScore double, sourceScore double, "
    "patternScore double, shapeScore double, dupeScore double")


def ingest_json(df: DataFrame, schema: str, json_col: str = "json") -> DataFrame:
    """Parse JSON payload rows with a declared schema (no inference) and
    flatten the top level."""
    return df.select(F.from_json(F.col(json_col), schema).alias("_r")).select("_r.*")


def ingest_findings(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Findings payloads (seven finding arrays + scores) for ``rules.flatten_findings``."""
    return ingest_json(df, FINDINGS_SCHEMA, json_col)


# U5 ------------------------------------------------------------------------
def reconcile_sources(source: DataFrame, target: DataFrame, cols: Sequence[str] | None = None,
                      chunk: int = 10_000) -> DataFrame:
    """Source reconciliation ("source" finding type): rows present on one side
    only, with multiplicity (``EXCEPT ALL`` both ways).  Output: the compared
    columns, side.

    One signed count per distinct row over the union of both sides (+1 source,
    -1 target; partial aggregation, a single shuffle) replaces two
    ``exceptAll`` passes.  A row left over ``n`` times is emitted ``n`` times:
    up to ``chunk`` copies come from one bounded array; a larger surplus is
    first cut into chunks that are spread over tasks (round robin) and then
    expanded, so a hot duplicate never builds one huge array in one task."""
    cols = list(cols or source.columns)
    sel = [F.col(_q(c)) for c in cols]
    u = source.select(*sel, F.lit(1).alias("_v")).unionByName(target.select(*sel, F.lit(-1).alias("_v")))
    d = u.groupBy(*sel).agg(F.sum("_v").alias("_d")).where(F.col("_d") != 0)
    d = d.select(*sel, F.when(F.col("_d") > 0, F.lit("source_only")).otherwise(F.lit("target_only")).alias("side"),
                 F.abs("_d").alias("_n"))
    small = d.where(F.col("_n") <= chunk).select(*sel, "side", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))))
    big = d.where(F.col("_n") > chunk).select(
        *sel, "side", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / chunk))).alias("_k"))
    spread = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    big = big.repartition(spread).select(
        *sel, "side", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(chunk), F.col("_n") - F.col("_k") * chunk)
                                                        .cast("int"))))
    return small.drop("col").unionByName(big.drop("col"))
