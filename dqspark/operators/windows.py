"""Skew-safe run ("gaps and islands") numbering.

A window partitioned by one key (e.g. a conversation) sends the whole key to
one task; a key holding a third of the rows then serialises the job.  Here
the order column is cut into blocks of ``block`` values: per-row work runs in
windows over (key, block) - at most ``block`` rows each - and only one summary
row per block goes through the per-key window that carries run state across
blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_ids(df: DataFrame, key: str, order: str, value: str, block: int = 100_000,
            out: str = "run_id", keep_block: str | None = None) -> DataFrame:
    """Add ``out``: 1-based number of the maximal run of equal ``value``
    (null-safe) that each row belongs to, within ``key`` ordered by ``order``
    (a numeric column, unique within the key).  With ``keep_block`` the
    block number is kept under that name: the rows come out partitioned by
    (key, block), so a later aggregation on a superset of those columns needs
    no shuffle."""
    d = df.withColumn("_blk", F.floor(F.col(order) / block))
    wb = Window.partitionBy(key, "_blk").orderBy(order)
    d = d.withColumn("_prev", F.lag(value).over(wb)) \
         .withColumn("_first", F.row_number().over(wb) == 1)
    # changes inside the block (the block's first row is decided below)
    d = d.withColumn("_chg", F.when(~F.col("_first") & ~F.col("_prev").eqNullSafe(F.col(value)), 1).otherwise(0))
    d = d.withColumn("_cum", F.sum("_chg").over(wb.rowsBetween(Window.unboundedPreceding, 0)))
    # one summary row per (key, block): first / last value and changes inside
    summ = d.groupBy(key, "_blk").agg(
        F.min_by(F.col(value), F.col(order)).alias("_fv"), F.max_by(F.col(value), F.col(order)).alias("_lv"),
        F.sum("_chg").alias("_n"))
    wk = Window.partitionBy(key).orderBy("_blk")
    summ = summ.withColumn("_plv", F.lag("_lv").over(wk)) \
        .withColumn("_has_prev", F.lag("_blk").over(wk).isNotNull())
    # a block's first row starts a new run unless it continues the previous block's last value
    summ = summ.withColumn("_start", F.when(F.col("_has_prev") & F.col("_plv").eqNullSafe(F.col("_fv")), 0)
                           .otherwise(1))
    summ = summ.withColumn("_before", F.sum(F.col("_start") + F.col("_n")).over(
        wk.rowsBetween(Window.unboundedPreceding, -1)))
    summ = summ.select(key, "_blk", F.coalesce("_before", F.lit(0)).alias("_before"), "_start")
    res = d.join(summ, [key, "_blk"])
    res = res.withColumn(out, (F.col("_before") + F.col("_start") + F.col("_cum")).cast("long")) \
        .drop("_prev", "_first", "_chg", "_cum", "_before", "_start")
    return res.withColumnRenamed("_blk", keep_block) if keep_block else res.drop("_blk")


def ordinal(df: DataFrame, order: str, out: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """Add ``out``: the 1-based position of each row in ``order`` order
    (values unique), without a single-partition window.  Range partitioning
    sorts the rows across tasks; per-partition row numbers are offset by the
    sizes of the partitions before them (one small row per partition, the
    only global step - its size is the partition count, so broadcasting it is
    bounded)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored: numbers and offsets must come from one and the same range exchange
    from dqspark.session import scratch_path
    path = scratch_path(df.sparkSession, "ordinal")
    s = df.repartitionByRange(n, order).withColumn("_pid", F.spark_partition_id())
    s.write.parquet(path)
    s = df.sparkSession.read.schema(s.schema).parquet(path)
    s = s.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(order)))
    sizes = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offsets = sizes.select("_pid", F.coalesce(F.sum("_c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return s.join(F.broadcast(offsets), "_pid").select(*df.columns, (F.col("_off") + F.col("_rn")).alias(out))
