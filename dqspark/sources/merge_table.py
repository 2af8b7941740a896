"""A keyed table that is merged on read (ST3 S7).

Upserts are written as deltas: a batch of k rows writes k rows, however large
the table is.  A reader lays the newest delta row of each key over the base;
compaction folds the deltas of the touched buckets into new base files and
leaves all other buckets where they are.

    base/v=<version>/bucket=<b>     base rows of a bucket
    delta/batch=<id>/bucket=<b>     rows of a batch; written again if the batch is replayed
    manifest/v=<version>            for each bucket its base version and the last batch in it

What is not committed (no ``_SUCCESS``) is never read, and nothing that a
manifest names is ever overwritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "bucket int, version long, upto long"


class MergeTable:
    """``keys`` identify a row; a row with a null among them is one of its own
    and never replaced (as under a unique key of a database)."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets
        self.cols = [f.name for f in schema.fields]
        if "_bucket" in self.cols or "_batch" in self.cols or "_version" in self.cols:
            raise ValueError("_bucket, _batch and _version are the table's own columns")

    # -- layout ---------------------------------------------------------------
    def _bucketed(self, df: DataFrame) -> DataFrame:
        b = F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")
        return df.select(*self.cols, b.alias("_bucket"))

    def _committed(self, kind: str, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{name}=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)

    def manifest(self) -> list:
        """The newest manifest: one row per bucket that has a base."""
        versions = self._committed("manifest", "_version")
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/_version={versions[-1]}").collect() if versions else []

    def _stored(self, kind: str, folders: list[str], schema: StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*folders)

    def _base(self, manifest: list) -> DataFrame:
        folders = [f"{self.path}/base/_version={m.version}/_bucket={m.bucket}" for m in manifest]
        return self._stored("base", folders, StructType([*self.schema.fields]).add("_version", "long").add("_bucket", "integer")).drop("_version")

    def _deltas(self, manifest: list, upto: int | None = None) -> DataFrame:
        """Rows of committed batches that their bucket's base does not hold yet."""
        done = {m.bucket: m.upto for m in manifest}
        least = min(done.values(), default=-1) if len(done) == self.buckets else -1
        batches = [b for b in self._committed("delta", "_batch") if b > least and (upto is None or b <= upto)]
        rows = self._stored("delta", [f"{self.path}/delta/_batch={b}" for b in batches],
                            StructType([*self.schema.fields]).add("_batch", "long").add("_bucket", "integer"))
        if not done:
            return rows
        known = F.create_map(*[x for b, u in done.items() for x in (F.lit(b), F.lit(u))])
        return rows.where(F.col("_batch") > F.coalesce(F.try_element_at(known, F.col("_bucket")), F.lit(-1)))

    # -- writing ----------------------------------------------------------------
    def create(self, rows: DataFrame) -> MergeTable:
        """The first base.  A key that repeats keeps one of its rows."""
        self._write_base(self._bucketed(self._newest(rows, F.lit(0))), 0, -1, [])
        return self

    def append(self, batch: DataFrame, batch_id: int, order_by: str | Column | None = None) -> None:
        """Store a batch; of a key that repeats in it the last row by
        ``order_by`` stays.  The same id again replaces what it wrote."""
        order = F.lit(0) if order_by is None else F.col(order_by) if isinstance(order_by, str) else order_by
        one = self._newest(batch, order)
        self._bucketed(one).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/delta/_batch={batch_id}")

    def compact(self) -> int:
        """Fold all committed deltas into the bases of the buckets that they
        touch; returns the number of these.  A crash before the manifest is
        committed leaves the table as it was."""
        manifest, batches = self.manifest(), self._committed("delta", "_batch")
        if not batches:
            return 0
        upto = batches[-1]
        touched = [r[0] for r in self._deltas(manifest, upto).select("_bucket").distinct().collect()]  # at most one row a bucket
        if not touched:
            return 0
        merged = self._merged(manifest, upto).where(F.col("_bucket").isin(touched))
        version = max([m.version for m in manifest], default=-1) + 1
        self._write_base(merged, version, upto, [m for m in manifest if m.bucket not in set(touched)])
        return len(touched)

    def _write_base(self, bucketed: DataFrame, version: int, upto: int, others: list) -> None:
        # a bucket is dealt to one task or, if it is large, by AQE to several
        folder = f"{self.path}/base/_version={version}"
        bucketed.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        new = self.spark.read.schema(StructType([*self.schema.fields]).add("_bucket", "integer")).parquet(folder).select("_bucket").distinct().collect()
        rows = [(r[0], version, upto) for r in new] + [(m.bucket, m.version, m.upto) for m in others]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/_version={version}")

    # -- reading ----------------------------------------------------------------
    def _no_null(self) -> Column:
        out = F.lit(True)
        for k in self.keys:
            out = out & F.col(k).isNotNull()
        return out

    def _newest(self, rows: DataFrame, order: Column) -> DataFrame:
        keyed = rows.where(self._no_null()).groupBy(*self.keys).agg(F.max_by(F.struct(*self.cols), order).alias("_r")).select("_r.*")
        return keyed.unionByName(rows.where(~self._no_null()).select(*self.cols))

    def _merged(self, manifest: list, upto: int | None = None) -> DataFrame:
        base, deltas = self._base(manifest), self._deltas(manifest, upto)
        keyed = deltas.where(self._no_null())
        last = keyed.groupBy("_bucket", *self.keys).agg(F.max_by(F.struct(*self.cols), F.col("_batch")).alias("_r")).select("_r.*", "_bucket")
        # base rows whose key has no delta; null keys match nothing and stay
        kept = base.select(*self.cols, "_bucket").join(last.select("_bucket", *self.keys), ["_bucket", *self.keys], "left_anti")
        return kept.unionByName(last).unionByName(deltas.where(~self._no_null()).select(*self.cols, "_bucket"))

    def read(self) -> DataFrame:
        return self._merged(self.manifest()).select(*self.cols)


def stream_merge_upsert(incoming: DataFrame, table: MergeTable, checkpoint: str, compact_every: int | None = 16,
                        order_by: str | Column | None = None) -> None:
    """Every micro-batch of ``incoming`` becomes a delta of ``table`` under its
    batch id (a replayed one replaces itself); every ``compact_every`` batches
    the deltas are folded in.  Runs over all there is, from its checkpoint."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        table.append(batch, batch_id, order_by)
        if compact_every and (batch_id + 1) % compact_every == 0:
            table.compact()

    (incoming.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
