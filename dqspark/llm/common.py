"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the
    lineage, is computed once, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a Python worker remembers between tasks, by a name: functions that forget it.
REMEMBERED: dict = {}


def tidy(task, keep: str | None = None):
    """``task`` for ``mapInArrow``, in a worker that first forgets what
    operators other than its own (``keep``) remember, and before and after
    its work returns freed memory to the system: workers serve one operator
    after another, and what each left behind would add up."""
    def run(batches):
        for name, forget in REMEMBERED.items():
            if name != keep:
                forget()
        return_freed()
        yield from task(batches)
        return_freed()
    return run


def return_freed() -> None:
    """Give memory that this process has freed back to the system: Arrow's
    pool, and the C library's heap where the library can do so."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(col: Column) -> Column:
    """The text's UTF-8 bytes (null text: no bytes)."""
    return F.encode(F.coalesce(col, F.lit("")), "UTF-8")


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _h, _text)`` of every row.  Rows are matched on id *and* text
    hash, so repeated or null ids never mix the results of different texts;
    fully repeated rows share one result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"))


def on_keys(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & (a["_h"] == b["_h"])


def join_on_keys(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Null-safe join on ``(_id, _h)`` that keeps one copy of the keys."""
    r = b.withColumnsRenamed({"_id": "_rid", "_h": "_rh"})
    out = a.join(r, a["_id"].eqNullSafe(r["_rid"]) & (a["_h"] == r["_rh"]), how)
    return out.drop("_rid", "_rh")


def crc_fold(id_col: Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: fold of the empty string)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def bounded_labels(labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id",
                   held_out_fold: int = 1) -> DataFrame:
    """``(_id, _label, _fold, _weight)`` of at most about ``per_class`` labelled rows
    of each class outside the held-out fold: rows are kept by a hash of their
    id against the class's share, so the sample is the same on every run and
    its size does not grow with the input.  An id labelled twice counts once,
    with its largest label; null ids or labels are not learned from.
    ``_weight``: rows of its class that a kept row stands for."""
    rows = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
            .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
            .withColumn("_fold", crc_fold(F.col("_id")).cast("int")).filter(F.col("_fold") != held_out_fold))
    sizes = {r["_label"]: r["n"] for r in rows.filter(F.col("_label").isin(0, 1))
             .groupBy("_label").agg(F.count("*").alias("n")).collect()}
    unit = 1 << 20
    keep, weight = F.lit(False), F.lit(1.0)
    for label, n in sizes.items():
        share = unit if n <= per_class else unit * per_class // n
        keep = keep | ((F.col("_label") == label) & (F.pmod(F.xxhash64("_id"), F.lit(unit)) < share))
        weight = F.when(F.col("_label") == label, F.lit(unit / share)).otherwise(weight)
    return rows.filter(keep).withColumn("_weight", weight)


def logistic_fit(x, y, w, ridge: float = 1e-2, steps: int = 50):
    """Weights (bias last) of a logistic regression by Newton's method."""
    import numpy as np
    x = np.column_stack([np.asarray(x, float), np.ones(len(y))])
    y, w = np.asarray(y, float), np.asarray(w, float)
    beta = np.zeros(x.shape[1])
    damp = ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + damp, x.T @ (w * (y - p)) - damp @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta
