"""Profiling operators: A1 A2 A3 A7 A8 A9 A17 A18 T3 T5.

Scale notes
-----------
* Columns are profiled in ONE scan: the table is unpivoted to long form
  ``(column_name, value)`` and a single ``groupBy(column_name)`` carries all
  aggregates.  With exactly one distinct aggregate Catalyst plans the
  two-level aggregation itself (partial by (column, value) -> merge ->
  partial count -> final), so a hot value is collapsed map-side before any
  shuffle and the last shuffle holds one row per column per partition.
* ``exact=False`` swaps ``count(distinct)`` for ``approx_count_distinct``
  (HyperLogLog++): one scan, partial aggregation only, no value shuffle.
* Top/bottom-N use ``row_number() <= n`` which Catalyst turns into a
  WindowGroupLimit before the shuffle, so a column with billions of distinct
  values still sends only n rows per partition to the ranking task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.exprs import py_strip
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_FLOATING = (T.FloatType, T.DoubleType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_LANED = (*_WHOLE, *_FLOATING, T.StringType)


def _dtype(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(_dtype(df, c), _NUMERIC)


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _norm_double(col: Column) -> Column:
    # -0.0 + 0.0 == 0.0: one representation for the two zeros
    return col.cast("double") + F.lit(0.0)


def unpivot(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (),
            value: str = "double", name_col: str = "column_name",
            value_col: str = "value") -> DataFrame:
    """Long form ``(ids..., column_name, value)`` with every value cast to
    ``value`` (one row per input row and column).  Uses ``DataFrame.unpivot``
    (an ``Expand`` node, inside whole-stage codegen)."""
    if value == "double":
        vals = [_norm_double(F.col(_q(c))) for c in cols]
    else:
        vals = [(_norm_double(F.col(_q(c))) if isinstance(_dtype(df, c), _FLOATING) else F.col(_q(c)))
                .cast(value) for c in cols]
    tmp = [f"_v{i}" for i in range(len(cols))]
    src = df.select(*[F.col(_q(c)) for c in dict.fromkeys([*ids, *cols])])
    wide = src.select(*[F.col(_q(i)) for i in ids], *[v.alias(t) for v, t in zip(vals, tmp)])
    long = wide.unpivot(list(ids), tmp, name_col, value_col)
    names = F.create_map(*[x for t, c in zip(tmp, cols) for x in (F.lit(t), F.lit(c))])
    return long.withColumn(name_col, names[F.col(name_col)])


# A1 ------------------------------------------------------------------------
def profile_table(df: DataFrame, table_name: str | None = None) -> DataFrame:
    """row_count, column_count, columns (array) and data_types (map) of a table."""
    names = [f.name for f in df.schema.fields]
    types = [f.dataType.simpleString() for f in df.schema.fields]
    out = df.agg(F.count(F.lit(1)).alias("row_count")).select(
        *([F.lit(table_name).alias("table_name")] if table_name is not None else []),
        "row_count",
        F.lit(len(names)).alias("column_count"),
        F.array(*[F.lit(n) for n in names]).alias("columns"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]),
                          F.array(*[F.lit(t) for t in types])).alias("data_types"))
    return out


# A2 ------------------------------------------------------------------------
def profile_columns(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True,
                    value_type: str | None = None, rsd: float = 0.01) -> DataFrame:
    """One row per column: row_count, null_count, distinct_count (non-null),
    min_value, max_value, null_fraction_ref, null_ratio.

    Whole numbers, floats and texts: one scan and one shuffle of the distinct
    typed values with their counts, from which everything follows.  With a
    column of another type, or approximate counts: counts and extremes come
    from one typed aggregate per column (one map-side pass), distinct values
    from their own pass over the values' exact text.  ``value_type``: ``double`` or ``string`` form of the
    extremes (default: double if all columns are numeric; use ``string`` to
    see longs beyond 2^53 exactly).

    ``null_fraction_ref = null_count / (distinct_count + null_count)`` (0 when
    the denominator is 0) is the reference's formula, whose denominator is not
    the row count; ``null_ratio = null_count / row_count`` is the usual one.
    """
    cols = list(cols or df.columns)
    value_type = value_type or ("double" if all(is_numeric(df, c) for c in cols) else "string")
    den = F.col("distinct_count") + F.col("null_count")
    out = ["column_name", "row_count", "null_count", "distinct_count", "min_value", "max_value",
           F.when(den == 0, F.lit(0.0)).otherwise(F.col("null_count") / den).alias("null_fraction_ref"),
           F.when(F.col("row_count") == 0, F.lit(0.0)).otherwise(F.col("null_count") / F.col("row_count")).alias("null_ratio")]
    if exact and all(isinstance(_dtype(df, c), _LANED) for c in cols):
        return _laned_profile(df, cols, value_type).select(*out)
    typed = [_norm_double(F.col(_q(c))) if isinstance(_dtype(df, c), _FLOATING) else F.col(_q(c)) for c in cols]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, v in enumerate(typed) for x in (
        F.count(v).alias(f"c{i}"), F.min(v).cast(value_type).alias(f"lo{i}"), F.max(v).cast(value_type).alias(f"hi{i}"))])
    if value_type == "double":
        wide = wide.withColumns({f"{e}{i}": F.col(f"{e}{i}") + F.lit(0.0) for i in range(len(cols)) for e in ("lo", "hi")})
    stats = wide.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col("n").alias("row_count"), (F.col("n") - F.col(f"c{i}")).alias("null_count"),
        F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value")) for i, c in enumerate(cols)])))
    distinct = (F.count_distinct("value") if exact else F.approx_count_distinct("value", rsd))
    kinds = unpivot(df, cols, value="string").groupBy("column_name").agg(distinct.alias("distinct_count"))
    return stats.join(kinds, "column_name").select(*out)


def _laned_profile(df: DataFrame, cols: Sequence[str], value_type: str) -> DataFrame:
    """Counts and extremes by one grouped pass over typed cells: each cell has
    its value in the lane of its type (long, double or text), so no number
    becomes text and equal values meet before the shuffle."""
    lanes = {"l": (T.LongType(), _WHOLE), "d": (T.DoubleType(), _FLOATING), "s": (T.StringType(), (T.StringType,))}
    used = [n for n, (_, kinds) in lanes.items() if any(isinstance(_dtype(df, c), kinds) for c in cols)]

    def cell(c):
        t = _dtype(df, c)
        value = _norm_double(F.col(_q(c))) if isinstance(t, _FLOATING) else F.col(_q(c))
        return F.struct(*[(value if isinstance(t, lanes[n][1]) else F.lit(None)).cast(lanes[n][0]).alias(n) for n in used])

    tmp = [f"_v{i}" for i in range(len(cols))]
    long = df.select(*[cell(c).alias(t) for c, t in zip(cols, tmp)]).unpivot([], tmp, "_c", "_v")
    counted = long.groupBy("_c", *[F.col(f"_v.{n}").alias(n) for n in used]).agg(F.count(F.lit(1)).alias("_n"))
    value = F.lit(False)
    for n in used:
        value = value | F.col(n).isNotNull()
    extreme = (lambda f: F.coalesce(*[f(n).cast(value_type) for n in used]))
    names = F.create_map(*[x for t, c in zip(tmp, cols) for x in (F.lit(t), F.lit(c))])
    return counted.groupBy("_c").agg(
        F.sum("_n").alias("row_count"), F.coalesce(F.sum(F.when(~value, F.col("_n"))), F.lit(0)).alias("null_count"),
        F.count_if(value).alias("distinct_count"), extreme(F.min).alias("min_value"), extreme(F.max).alias("max_value")).select(
        names[F.col("_c")].alias("column_name"), "*").drop("_c")


# T3 ------------------------------------------------------------------------
def columns_for_review(profile: DataFrame) -> DataFrame:
    """Column profile ordered by ascending null fraction (then name)."""
    return profile.orderBy(F.col("null_ratio").asc(), F.col("column_name").asc())


# A3 / A17 --------------------------------------------------------------------
def _clean_keys(keys: Sequence[str]) -> list[str]:
    keys = [k.strip() for k in keys if k and k.strip()]
    if not keys:
        raise ValueError("At least one key column is required.")
    return keys


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n) - rows per key tuple; null keys group together."""
    keys = _clean_keys(keys)
    return df.groupBy(*[F.col(_q(k)) for k in keys]).agg(F.count(F.lit(1)).alias("n"))


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A3 one-row summary: total_rows, distinct_keys, duplicate_keys,
    duplicate_rows, is_unique."""
    kc = key_counts(df, keys)
    return kc.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("duplicate_rows"),
    ).withColumn("is_unique", F.col("duplicate_keys") == 0)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All key tuples occurring more than once, with their counts."""
    return key_counts(df, keys).where(F.col("n") > 1)


def duplicate_examples(df: DataFrame, keys: Sequence[str], examples: int = 10) -> DataFrame:
    """The ``examples`` most repeated key tuples (ties by key) - the report
    the reference shows; the full list is :func:`duplicate_keys`."""
    keys = _clean_keys(keys)
    return (duplicate_keys(df, keys)
            .orderBy(F.col("n").desc(), *[F.col(_q(k)).asc_nulls_first() for k in keys])
            .limit(max(1, int(examples))))


def _dupe_keyed(df: DataFrame, include: Sequence[str], digest: bool = False):
    """Key columns for the dupe layer over ``include`` (sorted, at most 10).

    With ``digest=True`` the key is ``sha2`` of the joined values plus their
    total length, so long text values are never shuffled: only the 64-char
    digest moves.
    """
    include = sorted(_clean_keys(include))
    if len(include) > 10:
        raise ValueError("The dupe layer takes at most 10 columns; use a custom rule instead.")
    if digest:
        joined = F.concat_ws("\u0001", *[F.coalesce(F.col(_q(c)).cast("string"), F.lit("\u0000"))
                                         for c in include])
        keyed = df.select(F.sha2(joined, 256).alias("group_key"),
                          F.length(joined).cast("long").alias("key_length"), *df.columns)
        keys = ["group_key", "key_length"]
    else:
        keyed, keys = df, include
    return keyed, keys


def duplicate_check(df: DataFrame, include: Sequence[str], id_col: str, digest: bool = False) -> DataFrame:
    """A17 dupe layer: groups of rows equal on ``include`` with n_copies and
    the smallest / largest ``id_col``."""
    keyed, keys = _dupe_keyed(df, include, digest)
    return (keyed.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_copies"),
                 F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))
            .where(F.col("n_copies") > 1))


def duplicate_share(df: DataFrame, include: Sequence[str], id_col: str, digest: bool = False) -> DataFrame:
    """A17 in one row: rows, groups of equal rows, rows in them, surplus rows
    (all but one of each group) and their share of all rows (0 for no rows)."""
    keyed, keys = _dupe_keyed(df, include, digest)
    g = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    d = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count_if(F.col("n") > 1).alias("n_groups"),
              F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_groups"),
              F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"))
    return d.select("*", F.when(F.col("row_count") == 0, F.lit(0.0)).otherwise(F.col("surplus_rows") / F.col("row_count")).alias("duplicate_share"))


# A7 / T5 ---------------------------------------------------------------------
def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value string, n) with null kept as a value."""
    return (unpivot(df, cols, value="string")
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def topn_bottomn(df: DataFrame, cols: Sequence[str], n: int = 5) -> DataFrame:
    """Per column the ``n`` most and ``n`` least frequent values.

    Ties are broken by value (nulls first) so the result is deterministic.
    Output: column_name, profile_type (TOPN/BOTTOMN), rank, value, count.
    """
    vc = value_counts(df, cols)
    top_w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value").asc_nulls_first())
    bot_w = Window.partitionBy("column_name").orderBy(F.col("n").asc(), F.col("value").asc_nulls_first())
    top = (vc.withColumn("rank", F.row_number().over(top_w)).where(F.col("rank") <= n)
           .withColumn("profile_type", F.lit("TOPN")))
    bot = (vc.withColumn("rank", F.row_number().over(bot_w)).where(F.col("rank") <= n)
           .withColumn("profile_type", F.lit("BOTTOMN")))
    return top.unionByName(bot).select("column_name", "profile_type", F.col("rank").cast("long").alias("rank"), "value",
                                       F.col("n").alias("count"))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """T5: the most frequent values of one column (count desc, value asc)."""
    return (df.groupBy(F.col(_q(col)).alias("value")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("value").asc_nulls_first()).limit(n))


# A8 ------------------------------------------------------------------------
_NULL_WORDS = ["null", "NULL", ""]


def normalize_topn(records: DataFrame) -> DataFrame:
    """Group flat TOPN/BOTTOMN records per (dataset, runId, fieldNm) into
    ``array<struct<profile_type, value, count>>`` ordered by record id.

    ``"null"``, ``"NULL"`` and ``""`` values become null.  Unlike the reference
    (which labels a mixed TOPN+BOTTOMN list with the first record's type),
    every entry keeps its own profile_type; the header takes the first
    record's values.
    """
    v = F.col("fieldValue")
    entry = F.struct(F.col("id").alias("id"), F.col("fieldFunc").alias("profile_type"),
                     F.when(v.isin(*_NULL_WORDS), F.lit(None).cast("string")).otherwise(v).alias("value"),
                     F.col("uniqueCnt").cast("long").alias("count"),
                     F.col("updtTs").alias("generated_at"))
    g = records.groupBy("dataset", "runId", "fieldNm").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return g.select(
        "dataset", F.col("runId").alias("run_id"), F.col("fieldNm").alias("column_name"),
        F.col("e")[0]["profile_type"].alias("profile_type"),
        F.col("e")[0]["generated_at"].alias("generated_at"),
        F.transform("e", lambda x: F.struct(x["profile_type"].alias("profile_type"),
                                            x["value"].alias("value"),
                                            x["count"].alias("count"))).alias("values"))


# A9 ------------------------------------------------------------------------
def run_profile(df: DataFrame, run: Column | str, cols: Sequence[str], exact: bool = True,
                rsd: float = 0.01) -> DataFrame:
    """Per (run_id, column): row_count, null/empty/filled percent (0-100),
    unique_cnt, unique_ratio (unique_cnt / row_count, a fraction), numeric
    min/max/mean (numeric columns only) and the column's data type.

    "Run" is any expression (e.g. the month of a date) so a whole history of
    runs is profiled in one scan.  Formula for the C-tagged ratios is ours.
    """
    run_c = F.col(run) if isinstance(run, str) else run
    base = df.select(run_c.alias("run_id"), *[F.col(_q(c)) for c in cols])
    vals, types = [], []
    for c in cols:
        dt = _dtype(df, c)
        num = isinstance(dt, _NUMERIC)
        sval = (_norm_double(F.col(_q(c))) if isinstance(dt, _FLOATING) else F.col(_q(c))).cast("string")
        nval = F.col(_q(c)).cast("double") if num else F.lit(None).cast("double")
        vals.append(F.struct(sval.alias("sval"), nval.alias("nval")))
        types.append(dt.simpleString())
    tmp = [f"_v{i}" for i in range(len(cols))]
    wide = base.select("run_id", *[v.alias(t) for v, t in zip(vals, tmp)])
    long = wide.unpivot(["run_id"], tmp, "_c", "_v")
    names = F.create_map(*[x for t, c in zip(tmp, cols) for x in (F.lit(t), F.lit(c))])
    dtypes = F.create_map(*[x for t, d in zip(tmp, types) for x in (F.lit(t), F.lit(d))])
    long = long.select("run_id", names[F.col("_c")].alias("column_name"), dtypes[F.col("_c")].alias("data_type"),
                       F.col("_v.sval").alias("sval"), F.col("_v.nval").alias("nval"))
    distinct = F.count_distinct("sval") if exact else F.approx_count_distinct("sval", rsd)
    agg = long.groupBy("run_id", "column_name", "data_type").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("sval").alias("non_null"),
        F.count_if(py_strip(F.col("sval")) == "").alias("empty_count"),
        distinct.alias("unique_cnt"),
        F.min("nval").alias("min_value"),
        F.max("nval").alias("max_value"),
        F.avg("nval").alias("mean_value"))
    rc = F.col("row_count")
    null_count = rc - F.col("non_null")
    return agg.select(
        "run_id", "column_name", "data_type", "row_count",
        null_count.alias("null_count"), "empty_count",
        (null_count * 100.0 / rc).alias("null_pct"),
        (F.col("empty_count") * 100.0 / rc).alias("empty_pct"),
        ((rc - null_count - F.col("empty_count")) * 100.0 / rc).alias("filled_pct"),
        "unique_cnt",
        (F.col("unique_cnt") / rc).alias("unique_ratio"),
        "min_value", "max_value", "mean_value")


# A18 -------------------------------------------------------------------------
def shape_of(c, granular: bool = False, max_len: int = 12) -> Column:
    """Value format: upper-case letters -> 'A', lower-case -> 'a', digits -> '9',
    other characters kept.  Unless ``granular``, runs of one class collapse to
    a single symbol ('Customer#000000001' -> 'Aa#9').  Shapes are cut to
    ``max_len`` characters.  (Algorithm is ours; the reference only names the
    parameters.)"""
    s = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(s.cast("string"), r"\p{Lu}", "A")
    s = F.regexp_replace(s, r"\p{Ll}", "a")
    s = F.regexp_replace(s, r"[0-9]", "9")
    if not granular:
        s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "A+", "A"), "a+", "a"), "9+", "9")
    return F.substring(s, 1, max_len)


def shape_check(df: DataFrame, cols: Sequence[str], sensitivity: float = 0.001, max_per_col: int = 20,
                max_len: int = 12, granular: bool = False) -> DataFrame:
    """Per column the ``max_per_col`` most common shapes with count, share of
    non-null values and ``is_rare`` (share < sensitivity)."""
    long = unpivot(df, cols, value="string").where(F.col("value").isNotNull())
    counts = (long.select("column_name", shape_of("value", granular, max_len).alias("shape"))
              .groupBy("column_name", "shape").agg(F.count(F.lit(1)).alias("n")))
    w_rank = Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("shape").asc())
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    ranked = (counts.withColumn("shape_rank", F.row_number().over(w_rank))
              .where(F.col("shape_rank") <= max_per_col)
              .join(totals, "column_name"))
    return ranked.select("column_name", F.col("shape_rank").cast("long").alias("shape_rank"), "shape", "n",
                         (F.col("n") / F.col("total")).alias("share"),
                         ((F.col("n") / F.col("total")) < sensitivity).alias("is_rare"))


def rare_shapes(df: DataFrame, cols: Sequence[str], sensitivity: float = 0.001,
                max_len: int = 12, granular: bool = False) -> DataFrame:
    """All shapes whose share is below ``sensitivity`` (no per-column cap)."""
    long = unpivot(df, cols, value="string").where(F.col("value").isNotNull())
    counts = (long.select("column_name", shape_of("value", granular, max_len).alias("shape"))
              .groupBy("column_name", "shape").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    return (counts.join(totals, "column_name")
            .where(F.col("n") / F.col("total") < sensitivity)
            .select("column_name", "shape", "n", (F.col("n") / F.col("total")).alias("share")))


#: Classes of a text value, the first that matches.
VALUE_CLASSES = {"integer": r"^\s*[+-]?[0-9]+\s*$", "decimal": r"^\s*[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))([eE][+-]?[0-9]+)?\s*$",
                 "date": r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([ T].*)?$", "boolean": r"(?i)^\s*(true|false)\s*$"}


def detected_types(df: DataFrame, run: Column, cols: Sequence[str], dataset: str, share: float = 0.95) -> DataFrame:
    """What the values of each run and column look like: the class that at
    least ``share`` of the filled values have (whole numbers count as decimals
    too), else ``mixed``; ``empty`` without filled values.  Rows for
    ``drift.categorical_check``; one scan, partial counts only."""
    long = unpivot(df.select(run.alias("run_id"), *[F.col(_q(c)) for c in cols]), cols, ids=["run_id"], value="string")
    kind = F.lit("text")
    for name, pattern in reversed(VALUE_CLASSES.items()):
        kind = F.when(F.col("value").rlike(pattern), name).otherwise(kind)
    kinds = [*VALUE_CLASSES, "text"]
    runs = long.select("run_id", "column_name", F.when(py_strip(F.col("value")) != "", kind).alias("_k")).groupBy("run_id", "column_name").agg(
        F.count("_k").alias("_n"), *[F.count_if(F.col("_k") == k).alias(f"_{k}") for k in kinds])
    found = F.lit("mixed")
    for k in reversed(kinds):
        n = F.col("_integer") + F.col("_decimal") if k == "decimal" else F.col(f"_{k}")
        found = F.when(n >= share * F.col("_n"), k).otherwise(found)
    return runs.select(F.lit(dataset).alias("dataset"), "run_id", F.col("column_name").alias("item"), F.lit("DATA_TYPE").alias("metric_type"),
                       F.when(F.col("_n") == 0, "empty").otherwise(found).alias("category"))


# Q11 -----------------------------------------------------------------------
def outlier_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5, accuracy: int = 10000) -> DataFrame:
    """Per numeric column the IQR fences ``[q1 - k*IQR, q3 + k*IQR]`` from
    ``percentile_approx`` (a bounded quantile sketch per column, one scan, no
    value shuffle).  The outlier layer's algorithm is ours: the reference only
    names the layer."""
    long = unpivot(df, cols, value="double").where(F.col("value").isNotNull())
    q = long.groupBy("column_name").agg(F.percentile_approx("value", [0.25, 0.75], accuracy).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.select("column_name", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"),
                    (F.col("q")[0] - k * iqr).alias("lower"), (F.col("q")[1] + k * iqr).alias("upper"))


def outlier_check(df: DataFrame, cols: Sequence[str], k: float = 1.5, accuracy: int = 10000) -> DataFrame:
    """Outlying values per column with their counts: the (one row per column)
    bounds are broadcast to the unpivoted values, counts are pre-aggregated
    per (column, value)."""
    bounds = outlier_bounds(df, cols, k, accuracy)
    long = unpivot(df, cols, value="double").where(F.col("value").isNotNull())
    hits = long.join(F.broadcast(bounds), "column_name") \
        .where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
    return hits.groupBy("column_name", "value", "lower", "upper").agg(F.count(F.lit(1)).alias("n"))


def pattern_check(df: DataFrame, key: str, dependent: str, min_share: float = 0.01) -> DataFrame:
    """Rare value pairs: for each ``key`` value, ``dependent`` values whose
    share within that key is below ``min_share`` (pair counts pre-aggregated,
    key totals from the pair counts - no second scan)."""
    pairs = df.groupBy(F.col(_q(key)).alias("key"), F.col(_q(dependent)).alias("value")) \
        .agg(F.count(F.lit(1)).alias("n"))
    # key totals from the pre-aggregated pairs (one scan of the table).  A
    # grouped sum (partial per partition) joined back on the key instead of a
    # window over the key: a key with very many distinct dependent values is
    # then not sorted inside one task.  null keys match null keys.
    totals = pairs.groupBy(F.col("key").alias("_k")).agg(F.sum("n").alias("key_total"))
    tot = pairs.join(totals, F.col("key").eqNullSafe(F.col("_k"))).select("key", "value", "n", "key_total")
    return tot.withColumn("share", F.col("n") / F.col("key_total")).where(F.col("share") < min_share)
