"""Profiling queries (A1 A2 A3 A7 A8 A9 A17 A18 T3 T5) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import profile as P
from dqspark.plans.catalog import TABLES, register, table

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]


def _sql_profile_columns(tbl: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS column_name, count(*) AS row_count,
  count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count,
  min({c})::DOUBLE + 0.0 AS min_value, max({c})::DOUBLE + 0.0 AS max_value,
  CASE WHEN count(DISTINCT {c}) + count(*) - count({c}) = 0 THEN 0.0
       ELSE (count(*) - count({c})) / (count(DISTINCT {c}) + count(*) - count({c})) END AS null_fraction_ref,
  CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) - count({c})) / count(*) END AS null_ratio
FROM {tbl}""")
    return "\nUNION ALL\n".join(parts)


@register("profile_columns_lineitem", _sql_profile_columns("lineitem", LINEITEM_NUMERIC))
def profile_columns_lineitem(spark, sf):
    return P.profile_columns(table(spark, sf, "lineitem"), LINEITEM_NUMERIC)


def _sql_profile_text(tbl: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
  count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM {tbl}"""
                                for c in cols)


ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("profile_columns_all_orders", _sql_profile_text(f"""(SELECT * REPLACE (9007199254740992 + o_orderkey AS o_orderkey) FROM orders)""",
                                                          ORDERS_COLUMNS))
def profile_columns_all_orders(spark, sf):
    """A2 over all columns of orders (text, dates, doubles; keys moved beyond
    2^53, where doubles would merge neighbours)."""
    orders = table(spark, sf, "orders").withColumn("o_orderkey", F.col("o_orderkey") + F.lit(9007199254740992))
    return P.profile_columns(orders, ORDERS_COLUMNS).select(
        "column_name", "row_count", "null_count", "distinct_count", "min_value", "max_value")


@register("columns_for_review_orders", _sql_profile_columns("orders", ["o_orderkey", "o_custkey", "o_totalprice"]))
def columns_for_review_orders(spark, sf):
    """The numeric column profile of orders, least-null columns first."""
    return P.columns_for_review(P.profile_columns(table(spark, sf, "orders"),
                                                  ["o_orderkey", "o_custkey", "o_totalprice"]))


@register("profile_table_all", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count, "
    f"(SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}')::INTEGER AS column_count"
    for t in TABLES))
def profile_table_all(spark, sf):
    out = None
    for t in TABLES:
        one = P.profile_table(table(spark, sf, t), t).select("table_name", "row_count", "column_count")
        out = one if out is None else out.unionByName(one)
    return out


_KEYS = ["l_orderkey", "l_linenumber"]


@register("key_uniqueness_lineitem", """
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT sum(n)::BIGINT AS total_rows, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS duplicate_keys,
       coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS duplicate_rows,
       count(*) FILTER (WHERE n > 1) = 0 AS is_unique
FROM k""")
def key_uniqueness_lineitem(spark, sf):
    return P.key_uniqueness(table(spark, sf, "lineitem"), _KEYS)


@register("duplicate_keys_lineitem", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys_lineitem(spark, sf):
    return P.duplicate_keys(table(spark, sf, "lineitem"), _KEYS)


@register("duplicate_examples_lineitem", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1
ORDER BY n DESC, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST LIMIT 10""")
def duplicate_examples_lineitem(spark, sf):
    return P.duplicate_examples(table(spark, sf, "lineitem"), _KEYS, examples=10)


@register("duplicate_documents", """
SELECT sha256(text) AS group_key, length(text) AS key_length, count(*) AS n_copies,
       min(doc_id) AS first_id, max(doc_id) AS last_id
FROM documents GROUP BY ALL HAVING count(*) > 1""")
def duplicate_documents(spark, sf):
    return P.duplicate_check(table(spark, sf, "documents"), ["text"], id_col="doc_id", digest=True)


@register("duplicate_share_documents", """
WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY 1)
SELECT sum(n)::BIGINT AS row_count, count(*) FILTER (WHERE n > 1) AS n_groups, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS rows_in_groups,
  sum(n - 1)::BIGINT AS surplus_rows, sum(n - 1) / sum(n) AS duplicate_share FROM g""")
def duplicate_share_documents(spark, sf):
    """Share of documents that repeat another's text."""
    return P.duplicate_share(table(spark, sf, "documents"), ["text"], id_col="doc_id", digest=True)


def _sql_topn(tbl, cols, n):
    vc = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {tbl} GROUP BY 2"
        for c in cols)
    return f"""
WITH vc AS ({vc}),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value ASC NULLS FIRST) AS rt,
             row_number() OVER (PARTITION BY column_name ORDER BY n ASC, value ASC NULLS FIRST) AS rb FROM vc)
SELECT column_name, 'TOPN' AS profile_type, rt AS rank, value, n AS count FROM r WHERE rt <= {n}
UNION ALL
SELECT column_name, 'BOTTOMN' AS profile_type, rb AS rank, value, n AS count FROM r WHERE rb <= {n}"""


@register("topn_bottomn_part", _sql_topn("part", ["p_brand", "p_type", "p_size"], 5))
def topn_bottomn_part(spark, sf):
    return P.topn_bottomn(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"], n=5)


# The A7 lists as the flat records the result service returns (record id
# orders TOPN before BOTTOMN), grouped back into one list per column.
_TOPN_PART_COLS = ["p_brand", "p_type", "p_size"]


@register("normalize_topn_part", f"""
WITH t AS ({_sql_topn("part", _TOPN_PART_COLS, 5)})
SELECT 'part' AS dataset, '2024-01-31' AS run_id, column_name, 'TOPN' AS header_type,
  (row_number() OVER (PARTITION BY column_name
                      ORDER BY CASE WHEN profile_type = 'TOPN' THEN 0 ELSE 100 END + rank) - 1)::INTEGER AS pos,
  profile_type, CASE WHEN value IN ('null', 'NULL', '') THEN NULL ELSE value END AS value, count
FROM t""")
def normalize_topn_part(spark, sf):
    lists = P.topn_bottomn(table(spark, sf, "part"), _TOPN_PART_COLS, n=5)
    recs = lists.select(
        (F.when(F.col("profile_type") == "TOPN", 0).otherwise(100) + F.col("rank")).alias("id"),
        F.lit("part").alias("dataset"), F.lit("2024-01-31").alias("runId"), F.col("column_name").alias("fieldNm"),
        F.col("profile_type").alias("fieldFunc"), F.col("value").alias("fieldValue"),
        F.col("count").alias("uniqueCnt"), F.lit("2024-01-31 06:00:00").alias("updtTs"))
    norm = P.normalize_topn(recs)
    return norm.select("dataset", "run_id", "column_name", F.col("profile_type").alias("header_type"),
                       F.posexplode("values").alias("pos", "e")).select(
        "dataset", "run_id", "column_name", "header_type", "pos", F.col("e.profile_type").alias("profile_type"),
        F.col("e.value").alias("value"), F.col("e.count").alias("count"))


@register("top_values_lineitem", """
SELECT l_partkey AS value, count(*) AS count FROM lineitem GROUP BY 1
ORDER BY count DESC, value ASC NULLS FIRST LIMIT 10""")
def top_values_lineitem(spark, sf):
    return P.top_values(table(spark, sf, "lineitem"), "l_partkey", n=10)


def _sql_shape_expr(col, max_len=12):
    return (f"substr(regexp_replace(regexp_replace(regexp_replace("
            f"regexp_replace(regexp_replace(regexp_replace(CAST({col} AS VARCHAR), '\\p{{Lu}}', 'A', 'g'),"
            f" '\\p{{Ll}}', 'a', 'g'), '[0-9]', '9', 'g'), 'A+', 'A', 'g'), 'a+', 'a', 'g'), '9+', '9', 'g'), 1, {max_len})")


def _sql_shape(tbl, col, max_per_col=20, sensitivity=0.001, max_len=12):
    shp = _sql_shape_expr(col, max_len)
    return f"""
SELECT column_name, shape_rank, shape, n, n / total AS share, n / total < {sensitivity} AS is_rare FROM (
  SELECT '{col}' AS column_name, {shp} AS shape, count(*) AS n,
         sum(count(*)) OVER () AS total,
         row_number() OVER (ORDER BY count(*) DESC, {shp} ASC) AS shape_rank
  FROM {tbl} WHERE {col} IS NOT NULL GROUP BY 2) WHERE shape_rank <= {max_per_col}"""


@register("shape_check_customer",
          _sql_shape("customer", "c_name") + "\nUNION ALL\n" + _sql_shape("part", "p_brand")
          + "\nUNION ALL\n" + _sql_shape("pages", "url"))
def shape_check_customer(spark, sf):
    a = P.shape_check(table(spark, sf, "customer"), ["c_name"])
    b = P.shape_check(table(spark, sf, "part"), ["p_brand"])
    c = P.shape_check(table(spark, sf, "pages"), ["url"])
    return a.unionByName(b).unionByName(c)


@register("rare_shapes_conversations", f"""
SELECT column_name, shape, n, n / total AS share FROM (
  SELECT 'text' AS column_name, {_sql_shape_expr("text")} AS shape, count(*) AS n, sum(count(*)) OVER () AS total
  FROM conversations WHERE text IS NOT NULL GROUP BY 2) WHERE n / total < 0.01""")
def rare_shapes_conversations(spark, sf):
    """A18, uncapped: every message-text shape with a share below 1 %."""
    return P.rare_shapes(table(spark, sf, "conversations"), ["text"], sensitivity=0.01)


ORDERS_COLS = ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey"]
ORDERS_TYPES = {"o_orderstatus": "string", "o_orderpriority": "string", "o_totalprice": "double",
                "o_custkey": "bigint"}


def orders_run():
    """Run id = month of the order date (a whole history profiled in one scan)."""
    return F.date_format("o_orderdate", "yyyy-MM")


def sql_run_profile_orders() -> str:
    parts = []
    for c in ORDERS_COLS:
        num = ORDERS_TYPES[c] != "string"
        sval = f"{c} + 0.0" if ORDERS_TYPES[c] == "double" else c
        empty = "0" if num else f"count(*) FILTER (WHERE trim({c}) = '')"
        mn = f"min({c})::DOUBLE" if num else "NULL::DOUBLE"
        mx = f"max({c})::DOUBLE" if num else "NULL::DOUBLE"
        av = f"avg({c})::DOUBLE" if num else "NULL::DOUBLE"
        parts.append(f"""SELECT strftime(o_orderdate, '%Y-%m') AS run_id, '{c}' AS column_name,
  '{ORDERS_TYPES[c]}' AS data_type, count(*) AS row_count, count(*) - count({c}) AS null_count,
  {empty} AS empty_count, count(DISTINCT {sval}) AS unique_cnt,
  {mn} AS min_value, {mx} AS max_value, {av} AS mean_value
FROM orders GROUP BY 1""")
    return "\nUNION ALL\n".join(parts)


RUN_PROFILE_SELECT = """run_id, column_name, data_type, row_count, null_count, empty_count,
  null_count * 100.0 / row_count AS null_pct, empty_count * 100.0 / row_count AS empty_pct,
  (row_count - null_count - empty_count) * 100.0 / row_count AS filled_pct,
  unique_cnt, unique_cnt / row_count AS unique_ratio, min_value, max_value, mean_value"""


@register("run_profile_orders", f"SELECT {RUN_PROFILE_SELECT} FROM ({sql_run_profile_orders()})")
def run_profile_orders(spark, sf):
    return P.run_profile(table(spark, sf, "orders"), orders_run(), ORDERS_COLS)


# Q11 -----------------------------------------------------------------------
@register("outliers_events")
def outliers_events(spark, sf):
    """Q11 outlier layer: IQR fences from quantile sketches (approximate by
    design; rows-only check) over event values and order prices."""
    a = P.outlier_check(table(spark, sf, "events"), ["value"])
    b = P.outlier_check(table(spark, sf, "orders"), ["o_totalprice"])
    return a.unionByName(b)


@register("patterns_orders", """
WITH p AS (SELECT o_orderpriority AS key, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL),
t AS (SELECT key, sum(n) AS key_total FROM p GROUP BY key)
SELECT p.key, value, n, key_total::BIGINT AS key_total, n / key_total AS share FROM p JOIN t USING (key)
WHERE n / key_total < 0.34""")
def patterns_orders(spark, sf):
    """Q11 pattern layer: order statuses rare within an order priority."""
    return P.pattern_check(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", min_share=0.34)
