"""Table-maintenance queries (J1 S6 S7 S8 J11 E25) over customer / orders / conversations.

Target and incoming snapshots are split from the whole table by business
attributes (market segment, order priority), so every row takes part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import audit as A
from dqspark.operators.joins import filter_new_rows
from dqspark.plans.catalog import register, table
from dqspark.sources import sinks as S

CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
TARGET_SEGS = ("BUILDING", "AUTOMOBILE", "MACHINERY")
INCOMING_SEGS = ("MACHINERY", "HOUSEHOLD", "FURNITURE")
_TS = "('" + "','".join(TARGET_SEGS) + "')"
_IS = "('" + "','".join(INCOMING_SEGS) + "')"


def _split(spark, sf):
    c = table(spark, sf, "customer").select(*CUST_COLS)
    return c.where(F.col("c_mktsegment").isin(*TARGET_SEGS)), c.where(F.col("c_mktsegment").isin(*INCOMING_SEGS))


@register("new_rows", f"""
SELECT c_custkey, c_name FROM customer i WHERE c_mktsegment IN {_IS}
  AND NOT EXISTS (SELECT 1 FROM customer t WHERE t.c_mktsegment IN {_TS} AND t.c_custkey = i.c_custkey)""")
def new_rows(spark, sf):
    """Incoming customers whose key is not in the target snapshot."""
    target, incoming = _split(spark, sf)
    return filter_new_rows(incoming, target, ["c_custkey"]).select("c_custkey", "c_name")


@register("insert_or_ignore", f"""
WITH inc AS (SELECT *, 1 AS seq FROM customer WHERE c_mktsegment IN {_IS}
             UNION ALL SELECT c_custkey, c_name || '-retry', c_nationkey, c_acctbal, c_mktsegment, 2
             FROM customer WHERE c_mktsegment = 'HOUSEHOLD'),
first AS (SELECT * EXCLUDE (seq, rn) FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY seq) AS rn FROM inc)
          WHERE rn = 1)
SELECT {', '.join(CUST_COLS)} FROM customer WHERE c_mktsegment IN {_TS}
UNION ALL
SELECT {', '.join(CUST_COLS)} FROM first f WHERE NOT EXISTS (
  SELECT 1 FROM customer t WHERE t.c_mktsegment IN {_TS} AND t.c_custkey = f.c_custkey)""")
def insert_or_ignore(spark, sf):
    """ON CONFLICT DO NOTHING; a retried batch row for the same key loses
    to the first one."""
    target, incoming = _split(spark, sf)
    retry = incoming.where(F.col("c_mktsegment") == "HOUSEHOLD") \
        .withColumn("c_name", F.concat("c_name", F.lit("-retry")))
    inc = incoming.withColumn("seq", F.lit(1)).unionByName(retry.withColumn("seq", F.lit(2)))
    return S.insert_or_ignore(target, inc, CUST_COLS, ["c_custkey"], order_by="seq")


@register("upsert_customers", f"""
WITH t AS (SELECT * FROM customer WHERE c_mktsegment IN {_TS}),
i AS (SELECT c_custkey, c_name, c_nationkey,
             CASE WHEN c_nationkey < 10 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, c_mktsegment
      FROM customer WHERE c_mktsegment IN {_IS})
SELECT coalesce(t.c_custkey, i.c_custkey) AS c_custkey,
  CASE WHEN t.c_custkey IS NULL OR (i.c_custkey IS NOT NULL AND t.c_acctbal IS DISTINCT FROM i.c_acctbal)
       THEN i.c_name ELSE t.c_name END AS c_name,
  CASE WHEN t.c_custkey IS NULL OR (i.c_custkey IS NOT NULL AND t.c_acctbal IS DISTINCT FROM i.c_acctbal)
       THEN i.c_nationkey ELSE t.c_nationkey END AS c_nationkey,
  CASE WHEN t.c_custkey IS NULL OR (i.c_custkey IS NOT NULL AND t.c_acctbal IS DISTINCT FROM i.c_acctbal)
       THEN i.c_acctbal ELSE t.c_acctbal END AS c_acctbal,
  CASE WHEN t.c_custkey IS NULL OR (i.c_custkey IS NOT NULL AND t.c_acctbal IS DISTINCT FROM i.c_acctbal)
       THEN i.c_mktsegment ELSE t.c_mktsegment END AS c_mktsegment,
  CASE WHEN t.c_custkey IS NULL THEN 'insert' WHEN i.c_custkey IS NULL THEN 'keep'
       WHEN t.c_acctbal IS DISTINCT FROM i.c_acctbal THEN 'update' ELSE 'unchanged' END AS _action
FROM t FULL OUTER JOIN i ON t.c_custkey = i.c_custkey""")
def upsert_customers(spark, sf):
    """Upsert keyed by c_custkey with change detection on c_acctbal."""
    target, incoming = _split(spark, sf)
    inc = incoming.withColumn("c_acctbal", F.when(F.col("c_nationkey") < 10, F.col("c_acctbal") + 10)
                              .otherwise(F.col("c_acctbal")))
    return S.upsert(target, inc, ["c_custkey"], CUST_COLS, change_detect_cols=["c_acctbal"], with_action=True)


@register("prune_orders", """
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders o
WHERE NOT (o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '5-LOW' AND o_custkey IS NOT NULL)
           AND o_orderkey IS NOT NULL
           AND o_orderkey NOT IN (SELECT o_orderkey FROM orders i
                                  WHERE i.o_orderpriority <> '5-LOW' AND i.o_custkey = o.o_custkey
                                    AND i.o_orderkey IS NOT NULL))""")
def prune_orders(spark, sf):
    """Per customer present in the incoming snapshot (non-LOW orders),
    delete the orders no longer present (the LOW ones)."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    incoming = orders.where(F.col("o_orderpriority") != "5-LOW")
    return S.prune_missing(orders, incoming, ["o_custkey"], ["o_custkey", "o_orderkey"])


# J11 -----------------------------------------------------------------------
def customer_after(cust):
    """A later snapshot of customer: balances of nation 3 raised, segment of
    nation 5 renamed, nation 7 removed, nation 8 re-keyed (new rows)."""
    changed = cust.where(F.col("c_nationkey") != 7).select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_nationkey") == 3, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_nationkey") == 5, F.lit("CONSTRUCTION")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    added = cust.where(F.col("c_nationkey") == 8).withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return changed.unionByName(added.select(*changed.columns))


def _dec(df):
    return df.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(14,2)"))


@register("snapshot_diff_customers", """
WITH b AS (SELECT c_custkey, c_name, CAST(CAST(c_acctbal AS DECIMAL(14,2)) AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer),
a0 AS (SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_nationkey = 3 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_nationkey = 5 THEN 'CONSTRUCTION' ELSE c_mktsegment END AS c_mktsegment
       FROM customer WHERE c_nationkey <> 7
       UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey = 8),
a AS (SELECT c_custkey, c_name, CAST(CAST(c_acctbal AS DECIMAL(14,2)) AS VARCHAR) AS c_acctbal, c_mktsegment FROM a0),
j AS (SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, b.c_name AS bn, a.c_name AS an, b.c_acctbal AS bb,
             a.c_acctbal AS ab, b.c_mktsegment AS bs, a.c_mktsegment AS als
      FROM b FULL OUTER JOIN a ON b.c_custkey = a.c_custkey),
l AS (SELECT c_custkey, 'Customer' AS change_category, 'Name' AS change_item, bn AS change_from, an AS change_to FROM j
      UNION ALL SELECT c_custkey, 'Customer', 'Balance', bb, ab FROM j
      UNION ALL SELECT c_custkey, 'Customer', 'Segment', bs, als FROM j)
SELECT * FROM l WHERE change_from IS DISTINCT FROM change_to""")
def snapshot_diff_customers(spark, sf):
    """One row per changed field between two customer snapshots."""
    cust = table(spark, sf, "customer")
    before, after = _dec(cust), _dec(customer_after(cust))
    return A.snapshot_diff(before, after, ["c_custkey"], ["c_name", "c_acctbal", "c_mktsegment"],
                           category="Customer", labels={"c_name": "Name", "c_acctbal": "Balance",
                                                        "c_mktsegment": "Segment"})


# E25 -----------------------------------------------------------------------
def _after_text(c):
    return F.concat(F.regexp_replace(c, r"\n[^\n]*\z", ""), F.lit("\nEND"))


@register("line_diff_conversations", r"""
WITH d AS (SELECT conv_id, turn, text AS b, regexp_replace(text, '\n[^\n]*\z', '') || chr(10) || 'END' AS a
           FROM conversations WHERE role = 'assistant'),
lb AS (SELECT conv_id, turn, pos, line, row_number() OVER (PARTITION BY conv_id, turn, line ORDER BY pos) AS occ FROM (
         SELECT conv_id, turn, generate_subscripts(string_split(b, chr(10)), 1) - 1 AS pos,
                unnest(string_split(b, chr(10))) AS line FROM d WHERE b IS NOT NULL)),
la AS (SELECT conv_id, turn, pos, line, row_number() OVER (PARTITION BY conv_id, turn, line ORDER BY pos) AS occ FROM (
         SELECT conv_id, turn, generate_subscripts(string_split(a, chr(10)), 1) - 1 AS pos,
                unnest(string_split(a, chr(10))) AS line FROM d WHERE a IS NOT NULL))
SELECT coalesce(lb.conv_id, la.conv_id) AS conv_id, coalesce(lb.turn, la.turn) AS turn,
       CASE WHEN lb.pos IS NULL THEN '+' ELSE '-' END AS op, coalesce(la.pos, lb.pos) AS line_no,
       coalesce(lb.line, la.line) AS line
FROM lb FULL OUTER JOIN la ON lb.conv_id = la.conv_id AND lb.turn = la.turn AND lb.line = la.line AND lb.occ = la.occ
WHERE lb.pos IS NULL OR la.pos IS NULL""")
def line_diff_conversations(spark, sf):
    """Lines removed / added when each assistant message loses its last
    line and gains an END line."""
    conv = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    d = conv.select("conv_id", "turn", F.col("text").alias("b"), _after_text(F.col("text")).alias("a"))
    return A.line_diff(d, ["conv_id", "turn"], "b", "a")


# S1 S2 U5 ------------------------------------------------------------------
@register("read_part_columns", "SELECT p_partkey, p_name, p_retailprice FROM part")
def read_part_columns(spark, sf):
    """A column subset of a table (pruned scan)."""
    from dqspark.sources.tables import read_table
    return read_table(spark, f"{sf}/part.parquet", ["p_partkey", "p_name", "p_retailprice"])


@register("sample_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50")
def sample_orders(spark, sf):
    """A deterministic sample (limit clamped to 50, ordered by key)."""
    from dqspark.sources.tables import sample_table
    return sample_table(table(spark, sf, "orders"), limit=500, order_by=["o_orderkey"])


@register("reconcile_orders", """
WITH s AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders),
t AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'
      UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT *, 'source_only' AS side FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM t)
UNION ALL SELECT *, 'target_only' AS side FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM s)""")
def reconcile_orders(spark, sf):
    """Orders missing from / duplicated in a downstream copy."""
    from dqspark.sources.tables import reconcile_sources
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    copy = o.where(F.col("o_orderpriority") != "5-LOW").unionByName(o.where(F.col("o_orderpriority") == "1-URGENT"))
    return reconcile_sources(o, copy)


@register("list_table_files")
def list_table_files(spark, sf):
    """Object listing of the table folder (metadata only), 10 keys."""
    from dqspark.sources.tables import list_objects
    return list_objects(spark, sf, max_keys=10, glob="*.parquet")


@register("sample_csv_customers")
def sample_csv_customers(spark, sf):
    """S3: the customer table exported as CSV to the shared scratch folder,
    then sampled (header, permissive, byte budget)."""
    from dqspark.session import scratch_path
    from dqspark.sources.tables import sample_csv
    path = scratch_path(spark, "customer-csv")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return sample_csv(spark, path, limit=20, max_bytes=4096)


# S12 -------------------------------------------------------------------------
def part_definitions(part):
    """One column definition per part: a dataset per brand, the column named
    by part name and key, dataset-level fields from the part's attributes."""
    return part.select(
        F.concat(F.lit("ds_"), F.lower("p_brand")).alias("dataset"),
        F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("col_name"),
        F.lit("double").alias("Data Type"), F.col("p_size").alias("Row Count"),
        F.col("p_type").alias("Scheduler"), F.concat(F.lit("tpch_"), F.col("p_size").cast("string")).alias("db_nm"),
        F.lower(F.regexp_replace("p_brand", "#", "_")).alias("table_nm"))


@register("split_definitions_part", """
SELECT 'ds_' || lower(p_brand) AS dataset,
  arg_min(p_type, p_name || '#' || p_partkey) AS "Scheduler",
  arg_min('tpch_' || p_size, p_name || '#' || p_partkey) AS db_nm,
  arg_min(lower(replace(p_brand, '#', '_')), p_name || '#' || p_partkey) AS table_nm
FROM part GROUP BY 1""")
def split_definitions_part(spark, sf):
    """Dataset-level fields of each dataset (from its first column row
    by name), grouped in one aggregation."""
    from dqspark.sources.sinks import split_definitions
    info, _ = split_definitions(part_definitions(table(spark, sf, "part")))
    return info


# S13 -------------------------------------------------------------------------
@register("clean_documents", """
SELECT doc_id, to_json({'lang': lang, 'source': source})::VARCHAR AS meta,
  to_json([lang, source])::VARCHAR AS tags, to_json([n_chars, doc_id])::VARCHAR AS sizes,
  CASE WHEN n_chars % 7 = 0 THEN NULL ELSE n_chars / 1000.0 END AS kchars
FROM documents""")
def clean_documents(spark, sf):
    """Nested values (struct, string and integer arrays) become JSON
    text and NaN becomes null before a write; other columns pass through."""
    d = table(spark, sf, "documents")
    nan = F.lit(float("nan"))
    frame = d.select("doc_id", F.struct("lang", "source").alias("meta"), F.array("lang", "source").alias("tags"),
                     F.array("n_chars", "doc_id").alias("sizes"),
                     F.when(F.col("n_chars") % 7 == 0, nan).otherwise(F.col("n_chars") / 1000.0).alias("kchars"))
    return S.clean_for_write(frame)


@register("split_definitions_columns_part", """
SELECT 'ds_' || lower(p_brand) AS dataset, p_name || '#' || p_partkey AS col_name, 'double' AS "Data Type", p_size AS "Row Count" FROM part""")
def split_definitions_columns_part(spark, sf):
    """The column half; every column row keeps its own fields only."""
    from dqspark.sources.sinks import split_definitions
    return split_definitions(part_definitions(table(spark, sf, "part")))[1]
