"""Rule queries (F4 F6-F9 A11 A12 A14 J9 J13) over lineitem / orders / customer / part."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import rules as R
from dqspark.plans.catalog import register, register_views, table

# Rule set of the lineitem dataset (configuration, compiled into one scan).
LINEITEM_RULES = [
    {"ruleNm": "if_l_quantity_gt_45", "ruleType": "SQLG", "ruleValue": "l_quantity > 45",
     "columnName": "l_quantity", "dimId": 4, "points": 1, "perc": 1, "tolerance": 0},
    {"ruleNm": "if_l_discount_high", "ruleType": "SQLG", "ruleValue": "l_discount > 0.08",
     "columnName": "l_discount", "dimId": 6, "points": 2, "perc": 5, "tolerance": 1},
    {"ruleNm": "if_l_returnflag_r_open", "ruleType": "SQLG",
     "ruleValue": "l_returnflag = 'R' AND l_linestatus = 'O'", "columnName": "l_returnflag",
     "dimId": 5, "points": 1, "perc": 2, "tolerance": 0},
    {"ruleNm": "if_l_tax_is_null_empty", "ruleType": "CUSTOM", "ruleRepo": "null_empty",
     "ruleValue": "l_tax", "columnName": "l_tax", "dimId": 1, "points": 3, "perc": 1, "tolerance": 0},
    {"ruleNm": "if_l_shipdate_early", "ruleType": "SQLG", "ruleValue": "l_shipdate < '1995-06-01'",
     "columnName": "l_shipdate", "dimId": 2, "points": 1, "perc": 1, "tolerance": 5},
    {"ruleNm": "if_l_extendedprice_high_n", "ruleType": "SQLG", "ruleValue": "l_extendedprice > 50000",
     "filterQuery": "l_returnflag = 'N'", "columnName": "l_extendedprice", "dimId": 4, "points": 1,
     "perc": 1, "tolerance": 0},
    {"ruleNm": "if_l_linenumber_is_range", "ruleType": "CUSTOM", "ruleRepo": "range",
     "ruleValue": "l_linenumber", "columnName": "l_linenumber", "params": {"low": 1, "high": 6},
     "dimId": 4, "points": 1, "perc": 1, "tolerance": 0},
]


def _dq(c):
    return '"' + c + '"'


def _sql_cond(r):
    if r.get("ruleRepo"):
        return R.expand_template(r["ruleRepo"], r["columnName"], quote=_dq, **(r.get("params") or {}))
    return r["ruleValue"]


def sql_rule_rates(tbl="lineitem", rules=LINEITEM_RULES):
    parts = []
    for r in rules:
        flt = r.get("filterQuery") or "TRUE"
        dim = R.DIMENSIONS.get(int(r.get("dimId") or 0))
        parts.append(f"""SELECT '{r["ruleNm"]}' AS rule_name, {int(r.get("dimId") or 0)} AS dim_id,
  '{dim}' AS dimension, {int(r.get("points", 1))} AS points, {float(r.get("perc", 1))}::DOUBLE AS perc,
  {float(r.get("tolerance", 0))}::DOUBLE AS tolerance,
  count(*) FILTER (WHERE coalesce(({flt}), FALSE) AND coalesce(({_sql_cond(r)}), FALSE)) AS breaks,
  count(*) FILTER (WHERE coalesce(({flt}), FALSE)) AS total FROM {tbl}""")
    body = "\nUNION ALL\n".join(parts)
    return f"""SELECT *, CASE WHEN total = 0 THEN 0.0 ELSE breaks * 100.0 / total END AS break_pct FROM ({body})"""


def lineitem_rates(spark, sf):
    return R.rule_break_rates(table(spark, sf, "lineitem"), LINEITEM_RULES)


@register("rule_break_rates", sql_rule_rates())
def rule_break_rates(spark, sf):
    """All lineitem rules evaluated in one scan (SQLG + CUSTOM templates + filterQuery)."""
    return lineitem_rates(spark, sf)


@register("dataset_score_lineitem", f"""
SELECT greatest(0.0, 100.0 - sum(points * floor(greatest(break_pct - tolerance, 0.0) / perc))::DOUBLE) AS score,
       count(*) AS n_rules, count(*) FILTER (WHERE breaks > 0) AS n_breaking_rules
FROM ({sql_rule_rates()})""")
def dataset_score_lineitem(spark, sf):
    return R.dataset_score(lineitem_rates(spark, sf))


@register("dimension_rollup", f"""
SELECT dimension, sum(breaks)::BIGINT AS breaks, sum(total)::BIGINT AS total, count(*) AS n_rules,
  CASE WHEN sum(total) = 0 THEN 0.0 ELSE sum(breaks) * 100.0 / sum(total) END AS break_pct
FROM ({sql_rule_rates()}) GROUP BY ROLLUP (dimension)""")
def dimension_rollup(spark, sf):
    return R.dimension_rollup(lineitem_rates(spark, sf))


@register("referential_rule", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def referential_rule(spark, sf):
    """Orders whose customer is not a BUILDING-segment customer (NOT IN, null-aware)."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    parent = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return R.referential_rule(orders, parent, "o_custkey", "c_custkey")


READONLY_SQL = """select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as sum_qty
from lineitem group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus;"""


@register("readonly_query", f"SELECT * FROM ({READONLY_SQL.rstrip(';')}) AS _rule_test LIMIT 20")
def readonly_query(spark, sf):
    register_views(spark, sf, ["lineitem"])
    return R.run_readonly_query(spark, READONLY_SQL, limit=20)


SQLF_RULE = """SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_acctbal
FROM @orders o JOIN @customer c ON o.o_custkey = c.c_custkey
WHERE o.o_totalprice > 100 * c.c_acctbal"""


@register("rule_sql_breaks", SQLF_RULE.replace("@orders", "orders").replace("@customer", "customer"))
def rule_sql_breaks(spark, sf):
    """SQLF rule with @dataset tokens bound to the orders and customer tables."""
    return R.rule_sql(spark, SQLF_RULE, {"orders": table(spark, sf, "orders"),
                                        "customer": table(spark, sf, "customer")})


@register("rule_condition_lineitem", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_returnflag = 'R' AND coalesce(l_quantity > 45, FALSE)""")
def rule_condition_lineitem(spark, sf):
    """SQLG condition with a filterQuery pre-filter: the break rows."""
    li = table(spark, sf, "lineitem")
    return R.rule_condition(li, "l_quantity > 45", "l_returnflag = 'R'") \
        .select("l_orderkey", "l_linenumber", "l_quantity")


@register("rule_template_part", f"""
SELECT p_partkey, p_size FROM part WHERE coalesce(({R.expand_template("range", "p_size", quote=_dq,
                                                                    low=1, high=45)}), FALSE)""")
def rule_template_part(spark, sf):
    """CUSTOM template rule (range) applied to part.p_size."""
    cond = R.template_condition("range", "p_size", low=1, high=45)
    return R.rule_condition(table(spark, sf, "part"), cond).select("p_partkey", "p_size")


@register("rule_templates_more_part", r"""
SELECT p_partkey, 'regex' AS template FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-3]\d$')
UNION ALL SELECT p_partkey, 'not_in_set' FROM part WHERE p_size NOT IN (1, 7, 14, 21, 28)
UNION ALL SELECT p_partkey, 'length' FROM part WHERE length(p_name) > 12""")
def rule_templates_more_part(spark, sf):
    """F8: the regex, set and length templates over the whole part table."""
    part = table(spark, sf, "part")
    asked = {"regex": ("p_brand", {"pattern": r"^Brand#[1-3]\d$"}), "not_in_set": ("p_size", {"values": [1, 7, 14, 21, 28]}),
             "length": ("p_name", {"max_len": 12})}
    out = None
    for name, (col, params) in asked.items():
        one = R.rule_condition(part, R.template_condition(name, col, **params)).select("p_partkey", F.lit(name).alias("template"))
        out = one if out is None else out.unionByName(one)
    return out


EXPECTED_EXTRA = "if_l_missing_rule"


@register("validate_rules_lineitem", f"""
WITH f AS (SELECT 'lineitem' AS dataset, '2024-01-31' AS run_date, rule_name,
                  CASE WHEN breaks = 0 THEN 'Passing ' ELSE 'BREAKING' END AS breakMsg,
                  NULL::VARCHAR AS exception, 100.0 - break_pct AS score, perc, total AS "rows", (breaks = 0)::INTEGER AS "passFail" FROM ({sql_rule_rates()})),
e AS (SELECT 'lineitem' AS dataset, '2024-01-31' AS run_date, rule_name FROM f
      UNION ALL SELECT 'lineitem', '2024-01-31', '{EXPECTED_EXTRA}')
SELECT e.dataset, e.run_date, e.rule_name, f.rule_name IS NOT NULL AS found,
  CASE WHEN f.rule_name IS NULL THEN NULL
       ELSE upper(trim(coalesce(f.breakMsg, ''))) = 'PASSING' AND coalesce(f.exception, '') = '' END AS passed,
  f.score, f.perc, f.breakMsg, f.exception, f."rows", f."passFail"
FROM e LEFT JOIN f USING (dataset, run_date, rule_name)""")
def validate_rules_lineitem(spark, sf):
    """Expected rules (the rule set plus one never run) against the run's
    rule findings; a passing rule carries breakMsg ' Passing '."""
    rates = lineitem_rates(spark, sf)
    findings = rates.select(
        F.lit("lineitem").alias("dataset"), F.lit("2024-01-31").alias("run_date"),
        F.col("rule_name").alias("ruleNm"),
        F.when(F.col("breaks") == 0, "Passing ").otherwise("BREAKING").alias("breakMsg"),
        F.lit(None).cast("string").alias("exception"), (100.0 - F.col("break_pct")).alias("score"), "perc",
        F.col("total").alias("rows"), (F.col("breaks") == 0).cast("int").alias("passFail"))
    # expected rules = the configured rule list (+ one that never ran): configuration, no scan
    expected = spark.createDataFrame([("lineitem", "2024-01-31", r["ruleNm"]) for r in LINEITEM_RULES]
                                     + [("lineitem", "2024-01-31", EXPECTED_EXTRA)],
                                     "dataset string, run_date string, rule_name string")
    return R.validate_rules(expected, findings)


# S14 + S15 + F14 ---------------------------------------------------------------
# Findings payloads (JSON text, as the result service returns them) of one run
# per (order priority, month): a status rule per order status, a dqItem for
# runs of more than 40 orders, no other finding arrays.  The payload arrays
# have a fixed size (built from aggregates, not from collected rows).
def orders_findings_json(orders):
    n = F.count(F.lit(1))
    st = {s: F.count_if(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}
    g = orders.groupBy(F.col("o_orderpriority").alias("dataset"),
                       F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-01")).alias("run_date")).agg(
        n.alias("rows"), *[v.alias(f"_{s}") for s, v in st.items()], F.max("o_totalprice").alias("_mx"))
    rules = F.array(*[F.struct(F.lit(f"if_status_{s}").alias("ruleNm"),
                               F.when(F.col(f"_{s}") > 0, "BREAK").otherwise("Passing").alias("breakMsg"),
                               F.col(f"_{s}").cast("double").alias("score"),
                               (F.col(f"_{s}") * 100.0 / F.col("rows")).alias("perc")) for s in st])
    dq = F.when(F.col("rows") > 40, F.array(F.struct(F.lit("o_totalprice").alias("item"), F.lit("MAX").alias("metric"),
                                                      F.col("_mx").alias("score"))))
    payload = F.struct("dataset", "run_date", "rows", rules.alias("rules"),
                       F.coalesce(dq, F.array().cast("array<struct<item:string,metric:string,score:double>>"))
                       .alias("dqItems"), F.col("_F").cast("double").alias("ruleScore"))
    return g.select(F.to_json(payload).alias("json"))


@register("findings_orders", """
WITH g AS (SELECT o_orderpriority AS dataset, strftime(o_orderdate, '%Y-%m') || '-01' AS run_date, count(*) AS n,
                  count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o,
                  count(*) FILTER (WHERE o_orderstatus = 'P') AS p, max(o_totalprice) AS mx
           FROM orders GROUP BY 1, 2),
i AS (SELECT dataset, run_date, 'rules' AS finding_type, 'if_status_F' AS item_name, f::DOUBLE AS item_score, TRUE AS has_item FROM g
      UNION ALL SELECT dataset, run_date, 'rules', 'if_status_O', o::DOUBLE, TRUE FROM g
      UNION ALL SELECT dataset, run_date, 'rules', 'if_status_P', p::DOUBLE, TRUE FROM g
      UNION ALL SELECT dataset, run_date, 'dqItems', CASE WHEN n > 40 THEN 'o_totalprice' END,
                       CASE WHEN n > 40 THEN mx END, n > 40 FROM g
      UNION ALL SELECT dataset, run_date, 'outliers', NULL, NULL, FALSE FROM g)
SELECT * FROM i WHERE dataset = '1-URGENT' AND run_date >= '1994-01-01' AND run_date <= '1996-12-31'""")
def findings_orders(spark, sf):
    """S14 -> S15 -> F14: findings payloads ingested with the declared schema,
    flattened to one row per finding (a missing or empty array still gives
    its run one row), then filtered by dataset, run-date window and finding
    types.  Typed fields are read back out of each item's JSON."""
    from dqspark.sources.tables import ingest_findings
    flat = R.flatten_findings(ingest_findings(orders_findings_json(table(spark, sf, "orders"))))
    f = R.filter_findings(flat, "1-URGENT", since="1994-01-01", until="1996-12-31",
                          finding_types=["rules", "dqItems", "outliers"])
    return f.select("dataset", "run_date", "finding_type",
                    F.coalesce(F.get_json_object("item", "$.ruleNm"), F.get_json_object("item", "$.item"))
                    .alias("item_name"),
                    F.get_json_object("item", "$.score").cast("double").alias("item_score"),
                    F.col("item").isNotNull().alias("has_item"))
