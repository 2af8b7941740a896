"""Audit and change-history queries.

Definitions are built from supplier rows, rules from part rows and
change-history rows from events (event_type = category, user_id = user).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.functions.exprs import dataset_name
from dqspark.operators import audit as A
from dqspark.operators import rules as R
from dqspark.plans.catalog import register, table
from dqspark.plans.registry_plans import part_registry

_DAYS = "[" + ",".join(f"'{d}'" for d in sorted(A.SCHEDULE_DAYS)) + "]"


# Q8 + Q1 ---------------------------------------------------------------------
def supplier_requests(supplier):
    k = F.col("s_nationkey")
    return supplier.select(
        "s_suppkey",
        F.when(F.col("s_acctbal") >= 0, dataset_name("redshift", F.lit("local"), F.lit("tpch"),
                                                     F.col("s_name")))
         .otherwise(F.concat(F.lit("supplier_"), F.col("s_suppkey"))).alias("dataset"),
        F.when(k % 3 == 0, "redshift").when(k % 3 == 1, "s3").otherwise("jdbc").alias("source_type"),
        F.lit("conn_local").alias("connection_name"), F.lit("tpch").alias("db_nm"),
        F.lower(F.regexp_replace("s_name", "#", "_")).alias("table_nm"),
        F.concat(F.lit("s3://bucket/tpch/"), F.col("s_suppkey"), F.lit(".csv")).alias("s3_path"),
        F.when(k % 4 != 0, F.lit("Master-Data")).alias("data_domain"),
        F.lit("ORG").alias("sub_domain"),
        F.when(F.col("s_acctbal") > 1000, F.array(F.lit("s_suppkey"))).otherwise(F.array().cast("array<string>"))
        .alias("link_id"),
        F.when(k != 5, F.lit("06:00")).alias("schedule_time"),
        F.lit("2024-01-31").alias("run_date"))


SQL_SUPPLIER_AUDIT = f"""
WITH r AS (SELECT s_suppkey,
    CASE WHEN s_acctbal >= 0 THEN 'ds_redshift_local_tpch_' || regexp_replace(replace(lower(s_name), '-', '_'), '[^a-z0-9_]+', '_', 'g')
         ELSE 'supplier_' || s_suppkey END AS dataset,
    CASE s_nationkey % 3 WHEN 0 THEN 'redshift' WHEN 1 THEN 's3' ELSE 'jdbc' END AS source_type,
    CASE WHEN s_nationkey % 4 <> 0 THEN 'Master-Data' END AS data_domain,
    s_acctbal > 1000 AS has_link, CASE WHEN s_nationkey <> 5 THEN '06:00' END AS schedule_time
  FROM supplier)
SELECT s_suppkey, dataset,
  CASE WHEN source_type NOT IN ('redshift', 's3') THEN 'unsupported source_type' END AS error,
  concat_ws('; ',
    CASE WHEN NOT has_link THEN 'DUPLICATES_OFF; KEYS_MISSING' END,
    CASE WHEN NOT starts_with(dataset, 'ds_') THEN 'NAME_PREFIX' END,
    CASE WHEN coalesce(schedule_time, '') = '' THEN 'SCHEDULE_TIME' END,
    CASE WHEN coalesce(data_domain, '') = '' THEN 'TAGS_INCOMPLETE' END) AS issues
FROM r"""


@register("audit_definitions", SQL_SUPPLIER_AUDIT)
def audit_definitions(spark, sf):
    """Q8 + Q1: build a definition per supplier request, then audit it."""
    defs = A.build_definitions(supplier_requests(table(spark, sf, "supplier")))
    audited = A.audit_best_practices(defs.select("s_suppkey", "error", "definition.*"))
    return audited.select("s_suppkey", "dataset", "error", F.array_join("issues", "; ").alias("issues"))


# Q3 + Q2 -------------------------------------------------------------------
def part_rules(part):
    s = F.col("p_size")
    repo = F.when(s % 3 == 2, F.lit("null_empty"))
    col = F.when(s <= 45, F.lit("p_brand"))
    name = (F.when(s % 3 == 0, F.concat(F.lit("if_"), F.lower("p_type"), F.lit("_size")))
            .when(s % 3 == 1, F.concat(F.lit("IF_BAD-"), F.col("p_partkey")))
            .otherwise(F.concat(F.lit("if_p_brand_is_"), repo)))
    rtype = F.when(F.col("p_type") == "ECONOMY", "CUSTOM").when(F.col("p_type") == "SMALL", "SQLX").otherwise("SQLG")
    return part.select("p_partkey", name.alias("ruleNm"), rtype.alias("ruleType"), repo.alias("ruleRepo"),
                       col.alias("columnName"),
                       F.when(repo.isNotNull(), F.lit("p_brand")).otherwise(F.lit("p_size > 10")).alias("ruleValue"),
                       F.lit(None).cast("string").alias("filterQuery"))


@register("audit_rules", """
WITH r AS (SELECT p_partkey,
    CASE p_size % 3 WHEN 0 THEN 'if_' || lower(p_type) || '_size' WHEN 1 THEN 'IF_BAD-' || p_partkey
         ELSE 'if_p_brand_is_null_empty' END AS nm,
    CASE WHEN p_type = 'ECONOMY' THEN 'CUSTOM' WHEN p_type = 'SMALL' THEN 'SQLX' ELSE 'SQLG' END AS rtype,
    CASE WHEN p_size % 3 = 2 THEN 'null_empty' ELSE '' END AS repo,
    CASE WHEN p_size <= 45 THEN 'p_brand' END AS col,
    CASE WHEN p_size % 3 = 2 THEN 'p_brand' ELSE 'p_size > 10' END AS val FROM part)
SELECT p_partkey, nm AS ruleNm, repo AS ruleRepo, CASE WHEN repo <> '' AND col <> '' THEN 'if_' || col || '_is_' || repo END AS expected_rule_nm,
  concat_ws('; ',
  CASE WHEN coalesce(col, '') = '' THEN 'COLUMN_MISSING' END,
  CASE WHEN NOT regexp_full_match(nm, 'if_[a-z0-9]+(?:_[a-z0-9]+)*') THEN 'NAME_PATTERN' END,
  CASE WHEN repo <> '' AND coalesce(col, '') <> '' AND nm <> 'if_' || col || '_is_' || repo THEN 'TEMPLATE_NAME' END,
  CASE WHEN repo <> '' AND rtype <> 'CUSTOM' THEN 'TEMPLATE_TYPE' END,
  CASE WHEN repo <> '' AND coalesce(col, '') <> '' AND val <> col THEN 'TEMPLATE_VALUE' END,
  CASE WHEN repo = '' AND rtype NOT IN ('SQLF', 'SQLG') THEN 'TYPE_UNKNOWN' END) AS issues
FROM r""")
def audit_rules(spark, sf):
    """Q3 + Q2: normalise new rules (defaults, '' for null ruleRepo) and list
    their best-practice issues."""
    rules = R.normalize_rules(part_rules(table(spark, sf, "part")))
    audited = R.audit_rules(rules)
    return audited.select("p_partkey", "ruleNm", "ruleRepo", "expected_rule_nm", F.array_join("issues", "; ").alias("issues"))


# Q7 ------------------------------------------------------------------------
@register("audit_taxonomy", f"""
WITH g AS (SELECT p_type, p_name, min(p_size) AS s FROM part GROUP BY ALL),
m AS (SELECT 'ds_redshift_local_' || lower(p_type) || '_' || replace(p_name, ' ', '_') AS dataset,
        ['{"','".join(A.DATA_DOMAINS)}'][s % 7 + 1] AS dom,
        'PRO,' || CASE WHEN s % 2 = 0 THEN 'SAL' ELSE 'GEO' END || CASE WHEN p_type = 'PROMO' THEN ',XYZ,ABC' ELSE '' END AS sub
      FROM g),
c AS (SELECT *, list_filter(list_transform(string_split(coalesce(sub, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS codes FROM m),
b AS (SELECT *, list_sort(list_filter(codes, lambda x: NOT list_contains(['{"','".join(A.SUBDOMAIN_CODES)}'], x))) AS bad FROM c)
SELECT dataset, concat_ws('; ',
  CASE WHEN dom NOT IN ('{"','".join(A.DATA_DOMAINS)}') OR dom IS NULL THEN 'unknown Data Domain' END,
  CASE WHEN len(codes) = 0 THEN 'subDomain is empty' END,
  CASE WHEN len(bad) > 0 THEN 'unknown subDomain codes: ' || array_to_string(list_sort(list_distinct(bad)), ',') END) AS issues
FROM b""")
def audit_taxonomy(spark, sf):
    """Q7: Data Domain and sub-domain codes of the tagged registry."""
    reg = part_registry(table(spark, sf, "part")).withColumn(
        "subDomain", F.when(F.col("db_nm") == "promo", F.concat("subDomain", F.lit(",XYZ,ABC")))
        .otherwise(F.col("subDomain")))
    out = A.audit_taxonomy(reg)
    return out.select("dataset", F.array_join("issues", "; ").alias("issues"))


# change history from events ---------------------------------------------------
def event_changes(events):
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("ds_app_"), (F.col("user_id") % 5).cast("string")).alias("dataset"),
        F.when(F.col("user_id") % 2 == 0, "local").otherwise("region").alias("region"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"),
        F.lit("Existing").alias("dataset_category"),
        F.col("event_type").alias("change_category"), F.lit("k").alias("change_item"),
        F.get_json_object("props", "$.k").alias("change_from"),
        F.col("value").cast("decimal(12,2)").cast("string").alias("change_to"),
        F.when(F.col("value") > 250, "large").alias("change_reason"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("change_by"),
        F.col("ts").alias("changed_at"))


SQL_CHANGES = """SELECT event_id AS id, 'ds_app_' || (user_id % 5) AS dataset,
  CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'region' END AS region,
  user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, 'Existing' AS dataset_category,
  event_type AS change_category, 'k' AS change_item, json_extract_string(props, '$.k') AS change_from,
  CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS change_to,
  CASE WHEN value > 250 THEN 'large' END AS change_reason, 'user_' || user_id AS change_by, ts AS changed_at
FROM events"""

_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_SFMT = "%Y-%m-%d %H:%M:%S.%f"


@register("change_history", f"""
SELECT id, strftime(changed_at, '{_SFMT}') AS changed_at, change_by, change_to FROM ({SQL_CHANGES})
WHERE dataset = 'ds_app_3' AND change_category = 'purchase'
  AND changed_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY
ORDER BY changed_at DESC, id DESC LIMIT 200""")
def change_history(spark, sf):
    """F10 + T1: one dataset's purchase changes of the last 10 days, newest first."""
    ch = event_changes(table(spark, sf, "events"))
    h = A.filter_change_history(ch, "ds_app_3", as_of="2024-01-31 00:00:00", category="purchase",
                                since_days=10, limit=200)
    return h.select("id", F.date_format("changed_at", _FMT).alias("changed_at"), "change_by", "change_to")


@register("change_summary", f"""
SELECT dataset, count(*) AS total_changes,
  count(DISTINCT CASE WHEN coalesce(session_id, '') <> '' THEN session_id END) AS distinct_sessions,
  strftime(min(changed_at), '{_SFMT}') AS first_change_at, strftime(max(changed_at), '{_SFMT}') AS last_change_at
FROM ({SQL_CHANGES}) GROUP BY dataset""")
def change_summary(spark, sf):
    """Per dataset totals, distinct sessions, first / last change."""
    s = A.change_summary(event_changes(table(spark, sf, "events")))
    return s.select("dataset", "total_changes", "distinct_sessions",
                    F.date_format("first_change_at", _FMT).alias("first_change_at"),
                    F.date_format("last_change_at", _FMT).alias("last_change_at"))


@register("change_breakdown", f"""
SELECT dataset, 'category' AS dimension, CASE WHEN coalesce(change_category, '') = '' THEN 'Unknown' ELSE change_category END AS value,
  count(*) AS n FROM ({SQL_CHANGES}) GROUP BY ALL
UNION ALL
SELECT dataset, 'user', CASE WHEN coalesce(change_by, '') = '' THEN 'unknown' ELSE change_by END, count(*)
FROM ({SQL_CHANGES}) GROUP BY ALL""")
def change_breakdown(spark, sf):
    """Changes by category and by user per dataset."""
    return A.change_breakdown(event_changes(table(spark, sf, "events")))


@register("change_digest", f"""
WITH c AS (SELECT * FROM ({SQL_CHANGES}) WHERE changed_at >= TIMESTAMP '2024-01-30 00:00:00'),
b AS (SELECT region, dataset, changed_at, change_by, change_reason,
        concat_ws(chr(10), '- Changed by: ' || coalesce(change_by, ''),
                  '- Change date: ' || strftime(changed_at, '%Y-%m-%d %H:%M:%S'),
                  '- Reason: ' || coalesce(nullif(change_reason, ''), 'N/A'), '',
                  string_agg('- [' || coalesce(change_category, '') || '] ' || coalesce(change_item, '') || ': '
                             || coalesce(change_from, 'None') || ' -> ' || coalesce(change_to, 'None'), chr(10)
                             ORDER BY change_item, '- [' || coalesce(change_category, '') || '] ' || coalesce(change_item, '') || ': '
                             || coalesce(change_from, 'None') || ' -> ' || coalesce(change_to, 'None'))) AS text
      FROM c GROUP BY region, dataset, changed_at, change_by, change_reason)
SELECT region, dataset, count(*) AS n_batches, string_agg(text, chr(10) || chr(10) ORDER BY changed_at, text) AS digest
FROM b GROUP BY region, dataset""")
def change_digest(spark, sf):
    """The last day's change batches rendered as one text per (region, dataset)."""
    ch = event_changes(table(spark, sf, "events")).where(
        F.col("changed_at") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    return A.change_digest(ch)


@register("change_batches", f"""
SELECT dataset, strftime(changed_at, '{_SFMT}') AS changed_at, change_by, coalesce(change_reason, '') AS change_reason,
  count(*) OVER (PARTITION BY dataset, changed_at, change_by, coalesce(change_reason, '')) AS n_changes,
  change_category, change_item, change_from, change_to
FROM ({SQL_CHANGES})""")
def change_batches(spark, sf):
    """Changes grouped into batches (time, user, reason); each change is
    listed with the size of its batch."""
    b = A.change_batches(event_changes(table(spark, sf, "events")))
    return b.select("dataset", F.date_format("changed_at", _FMT).alias("changed_at"), "change_by", "change_reason",
                    "n_changes", F.inline("changes"))


@register("change_log_events", f"""
SELECT dataset, region, session_id, dataset_category, change_category, change_item, change_from, change_to,
  change_reason, change_by, strftime(changed_at, '{_SFMT}') AS changed_at FROM ({SQL_CHANGES})""")
def change_log_events(spark, sf):
    """Event-derived changes appended to a change-history table in the
    shared scratch folder in two batches (before / from mid-January), then
    read back."""
    from dqspark.session import scratch_path
    from dqspark.sources.sinks import append_change_log
    ch = event_changes(table(spark, sf, "events"))
    mid = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    path = scratch_path(spark, "change-log")
    append_change_log(ch.where(F.col("changed_at") < mid), path)
    append_change_log(ch.where(F.col("changed_at") >= mid), path)
    log = spark.read.parquet(path)
    return log.select(*[c for c in log.columns if c != "changed_at"],
                      F.date_format("changed_at", _FMT).alias("changed_at"))


# Q9 ------------------------------------------------------------------------
def event_scores(events):
    return events.groupBy(F.concat(F.lit("ds_app_"), (F.col("user_id") % 5).cast("string")).alias("dataset"),
                          F.to_date("ts").cast("string").alias("run_date")) \
        .agg((F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)) * 100.0).alias("score"))


def dataset_alerts(region):
    """Alert definitions kept in a small table: datasets ds_app_0..2 (one per
    region key) carry a custom condition, ds_app_1's alert is inactive."""
    ds = region.select(F.concat(F.lit("ds_app_"), F.col("r_regionkey").cast("string")).alias("dataset"))
    return ds.where(F.col("dataset").isin("ds_app_0", "ds_app_1", "ds_app_2")).select(
        "dataset", F.lit("Custom Low Score").alias("alertNm"), F.lit("score < 78").alias("alertCond"),
        (F.col("dataset") != "ds_app_1").alias("active"))


@register("evaluate_alerts", """
WITH s AS (SELECT 'ds_app_' || (user_id % 5) AS dataset, strftime(ts, '%Y-%m-%d') AS run_date,
                  avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) * 100.0 AS score FROM events GROUP BY ALL),
a AS (SELECT DISTINCT dataset, coalesce(CASE WHEN dataset IN ('ds_app_0', 'ds_app_1', 'ds_app_2') THEN 'score < 78' END,
                                        'score < 95') AS alertCond,
             coalesce(CASE WHEN dataset IN ('ds_app_0', 'ds_app_1', 'ds_app_2') THEN dataset <> 'ds_app_1' END, TRUE) AS active,
             dataset NOT IN ('ds_app_0', 'ds_app_1', 'ds_app_2') AS is_default FROM s)
SELECT s.dataset, run_date, score, alertCond, is_default,
  CASE alertCond WHEN 'score < 78' THEN score < 78 ELSE score < 95 END AS fired
FROM s JOIN a ON s.dataset = a.dataset WHERE active""")
def evaluate_alerts(spark, sf):
    """Q9: each dataset's alert (or the default low-score alert) evaluated
    against its daily scores."""
    scores = event_scores(table(spark, sf, "events"))                    # the one scan of events
    region = table(spark, sf, "region")
    datasets = region.select(F.concat(F.lit("ds_app_"), F.col("r_regionkey").cast("string")).alias("dataset"))
    plan = A.plan_alerts(datasets, dataset_alerts(region))
    out = A.evaluate_alerts(scores, plan)
    return out.select("dataset", "run_date", "score", "alertCond", "is_default", "fired")


def customer_alerts(customer):
    """An alert per customer key, its condition written as a user might."""
    b = (F.col("c_custkey") % 100).cast("string")
    cond = F.element_at(F.array(
        F.concat(F.lit("score < "), b), F.concat(F.lit("n_events >= "), b, F.lit(" AND score <= 80")),
        F.concat(F.lit(" score BETWEEN 70 and 7"), (F.col("c_custkey") % 10).cast("string"), F.lit(" or n_errors > "), b),
        F.concat(b, F.lit(".5>score")), F.concat(F.lit("max_big is null Or max_big != 0 and n_events == "), b),
        F.lit("score <"), F.lit("speed > 1"), F.lit(" ")), (F.col("c_custkey") % 8 + 1).cast("int"))
    return customer.select(F.concat(F.lit("ds_app_"), (F.col("c_custkey") % 5).cast("string")).alias("dataset"),
                           F.col("c_custkey").alias("alert_id"), cond.alias("alertCond"), (F.col("c_custkey") % 9 != 0).alias("active"))


@register("alert_conditions_customer", """
WITH s AS (SELECT 'ds_app_' || (user_id % 5) AS dataset, strftime(ts, '%Y-%m-%d') AS run_date, count(*) AS n_events,
             avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) * 100.0 AS score,
             count(*) FILTER (WHERE event_type = 'error') AS n_errors, max(CASE WHEN value > 330 THEN value END) AS max_big
           FROM events GROUP BY ALL),
a AS (SELECT 'ds_app_' || (c_custkey % 5) AS dataset, c_custkey AS alert_id, c_custkey % 100 AS b, c_custkey % 10 AS e, c_custkey % 8 AS k
      FROM customer WHERE c_custkey % 9 <> 0),
j AS (SELECT *, CASE k WHEN 0 THEN score < b WHEN 1 THEN n_events >= b AND score <= 80 WHEN 2 THEN score BETWEEN 70 AND 70 + e OR n_errors > b
        WHEN 3 THEN score < b + 0.5 WHEN 4 THEN max_big IS NULL OR max_big <> 0 AND n_events = b END AS f FROM s JOIN a USING (dataset))
SELECT dataset, alert_id, CASE k WHEN 5 THEN 'not a test: score <' WHEN 6 THEN 'unknown column speed' WHEN 7 THEN 'no condition' END AS reason,
  count(*) AS n_runs, count(*) FILTER (WHERE coalesce(f, false)) AS n_fired
FROM j GROUP BY ALL""")
def alert_conditions_customer(spark, sf):
    """Q9: thousands of alert conditions as data, evaluated over the daily
    scores in one plan; those that are no conditions are named."""
    ev = table(spark, sf, "events").select(
        F.concat(F.lit("ds_app_"), (F.col("user_id") % 5).cast("string")).alias("dataset"), F.to_date("ts").cast("string").alias("run_date"),
        (F.col("event_type") == "error").alias("err"), "value")
    scores = ev.groupBy("dataset", "run_date").agg(
        F.count("*").alias("n_events"), (F.avg(F.when(~F.col("err"), 1.0).otherwise(0.0)) * 100.0).alias("score"),
        F.count_if("err").alias("n_errors"), F.max(F.when(F.col("value") > 330, F.col("value"))).alias("max_big"))
    out = A.evaluate_alerts(scores, customer_alerts(table(spark, sf, "customer")))
    return out.groupBy("dataset", "alert_id", "reason").agg(F.count("*").alias("n_runs"), F.count_if("fired").alias("n_fired"))


# Q4 --------------------------------------------------------------------------
def part_profile_requests(part):
    """Per part: the stored profile flags and one requested patch, chosen by
    p_size % 5 (modifiable flags, a locked flag, an unknown flag, or a mix of
    modifiable, locked and unknown)."""
    profile = F.create_map(F.lit("behaviorRowCheck"), F.col("p_size") % 2 == 0,
                           F.lit("behaviorNullCheck"), F.col("p_size") > 25, F.lit("detectTopnBotn"), F.lit(True))
    k = F.col("p_size") % 5
    patch = (F.when(k == 0, F.create_map(F.lit("behaviorNullCheck"), F.lit(False)))
             .when(k == 1, F.create_map(F.lit("behaviorMeanValueCheck"), F.lit(True),
                                        F.lit("behaviorRowCheck"), F.col("p_retailprice") > 1500))
             .when(k == 2, F.create_map(F.lit("detectTopnBotn"), F.lit(False)))
             .when(k == 3, F.create_map(F.lit("fooCheck"), F.lit(True)))
             .otherwise(F.create_map(F.lit("behaviorUniqueCheck"), F.lit(True), F.lit("detectScalePrecision"), F.lit(True),
                                     F.lit("barCheck"), F.lit(False))))
    return part.select("p_partkey", profile.alias("profile"), patch.alias("patch"))


@register("profile_settings_part", """
SELECT p_partkey,
  CASE p_size % 5 WHEN 2 THEN 'locked flags: detectTopnBotn' WHEN 3 THEN 'unknown flags: fooCheck'
                  WHEN 4 THEN 'locked flags: detectScalePrecision' END AS error,
  CASE WHEN p_size % 5 = 1 THEN p_retailprice > 1500 ELSE p_size % 2 = 0 END AS behaviorRowCheck,
  CASE WHEN p_size % 5 = 0 THEN FALSE ELSE p_size > 25 END AS behaviorNullCheck,
  CASE WHEN p_size % 5 = 1 THEN TRUE END AS behaviorMeanValueCheck,
  CAST(NULL AS BOOLEAN) AS behaviorUniqueCheck,
  TRUE AS detectTopnBotn,
  (CASE WHEN p_size % 5 = 1 THEN 4 ELSE 3 END)::INTEGER AS n_flags
FROM part""")
def profile_settings_part(spark, sf):
    """Q4: requested profile flags overlaid on each definition's profile;
    a request touching a locked or unknown flag is rejected whole."""
    out = A.apply_profile_settings(part_profile_requests(table(spark, sf, "part")))
    p = F.col("new_profile")
    return out.select("p_partkey", "error",
                      *[p[f].alias(f) for f in ("behaviorRowCheck", "behaviorNullCheck", "behaviorMeanValueCheck",
                                                "behaviorUniqueCheck", "detectTopnBotn")],
                      F.size(p).alias("n_flags"))


# Q5 --------------------------------------------------------------------------
# Existing rules: one per part of size <= 25 in its brand's dataset.  Payload:
# one rule per part, by p_partkey % 5 - kept as is (0), renamed with a new
# value (1), renamed onto the previous part's name (2), value changed (3),
# old name equal to the name (4).
def _rule_name(k):
    return F.concat(F.lit("if_p"), k.cast("string"))


def _size_rule(s):
    return F.concat(F.lit("p_size > "), s.cast("string"))


def part_rule_sets(part):
    ds = F.concat(F.lit("ds_"), F.lower("p_brand"))
    nm, val = _rule_name, _size_rule
    k, m = F.col("p_partkey"), F.col("p_partkey") % 5
    existing = part.where(F.col("p_size") <= 25).select(ds.alias("dataset"), nm(k).alias("ruleNm"),
                                                        val(F.col("p_size")).alias("ruleValue"))
    payload = part.select(
        "p_partkey", ds.alias("dataset"),
        F.when(m == 1, F.concat(nm(k), F.lit("_v2"))).when(m == 2, nm(k - 1)).otherwise(nm(k)).alias("ruleNm"),
        F.when(m.isin(1, 3), val(F.col("p_size") + 1)).otherwise(val(F.col("p_size"))).alias("ruleValue"),
        F.when(m.isin(1, 2, 4), nm(k)).alias("old_rule_nm"))
    return existing, payload


@register("rule_changes_part", """
WITH e AS (SELECT 'ds_' || lower(p_brand) AS dataset, 'if_p' || p_partkey AS ruleNm, 'p_size > ' || p_size AS ruleValue
           FROM part WHERE p_size <= 25),
p AS (SELECT p_partkey, 'ds_' || lower(p_brand) AS dataset,
        CASE p_partkey % 5 WHEN 1 THEN 'if_p' || p_partkey || '_v2' WHEN 2 THEN 'if_p' || (p_partkey - 1)
             ELSE 'if_p' || p_partkey END AS ruleNm,
        CASE WHEN p_partkey % 5 IN (1, 3) THEN 'p_size > ' || (p_size + 1) ELSE 'p_size > ' || p_size END AS ruleValue,
        CASE WHEN p_partkey % 5 IN (1, 2, 4) THEN 'if_p' || p_partkey END AS old_rule_nm
      FROM part),
j AS (SELECT p.p_partkey, p.dataset, p.ruleNm, p.ruleValue, p.old_rule_nm, e.ruleNm AS e_name, e.ruleValue AS e_value,
  CASE WHEN p.old_rule_nm IS NOT NULL AND e.ruleNm IS NULL THEN 'reject: unknown old name'
       WHEN p.old_rule_nm IS NOT NULL AND p.old_rule_nm <> p.ruleNm AND t.ruleNm IS NOT NULL THEN 'reject: new name taken'
       WHEN p.old_rule_nm IS NOT NULL AND p.old_rule_nm <> p.ruleNm THEN 'rename'
       WHEN e.ruleNm IS NOT NULL THEN 'update' ELSE 'new' END AS status,
  p.ruleValue IS DISTINCT FROM e.ruleValue AS requires_validation
FROM p LEFT JOIN e ON p.dataset = e.dataset AND coalesce(p.old_rule_nm, p.ruleNm) = e.ruleNm
LEFT JOIN e t ON p.dataset = t.dataset AND p.ruleNm = t.ruleNm)
SELECT p_partkey, dataset, ruleNm, ruleValue, old_rule_nm, status, requires_validation,
  CASE WHEN status = 'rename' THEN e_name END AS delete_rule_nm,
  CASE WHEN status NOT LIKE 'reject%' THEN e_name END AS before_name,
  CASE WHEN status NOT LIKE 'reject%' THEN e_value END AS before_value,
  CASE WHEN status NOT LIKE 'reject%' THEN ruleNm END AS rule_name,
  CASE WHEN status NOT LIKE 'reject%' THEN ruleValue END AS rule_value,
  CASE WHEN status = 'new' THEN 1 END AS rule_points, CASE WHEN status = 'new' THEN 'LOW' END AS rule_weight,
  CASE WHEN status = 'new' THEN '' END AS rule_filter,
  CASE WHEN status = 'new' THEN concat_ws(',', 'COLUMN_MISSING',
       CASE WHEN NOT regexp_full_match(ruleNm, 'if_[a-z0-9]+(?:_[a-z0-9]+)*') THEN 'NAME_PATTERN' END, 'TYPE_UNKNOWN') END AS issues,
  CASE WHEN status NOT LIKE 'reject%' THEN CASE WHEN requires_validation THEN 'ruleValue' ELSE '' END END AS changed_fields
FROM j""")
def rule_changes_part(spark, sf):
    """Q5: payload rules matched to existing ones by (dataset, name) or by the
    old name of a rename; new / update / rename / reject, whether the rule
    text needs validation, the name to delete, the rule before, the row to be
    written with the defaults of a new rule, and a new rule's issues."""
    existing, payload = part_rule_sets(table(spark, sf, "part"))
    plan = R.plan_rule_changes(existing, payload)
    return plan.select(
        *payload.columns, "status", "requires_validation", "delete_rule_nm", F.col("before.ruleNm").alias("before_name"),
        F.col("before.ruleValue").alias("before_value"), F.col("rule.ruleNm").alias("rule_name"),
        F.col("rule.ruleValue").alias("rule_value"), F.col("rule.points").alias("rule_points"),
        F.col("rule.weight").alias("rule_weight"), F.col("rule.filterQuery").alias("rule_filter"),
        F.array_join("issues", ",").alias("issues"), F.array_join("changed_fields", ",").alias("changed_fields"))
