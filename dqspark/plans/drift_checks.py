"""Adaptive checks of DATA_TYPE and TIME (Q10) and the audit of suppression requests (Q6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import drift as D
from dqspark.operators import profile as P
from dqspark.plans.catalog import register, table
from dqspark.plans.drift import LOOKBACK

# A daily run of the events; ``tag`` holds ids, but words on some days; a run's
# job lasts from its first to its last sign-up.
SQL_EVENT_BREAKS = """
WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS run_id, day(ts) AS d FROM events),
t AS (SELECT run_id, c.item, c.v FROM e, LATERAL (VALUES ('value', CAST(value AS VARCHAR)), ('event_type', event_type),
        ('tag', CASE WHEN d % 9 = 5 THEN 'v' || user_id WHEN d % 9 = 7 AND event_id % 2 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END)) c(item, v)),
k AS (SELECT run_id, item, count(v) AS n, count(*) FILTER (WHERE regexp_full_match(v, '[+-]?[0-9]+')) AS i,
        count(*) FILTER (WHERE regexp_full_match(v, '[+-]?[0-9]+[.][0-9]*')) AS f, count(*) FILTER (WHERE NOT regexp_full_match(v, '[+-]?[0-9]+([.][0-9]*)?')) AS x FROM t GROUP BY ALL),
m AS (SELECT run_id, item, CASE WHEN i >= 0.95 * n THEN 'integer' WHEN i + f >= 0.95 * n THEN 'decimal' WHEN x >= 0.95 * n THEN 'text' ELSE 'mixed' END AS category FROM k),
c AS (SELECT *, list(category) OVER w AS a FROM m WINDOW w AS (PARTITION BY item ORDER BY run_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
j AS (SELECT run_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS value FROM e WHERE event_type = 'signup' GROUP BY 1),
b AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mu, coalesce(stddev_samp(value) OVER w, 0.0) AS sd
      FROM j WINDOW w AS (ORDER BY run_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
q AS (SELECT item, metric_type, max_by(suppress, ts) AS suppress FROM (
        SELECT CASE n_nationkey % 3 WHEN 1 THEN 'Load Time' ELSE ['value', 'tag', 'event_type'][n_nationkey % 4 % 3 + 1] END AS item,
          ['DATA_TYPE', 'TIME', 'NULL'][n_nationkey % 3 + 1] AS metric_type, (n_nationkey % 5 = 0)::INT AS suppress, n_nationkey AS ts FROM nation) GROUP BY ALL),
r AS (SELECT run_id, item, 'DATA_TYPE' AS metric_type, category AS found,
        array_to_string(list_sort(list_distinct(a)), '|') AS expected, len(a)::BIGINT AS baseline_runs
      FROM c WHERE len(a) >= 3 AND NOT list_contains(a, category)
      UNION ALL
      SELECT run_id, 'Load Time', 'TIME', NULL, NULL, n FROM b WHERE n >= 3 AND NOT (value BETWEEN mu - 2.0 * sd AND mu + 2.0 * sd))
SELECT 'events' AS dataset, r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.suppress = 1 AND q.item = r.item AND q.metric_type = r.metric_type)"""


@register("adaptive_breaks_events", SQL_EVENT_BREAKS)
def adaptive_breaks_events(spark, sf):
    """Q10 + J10: breaks of the DATA_TYPE of the events' columns (a category not
    seen in the six days before) and of the runs' load TIME, less what is
    suppressed."""
    ev = table(spark, sf, "events")
    d = F.dayofmonth("ts")
    tag = (F.when(d % 9 == 5, F.concat(F.lit("v"), F.col("user_id").cast("string"))).when((d % 9 == 7) & (F.col("event_id") % 2 == 0), "x")
           .otherwise(F.col("user_id").cast("string")))
    run = F.date_format("ts", "yyyy-MM-dd")
    types = D.categorical_check(P.detected_types(ev.withColumn("tag", tag), run, ["value", "event_type", "tag"], "events"), LOOKBACK)
    jobs = (ev.where("event_type = 'signup'").groupBy(F.lit("events").alias("dataset"), run.alias("run_id"))
            .agg(F.min("ts").cast("timestamp").alias("started_at"), F.max("ts").cast("timestamp").alias("finished_at")))
    times = D.adaptive_check(D.load_time_metrics(jobs), lookback=LOOKBACK)
    nothing = F.lit(None).cast("string")
    both = types.where("is_break").select("dataset", "run_id", "item", "metric_type", F.col("category").alias("found"),
                                          F.array_join("seen", "|").alias("expected"), "baseline_runs").unionByName(
        times.where("is_break").select("dataset", "run_id", "item", "metric_type", nothing.alias("found"), nothing.alias("expected"), "baseline_runs"))
    key = F.col("n_nationkey")
    metric = F.element_at(F.array(F.lit("DATA_TYPE"), F.lit("TIME"), F.lit("NULL")), (key % 3 + 1).cast("int"))
    item = F.when(metric == "TIME", "Load Time").otherwise(F.element_at(F.array(F.lit("value"), F.lit("tag"), F.lit("event_type")), (key % 4 % 3 + 1).cast("int")))
    sup = table(spark, sf, "nation").select(F.lit("events").alias("dataset"), item.alias("item"), metric.alias("metricType"),
                                            (key % 5 == 0).cast("int").alias("suppress"), key.cast("long").alias("ts"))
    return D.suppress_findings(both, sup)


@register("audit_suppressions_nation", """
WITH r AS (SELECT n_nationkey, ['NULL', 'ROW_COUNT', 'TIME', 'SPEED', NULL][n_nationkey % 5 + 1] AS metric,
             CASE n_nationkey % 4 WHEN 0 THEN 'Row Count' WHEN 1 THEN 'o_custkey' WHEN 2 THEN ' ' END AS item,
             CASE n_nationkey % 3 WHEN 2 THEN NULL WHEN 1 THEN 7 ELSE 1 END AS suppress FROM nation),
i AS (SELECT *, concat_ws('|', CASE WHEN metric IS NULL OR metric = 'SPEED' THEN 'unknown metric type' END,
    CASE WHEN suppress IS NULL OR suppress = 7 THEN 'suppress must be 0 or 1' END, CASE WHEN item IS NULL OR item = ' ' THEN 'item is required' END,
    CASE WHEN metric = 'ROW_COUNT' AND item <> 'Row Count' THEN 'ROW_COUNT applies to item ''Row Count''' END,
    CASE WHEN metric = 'TIME' AND item <> 'Load Time' THEN 'TIME applies to item ''Load Time''' END) AS issues FROM r)
SELECT n_nationkey, issues, issues = '' AS valid FROM i""")
def audit_suppressions_nation(spark, sf):
    """Q6: suppression requests, one per nation, with all their issues."""
    key = F.col("n_nationkey")
    metric = F.element_at(F.array(*[F.lit(m) for m in ("NULL", "ROW_COUNT", "TIME", "SPEED", None)]), (key % 5 + 1).cast("int"))
    req = table(spark, sf, "nation").select(
        "n_nationkey", metric.alias("metricType"), F.when(key % 4 == 0, "Row Count").when(key % 4 == 1, "o_custkey").when(key % 4 == 2, " ").alias("item"),
        F.when(key % 3 == 0, 1).when(key % 3 == 1, 7).alias("suppress"))
    return D.audit_suppressions(req).select("n_nationkey", F.array_join("issues", "|").alias("issues"), "valid")
