"""Registry queries (F1-F3 F5 J3-J6 J8 E10-E15 A4 A5 S5 W6) over the driver tables.

Registries (business units, mappings, connections, existing names) are
derived from the driver tables by Spark expressions, so every query's work
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.functions.exprs import MARKETS, dataset_name
from dqspark.operators import registry as G
from dqspark.plans.catalog import TABLES, register, table

TPCH = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
PROJECTS = ["ANGen", "ANGen MAF", "Data-Product", "E.AI"]


def _cluster(t):
    return "local" if t in TPCH else "region"


def _schema(t):
    return "tpch" if t in TPCH else "app"


# units: nations 0-7 are the markets, the others projects "<market> - <project>"
def units_from_nation(nation):
    mk = F.array(*[F.lit(m) for m in MARKETS])
    pj = F.array(*[F.lit(p) for p in PROJECTS])
    k = F.col("n_nationkey")
    is_market = k < len(MARKETS)
    return nation.select(
        F.when(is_market, k).otherwise(k + 100).cast("long").alias("id"),
        F.when(is_market, F.element_at(mk, (k + 1).cast("int"))).otherwise(
            F.concat(F.element_at(mk, (k % len(MARKETS) + 1).cast("int")), F.lit(" - "),
                     F.element_at(pj, (k % len(PROJECTS) + 1).cast("int")))).alias("name"),
        F.when(is_market, F.lit(None)).otherwise(k % len(MARKETS)).cast("long").alias("subId"))


_MK = "[" + ",".join(f"'{m}'" for m in MARKETS) + "]"
_PJ = "[" + ",".join(f"'{p}'" for p in PROJECTS) + "]"
SQL_UNITS = f"""SELECT CASE WHEN n_nationkey < {len(MARKETS)} THEN n_nationkey ELSE n_nationkey + 100 END::BIGINT AS id,
  CASE WHEN n_nationkey < {len(MARKETS)} THEN {_MK}[n_nationkey + 1]
       ELSE {_MK}[n_nationkey % {len(MARKETS)} + 1] || ' - ' || {_PJ}[n_nationkey % {len(PROJECTS)} + 1] END AS name,
  CASE WHEN n_nationkey < {len(MARKETS)} THEN NULL ELSE n_nationkey % {len(MARKETS)} END::BIGINT AS subId
FROM nation"""


@register("business_units", f"""
WITH u AS ({SQL_UNITS}),
m AS (SELECT id AS market_id, name AS market FROM u WHERE subId IS NULL AND name IS NOT NULL),
p AS (SELECT subId AS market_id, CASE WHEN position(' - ' IN name) > 0
             THEN trim(substr(name, position(' - ' IN name) + 3)) END AS project FROM u WHERE subId IS NOT NULL)
SELECT market_id, market, array_to_string(list_sort(list_distinct(list(project) FILTER (WHERE project IS NOT NULL))), '|') AS projects,
       count(project) AS n_projects
FROM m LEFT JOIN p USING (market_id) GROUP BY ALL""")
def business_units(spark, sf):
    """Markets with their sorted distinct project names."""
    h = G.bu_hierarchy(units_from_nation(table(spark, sf, "nation")))
    return h.select("market_id", "market", F.array_join("projects", "|").alias("projects"), "n_projects")


# requests derived from customers: schema / dataset / table names
SCHEMAS = ["anz", "cn", "hk", "jp", "kr", "region", "tw", "vn", "na", "pixonomy", "misc"]
_SC = "[" + ",".join(f"'{s}'" for s in SCHEMAS) + "]"


def customer_requests(customer, keep=()):
    sc = F.array(*[F.lit(s) for s in SCHEMAS])
    db = F.element_at(sc, (F.col("c_nationkey") % len(SCHEMAS) + 1).cast("int"))
    seg = F.lower("c_mktsegment")
    tbl = (F.when(seg == "building", F.concat(seg, F.lit("_angen")))
           .when(seg == "automobile", F.concat(seg, F.lit("_angen_maf")))
           .when(seg == "machinery", F.concat(F.lit("sales_dp_"), seg)).otherwise(seg))
    return customer.select("c_custkey", db.alias("db_nm"), tbl.alias("table_nm"), *keep) \
        .withColumn("dataset", dataset_name("redshift", F.lit("local"), F.col("db_nm"), F.col("table_nm")))


SQL_REQUESTS = f"""SELECT c_custkey, db_nm, table_nm, 'ds_redshift_local_' || db_nm || '_' || table_nm AS dataset FROM (
  SELECT c_custkey, {_SC}[c_nationkey % {len(SCHEMAS)} + 1] AS db_nm,
    CASE lower(c_mktsegment) WHEN 'building' THEN 'building_angen' WHEN 'automobile' THEN 'automobile_angen_maf'
         WHEN 'machinery' THEN 'sales_dp_machinery' ELSE lower(c_mktsegment) END AS table_nm FROM customer)"""


def _sql_first_hit(src):
    toks = f"string_split_regex(lower(coalesce({src}, '')), '[^a-z0-9]+')"
    return "CASE " + " ".join(f"WHEN list_contains({toks}, '{m.lower()}') THEN '{m}'" for m in MARKETS) + " END"


SQL_SUGGEST = f"""
WITH r AS ({SQL_REQUESTS}), u AS ({SQL_UNITS}),
s AS (SELECT *, coalesce(CASE lower(trim(db_nm)) WHEN 'pixonomy' THEN 'REGION' WHEN 'na' THEN 'KR' WHEN 'kr' THEN 'KR' END,
                          {_sql_first_hit('lower(trim(db_nm))')}, {_sql_first_hit('table_nm')}, {_sql_first_hit('dataset')}) AS suggested_market,
        CASE WHEN lower(concat_ws(' ', dataset, db_nm, table_nm)) LIKE '%angen\\_maf%' ESCAPE '\\'
               OR lower(concat_ws(' ', dataset, db_nm, table_nm)) LIKE '%angen maf%' THEN 'ANGen MAF'
             WHEN lower(concat_ws(' ', dataset, db_nm, table_nm)) LIKE '%angen%' THEN 'ANGen'
             WHEN lower(concat_ws(' ', dataset, db_nm, table_nm)) LIKE '%\\_dp\\_%' ESCAPE '\\' THEN 'Data-Product'
             ELSE 'E.AI' END AS suggested_project FROM r)
SELECT c_custkey, suggested_market, suggested_project,
  CASE WHEN suggested_market IS NOT NULL THEN suggested_market || ' - ' || suggested_project END AS suggested_business_unit,
  (SELECT min(id) FROM u WHERE subId IS NULL AND u.name = s.suggested_market) AS market_id,
  (SELECT min(id) FROM u WHERE subId IS NOT NULL AND u.name = s.suggested_market || ' - ' || s.suggested_project) AS existing_unit_id
FROM s"""


@register("suggest_business_unit", f"""
SELECT *, suggested_business_unit IS NOT NULL AND existing_unit_id IS NULL AS needs_creation FROM ({SQL_SUGGEST})""")
def suggest_business_unit(spark, sf):
    """Market / project inferred from schema, table and dataset names,
    matched against the unit hierarchy."""
    req = customer_requests(table(spark, sf, "customer"))
    out = G.suggest_business_unit(req, units_from_nation(table(spark, sf, "nation")))
    return out.select("c_custkey", "suggested_market", "suggested_project", "suggested_business_unit",
                      "market_id", "existing_unit_id", "needs_creation")


@register("suggest_business_unit_lists", f"""
WITH u AS ({SQL_UNITS}), s AS ({SQL_SUGGEST}),
l AS (SELECT array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE subId IS NULL)), '|') AS available_markets,
             array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE subId IS NOT NULL)), '|') AS available_projects FROM u),
p AS (SELECT m.name AS market, string_agg(substr(c.name, position(' - ' IN c.name) + 3), '|' ORDER BY substr(c.name, position(' - ' IN c.name) + 3)) AS projects
      FROM u m JOIN u c ON c.subId = m.id AND m.subId IS NULL AND position(' - ' IN c.name) > 0 GROUP BY 1)
SELECT c_custkey, suggested_business_unit, suggested_business_unit IS NOT NULL AND existing_unit_id IS NULL AS needs_creation,
  available_markets, available_projects, coalesce(projects, '') AS projects_in_market
FROM s JOIN l ON true LEFT JOIN p ON p.market = s.suggested_market AND s.market_id IS NOT NULL""")
def suggest_business_unit_lists(spark, sf):
    """Each suggestion with what it was chosen from (markets, projects,
    and the projects of its market)."""
    units = units_from_nation(table(spark, sf, "nation"))
    out = G.suggest_business_unit(customer_requests(table(spark, sf, "customer")), units)
    lists = G.unit_lists(units)
    known = F.when(F.col("market_id").isNotNull(), F.col("suggested_market"))
    j = out.withColumn("_m", known).join(lists, F.col("_m").eqNullSafe(lists["market"]), "left")
    return j.select("c_custkey", "suggested_business_unit", "needs_creation", *[F.array_join(c, "|").alias(c) for c in (
        "available_markets", "available_projects", "projects_in_market")])


@register("dataset_business_unit", f"""
WITH r AS ({SQL_REQUESTS}), u AS ({SQL_UNITS}),
mp AS (SELECT c_custkey AS id, dataset, 100 + c_nationkey AS businessUnitId FROM r JOIN customer USING (c_custkey)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY id) AS rn FROM mp) WHERE rn = 1),
d AS (SELECT DISTINCT dataset FROM r),
j AS (SELECT d.dataset, f.id AS mapping_id, u.name AS business_unit FROM d LEFT JOIN f USING (dataset)
      LEFT JOIN u ON u.id = f.businessUnitId)
SELECT dataset, mapping_id, business_unit,
  CASE WHEN trim(business_unit) = '' OR business_unit IS NULL THEN NULL
       WHEN position(' - ' IN trim(business_unit)) > 0 THEN trim(split_part(trim(business_unit), ' - ', 1))
       ELSE trim(business_unit) END AS market,
  CASE WHEN position(' - ' IN trim(coalesce(business_unit, ''))) > 0
       THEN trim(substr(trim(business_unit), position(' - ' IN trim(business_unit)) + 3)) END AS project,
  CASE WHEN upper(CASE WHEN position(' - ' IN trim(coalesce(business_unit, ''))) > 0
       THEN trim(substr(trim(business_unit), position(' - ' IN trim(business_unit)) + 3)) END) = 'CDE'
       THEN 'Yes' ELSE 'No' END AS cde
FROM j""")
def dataset_business_unit(spark, sf):
    """First mapping row per dataset, then its unit, parsed into market / project / CDE."""
    cust = table(spark, sf, "customer")
    # one projection of customer carries the request fields and its unit id
    # (c_custkey is the key, so no self-join is needed)
    req = customer_requests(cust.withColumn("_unit", (F.col("c_nationkey") + 100).cast("long")), keep=["_unit"])
    mapping = req.select(F.col("c_custkey").alias("id"), "dataset", F.col("_unit").alias("businessUnitId"))
    datasets = req.select("dataset").distinct()
    return G.dataset_business_unit(datasets, mapping, units_from_nation(table(spark, sf, "nation")))


# J6 ------------------------------------------------------------------------
def connections_from_pages(pages):
    host = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    first = F.regexp_extract("url", r"^(https?://[^/?#]+/[^/?#]+)", 1)
    locs = pages.select(host.alias("location")).union(pages.select(first.alias("location"))) \
        .where(F.col("location") != "").distinct()
    from dqspark.operators.windows import ordinal
    # registry order = location order, numbered across tasks (no single-partition window)
    return ordinal(locs, "location") \
        .select("ordinal", F.concat(F.lit("conn_"), F.col("ordinal")).alias("connName"), F.lit("S3").alias("type"),
                "location")


@register("connection_prefix", r"""
WITH l AS (SELECT DISTINCT location FROM (
    SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS location FROM pages
    UNION ALL SELECT regexp_extract(url, '^(https?://[^/?#]+/[^/?#]+)', 1) FROM pages) WHERE location <> ''),
c AS (SELECT row_number() OVER (ORDER BY location) AS ordinal, location FROM l),
c2 AS (SELECT *, 'conn_' || ordinal AS connName, lower(rtrim(location, '/')) AS loc FROM c),
p AS (SELECT page_id, url, lower(rtrim(trim(url), '/')) AS norm,
        list_filter(string_split(regexp_replace(trim(url), '^https?://', ''), '/'), lambda x: x <> '') AS segs FROM pages),
m AS (SELECT p.page_id, connName, location,
        row_number() OVER (PARTITION BY p.page_id ORDER BY length(location) DESC, ordinal) AS rn
      FROM p JOIN c2 ON starts_with(p.norm, c2.loc))
SELECT p.page_id, p.url, m.connName AS connection_name, m.location,
  CASE WHEN len(segs) >= 2 THEN segs[len(segs) - 1] END AS schema,
  CASE WHEN len(segs) >= 2 THEN CASE WHEN position('.' IN segs[len(segs)]) > 0
       THEN regexp_extract(segs[len(segs)], '^(.*)\.[^.]*$', 1) ELSE segs[len(segs)] END END AS "table",
  CASE WHEN len(segs) < 2 THEN 'path has no file name' END AS error
FROM p LEFT JOIN (SELECT * FROM m WHERE rn = 1) m USING (page_id)""")
def connection_prefix(spark, sf):
    """Longest registered location prefixing each page URL (equi-join on
    the URL's prefixes of the registry's location lengths)."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    conns = connections_from_pages(pages)
    return G.resolve_connection(spark, pages, conns, id_col="page_id", path_col="url",
                                schemes=("http://", "https://"))


# J8 / E10 / E11 -----------------------------------------------------------
def part_bases(part):
    return part.select("p_partkey", "p_size", "p_retailprice",
                       dataset_name("s3", F.lower("p_type"), F.col("p_name")).alias("base_name"))


def existing_names(bases):
    return bases.where(F.col("p_size") > 40).select(F.col("base_name").alias("dataset")) \
        .union(bases.where(F.col("p_retailprice") > 1500).select(F.concat("base_name", F.lit("_2")))) \
        .union(bases.where(F.col("p_size") < 10).select(F.upper(F.concat("base_name", F.lit("_3")))))


_SQL_BASES = """SELECT p_partkey, p_size, p_retailprice,
  'ds_conn_s3_' || regexp_replace(replace(lower(p_type), '-', '_'), '[^a-z0-9_]+', '_', 'g') || '_'
  || regexp_replace(replace(lower(p_name), '-', '_'), '[^a-z0-9_]+', '_', 'g') AS base_name FROM part"""


@register("name_candidates", f"""
WITH b AS ({_SQL_BASES}),
ex AS (SELECT DISTINCT lower(dataset) AS taken FROM (
   SELECT base_name AS dataset FROM b WHERE p_size > 40
   UNION ALL SELECT base_name || '_2' FROM b WHERE p_retailprice > 1500
   UNION ALL SELECT upper(base_name || '_3') FROM b WHERE p_size < 10)),
r AS (SELECT DISTINCT base_name FROM b),
c AS (SELECT base_name, s, CASE WHEN s = 1 THEN base_name ELSE base_name || '_' || s END AS candidate
      FROM r, generate_series(1, 19) g(s)),
f AS (SELECT * FROM c WHERE lower(candidate) NOT IN (SELECT taken FROM ex)),
k AS (SELECT *, row_number() OVER (PARTITION BY base_name ORDER BY s) AS rank FROM f)
SELECT k.base_name, candidate, rank, lower(k.base_name) IN (SELECT taken FROM ex) AS base_exists
FROM k WHERE rank <= 3""")
def name_candidates(spark, sf):
    """Three free dataset names per part-derived base name."""
    bases = part_bases(table(spark, sf, "part"))
    return G.name_candidates(bases, existing_names(bases))


# F2 / F3 / S5 / W6 / U1 ------------------------------------------------------
def catalog(spark, sf):
    tabs = {t: table(spark, sf, t) for t in TABLES}
    return G.table_catalog(spark, tabs, {t: _cluster(t) for t in TABLES}, {t: _schema(t) for t in TABLES})


def row_counts(spark, sf):
    out = None
    for t in TABLES:
        one = table(spark, sf, t).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(t).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


_SQL_CAT = " UNION ALL ".join(
    f"SELECT '{_cluster(t)}' AS cluster, '{_schema(t)}' AS table_schema, '{t}' AS table_name, "
    f"(SELECT count(*) FROM {t}) AS row_count" for t in TABLES)


@register("search_columns", f"""
WITH t AS ({_SQL_CAT}),
c AS (SELECT t.cluster, t.table_schema, t.table_name, column_name, ordinal_position::INTEGER AS ordinal, t.row_count
      FROM information_schema.columns i JOIN t ON i.table_name = t.table_name
      WHERE lower(column_name) LIKE '%key%')
SELECT cluster, table_schema, table_name, column_name, ordinal, row_count FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY table_schema, table_name, column_name) AS rn FROM c)
WHERE rn <= 12""")
def search_columns(spark, sf):
    """F3 + W6: columns LIKE '%key%', top 12 per cluster, with table row counts."""
    hits = G.search_columns(catalog(spark, sf), "key", limit=12)
    return hits.join(row_counts(spark, sf), "table_name").select(
        "cluster", "table_schema", "table_name", "column_name", "ordinal", "row_count")


@register("search_tables", f"""
SELECT cluster, table_schema, table_name, row_count FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY table_schema, table_name) AS rn FROM ({_SQL_CAT})
  WHERE lower(table_name) LIKE '%e_s%')
WHERE rn <= 2""")
def search_tables(spark, sf):
    """F2 + U1: tables LIKE '%e_s%' ('_' stays a wildcard), top 2 per cluster."""
    hits = G.search_tables(catalog(spark, sf), "e_s", limit=2)
    return hits.join(row_counts(spark, sf), "table_name").select(
        "cluster", "table_schema", "table_name", "row_count")


# F1 / F5 -------------------------------------------------------------------
@register("parts_named_ring", "SELECT p_partkey, p_name FROM part WHERE position('ring' IN lower(p_name)) > 0")
def parts_named_ring(spark, sf):
    return G.filter_name_contains(table(spark, sf, "part"), "p_name", "RING").select("p_partkey", "p_name")


@register("distinct_sources", """
SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND trim(source) <> ''""")
def distinct_sources(spark, sf):
    return G.distinct_nonblank(table(spark, sf, "documents"), "source")


# A4 / A5 -------------------------------------------------------------------
def documents_mapping(docs):
    return docs.select(F.col("doc_id").alias("target_id"), F.col("lang").alias("Data Domain"),
                       F.concat_ws(", ", "source", F.lit(""), "lang").alias("subDomain"))


@register("domain_distribution", """
SELECT lang AS domain, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1""")
def domain_distribution(spark, sf):
    return G.domain_distribution(documents_mapping(table(spark, sf, "documents")))


@register("domain_votes", """
SELECT 'domain' AS kind, lang AS value, count(*) AS votes FROM documents WHERE lang IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'subdomain', code, count(*) FROM (
  SELECT unnest(list_filter(list_transform(string_split(concat_ws(', ', source, '', lang), ','), lambda x: trim(x)), lambda x: x <> '')) AS code
  FROM documents) GROUP BY 2""")
def domain_votes(spark, sf):
    """A5: domain and sub-domain code votes (codes from a comma list)."""
    v = G.domain_votes(documents_mapping(table(spark, sf, "documents")).withColumn("k", F.lit(1)), keys=["k"])
    return v.select("kind", "value", "votes")


# J5 ------------------------------------------------------------------------
DOMAINS = ["Commercial-(Other)", "Commercial-Omnichannel", "Commercial-SFE", "Market-Access/Pricing",
           "Master-Data", "Medical", "Patient"]


def part_targets(part):
    return part.select(F.col("p_partkey").alias("target_id"),
                       F.concat(F.lit("ds_conn_s3_"), F.lower("p_type"), F.lit("_"),
                                F.regexp_replace("p_name", " ", "_")).alias("dataset"),
                       F.col("p_name").alias("table_nm"), F.col("p_brand").alias("connectionName"),
                       F.lower("p_type").alias("db_nm"))


def part_registry(part):
    """Tagged registry: one row per (type, name) seen in part."""
    g = part.groupBy("p_type", "p_name").agg(F.min("p_brand").alias("connectionName"),
                                             F.min("p_size").alias("_s"))
    dm = F.array(*[F.lit(d) for d in DOMAINS])
    return g.select(
        F.concat(F.lit("ds_redshift_local_"), F.lower("p_type"), F.lit("_"),
                 F.regexp_replace("p_name", " ", "_")).alias("dataset"),
        F.regexp_replace("p_name", " ", "_").alias("table_nm"), "connectionName",
        F.lower("p_type").alias("db_nm"),
        F.element_at(dm, (F.col("_s") % len(DOMAINS) + 1).cast("int")).alias("Data Domain"),
        F.concat_ws(",", F.lit("PRO"), F.when(F.col("_s") % 2 == 0, F.lit("SAL")).otherwise(F.lit("GEO")))
        .alias("subDomain"))


@register("similar_parts")
def similar_parts(spark, sf):
    """J5 with the full score (token Jaccard + Ratcliff-Obershelp ratio +
    connection / schema bonuses), top 5 per part.  No SQL form (the ratio);
    checked against brute force in tests."""
    part = table(spark, sf, "part")
    m = G.similar_datasets(spark, part_targets(part), part_registry(part), top_n=5)
    return m.select("target_id", "rank", "match_dataset", "similarity", "Data Domain", "subDomain")


_SQL_TOK = "list_distinct(list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda t: length(t) > 1))"


@register("similar_parts_tokens", f"""
WITH t AS (SELECT p_partkey AS target_id, 'ds_conn_s3_' || lower(p_type) || '_' || replace(p_name, ' ', '_') AS dataset,
                  p_name AS table_nm, p_brand AS conn, lower(p_type) AS db FROM part),
r AS (SELECT 'ds_redshift_local_' || lower(p_type) || '_' || replace(p_name, ' ', '_') AS rds,
             replace(p_name, ' ', '_') AS rtab, min(p_brand) AS rconn, lower(p_type) AS rdb FROM part GROUP BY p_type, p_name),
tt AS (SELECT *, list_distinct(list_concat({_SQL_TOK.format('dataset')}, {_SQL_TOK.format('table_nm')})) AS tk FROM t),
rr AS (SELECT *, list_distinct(list_concat({_SQL_TOK.format('rds')}, {_SQL_TOK.format('rtab')})) AS rk FROM r),
s AS (SELECT target_id, rds,
        CASE WHEN len(list_distinct(list_concat(tk, rk))) = 0 THEN 0.0
             ELSE len(list_intersect(tk, rk)) / len(list_distinct(list_concat(tk, rk))) END AS jac,
        CASE WHEN lower(conn) = lower(rconn) THEN 0.15 ELSE 0.0 END AS bc,
        CASE WHEN lower(db) = lower(rdb) THEN 0.10 ELSE 0.0 END AS bs FROM tt, rr),
k AS (SELECT *, 0.6 * jac + bc + bs AS score,
        row_number() OVER (PARTITION BY target_id ORDER BY 0.6 * jac + bc + bs DESC, rds) AS rank FROM s)
SELECT target_id, rank, rds AS match_dataset, round(score, 3) AS similarity FROM k WHERE rank <= 5""")
def similar_parts_tokens(spark, sf):
    """J5 with the ratio weight 0 (token overlap + bonuses): exact SQL form."""
    part = table(spark, sf, "part")
    m = G.similar_datasets(spark, part_targets(part), part_registry(part), top_n=5, w_ratio=0.0)
    return m.select("target_id", "rank", "match_dataset", "similarity")


@register("similar_parts_votes")
def similar_parts_votes(spark, sf):
    """A5 over J5: Data Domain / sub-domain votes of each part's top matches."""
    part = table(spark, sf, "part")
    m = G.similar_datasets(spark, part_targets(part), part_registry(part), top_n=5)
    return G.domain_votes(m, keys=["target_id"])


# J7 --------------------------------------------------------------------------
# Catalog: every document source is a table (schema = language) in the local
# cluster when the document is short, in the region cluster when it is long.
# Requests: the (language, source) pairs of the documents plus the
# (language segment, host) pairs of the pages, which are in no cluster.
@register("detect_cluster_documents", """
WITH cat AS (SELECT DISTINCT CASE WHEN n_chars < 2000 THEN 'local' ELSE 'region' END AS cluster,
                    lang AS table_schema, source AS table_name FROM documents),
req AS (SELECT DISTINCT lang AS table_schema, source AS table_name FROM documents
        UNION SELECT regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS table_schema,
                     regexp_extract(url, '^https?://([^/?#]+)', 1) AS table_name FROM pages),
m AS (SELECT r.table_schema, r.table_name,
             coalesce(list_sort(list(c.cluster) FILTER (WHERE c.cluster IS NOT NULL)), []::VARCHAR[]) AS matched
      FROM req r LEFT JOIN cat c ON r.table_schema = c.table_schema AND r.table_name = c.table_name
      GROUP BY r.table_schema, r.table_name)
SELECT table_schema, table_name, array_to_string(matched, ',') AS matched, list_contains(matched, 'local') AS found_local,
       list_contains(matched, 'region') AS found_region, CASE WHEN len(matched) = 1 THEN matched[1] END AS cluster
FROM m""")
def detect_cluster_documents(spark, sf):
    """Which cluster holds each requested (schema, table)."""
    docs = table(spark, sf, "documents")
    cat = docs.select(F.when(F.col("n_chars") < 2000, "local").otherwise("region").alias("cluster"),
                      F.col("lang").alias("table_schema"), F.col("source").alias("table_name"))
    pages = table(spark, sf, "pages")
    req = docs.select(F.col("lang").alias("table_schema"), F.col("source").alias("table_name")).unionByName(
        pages.select(F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1).alias("table_schema"),
                     F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("table_name"))).distinct()
    d = G.detect_cluster(req, cat)
    return d.select("table_schema", "table_name", F.array_join("matched", ",").alias("matched"), "found_local",
                    "found_region", "cluster")
