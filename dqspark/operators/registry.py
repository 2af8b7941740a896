"""Registry operators: F1-F3 F5 S5 J3-J8 E15 A4 A5 W6 U1.

Matching datasets to reference registries (business units, dataset
mappings, connections, catalogs).  Joins with registries are left to the
planner; only :func:`similar_datasets` broadcasts one itself, after a check
of its rows.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from dqspark.functions.exprs import infer_market, infer_project, py_strip


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(n, lo, hi) -> int:
    return max(lo, min(hi, int(n)))


# F1 / F5 -------------------------------------------------------------------
def filter_name_contains(df: DataFrame, col: str, needle: str | None) -> DataFrame:
    """Case-insensitive substring filter (no wildcards); empty needle -> all."""
    if not needle:
        return df
    return df.where(F.instr(F.lower(F.col(col)), needle.lower()) > 0)


def distinct_nonblank(df: DataFrame, col: str) -> DataFrame:
    """Distinct, non-null, non-blank values, sorted."""
    c = F.col(col)
    return df.select(c).where(c.isNotNull() & (py_strip(c) != "")).distinct().orderBy(col)


# S5 ------------------------------------------------------------------------
CATALOG_SCHEMA = T.StructType([
    T.StructField("cluster", T.StringType()), T.StructField("table_schema", T.StringType()),
    T.StructField("table_name", T.StringType()), T.StructField("column_name", T.StringType()),
    T.StructField("ordinal", T.IntegerType()), T.StructField("data_type", T.StringType())])


def table_catalog(spark: SparkSession, tables: Mapping[str, DataFrame],
                  cluster_of: Mapping[str, str], schema_of: Mapping[str, str]) -> DataFrame:
    """(cluster, table_schema, table_name, column_name, ordinal, data_type)
    from the tables' schemas (metadata only, no scan)."""
    rows = []
    for name, df in tables.items():
        for i, f in enumerate(df.schema.fields, start=1):
            rows.append((cluster_of[name], schema_of[name], name, f.name, i, f.dataType.simpleString()))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


# F2 / F3 / W6 / U1 ---------------------------------------------------------
def _search(catalog: DataFrame, name_col: str, keyword: str, order: Sequence[str], cluster=None,
            schema=None, table=None, limit: int = 50) -> DataFrame:
    kw = (keyword or "").strip().lower()
    if not kw:
        raise ValueError("keyword must not be blank")
    d = catalog.where(F.lower(F.col(name_col)).like(f"%{kw}%"))   # % and _ stay wildcards
    if cluster:
        d = d.where(F.col("cluster") == cluster)
    if schema:
        d = d.where(F.col("table_schema") == schema)
    if table:
        d = d.where(F.col("table_name") == table)
    n = clamp(limit, 1, 200)
    w = Window.partitionBy("cluster").orderBy(*order)
    return d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def search_tables(catalog: DataFrame, keyword: str, cluster=None, schema=None, limit: int = 50) -> DataFrame:
    """Tables whose lower name is LIKE '%keyword%', top ``limit`` per cluster
    ordered by schema, table (union of the per-cluster results)."""
    tables = catalog.select("cluster", "table_schema", "table_name").distinct()
    return _search(tables, "table_name", keyword, ["table_schema", "table_name"], cluster, schema, None, limit)


def search_columns(catalog: DataFrame, keyword: str, cluster=None, schema=None, table=None,
                   limit: int = 50) -> DataFrame:
    """Columns matching LIKE '%keyword%', top ``limit`` per cluster ordered by
    schema, table, column."""
    return _search(catalog, "column_name", keyword, ["table_schema", "table_name", "column_name"],
                   cluster, schema, table, limit)


# J3 ------------------------------------------------------------------------
def bu_hierarchy(units: DataFrame) -> DataFrame:
    """Markets (subId null) with the sorted distinct short names of their
    projects (name after the first ' - ', trimmed)."""
    markets = units.where(F.col("subId").isNull() & F.col("name").isNotNull()) \
        .select(F.col("id").alias("market_id"), F.col("name").alias("market"))
    projects = units.where(F.col("subId").isNotNull()).select(
        F.col("subId").alias("market_id"),
        F.when(F.instr("name", " - ") > 0, py_strip(F.element_at(F.split("name", " - ", 2), 2))).alias("project"))
    j = markets.join(projects, "market_id", "left")
    return j.groupBy("market_id", "market").agg(
        F.array_sort(F.collect_set("project")).alias("projects"),
        F.count("project").alias("n_projects"))


def project_names(units: DataFrame) -> DataFrame:
    """All distinct project short names, sorted."""
    p = units.where(F.col("subId").isNotNull() & (F.instr(F.coalesce("name", F.lit("")), " - ") > 0)) \
        .select(py_strip(F.element_at(F.split("name", " - ", 2), 2)).alias("project"))
    return p.distinct().orderBy("project")


# J4 ------------------------------------------------------------------------
def dataset_business_unit(datasets: DataFrame, mapping: DataFrame, units: DataFrame) -> DataFrame:
    """First mapping row per dataset (by mapping id), then its unit, parsed
    into market / project / CDE; no mapping -> nulls."""
    from dqspark.functions.exprs import parse_business_unit_cols
    # first mapping row per dataset as an aggregate (partial, skew-safe)
    first = mapping.groupBy("dataset").agg(F.min_by(F.struct("id", "businessUnitId"), F.col("id")).alias("_f")) \
        .select("dataset", F.col("_f.id").alias("mapping_id"), F.col("_f.businessUnitId").alias("businessUnitId"))
    u = units.select(F.col("id").alias("businessUnitId"), F.col("name").alias("business_unit"))
    j = datasets.join(first, "dataset", "left").join(u, "businessUnitId", "left")
    return j.select(*datasets.columns, "mapping_id", "business_unit",
                    *parse_business_unit_cols(F.col("business_unit")))


# E15 ---------------------------------------------------------------------
def suggest_business_unit(requests: DataFrame, units: DataFrame) -> DataFrame:
    """Suggested "<market> - <project>" per (dataset, schema, table) request,
    whether it exists, whether it needs creating, and the market's id."""
    req = requests.select(
        "*", infer_market(F.col("db_nm"), F.col("dataset"), F.col("table_nm")).alias("suggested_market"),
        infer_project(F.col("dataset"), F.col("db_nm"), F.col("table_nm")).alias("suggested_project"))
    req = req.withColumn("suggested_business_unit", F.when(
        F.col("suggested_market").isNotNull(),
        F.concat_ws(" - ", "suggested_market", "suggested_project")))
    markets = units.where(F.col("subId").isNull()).select(F.col("name").alias("suggested_market"),
                                                          F.col("id").alias("market_id"))
    projects = units.where(F.col("subId").isNotNull()).groupBy(F.col("name").alias("suggested_business_unit")) \
        .agg(F.min("id").alias("existing_unit_id"))
    markets = markets.groupBy("suggested_market").agg(F.min("market_id").alias("market_id"))
    j = req.join(markets, "suggested_market", "left").join(projects, "suggested_business_unit", "left")
    return j.withColumn("needs_creation", F.col("suggested_business_unit").isNotNull()
                        & F.col("existing_unit_id").isNull())


def unit_lists(units: DataFrame) -> DataFrame:
    """What a suggestion is chosen from: one row per market (and one, with a
    null market, for requests without any) with ``available_markets``,
    ``available_projects`` (names of all units below a market) and
    ``projects_in_market`` (what follows the market in their names), each
    sorted.  The unit registry is the only input; join it to suggestions on
    the market."""
    names = units.agg(F.array_sort(F.collect_set(F.when(F.col("subId").isNull(), F.col("name")))).alias("available_markets"),
                      F.array_sort(F.collect_set(F.when(F.col("subId").isNotNull(), F.col("name")))).alias("available_projects"))
    markets = units.where(F.col("subId").isNull()).groupBy(F.col("name").alias("market")).agg(F.min("id").alias("market_id"))
    part = F.when(F.contains("name", F.lit(" - ")), F.substring("name", F.instr("name", " - ") + 3, F.length("name")))
    below = units.where(F.col("subId").isNotNull()).groupBy(F.col("subId").alias("market_id")).agg(F.array_sort(F.collect_list(part)).alias("projects_in_market"))
    none = F.array().cast("array<string>")
    rows = markets.join(below, "market_id", "left").select("market", F.coalesce("projects_in_market", none).alias("projects_in_market"))
    nothing = rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("market"), none.alias("projects_in_market"))
    one = F.lit(0).alias("_one")  # the lists are one row
    return rows.unionByName(nothing).select("*", one).join(F.broadcast(names.select("*", one)), "_one").drop("_one")


# J6 ------------------------------------------------------------------------
def parse_object_path(path, schemes: Sequence[str] = ("s3://",)) -> list[Column]:
    """[schema (parent folder), table (file name without its last extension),
    error] of an object path; other schemes or fewer than 2 segments -> error."""
    p = py_strip(_c(path))
    ok_scheme = None
    rest = None
    for s in schemes:
        cond = F.startswith(F.lower(p), F.lit(s.lower()))
        ok_scheme = cond if ok_scheme is None else (ok_scheme | cond)
        r = F.substr(p, F.lit(len(s) + 1))
        rest = F.when(cond, r) if rest is None else rest.when(cond, r)
    segs = F.filter(F.split(rest, "/"), lambda x: x != "")
    n = F.size(segs)
    fname = F.element_at(segs, -1)
    table = F.when(F.instr(fname, ".") > 0, F.regexp_extract(fname, r"^(.*)\.[^.]*$", 1)).otherwise(fname)
    err = F.when(~ok_scheme, F.lit("unsupported scheme")).when(n < 2, F.lit("path has no file name"))
    return [F.when(err.isNull(), F.element_at(segs, -2)).alias("schema"),
            F.when(err.isNull(), table).alias("table"), err.alias("error")]


def resolve_connection(spark: SparkSession, paths: DataFrame, connections: DataFrame, id_col: str = "path_id",
                       path_col: str = "path", strict: bool = False, schemes: Sequence[str] = ("s3://",)) -> DataFrame:
    """Longest connection location that prefixes each path (case-insensitive,
    trailing '/' stripped); ties keep registry order (``ordinal``).

    A prefix join as equi-joins: a location with a folder must agree with the
    path on scheme and host, so they join on that and the rest is compared;
    a location without a folder may end within the host, so it joins the
    prefixes of the *distinct* hosts.  The best match is an aggregate.
    ``strict=True`` also requires the match to end at a '/' boundary (the
    reference's prefix is not segment-aware).
    """
    head = lambda x: F.regexp_extract(x, "^(?:[a-z0-9+.-]*://)?[^/]*", 0)   # noqa: E731  scheme and host
    conns = connections.select("ordinal", "connName", "location", F.lower(F.regexp_replace("location", "/+$", "")).alias("_loc")) \
        .where(F.col("_loc") != "").withColumn("_lhead", head(F.col("_loc")))
    norm = F.lower(F.regexp_replace(py_strip(F.col(path_col)), "/+$", ""))
    base = paths.select("*", norm.alias("_norm"), *parse_object_path(F.col(path_col), schemes)).withColumn("_head", head(F.col("_norm")))
    keyed = base.select(F.col(id_col).alias("_pid"), "_norm", "_head")
    folders = conns.where(F.col("_loc") != F.col("_lhead"))
    ends = F.length("_norm") == F.length("_loc")
    at_bound = ends | (F.substr("_norm", F.length("_loc") + 1, F.lit(1)) == "/") if strict else F.lit(True)
    deep = keyed.join(folders, keyed["_head"] == folders["_lhead"]) \
        .where(F.col("_norm").startswith(F.col("_loc")) & at_bound).select("_pid", "connName", "location", "ordinal")
    hosts = keyed.select("_head").distinct()
    begins = hosts.select("_head", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_head"), F.lit(1))),
                                                         lambda n: F.substr("_head", F.lit(1), n))).alias("_begin"))
    if strict:
        begins = begins.where(F.col("_begin") == F.col("_head"))
    shallow = conns.where(F.col("_loc") == F.col("_lhead"))
    by_host = begins.join(shallow, begins["_begin"] == shallow["_loc"]).select(
        F.col("_head").alias("_h"), "connName", "location", "ordinal")
    wide = keyed.join(by_host, keyed["_head"] == by_host["_h"]).select("_pid", "connName", "location", "ordinal")
    best = deep.unionByName(wide).groupBy("_pid").agg(F.max_by(
        F.struct("connName", "location"), F.struct(F.length("location").alias("n"), (-F.col("ordinal")).alias("o"))).alias("_b"))
    out = base.join(best, base[id_col].eqNullSafe(best["_pid"]), "left")
    return out.select(*paths.columns, F.col("_b.connName").alias("connection_name"), F.col("_b.location").alias("location"),
                      "schema", "table", "error")


# J7 ------------------------------------------------------------------------
def detect_cluster(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per requested (schema, table): found flag per cluster, the matched
    clusters (sorted) and ``cluster`` only when exactly one matched."""
    tabs = catalog.select("cluster", "table_schema", "table_name").distinct()
    j = requests.join(tabs, ["table_schema", "table_name"], "left")
    g = j.groupBy("table_schema", "table_name").agg(F.array_sort(F.collect_set("cluster")).alias("matched"))
    return g.select("*", F.array_contains("matched", "local").alias("found_local"),
                    F.array_contains("matched", "region").alias("found_region"),
                    F.when(F.size("matched") == 1, F.col("matched")[0]).alias("cluster"))


# J8 ------------------------------------------------------------------------
def name_candidates(requests: DataFrame, existing: DataFrame, base_col: str = "base_name",
                    existing_col: str = "dataset", wanted: int = 3, max_suffix: int = 19) -> DataFrame:
    """Up to ``wanted`` free names per base name: the base itself, then
    ``_2`` ... ``_19``; case-insensitive against ``existing``.
    Output: base_name, candidate, rank, base_exists."""
    suffixes = F.sequence(F.lit(1), F.lit(max_suffix))
    cands = requests.select(base_col).where(F.col(base_col).isNotNull()).distinct().select(
        F.col(base_col), F.explode(suffixes).alias("_s")).select(
        base_col, "_s", F.when(F.col("_s") == 1, F.col(base_col))
        .otherwise(F.concat(F.col(base_col), F.lit("_"), F.col("_s").cast("string"))).alias("candidate"))
    ex = existing.select(F.lower(F.col(existing_col)).alias("_taken")).distinct()
    # one left join flags every candidate (the existing names are distinct, so
    # at most one match each); windows over a base name's <= max_suffix
    # candidates give both the base flag and the free candidates' ranks
    j = cands.join(ex, F.lower(F.col("candidate")) == F.col("_taken"), "left") \
        .withColumn("_is_taken", F.col("_taken").isNotNull())
    base_exists = F.max(F.when(F.col("_s") == 1, F.col("_is_taken"))).over(Window.partitionBy(base_col))
    j = j.withColumn("base_exists", base_exists)
    w = Window.partitionBy(base_col).orderBy("_s")
    free = j.where(~F.col("_is_taken"))
    picked = free.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= wanted)
    return picked.select(base_col, "candidate", F.col("rank").cast("long").alias("rank"), "base_exists")


# A4 / A5 -------------------------------------------------------------------
def domain_distribution(mapping: DataFrame, col: str = "Data Domain") -> DataFrame:
    """Datasets per Data Domain (null dropped), most frequent first."""
    c = F.col(f"`{col}`")
    return mapping.where(c.isNotNull()).groupBy(c.alias("domain")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col("n").desc(), F.col("domain"))


def subdomain_codes(c) -> Column:
    """Comma list -> trimmed non-empty codes."""
    return F.filter(F.transform(F.split(_c(c), ","), lambda x: py_strip(x)), lambda x: x != "")


def domain_votes(matches: DataFrame, keys: Sequence[str] = ("target_id",), domain_col: str = "Data Domain",
                 sub_col: str = "subDomain") -> DataFrame:
    """Value counts of Data Domain and of subDomain codes over the matches of
    each target: (keys..., kind, value, votes)."""
    # one pass: every match row emits its domain and its codes as (kind, value) entries
    dom = F.when(F.col(f"`{domain_col}`").isNotNull(),
                 F.array(F.struct(F.lit("domain").alias("kind"), F.col(f"`{domain_col}`").alias("value"))))
    subs = F.transform(subdomain_codes(F.col(sub_col)),
                       lambda c: F.struct(F.lit("subdomain").alias("kind"), c.alias("value")))
    entries = F.concat(F.coalesce(dom, F.array().cast("array<struct<kind:string,value:string>>")),
                       F.coalesce(subs, F.array().cast("array<struct<kind:string,value:string>>")))
    return matches.select(*keys, F.inline(entries)).groupBy(*keys, "kind", "value") \
        .agg(F.count(F.lit(1)).alias("votes")).select(*keys, "kind", "value", "votes")


# J5 / E9 -------------------------------------------------------------------
_NAME_WORD = re.compile("[a-z0-9]{2,}")


def _name_words(*names) -> frozenset:
    """Words of at least two characters in any of the names."""
    return frozenset(w for n in names if n for w in _NAME_WORD.findall(n.lower()))


def sequence_ratio_py(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio (argument order matters: a is the target)."""
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """E9 as an Arrow-batched UDF over lower-cased strings."""
    return pd.Series([sequence_ratio_py((x or "").lower(), (y or "").lower()) for x, y in zip(a, b)])


KEY_COLS = ["dataset", "table_nm", "connectionName", "db_nm"]
MATCH_SCHEMA = ("dataset string, table_nm string, connectionName string, db_nm string, rank int, "
                "match_dataset string, match_id bigint, similarity double, score double")
_NBUCKET = 128


def _char_counts(strings) -> np.ndarray:
    """Character multiset of each string, folded into 128 buckets (folding can
    only raise the multiset intersection, so bounds stay valid)."""
    m = np.zeros((len(strings), _NBUCKET), dtype=np.int32)
    for i, s in enumerate(strings):
        for ch in s:
            m[i, ord(ch) % _NBUCKET] += 1
    return m


def _score_block(tg: pd.DataFrame, reg: pd.DataFrame, n: int, w_tok: float, w_ratio: float,
                 b_conn: float, b_schema: float) -> pd.DataFrame:
    """Exact top-n registry rows for each (distinct) target key of ``tg``.

    * Token overlap is vectorised: the registry's tokens form a boolean
      incidence matrix, so a target's intersection sizes are one column sum.
    * Targets sharing a dataset name (differing only in connection / schema)
      share the overlap vector, the ratio upper bounds and the exact ratios.
    * The Ratcliff-Obershelp ratio (the expensive part) is bounded above by
      the character-multiset ratio (difflib's ``quick_ratio``); exact ratios
      are computed in bound order only while a row can still reach the n-th
      best score, so the result equals scoring every pair.
    * Score = w_tok*J + w_ratio*R, then + b_conn, then + b_schema, in the
      reference's order so rounding (and hence ties) match it.
    """
    reg_tokens = [_name_words(d, t) for d, t in zip(reg["dataset"], reg["table_nm"])]
    vocab = {t: k for k, t in enumerate(sorted(set().union(*reg_tokens)))} if reg_tokens else {}
    inc = np.zeros((len(reg_tokens), max(len(vocab), 1)), dtype=np.int32)
    for r_i, toks in enumerate(reg_tokens):
        for t in toks:
            inc[r_i, vocab[t]] = 1
    reg_sizes = inc.sum(axis=1).astype(float)
    reg_lower = [(d or "").lower() for d in reg["dataset"]]
    reg_len = np.array([len(x) for x in reg_lower], dtype=float)
    reg_cc = _char_counts(reg_lower) if w_ratio else None
    reg_conn = np.array([(c or "").lower() for c in reg["connectionName"]], dtype=object)
    reg_db = np.array([(c or "").lower() for c in reg["db_nm"]], dtype=object)
    reg_names = np.array(reg["dataset"].astype(object))
    reg_ids = reg["_rid"].to_numpy()
    out = []
    by_name: dict = {}
    for ds, tb, conn, db in zip(tg["dataset"], tg["table_nm"], tg["connectionName"], tg["db_nm"]):
        key = (ds, tb)
        if key not in by_name:
            tt = _name_words(ds, tb)
            idx = [vocab[t] for t in tt if t in vocab]
            inter = inc[:, idx].sum(axis=1).astype(float) if idx else np.zeros(len(reg_lower))
            union = len(tt) + reg_sizes - inter
            jac = np.where(union > 0, inter / np.maximum(union, 1), 0.0)
            dl = (ds or "").lower()
            if w_ratio:
                common = np.minimum(reg_cc, _char_counts([dl])[0]).sum(axis=1)
                tot = reg_len + len(dl)
                ub_ratio = np.where(tot > 0, 2.0 * common / np.maximum(tot, 1), 1.0)
            else:
                ub_ratio = None
            by_name[key] = (jac, dl, ub_ratio, {})
        jac, dl, ub_ratio, ratios = by_name[key]
        cb = np.where(reg_conn == conn.lower(), b_conn, 0.0) if conn else np.zeros(len(reg_lower))
        sb = np.where(reg_db == db.lower(), b_schema, 0.0) if db else np.zeros(len(reg_lower))
        if not w_ratio:
            score = ((w_tok * jac + 0.0) + cb) + sb
        else:
            ub = ((w_tok * jac + w_ratio * ub_ratio) + cb) + sb + 1e-12
            order = np.argsort(-ub, kind="stable")
            score = np.full(len(reg_lower), -1.0)
            best: list[float] = []
            for i in order:
                if len(best) >= n and ub[i] < best[n - 1]:
                    break
                r = ratios.get(i)
                if r is None:
                    r = ratios[i] = sequence_ratio_py(dl, reg_lower[i])
                sc = ((w_tok * jac[i] + w_ratio * r) + cb[i]) + sb[i]
                score[i] = sc
                best.append(sc)
                best.sort(reverse=True)
                del best[n + 1:]
        idx_top = np.lexsort((reg_ids, reg_names, -score))[:n]
        for rank, i in enumerate(idx_top, start=1):
            if score[i] < 0:
                continue
            out.append((ds, tb, conn, db, rank, reg_names[i], reg_ids[i], round(float(score[i]), 3), float(score[i])))
    return pd.DataFrame(out, columns=KEY_COLS + ["rank", "match_dataset", "match_id", "similarity", "score"])


def similar_datasets(spark: SparkSession, targets: DataFrame, registry: DataFrame, top_n: int = 10,
                     w_tok: float = 0.6, w_ratio: float = 0.4, b_conn: float = 0.15, b_schema: float = 0.10,
                     max_registry_rows: int = 50_000, target_buckets: int | None = None) -> DataFrame:
    """For every target, the ``top_n`` (1..50) most similar registry rows.

    score = w_tok * Jaccard(name tokens) + w_ratio * ratio(lower dataset names)
            + b_conn if same connection + b_schema if same schema (case-insensitive)

    ``targets``: target_id, dataset, table_nm, connectionName, db_nm.
    ``registry``: dataset, table_nm, connectionName, db_nm (+ carried columns).
    Ties are broken by registry dataset name.

    Execution: the registry is a reference table; when its size is within
    ``max_registry_rows`` (checked) it is shipped once to every executor and
    each target partition is scored by ``mapInPandas`` keeping only the top-n
    per target - no pair rows are ever materialised.  Beyond the bound the
    registry is split into chunks of that size, targets are hash-bucketed,
    and each (bucket, chunk) block is scored by a cogrouped pandas function;
    the per-chunk top-n lists are merged by a ``row_number() <= n`` window.
    """
    from dqspark.session import ship_package
    ship_package(spark)
    n = clamp(top_n, 1, 50)
    # rows are matched back by an id of their whole content: names may repeat (equal rows count once)
    registry = registry.withColumn("_rid", F.xxhash64(*registry.columns)).dropDuplicates(["_rid"])
    reg = registry.select(*KEY_COLS, "_rid")
    # score each distinct target key once (a hot key is scored once, not per row)
    keys = targets.select(*KEY_COLS).distinct()
    par = spark.sparkContext.defaultParallelism
    args = (n, w_tok, w_ratio, b_conn, b_schema)
    reg_pdf = reg.limit(max_registry_rows + 1).toPandas()     # at most max+1 rows reach the driver
    small = len(reg_pdf) <= max_registry_rows
    if small:
        bc = spark.sparkContext.broadcast(reg_pdf)

        def score_parts(it):
            r = bc.value
            for pdf in it:
                yield _score_block(pdf, r, *args)
        # explicit round-robin: the scoring is CPU-heavy per key while the keys
        # are few bytes, so AQE would coalesce them into very few partitions;
        # a repartition with a number is never coalesced
        top = keys.repartition(max(par, keys.rdd.getNumPartitions())).mapInPandas(score_parts, MATCH_SCHEMA)
    else:
        n_chunks = int(reg.count() // max_registry_rows) + 1
        buckets = target_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        reg_c = reg.withColumn("chunk", F.pmod(F.xxhash64("dataset"), F.lit(n_chunks)))
        reg_rep = reg_c.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
        tg_b = keys.withColumn("bucket", F.pmod(F.xxhash64(*KEY_COLS), F.lit(buckets))) \
            .select("*", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"))

        def score_block(tpdf, rpdf):
            return _score_block(tpdf, rpdf, *args)
        per_chunk = tg_b.groupBy("bucket", "chunk").cogroup(reg_rep.groupBy("bucket", "chunk")) \
            .applyInPandas(score_block, MATCH_SCHEMA)
        w = Window.partitionBy(*KEY_COLS).orderBy(F.col("score").desc(), F.col("match_dataset").asc(), F.col("match_id").asc())
        top = per_chunk.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    t = targets.select("target_id", *KEY_COLS)
    cond = None
    for k in KEY_COLS:
        c = t[k].eqNullSafe(top[k])
        cond = c if cond is None else (cond & c)
    per_target = t.join(top, cond, "inner").select("target_id", F.col("rank").cast("long").alias("rank"),
                                                   "match_dataset", "similarity", "match_id")
    carried = registry.drop(*KEY_COLS)
    return per_target.join(carried, per_target["match_id"] == carried["_rid"], "left").drop("match_id", "_rid")
