"""Rule operators: F4 F6-F9 A11 A12 A14 J9 J13 Q2 Q3 Q5 S15.

Rules are configuration (SQL text) and are compiled on the driver into
Catalyst expressions; the data never leaves the executors.  A11 evaluates
every rule of a dataset in ONE scan: each rule becomes a pair of
``count_if`` aggregates in a single ``agg`` (partial aggregation only, no
shuffle of rows).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.functions.exprs import py_strip

# --------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# --------------------------------------------------------------------------
# Rule dimensions (dimId -> dimName).
DIMENSIONS = {1: "COMPLETENESS", 2: "TIMELINESS", 3: "UNIQUENESS", 4: "VALIDITY", 5: "CONSISTENCY",
              6: "ACCURACY"}
# Defaults filled into a new custom rule.
NEW_RULE_DEFAULTS = {"points": 1, "perc": 1, "isActive": 1, "previewLimit": 6, "runTimeLimit": 30,
                     "scoringScheme": 0, "tolerance": 0, "weight": "LOW", "businessCategory": "",
                     "businessDesc": "", "filterQuery": "", "suppressed": False, "ruleRepo": ""}
# Rule naming convention (full match).
RULE_NAME_PATTERN = r"if_[a-z0-9]+(?:_[a-z0-9]+)*"
# Rule types.
SQL_RULE_TYPES = ["SQLF", "SQLG"]
TEMPLATE_RULE_TYPE = "CUSTOM"
# Finding arrays and their score fields.
FINDING_TYPES = {"dqItems": ["behaviorScore", "schemaScore"], "rules": ["ruleScore"],
                 "outliers": ["outlierScore"], "sources": ["sourceScore"], "patterns": ["patternScore"],
                 "datashapes": ["shapeScore"], "dupes": ["dupeScore"]}
# --------------------------------------------------------------------------

# Rule templates for CUSTOM rules ($colNm is replaced by the column).  The
# catalogue itself is ours; the reference only shows that templates exist.
RULE_TEMPLATES = {
    "null_empty": "$colNm IS NULL OR trim(CAST($colNm AS STRING)) = ''",
    "range": "$colNm IS NOT NULL AND $colNm NOT BETWEEN {low} AND {high}",
    "length": "$colNm IS NOT NULL AND length(CAST($colNm AS STRING)) > {max_len}",
}
# The templates as conditions; parameters are values, never SQL text.
_TEMPLATE_CONDITIONS = {
    "null_empty": lambda c: c.isNull() | (F.trim(c.cast("string")) == ""),
    "not_in_set": lambda c, values: ~c.isin(*values),
    "regex": lambda c, pattern: ~c.cast("string").rlike(pattern),
    "range": lambda c, low, high: ~c.between(low, high),
    "length": lambda c, max_len: F.length(c.cast("string")) > max_len,
}


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


# F4 ------------------------------------------------------------------------
def validate_readonly(query: str) -> str:
    """Trim, drop trailing ';'; must start with SELECT (any case) and hold no
    other ';' (so WITH queries and a ';' inside a literal are rejected)."""
    q = (query or "").strip()
    while q.endswith(";"):
        q = q[:-1].rstrip()
    if not q.lower().startswith("select"):
        raise ValueError("Only SELECT statements are allowed.")
    if ";" in q:
        raise ValueError("Multiple statements are not allowed.")
    return q


def run_readonly_query(spark: SparkSession, query: str, limit: int = 20) -> DataFrame:
    """``SELECT * FROM (<query>) AS _rule_test LIMIT n`` with n clamped to 1..100."""
    q = validate_readonly(query)
    n = max(1, min(100, int(limit)))
    return spark.sql(f"SELECT * FROM ({q}) AS _rule_test LIMIT {n}")


# F6 / F8 / F9 ---------------------------------------------------------------
def expand_template(template: str, column: str, quote=_q, **params) -> str:
    """F8: ``$colNm`` -> the (quoted) column; ``{param}`` -> parameters."""
    body = RULE_TEMPLATES.get(template, template)
    return body.replace("$colNm", quote(column)).format(**params)


def template_condition(template: str, column: str, **params) -> Column:
    """F8 as an expression: a named template, or SQL text with ``$colNm``.  A
    null value breaks no rule but ``null_empty`` (the condition is null)."""
    if template in _TEMPLATE_CONDITIONS:
        return _TEMPLATE_CONDITIONS[template](F.col(_q(column)), **params)
    return F.expr(template.replace("$colNm", _q(column)))


def rule_condition(df: DataFrame, condition: str | Column, filter_query: str | None = None) -> DataFrame:
    """F6 (SQLG): rows matching the bare condition are breaks; F9: an
    optional pre-filter applies first."""
    d = df.where(F.expr(filter_query)) if filter_query else df
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return d.where(F.coalesce(cond, F.lit(False)))


# F7 ------------------------------------------------------------------------
_TOKEN = re.compile(r"@([A-Za-z_][A-Za-z0-9_]*)")


def rule_sql(spark: SparkSession, sql: str, datasets: Mapping[str, DataFrame]) -> DataFrame:
    """SQLF: a full SELECT whose ``@name`` tokens name datasets; each token is
    replaced by a session temp view of that DataFrame.  Returned rows are the
    breaks."""
    names = {}
    for tok in set(_TOKEN.findall(sql)):
        if tok not in datasets:
            raise ValueError(f"unknown dataset token @{tok}")
        view = f"_dq_{tok}_{uuid.uuid4().hex[:8]}"
        datasets[tok].createOrReplaceTempView(view)
        names[tok] = view
    return spark.sql(_TOKEN.sub(lambda m: names[m.group(1)], sql))


# A11 -----------------------------------------------------------------------
def rule_break_rates(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """All condition rules of a dataset in one scan.

    ``rules``: dicts with ``ruleNm``, ``ruleValue`` (SQL condition, or a
    template name with ``columnName``/``params``), optional ``filterQuery``,
    ``dimId``, ``points``, ``perc``, ``tolerance``.
    Output: rule_name, dim_id, dimension, breaks, total, break_pct (0-100).
    """
    aggs, meta = [], []
    for i, r in enumerate(rules):
        cond = (template_condition(r["ruleRepo"], r["columnName"], **(r.get("params") or {})) if r.get("ruleRepo")
                else F.expr(r["ruleValue"]))
        flt = F.expr(r["filterQuery"]) if r.get("filterQuery") else F.lit(True)
        in_scope = F.coalesce(flt, F.lit(False))
        aggs += [F.count_if(in_scope & F.coalesce(cond, F.lit(False))).alias(f"b{i}"),
                 F.count_if(in_scope).alias(f"t{i}")]
        meta.append(r)
    wide = df.agg(*aggs)
    entries = [F.struct(F.lit(r["ruleNm"]).alias("rule_name"),
                        F.lit(int(r.get("dimId") or 0)).alias("dim_id"),
                        F.lit(DIMENSIONS.get(int(r.get("dimId") or 0))).cast("string").alias("dimension"),
                        F.lit(int(r.get("points", 1))).alias("points"),
                        F.lit(float(r.get("perc", 1))).alias("perc"),
                        F.lit(float(r.get("tolerance", 0))).alias("tolerance"),
                        F.col(f"b{i}").alias("breaks"), F.col(f"t{i}").alias("total"))
               for i, r in enumerate(meta)]
    long = wide.select(F.inline(F.array(*entries)))
    return long.withColumn("break_pct", F.when(F.col("total") == 0, F.lit(0.0))
                           .otherwise(F.col("breaks") * 100.0 / F.col("total")))


# A12 -----------------------------------------------------------------------
def rule_deductions(rates: DataFrame) -> Column:
    """points * floor(max(0, break_pct - tolerance) / perc) per rule."""
    over = F.greatest(F.col("break_pct") - F.col("tolerance"), F.lit(0.0))
    return F.col("points") * F.floor(over / F.col("perc"))


def dataset_score(rates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Score 0-100: 100 - sum of per-rule deductions, floored at 0 (formula is
    ours; the reference reads scores from an external service)."""
    g = rates.groupBy(*keys) if keys else rates.groupBy()
    return g.agg(F.greatest(F.lit(0.0), 100.0 - F.sum(rule_deductions(rates)).cast("double")).alias("score"),
                 F.count(F.lit(1)).alias("n_rules"),
                 F.count_if(F.col("breaks") > 0).alias("n_breaking_rules"))


# A14 -----------------------------------------------------------------------
def dimension_rollup(rates: DataFrame, dataset: str | None = None) -> DataFrame:
    """Breaks, totals and break percent per dimension, plus a grand total row
    (``rollup``; dimension null)."""
    r = rates if dataset is None else rates.withColumn("dataset", F.lit(dataset))
    return (r.rollup("dimension")
            .agg(F.sum("breaks").alias("breaks"), F.sum("total").alias("total"),
                 F.count(F.lit(1)).alias("n_rules"))
            .withColumn("break_pct", F.when(F.col("total") == 0, F.lit(0.0))
                        .otherwise(F.col("breaks") * 100.0 / F.col("total"))))


# J9 ------------------------------------------------------------------------
def validate_rules(expected: DataFrame, findings_rules: DataFrame) -> DataFrame:
    """Per expected (dataset, run_date, rule): found? passed? (three-valued:
    not found is neither).  passed <=> upper(trim(breakMsg)) = 'PASSING' and no
    exception.  The run's ``rows`` and ``passFail`` come along where the findings
    have them."""
    run = [c for c in ("rows", "passFail") if c in findings_rules.columns]
    f = findings_rules.select("dataset", "run_date", F.col("ruleNm").alias("rule_name"), "breakMsg",
                              "exception", "score", "perc", *run, F.lit(True).alias("_found"))
    j = expected.join(f, ["dataset", "run_date", "rule_name"], "left")
    passed = (F.upper(py_strip(F.coalesce(F.col("breakMsg"), F.lit("")))) == "PASSING") & \
             (F.coalesce(F.col("exception"), F.lit("")) == "")
    return j.select(expected.columns + [
        F.coalesce(F.col("_found"), F.lit(False)).alias("found"),
        F.when(F.col("_found").isNull(), F.lit(None).cast("boolean")).otherwise(passed).alias("passed"),
        "score", "perc", "breakMsg", "exception", *run])


# J13 ---------------------------------------------------------------------
def referential_rule(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Breaks of ``child.key NOT IN (SELECT key FROM parent)`` with SQL null
    semantics, as a hash anti join instead of a null-aware nested loop:

    * a child row with a null key is never a break (NOT IN yields null);
    * if the parent holds any null key, NOT IN is never true -> no breaks.

    The second case is an anti join against a relation of at most one row
    (``limit(1)``), so nothing grows with the data.
    """
    pk = parent.select(F.col(parent_key).alias("_pk"))
    keys = pk.where(F.col("_pk").isNotNull()).distinct()
    has_null = pk.where(F.col("_pk").isNull()).limit(1).select(F.lit(1).alias("_has_null"))
    c = child.where(F.col(child_key).isNotNull())
    breaks = c.join(keys, c[child_key] == keys["_pk"], "left_anti")
    return breaks.join(F.broadcast(has_null), how="left_anti")


# Q3 ------------------------------------------------------------------------
def normalize_rules(rules: DataFrame) -> DataFrame:
    """Fill the 13 defaults of a new rule for missing/null fields, coerce a
    boolean isActive to 0/1, and turn null ruleRepo / filterQuery into ''."""
    out = rules
    for k, v in NEW_RULE_DEFAULTS.items():
        if k not in out.columns:
            out = out.withColumn(k, F.lit(v))
        elif k in ("ruleRepo", "filterQuery"):
            out = out.withColumn(k, F.coalesce(F.col(k), F.lit("")))
    if dict(out.dtypes).get("isActive") == "boolean":
        out = out.withColumn("isActive", F.col("isActive").cast("int"))
    return out


# Q2 ------------------------------------------------------------------------
#: Issue codes of a new rule and what each one says.
RULE_ISSUES = {
    "COLUMN_MISSING": "no column is named",
    "NAME_PATTERN": "the name does not follow the naming pattern",
    "TEMPLATE_NAME": "the name is not the one made of column and template (see expected_rule_nm)",
    "TEMPLATE_TYPE": "the rule uses a template but is not of the template type",
    "TEMPLATE_VALUE": "the rule uses a template but its value is not the column",
    "TYPE_UNKNOWN": "the rule has SQL text but is of neither SQL type",
}


def expected_rule_name(rules: DataFrame) -> Column:
    """Name of a template rule after its column and template; null for others."""
    return F.when((F.col("ruleRepo") != "") & (F.col("columnName") != ""),
                  F.concat(F.lit("if_"), F.col("columnName"), F.lit("_is_"), F.col("ruleRepo")))


def rule_issues(rules: DataFrame) -> Column:
    """Codes (see :data:`RULE_ISSUES`) of new rules, in order of code."""
    text = (lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")))
    templated, named = text("ruleRepo") != "", text("columnName") != ""
    checks = {
        "COLUMN_MISSING": ~named,
        "NAME_PATTERN": ~text("ruleNm").rlike(f"^(?:{RULE_NAME_PATTERN})$"),
        "TEMPLATE_NAME": templated & named & (text("ruleNm") != expected_rule_name(rules)),
        "TEMPLATE_TYPE": templated & (text("ruleType") != TEMPLATE_RULE_TYPE),
        "TEMPLATE_VALUE": templated & named & (text("ruleValue") != text("columnName")),
        "TYPE_UNKNOWN": ~templated & ~text("ruleType").isin(*SQL_RULE_TYPES),
    }
    return F.array_compact(F.array(*[F.when(checks[code], F.lit(code)) for code in sorted(checks)]))


def audit_rules(rules: DataFrame) -> DataFrame:
    return (rules.withColumn("issues", rule_issues(rules)).withColumn("compliant", F.size("issues") == 0)
            .withColumn("expected_rule_nm", expected_rule_name(rules)))


# Q5 ------------------------------------------------------------------------
def plan_rule_changes(existing: DataFrame, payload: DataFrame, key: str = "ruleNm",
                      tracked: Sequence[str] = ("ruleValue", "ruleType", "columnName", "filterQuery")) -> DataFrame:
    """Plan of a whole table of proposed rules against the rules there are.

    A proposal is matched by (dataset, name), or by ``old_rule_nm`` for
    renames.  Returned are its own columns and

    * ``status``: new / update / rename / reject with the reason,
    * ``requires_validation``: the rule's text changes (new rules count),
    * ``delete_rule_nm``: the name a rename leaves behind,
    * ``before``: the matched rule's name and tracked fields as one struct,
    * ``rule``: the row to be written: what the proposal says laid over the
      matched rule, or for a new rule over the defaults (:func:`normalize_rules`),
    * ``issues``: codes of :func:`rule_issues`, for new rules only,
    * ``changed_fields``: tracked fields that differ from before, sorted.

    Rejected proposals have none of ``rule``, ``before``, ``delete_rule_nm``,
    ``issues`` and ``changed_fields``.  A null in a proposal means "not said".  One row per
    proposal if (dataset, name) is unique among the rules; two equi joins,
    no group is gathered."""
    types = {**dict(existing.dtypes), **dict(payload.dtypes)}
    fields = [c for c in dict.fromkeys([*tracked, *NEW_RULE_DEFAULTS]) if c in types]
    said, was = ([F.col(f"{side}.{c}") if c in df.columns else F.lit(None).cast(types[c]) for c in fields]
                 for side, df in (("p", payload), ("e", existing)))
    p, e = payload.alias("p"), existing.alias("e")
    names = existing.select(F.col("dataset").alias("_ds"), F.col(key).alias("_taken")).distinct()
    j = (p.join(e, (F.col("p.dataset") == F.col("e.dataset"))
                & (F.coalesce("p.old_rule_nm", f"p.{key}") == F.col(f"e.{key}")), "left")
         .join(names, (F.col("p.dataset") == F.col("_ds")) & (F.col(f"p.{key}") == F.col("_taken")), "left"))
    known, renaming = F.col(f"e.{key}").isNotNull(), F.col("p.old_rule_nm") != F.col(f"p.{key}")
    status = (F.when(F.col("p.old_rule_nm").isNotNull() & ~known, "reject: unknown old name")
              .when(renaming & F.col("_taken").isNotNull(), "reject: new name taken")
              .when(renaming, "rename").when(known, "update").otherwise("new"))
    j = j.select(F.struct("p.*").alias("_row"), status.alias("status"), F.col("p.dataset").alias("_dataset"),
                 F.col(f"p.{key}").alias("ruleNm"),
                 F.when(known, F.struct(F.col(f"e.{key}"), *[c.alias(n) for n, c in zip(fields, was, strict=True)])).alias("before"),
                 # what the proposal says is laid over the matched rule first: no new text, nothing to validate
                 F.struct(*[F.coalesce(a, b).alias(n) for n, a, b in zip(fields, said, was, strict=True)]).alias("_merged"))
    taken, fresh = ~F.col("status").startswith("reject"), F.col("status") == "new"

    def written(c):
        value = F.col("_merged")[c] if c in fields else F.lit(None)
        if types.get(c) == "boolean":
            value = value.cast("int")
        return F.when(fresh, F.coalesce(value, F.lit(NEW_RULE_DEFAULTS.get(c)))).otherwise(value).alias(c)

    columns = [*fields, *[c for c in NEW_RULE_DEFAULTS if c not in fields]]
    j = j.select("*", *[written(c) for c in columns],
                 *[F.lit(None).cast("string").alias(c) for c in ("columnName", "ruleType", "ruleValue") if c not in columns])
    old, new = F.col("before"), F.col("_merged")
    text = (lambda s: s["ruleValue"] if "ruleValue" in fields else F.lit(None).cast("string"))
    differs = F.array(*[F.when(~new[c].eqNullSafe(old[c]), F.lit(c)) for c in sorted(fields)])
    return j.select(
        "_row.*", "status", (old.isNull() | ~text(new).eqNullSafe(text(old))).alias("requires_validation"),
        F.when(F.col("status") == "rename", old[key]).alias("delete_rule_nm"), F.when(taken, old).alias("before"),
        F.when(taken, F.struct(F.col("_dataset").alias("dataset"), F.col("ruleNm").alias(key), *columns)).alias("rule"),
        F.when(fresh, rule_issues(j)).alias("issues"), F.when(taken, F.array_compact(differs)).alias("changed_fields"))


# S15 ---------------------------------------------------------------------
def flatten_findings(findings: DataFrame) -> DataFrame:
    """(dataset, run_date, finding_type, item json, scores) - one row per
    element of the seven finding arrays; a run with an empty array still
    reports its score with a null item."""
    out = None
    for arr, scores in FINDING_TYPES.items():
        if arr not in findings.columns:
            continue
        sc = F.to_json(F.struct(*[F.col(s) for s in scores if s in findings.columns]))
        one = findings.select("dataset", "run_date", F.lit(arr).alias("finding_type"),
                              F.explode_outer(arr).alias("_item"), sc.alias("scores")) \
            .select("dataset", "run_date", "finding_type", F.to_json("_item").alias("item"), "scores")
        out = one if out is None else out.unionByName(one)
    return out


def filter_findings(flat: DataFrame, dataset: str, since: str | None = None, until: str | None = None,
                    finding_types: Sequence[str] | None = None) -> DataFrame:
    """dataset mandatory; run_date window and finding types optional."""
    d = flat.where(F.col("dataset") == dataset)
    if since:
        d = d.where(F.col("run_date") >= since)
    if until:
        d = d.where(F.col("run_date") <= until)
    if finding_types:
        d = d.where(F.col("finding_type").isin(*finding_types))
    return d
