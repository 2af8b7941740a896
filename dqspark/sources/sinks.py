"""Table maintenance operators: S6-S13 (+ J1 in ``operators.joins``).

The reference runs these as row-by-row SQL against a database.  Here each is
a set-based DataFrame job that returns the *new snapshot* of the target
table; :func:`write_snapshot` persists it to a fresh path (never the path
being read), so a failed or retried job leaves the previous snapshot intact.
All joins are equi-joins on the key columns (hash partitioned, AQE may
broadcast the small side at runtime); no step pairs rows within a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from dqspark.functions.exprs import py_strip, stringify


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def with_columns(df: DataFrame, cols: Sequence[str], like: DataFrame | None = None) -> DataFrame:
    """Project to ``cols``; missing ones are added as null (typed like
    ``like``'s column when given)."""
    out = []
    for c in cols:
        if c in df.columns:
            out.append(F.col(_q(c)))
        else:
            t = like.schema[c].dataType if (like is not None and c in like.columns) else T.StringType()
            out.append(F.lit(None).cast(t).alias(c))
    return df.select(*out)


def _any_null(cols: Sequence[str]) -> Column:
    cond = None
    for c in cols:
        x = F.col(_q(c)).isNull()
        cond = x if cond is None else (cond | x)
    return cond


def _one_per_key(df: DataFrame, keys: Sequence[str], cols: Sequence[str], order_by, first: bool) -> DataFrame:
    """One row per key: the first (or last) by ``order_by``, as a
    ``min_by``/``max_by`` aggregate - partial aggregation collapses a hot key
    map-side instead of sorting all its rows in one window task."""
    if order_by is None:
        return df.dropDuplicates(list(keys)).select(*cols)
    o = F.col(order_by) if isinstance(order_by, str) else order_by
    # never a null ordering (it would null the row): rows without one lose to the others
    o = F.struct((o.isNull() if first else o.isNotNull()).alias("p"), o.alias("o"))
    rest = [c for c in cols if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    pick = (F.min_by if first else F.max_by)(F.struct(*[F.col(_q(c)) for c in rest]), o)
    return df.groupBy(*keys).agg(pick.alias("_p")).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in rest]) \
        .select(*cols)


# S6 ------------------------------------------------------------------------
def insert_or_ignore(target: DataFrame, incoming: DataFrame, insert_cols: Sequence[str],
                     conflict_cols: Sequence[str], order_by: str | Column | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING as a snapshot: target + the incoming
    rows whose key is new.  Within the batch the first row per key wins
    (``order_by``); rows with a null key component never conflict (SQL unique
    keys treat nulls as distinct) so they are all inserted."""
    extra = [c for c in incoming.columns if c not in insert_cols]
    inc = with_columns(incoming, list(insert_cols) + extra, like=target)
    nullk = inc.where(_any_null(conflict_cols)).select(*insert_cols)
    keyed = inc.where(~_any_null(conflict_cols))
    keyed = _one_per_key(keyed, conflict_cols, insert_cols, order_by, first=True)
    tk = target.select(*conflict_cols).where(~_any_null(conflict_cols)).distinct()
    new = keyed.join(tk, list(conflict_cols), "left_anti")
    return with_columns(target, insert_cols).unionByName(new).unionByName(nullk)


def attempted_rows(incoming: DataFrame) -> int:
    """What the reference returns: rows attempted (not rows inserted)."""
    return incoming.count()


# S7 ------------------------------------------------------------------------
def upsert(target: DataFrame, incoming: DataFrame, key_cols: Sequence[str], all_cols: Sequence[str],
           change_detect_cols: Sequence[str] | None = None, update_cols: Sequence[str] | None = None,
           order_by: str | Column | None = None, with_action: bool = False) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO UPDATE as a snapshot.

    New keys are inserted; matched rows take the incoming values of the
    update columns (default: every non-key column).  With
    ``change_detect_cols`` the update only fires when one of them IS DISTINCT
    FROM the stored value, and then refreshes all update columns.  No non-key
    column -> behaves as :func:`insert_or_ignore`.  A key repeated in the batch
    keeps the last row by ``order_by`` (the database would reject it).
    """
    upd = list(update_cols) if update_cols is not None else [c for c in all_cols if c not in key_cols]
    if not upd:
        return insert_or_ignore(target, incoming, all_cols, key_cols, order_by)
    inc = with_columns(incoming, all_cols, like=target)
    inc_k = _one_per_key(inc.where(~_any_null(key_cols)), key_cols, all_cols, order_by, first=False)
    inc_null = inc.where(_any_null(key_cols))
    # presence is a flag of its own: a key may be null in the target
    t = with_columns(target, all_cols).withColumn("_there", F.lit(True)).alias("t")
    i = inc_k.withColumn("_there", F.lit(True)).alias("i")
    cond = None
    for k in key_cols:
        c = F.col(f"t.{k}") == F.col(f"i.{k}")
        cond = c if cond is None else (cond & c)
    j = t.join(i, cond, "full_outer")
    t_there = F.col("t._there").isNotNull()
    i_there = F.col("i._there").isNotNull()
    if change_detect_cols:
        changed = None
        for c in change_detect_cols:
            x = ~F.col(f"t.{c}").eqNullSafe(F.col(f"i.{c}"))
            changed = x if changed is None else (changed | x)
    else:
        changed = F.lit(True)
    fire = t_there & i_there & changed
    action = (F.when(~t_there, "insert").when(~i_there, "keep").when(fire, "update").otherwise("unchanged"))
    cols = []
    for c in all_cols:
        if c in key_cols:
            cols.append(F.coalesce(F.col(f"t.{c}"), F.col(f"i.{c}")).alias(c))
        elif c in upd:
            cols.append(F.when(~t_there | fire, F.col(f"i.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.when(~t_there, F.col(f"i.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    out = j.select(*cols, action.alias("_action"))
    out = out.unionByName(inc_null.withColumn("_action", F.lit("insert")))
    return out if with_action else out.drop("_action")


# S8 ------------------------------------------------------------------------
def prune_missing(target: DataFrame, incoming: DataFrame, group_cols: Sequence[str],
                  key_cols: Sequence[str]) -> DataFrame:
    """DELETE rows of each group present in ``incoming`` whose remaining key
    is NOT IN that group's incoming keys - with SQL's NOT IN null logic - and
    return the surviving target rows.

    * groups whose group value is null, or (single key) whose incoming keys
      are all null, are left alone; no non-group key -> no-op;
    * single key: a target row with a null key is kept;
    * composite key: a row is deleted only if, against every incoming tuple of
      its group, some component is definitely different (both non-null and
      unequal).

    Execution: rows are split by which key components are null; for a pair of
    null patterns "not definitely different" is plain equality on the
    components non-null on both sides, so every check is a hash anti join -
    never a pairing of rows inside a group.
    """
    rest = [c for c in key_cols if c not in group_cols]
    if not rest:
        return target
    inc = incoming.where(~_any_null(group_cols)).select(*group_cols, *rest)
    if len(rest) == 1:
        # single key: the target is read once; two left joins flag its group as touched and its key
        # as listed.  NULL NOT IN (...) is unknown, so a null key is kept.
        k = rest[0]
        listed = inc.where(F.col(_q(k)).isNotNull()).select(*group_cols, k).distinct() \
            .withColumn("_listed", F.lit(True))
        groups = listed.select(*group_cols).distinct().withColumn("_touched", F.lit(True))
        j = target.join(groups, list(group_cols), "left").join(listed, [*group_cols, k], "left")
        keep = ~F.coalesce(F.col("_touched"), F.lit(False)) | F.col(_q(k)).isNull() | \
            F.coalesce(F.col("_listed"), F.lit(False))
        return j.where(keep).select(*target.columns)
    groups = inc.select(*group_cols).distinct()
    touched = target.join(groups, list(group_cols), "left_semi")
    untouched = target.join(groups, list(group_cols), "left_anti")
    patterns = [frozenset(p) for r in range(len(rest) + 1) for p in itertools.combinations(rest, r)]

    def only_pattern(df, p):
        cond = F.lit(True)
        for c in rest:
            cond = cond & (F.col(_q(c)).isNull() if c in p else F.col(_q(c)).isNotNull())
        return df.where(cond)

    survivors = None
    for p in patterns:                    # null pattern of the target row
        doomed = only_pattern(touched, p)
        for q in patterns:                # null pattern of incoming tuples
            on = list(group_cols) + [c for c in rest if c not in p and c not in q]
            inc_q = only_pattern(inc, q).select(*on).distinct()
            doomed = doomed.join(inc_q, on, "left_anti").select(*touched.columns)   # keep column order
        kept = only_pattern(touched, p).exceptAll(doomed)                           # (positional)
        survivors = kept if survivors is None else survivors.unionByName(kept)
    return untouched.unionByName(survivors)


# S9 ------------------------------------------------------------------------
CHANGE_LOG_COLUMNS = ["dataset", "region", "session_id", "dataset_category", "change_category",
                      "change_item", "change_from", "change_to", "change_reason", "change_by"]


def change_log_rows(changes: DataFrame, changed_at: Column | None = None) -> DataFrame:
    """Project change records to the fixed change-history columns (missing ->
    null) plus ``changed_at``."""
    ts = changed_at if changed_at is not None else (
        F.col("changed_at") if "changed_at" in changes.columns else F.current_timestamp())
    return with_columns(changes.withColumn("_ts", ts), [*CHANGE_LOG_COLUMNS, "_ts"]) \
        .withColumnRenamed("_ts", "changed_at")


def append_change_log(changes: DataFrame, path: str) -> None:
    """Append to the change-history table (an empty batch writes nothing)."""
    rows = change_log_rows(changes)
    if rows.isEmpty():
        return
    rows.write.mode("append").parquet(path)


# S10 / S11 -----------------------------------------------------------------
def upsert_sessions(target: DataFrame, incoming: DataFrame, as_of: Column | None = None,
                    default_region: str = "apac") -> DataFrame:
    """Upsert chat sessions keyed by session_id: region (trimmed, lower,
    default), app_user, turn_count, updated_at.

    ``incoming`` carries either the whole ``conversation_history`` value
    (turn_count = its size, as the reference stores it) or, in row form, a
    ``turn_count`` computed by an aggregate over the message rows (see
    :func:`session_counts`); the messages themselves are then upserted with
    :func:`upsert_session_messages`, so no history is gathered into one row."""
    now = as_of if as_of is not None else F.current_timestamp()
    hist = "conversation_history" in incoming.columns
    turn_count = F.size("conversation_history") if hist else F.col("turn_count").cast("int")
    inc = incoming.select(
        F.lower(py_strip(F.coalesce(F.col("region"), F.lit(default_region)))).alias("region"),
        "session_id", "app_user", *(["conversation_history"] if hist else []),
        turn_count.alias("turn_count"), now.alias("updated_at"))
    cols = ["region", "session_id", "app_user", *(["conversation_history"] if hist else []), "turn_count",
            "updated_at"]
    return upsert(target, inc, ["session_id"], cols)


def session_counts(messages: DataFrame, key: str = "session_id") -> DataFrame:
    """``key, turn_count`` of message rows (a partial aggregate: a session
    with a huge history is reduced map-side)."""
    return messages.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("turn_count"))


def upsert_session_messages(target: DataFrame, incoming: DataFrame, key: str = "session_id") -> DataFrame:
    """S10 history in row form (one row per message of a session): a session
    in the batch has its stored messages replaced by the batch's - the
    history value is replaced whole, as in the reference - other sessions
    keep theirs.  An anti join on the session key plus a union."""
    batch_sessions = incoming.select(key).distinct()
    return target.join(batch_sessions, key, "left_anti").unionByName(incoming.select(*target.columns))


TURN_STATUSES = ["completed", "interrupted", "error"]
TURN_MUTABLE = ["assistant_message_id", "assistant_response", "status", "stop_reason", "duration_ms",
                "completed_at"]


def upsert_turns(target: DataFrame, incoming: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Upsert agent turns keyed by turn_id; only the six mutable columns are
    updated (user/message fields keep their first value).  Rows with a status
    outside completed/interrupted/error are rejected (dropped here, see
    :func:`invalid_turns`); duration is clamped at 0."""
    now = as_of if as_of is not None else F.current_timestamp()
    inc = incoming.where(F.col("status").isin(*TURN_STATUSES)).withColumn(
        "duration_ms", F.greatest(F.col("duration_ms").cast("int"), F.lit(0))) \
        .withColumn("region", F.lower(py_strip(F.coalesce("region", F.lit("apac"))))) \
        .withColumn("completed_at", now)
    return upsert(target, inc, ["turn_id"], target.columns, update_cols=TURN_MUTABLE)


def invalid_turns(incoming: DataFrame) -> DataFrame:
    return incoming.where(~F.coalesce(F.col("status").isin(*TURN_STATUSES), F.lit(False)))


def tool_rows(turns: DataFrame, tools_col: str = "tool_executions") -> DataFrame:
    """Tool executions of each turn with a 1-based sequence number in
    arrival order (array position), keyed by execution_id."""
    return turns.select("turn_id", F.posexplode(tools_col).alias("_pos", "_t")).select(
        "turn_id", (F.col("_pos") + 1).alias("sequence_number"), "_t.*")


def tool_statuses(turns: DataFrame, tools_col: str = "tool_executions", error_col: str = "error") -> DataFrame:
    """E23 for the executions within ``turns``: none said is completed; when
    the turn failed, whatever has not completed is an error."""
    failed = F.col(error_col).isNotNull()
    return turns.withColumn(tools_col, F.transform(tools_col, lambda t: t.withField("status", F.when(
        failed & ~t["status"].eqNullSafe("completed"), "error").otherwise(
        F.when(F.coalesce(t["status"], F.lit("")) == "", "completed").otherwise(t["status"])))))


def upsert_tool_executions(target: DataFrame, turns: DataFrame, tools_col: str = "tool_executions",
                           error_col: str = "error") -> DataFrame:
    """The tool executions of re-logged turns laid over the stored ones.

    ``target``: execution_id, turn_id, sequence_number, tool_name, tool_input,
    status.  Executions are matched by execution_id; a stored one takes the
    new input and status only (its turn, place and tool stay), others are
    added.  An execution without input has the input ``{}``; one whose id is
    null is added as it is; an id twice in a batch counts as it stands last in
    its turn.  Turns without executions change nothing."""
    new = (tool_rows(tool_statuses(turns, tools_col, error_col), tools_col)
           .withColumn("tool_input", F.coalesce("tool_input", F.lit("{}"))))
    return upsert(target, new, ["execution_id"], target.columns, update_cols=["tool_input", "status"], order_by="sequence_number")


# S12 ---------------------------------------------------------------------
DATASET_LEVEL = ["dataset", "Run Id", "Link Id", "Date Filter", "Date Filter Key", "Scheduler", "Scheduled Freq",
                 "Scheduled Time", "db_nm", "table_nm", "business_unit", "Market", "Project", "CDE"]
COLUMN_LEVEL = ["col_name", "Data Type", "Row Count", "Execution Time", "Data Type Check", "Schema Change", "Dupes",
                "Custom Rules", "Null Values", "Empty Fields", "Uniqueness", "Min", "Max", "Mean", "Outliers",
                "Shapes", "Patterns", "Current Null Pct"]


def split_definitions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dataset_info, columns): dataset-level fields taken from the row with
    the smallest col_name (deterministic "first row"), column rows projected."""
    ds_cols = [c for c in DATASET_LEVEL if c in rows.columns and c != "dataset"]
    info = rows.groupBy("dataset").agg(
        *[F.min_by(F.col(_q(c)), F.col("col_name")).alias(c) for c in ds_cols])
    cols = rows.select("dataset", *[F.col(_q(c)) for c in COLUMN_LEVEL if c in rows.columns])
    return info, cols


# S13 ---------------------------------------------------------------------
def clean_for_write(df: DataFrame) -> DataFrame:
    """Arrays / maps / structs -> JSON text; NaN in float columns -> null;
    everything else unchanged (schema-driven, no row-level Python)."""
    out = []
    for f in df.schema.fields:
        c = F.col(_q(f.name))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(stringify(c, f.dataType.simpleString()).alias(f.name))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write a new snapshot (overwrite mode on a fresh path) and return the
    path; callers swap their table pointer afterwards."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
