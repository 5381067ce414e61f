"""Session-sample analyses: enrichment, blockers, peak use, deadlock report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.nulls import null_if_blank, text_concat, unless_null
from tidewatch.functions.times import moment, seconds_between
from tidewatch.operators.ordered import latest_per_key
from tidewatch.operators.runs import run_segments

# The columns that identify one session's stream of samples.
SESSION_KEYS = (
    "session_id", "session_serial", "inst_id", "user_id", "machine", "port", "module",
    "top_level_sql_id", "plsql_entry_object_id", "con_dbid", "con_id",
)

# Fixed value: stands for the user of a session that is no longer there.
NO_SESSION = "(no v$session)"


def procedure_name(owner: Column, object_name: Column, procedure: Column) -> Column:
    """``owner.object[.procedure]``, null when there is no owner."""
    tail = F.when(procedure.isNotNull(), F.concat(F.lit("."), procedure))
    return unless_null(owner, text_concat(owner, ".", object_name, tail))


def _with_procedure(df: DataFrame, procedures: DataFrame, role: str, prefix: str, overload: bool = False) -> DataFrame:
    """Left join of the procedure dimension on (object_id, subprogram_id)."""
    dim = procedures.select(
        F.col("object_id").alias(f"{role}_object_id"),
        F.col("subprogram_id").alias(f"{role}_subprogram_id"),
        F.col("owner").alias(f"{prefix}_owner"),
        F.col("object_name").alias(f"{prefix}_object"),
        F.col("procedure_name").alias(f"{prefix}_procedure"),
        *[F.col("overload").alias(f"{prefix}_overload")] * overload,
    )
    return df.join(dim, [f"{role}_object_id", f"{role}_subprogram_id"], "left")


def _with_calls(df: DataFrame, procedures: DataFrame) -> DataFrame:
    """Adds the names of the entry procedure and of the procedure called (``plsql_entry_call``, ``plsql_call``)."""
    named = _with_procedure(_with_procedure(df, procedures, "plsql_entry", "_pe"), procedures, "plsql", "_po")
    calls = {
        out: procedure_name(F.col(f"{p}_owner"), F.col(f"{p}_object"), F.col(f"{p}_procedure"))
        for out, p in (("plsql_entry_call", "_pe"), ("plsql_call", "_po"))
    }
    return named.withColumns(calls).drop(*[f"{p}_{c}" for p in ("_pe", "_po") for c in ("owner", "object", "procedure")])


def samples_in_range(
    samples: DataFrame, snapshots: DataFrame, time_from: datetime, time_to: datetime, snap_from: int, snap_to: int
) -> DataFrame:
    """Samples of a time and snapshot range whose snapshot is known."""
    keys = ["snap_id", "dbid", "inst_id"]
    known = snapshots.withColumnRenamed("instance_number", "inst_id").select(*keys).distinct()
    inside = F.col("sample_time").between(moment(samples, "sample_time", time_from), moment(samples, "sample_time", time_to)) & F.col("snap_id").between(snap_from, snap_to)
    return samples.where(inside).join(known, keys, "left_semi")


def enrich_runs(
    samples: DataFrame,
    users: DataFrame,
    objects: DataFrame,
    procedures: DataFrame,
    order: tuple[str, ...] = ("sample_id",),
    keys: tuple[str, ...] = SESSION_KEYS,
    hot_rows: int | None = None,
) -> DataFrame:
    """Run segmentation of session samples with user, object and procedure names attached.

    Each dimension is unique on its key, so the left joins keep one row per sample.
    """
    runs = run_segments(
        samples, keys, order, "xid", "sample_time", ("wait_time", "time_waited"), hot_rows=hot_rows
    )
    user_dim = users.select("user_id", "username")
    object_dim = objects.select(
        F.col("object_id").alias("current_obj"),
        F.col("owner").alias("curr_obj_owner"),
        F.col("object_name").alias("curr_obj_name"),
        F.col("object_type").alias("curr_obj_type"),
    )
    out = runs.join(user_dim, "user_id", "left").join(object_dim, "current_obj", "left")
    out = _with_procedure(out, procedures, "plsql_entry", "plentry")
    out = _with_procedure(out, procedures, "plsql", "plsql")
    identity = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, "run_id")]
    seconds = {f"{c}_s": F.round(F.col(c) / 1_000_000, 3) for c in ("time_waited", "run_time_waited", "wait_time", "run_wait_time")}
    megabytes = {f"{c}_mb": F.round(F.col(c) / 1_048_576, 1) for c in ("pga_allocated", "temp_space_allocated")}
    return out.withColumns(
        {
            "run_part_key": F.md5(F.concat_ws("+", *identity)),
            "is_top_level": F.when(F.col("top_level_sql_id") == F.col("sql_id"), "Y").otherwise("N"),
            "run_total_seconds": seconds_between("run_start_time", "run_end_time"),
            **seconds,
            **megabytes,
        }
    ).drop("time_waited", "run_time_waited", "wait_time", "run_wait_time", "pga_allocated", "temp_space_allocated")


def blocked_latest(samples: DataFrame, waiting: Column, blocked: Column, tie: str) -> DataFrame:
    """Newest waiting sample per session and statement execution, among sessions that at that
    sample block another one.

    ``waiting`` selects the samples looked at, ``blocked`` the samples of blocked sessions.
    """
    blockers = samples.where(blocked & F.col("blocking_session").isNotNull()).select(
        "sample_id", "inst_id", F.col("blocking_session").alias("session_id")
    )
    blocking = samples.where(waiting).join(blockers.distinct(), ["sample_id", "inst_id", "session_id"], "left_semi")
    newest = latest_per_key(blocking, ["session_id", "sql_exec_id"], [F.col("sample_id"), F.col(tie)])
    return newest.withColumn("running_seconds", seconds_between("sql_exec_start", "sample_time"))


def peak_two_level(
    samples: DataFrame,
    users: DataFrame,
    procedures: DataFrame,
    sessions: DataFrame,
    value: str = "temp_space_allocated",
    min_value: float = 2 * 1024 * 1048576,
    k_inner: int = 1,
    k_outer: int = 5,
) -> DataFrame:
    """Sessions with the highest peak per instance, parallel children added to their parent.

    Ties go to the later sample, then to the lower session. The few rows that remain get the
    peak in gigabytes, the user's name (or its number in brackets), the names of both procedures,
    and the operating-system user of the session, if ``sessions`` still has it.
    """
    child_keys = {"qc_instance_id": "inst_id", "qc_session_id": "session_id", "qc_session_serial": "session_serial"}
    children = (
        samples.where(F.col("qc_instance_id").isNotNull())
        .groupBy("sample_id", *[F.col(c).alias(p) for c, p in child_keys.items()])
        .agg(F.sum(value).alias("_child_value"), F.count(F.lit(1)).alias("child_rows"))
    )
    parents = samples.where(F.col("qc_instance_id").isNull())
    joined = parents.join(children, ["sample_id", *child_keys.values()], "left").withColumns(
        {
            "peak_value": F.col(value) + F.coalesce(F.col("_child_value"), F.lit(0)),
            "child_rows": F.coalesce(F.col("child_rows"), F.lit(0)),
        }
    )
    large = joined.where(F.col("peak_value") >= min_value).drop("_child_value")
    session = ["inst_id", "session_id", "session_serial"]
    if k_inner == 1:
        peaks = latest_per_key(large, session, [F.col("peak_value"), F.col("sample_id")])
    else:
        inner = Window.partitionBy(*session).orderBy(F.desc_nulls_last("peak_value"), F.desc("sample_id"))
        peaks = large.withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= k_inner).drop("_r")
    outer = Window.partitionBy("inst_id").orderBy(
        F.desc_nulls_last("peak_value"), F.desc("sample_id"), F.asc("session_id"), F.asc("session_serial")
    )
    top = peaks.withColumn("rank", F.row_number().over(outer)).where(F.col("rank") <= k_outer)
    top = top.withColumn("rank", F.col("rank").cast("bigint"))
    named = top.join(users.select("user_id", "username"), "user_id", "left")
    named = _with_calls(named, procedures)
    live = sessions.select(*session, F.col("os_user").alias("_os_user"), F.lit(True).alias("_live"))
    named = named.join(live, session, "left")
    return named.withColumns({
        "db_user": F.coalesce(F.col("username"), text_concat("(", F.col("user_id"), ")")),
        "os_user": F.when(F.col("_live"), F.col("_os_user")).otherwise(NO_SESSION),
        "peak_gb": F.col("peak_value") / 1_048_576 / 1024,
    }).drop("username", "_os_user", "_live")


def usage_pivot_topk(
    temp_segments: DataFrame, tablespaces: DataFrame, sessions: DataFrame, procedures: DataFrame, k: int = 5
) -> DataFrame:
    """Temporary space per session and tablespace by segment type; the k largest in total.

    The session join comes before the limit because it filters. The procedure joins come
    after it: their keys are unique, so they change no ranking.

    The ranking needs numbers alone, which a hash aggregate adds up without sorting the segments.
    Names, statements and lists of types, for which they would have to be sorted, are gathered for
    the k largest only.
    """
    # The segment types given columns of their own, and the empty statement id.
    types = ("LOB_DATA", "LOB_INDEX", "INDEX", "DATA", "HASH", "SORT")
    no_statement = "0000000000000"
    spotted = types[:-1]
    session, place = ["inst_id", "session_serial", "saddr"], ["tablespace", "contents"]

    temporary = F.col("contents") == "TEMPORARY"
    megabytes = F.col("blocks") * F.coalesce(F.col("block_size"), F.lit(-1)) / 1_048_576
    statement = F.nullif(F.col("sql_id_tempseg"), F.lit(no_statement))
    sums, measures = [], []
    for t in types:
        of_type = temporary & (F.col("segtype") == t)
        sums.append(F.sum(F.when(of_type, megabytes).otherwise(0.0)).alias(f"temp_{t.lower()}_mb"))
        measures += [sums[-1], F.min(F.when(of_type, statement)).alias(f"temp_{t.lower()}_sql_id")]
    unspotted = F.when(temporary & ~F.col("segtype").isin(*spotted), F.col("segtype")).when(
        F.col("contents") != "TEMPORARY", F.concat("contents", F.lit("::"), "segtype")
    )
    sized = temp_segments.join(
        tablespaces.select(F.col("tablespace_name").alias("tablespace"), "block_size"), "tablespace", "left"
    )
    total = sum((F.col(f"temp_{t.lower()}_mb") for t in types), F.lit(0.0)) / 1024
    keyed = sized.groupBy(*session, *place).agg(*sums).withColumn("temp_total_gb", total).join(sessions, session)
    top = keyed.orderBy(F.desc_nulls_last("temp_total_gb"), *session, *place).limit(k)
    top = top.select(
        F.monotonically_increasing_id().alias("_place"), *[F.col(c).alias(f"_top_{c}") for c in (*session, *place)],
        F.struct("temp_total_gb", *[c for c in sessions.columns if c not in session]).alias("_top"),
    )
    # The session join leaves no null in the session's keys; the others may be null.
    same = [F.col(c) == F.col(f"_top_{c}") for c in session] + [F.col(c).eqNullSafe(F.col(f"_top_{c}")) for c in place]
    pivot = sized.join(top, same).groupBy("_place", *session, *place).agg(
        F.min("username").alias("username"),
        F.min("sql_id").alias("sql_id"),
        *measures,
        null_if_blank(F.array_join(F.array_sort(F.collect_set(unspotted)), ",")).alias("segtypes_unspotted"),
        F.any_value("_top").alias("_top"),
    )
    largest = pivot.orderBy("_place").limit(k)
    return _with_calls(largest.select(*[c for c in pivot.columns if c not in ("_place", "_top")], "_top.*"), procedures)


def deadlock_report(
    fields: DataFrame, samples: DataFrame, snapshots: DataFrame, objects: DataFrame, procedures: DataFrame, since: datetime | None = None
) -> DataFrame:
    """Deadlocked sessions from the log (``deadlock_sessions``), with the blocked samples seen for them.

    Samples are joined to their snapshot and to the blocker's sample of the same moment; a
    deadlock without such a sample keeps its row. ``app_name`` and ``os_program`` of the log stand
    in for a missing ``module`` and ``program``. Object and both procedures are named.

    The few logged sessions come first: samples of other sessions go before any join, and of the
    remaining ones only the blockers' samples are looked for.
    """
    session = ["session_id", "session_serial", "inst_id"]
    recent = samples if since is None else samples.where(F.col("sample_time") >= moment(samples, "sample_time", since))
    recent = recent.join(fields.select(*session).distinct(), session, "left_semi")
    snaps = snapshots if since is None else snapshots.where(
        F.col("end_interval_time") >= moment(snapshots, "end_interval_time", since)
    )
    keys = ["snap_id", "dbid", "inst_id"]
    known = snaps.withColumnRenamed("instance_number", "inst_id").select(*keys).distinct()
    recent = recent.join(known, keys, "left_semi")
    blocker_keys = ["sample_id", "snap_id", "dbid", "blocking_session", "blocking_session_serial", "blocking_inst_id"]
    blocker = samples.select(
        "sample_id", "snap_id", "dbid", *[F.col(c).alias(b) for c, b in zip(session, blocker_keys[3:])],
        F.col("xid").alias("_blocking_xid"),
    )
    blocker = blocker.join(recent.select(*blocker_keys[3:]).distinct(), blocker_keys[3:], "left_semi")
    seen = recent.join(blocker, blocker_keys)
    # The transaction id is compared in any letter case.
    seen = seen.withColumn("_xid_key", F.upper("_blocking_xid"))
    logged = fields.withColumn("_xid_key", F.upper("blocking_xid")).withColumnsRenamed(
        {"app_name": "_log_module", "action": "_log_action", "os_program": "_log_program"}
    )
    out = logged.join(seen, [*session, "_xid_key"], "left")
    object_dim = objects.select(
        F.col("object_id").alias("current_obj"), F.col("owner").alias("curr_obj_owner"),
        F.col("object_name").alias("curr_obj_name"), F.col("object_type").alias("curr_obj_type"),
    )
    out = out.join(object_dim, "current_obj", "left")
    out = _with_procedure(_with_procedure(out, procedures, "plsql_entry", "plentry", True), procedures, "plsql", "plsql", True)
    return out.withColumns(
        {
            "module": F.coalesce("module", "_log_module"),
            "action": F.coalesce("action", "_log_action"),
            "program": F.coalesce("program", "_log_program"),
            "blocking_xid": F.coalesce("_blocking_xid", "blocking_xid"),
            "time_waited_s": F.round(F.col("time_waited") / 1_000_000, 3),
        }
    ).drop("_xid_key", "_blocking_xid", "_log_module", "_log_action", "_log_program", "time_waited")
