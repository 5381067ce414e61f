from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.operators.sessions import (
    blocked_latest, deadlock_report, enrich_runs, peak_two_level, procedure_name, samples_in_range, usage_pivot_topk,
)

T0 = datetime(2024, 1, 1)


def test_blocked_latest(spark):
    """A blocked session that blocks nobody, and a blocker of another sample, do not count."""
    rows = [
        # event_id, sample_id, session, exec, event, blocking_session
        (1, 10, 1, 7, "lock", None), (2, 10, 2, 5, "lock", 1), (3, 11, 1, 7, "lock", None), (4, 11, 3, 5, "lock", 1),
        (5, 12, 1, 7, "lock", None), (6, 13, 2, 5, "lock", 1), (7, 11, 1, 8, "lock", None), (8, 11, 4, 8, "cpu", 3),
    ]
    df = spark.createDataFrame(rows, "event_id int, sample_id int, session_id int, sql_exec_id int, event string, blocking_session int")
    df = df.withColumns({
        "inst_id": F.lit(1), "sample_time": F.expr("timestampadd(SECOND, sample_id, timestamp_ntz'2024-01-01')"),
        "sql_exec_start": F.lit(T0).cast("timestamp_ntz"),
    })
    got = blocked_latest(df, F.col("event") == "lock", F.col("event") == "lock", "event_id").collect()
    assert sorted((r.session_id, r.sql_exec_id, r.sample_id, r.running_seconds) for r in got) == [(1, 7, 11, 11.0), (1, 8, 11, 11.0)]


def _peak_samples(spark, rows):
    schema = "sample_id int, inst_id int, session_id int, session_serial int, user_id int, qc_instance_id int, qc_session_id int, qc_session_serial int, temp_space_allocated bigint"
    return spark.createDataFrame(rows, schema).withColumns({
        "plsql_entry_object_id": F.lit(4), "plsql_entry_subprogram_id": F.lit(5), "plsql_object_id": F.lit(6), "plsql_subprogram_id": F.lit(7)})


def test_peak_two_level(spark):
    rows = [
        (1, 1, 10, 1, 1, None, None, None, 50), (1, 1, 91, 1, 1, 1, 10, 1, 30), (1, 1, 92, 1, 1, 1, 10, 1, 20),
        (2, 1, 10, 1, 1, None, None, None, 100),                 # ties with the first sample: the later one wins
        (1, 1, 93, 1, 1, 1, 77, 1, 500),                         # children without a parent
        (3, 1, 11, 1, 2, None, None, None, 60), (4, 1, 12, 1, 9, None, None, None, 59),  # at and under the limit
        (5, 1, 13, 1, 2, None, None, None, None),                # unknown allocation
        *[(6, 2, s, 1, 2, None, None, None, 100 + s) for s in range(7)],
    ]
    users = spark.createDataFrame([(1, "ANNA")], "user_id int, username string")
    procs = spark.createDataFrame([(4, 5, "O", "P", "Q"), (6, 7, "O", "R", None)], "object_id int, subprogram_id int, owner string, object_name string, procedure_name string")
    live = spark.createDataFrame([(1, 10, 1, "root"), (1, 10, 2, "other"), (2, 6, 1, None)], "inst_id int, session_id int, session_serial int, os_user string")
    got = peak_two_level(_peak_samples(spark, rows), users, procs, live, min_value=60).collect()
    by = {(r.inst_id, r.session_id): r for r in got}
    assert (by[1, 10].os_user, by[1, 10].plsql_entry_call, by[1, 10].plsql_call) == ("root", "O.P.Q", "O.R")
    assert by[1, 11].os_user == "(no v$session)" and by[2, 6].os_user is None and by[1, 11].plsql_call == "O.R"
    assert by[1, 10].peak_gb == 100 / 1024**3
    first = sorted((r["rank"], r.session_id, r.sample_id, r.peak_value, r.child_rows, r.db_user) for r in got if r.inst_id == 1)
    assert first == [(1, 10, 2, 100, 0, "ANNA"), (2, 11, 3, 60, 0, "(2)")]
    assert [(r["rank"], r.session_id) for r in sorted(got, key=lambda r: r["rank"]) if r.inst_id == 2] == [(i + 1, 6 - i) for i in range(5)]
    both = peak_two_level(_peak_samples(spark, rows), users, procs, live, min_value=60, k_inner=2, k_outer=3).collect()
    assert sorted((r.session_id, r.sample_id) for r in both if r.inst_id == 1) == [(10, 1), (10, 2), (11, 3)]


def test_usage_pivot(spark):
    mb = 128  # blocks of 8 KiB
    rows = [
        ("A", "TEMPORARY", "HASH", 10 * mb, "x1"), ("A", "TEMPORARY", "HASH", 5 * mb, "0000000000000"),
        ("A", "TEMPORARY", "SORT", mb, "x2"), ("A", "TEMPORARY", "ODD", mb, None), ("A", "PERMANENT", "DATA", mb, "x3"),
        ("MISSING", "TEMPORARY", "DATA", 1048576, "x4"),
    ]
    segs = spark.createDataFrame(rows, "tablespace string, contents string, segtype string, blocks bigint, sql_id_tempseg string").withColumns(
        {"inst_id": F.lit(1), "session_serial": F.lit(5), "saddr": F.lit("s"), "username": F.lit("U"), "sql_id": F.lit("q")})
    ts = spark.createDataFrame([("A", 8192)], "tablespace_name string, block_size int")
    sessions = spark.createDataFrame([(1, 5, "s", 1, 1, 2, 2)], "inst_id int, session_serial int, saddr string, plsql_entry_object_id int, plsql_entry_subprogram_id int, plsql_object_id int, plsql_subprogram_id int")
    procs = spark.createDataFrame([(1, 1, "O", "P", None), (2, 2, "O", "Q", "R")], "object_id int, subprogram_id int, owner string, object_name string, procedure_name string")
    got = usage_pivot_topk(segs, ts, sessions, procs).collect()
    assert [(r.tablespace, r.contents) for r in got] == [("A", "TEMPORARY"), ("A", "PERMANENT"), ("MISSING", "TEMPORARY")]
    first, second, third = got
    assert (first.temp_hash_mb, first.temp_hash_sql_id, first.temp_sort_mb, first.temp_data_mb) == (15.0, "x1", 1.0, 0.0)
    assert first.segtypes_unspotted == "ODD,SORT" and second.segtypes_unspotted == "PERMANENT::DATA"
    assert third.temp_data_mb == -1.0 and third.temp_total_gb == -1 / 1024
    assert (first.plsql_entry_call, first.plsql_call) == ("O.P", "O.Q.R")
    assert len(usage_pivot_topk(segs, ts, sessions, procs, k=1).collect()) == 1


def test_usage_pivot_sorts_no_segments(spark):
    """All segments meet hash aggregates of numbers; names, statements and types are gathered for the k largest, nulls in their keys too."""
    rows = [(i % 40, None if i % 40 == 7 else "A", None if i % 40 == 9 else "TEMPORARY", "HASH", 128 * (i % 40), f"x{i}") for i in range(400)]
    segs = spark.createDataFrame(rows, "session_serial int, tablespace string, contents string, segtype string, blocks bigint, sql_id_tempseg string").withColumns(
        {"inst_id": F.lit(1), "saddr": F.lit("s"), "username": F.lit("U"), "sql_id": F.lit("q")})
    ts = spark.createDataFrame([("A", 8192)], "tablespace_name string, block_size int")
    ids = "plsql_entry_object_id int, plsql_entry_subprogram_id int, plsql_object_id int, plsql_subprogram_id int"
    sessions = spark.createDataFrame([(1, i, "s", f"m{i}", 1, 1, 2, 2) for i in range(40)], f"inst_id int, session_serial int, saddr string, machine string, {ids}")
    procs = spark.createDataFrame([(1, 1, "O", "P", None)], "object_id int, subprogram_id int, owner string, object_name string, procedure_name string")
    got = usage_pivot_topk(segs, ts, sessions, procs, k=39)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    sorting = [line for line in plan if "ObjectHashAggregate(" in line or "SortAggregate(" in line]
    assert sorting and all("_place" in line.split("functions=")[0] for line in sorting)
    found = got.collect()
    # Session 7's tablespace is unknown and takes less than nothing; 9's contents are null and take nothing, as 0 does.
    assert [r.session_serial for r in found] == [i for i in range(39, 0, -1) if i not in (7, 9)] + [0, 9]
    assert [(r.temp_hash_mb, r.temp_hash_sql_id, r.machine) for r in found[:2]] == [(390.0, "x119", "m39"), (380.0, "x118", "m38")]
    assert (found[-1].contents, found[-1].temp_hash_sql_id, found[-1].username) == (None, None, "U")


def test_procedure_name_without_owner(spark):
    df = spark.createDataFrame([(None, "a", "b"), ("o", "a", None)], "o string, a string, b string")
    assert [r.n for r in df.select(procedure_name(F.col("o"), F.col("a"), F.col("b")).alias("n")).collect()] == [None, "o.a"]


def test_samples_in_range_and_enrichment(spark):
    base = "timestamp_ntz'2024-01-01 00:00:00'"
    df = spark.range(6).select(
        F.col("id").alias("sample_id"), F.expr(f"timestampadd(MINUTE, id, {base})").alias("sample_time"), F.expr("cast(id div 2 as bigint)").alias("snap_id"),
        F.lit(1).alias("dbid"), F.lit(1).alias("inst_id"), F.lit(1).alias("session_id"), F.lit(1).alias("user_id"), F.lit("x").alias("xid"),
        F.lit("q").alias("sql_id"), F.lit(None).cast("string").alias("top_level_sql_id"), F.lit(3).alias("current_obj"),
        *[F.lit(1).alias(f"{r}_{c}_id") for r in ("plsql_entry", "plsql") for c in ("object", "subprogram")],
        *[F.lit(1_500_000).cast("bigint").alias(c) for c in ("wait_time", "time_waited", "pga_allocated", "temp_space_allocated")],
    )
    snaps = spark.createDataFrame([(0, 1, 1), (1, 1, 1)], "snap_id bigint, dbid int, instance_number int")
    known = samples_in_range(df, snaps, datetime(2024, 1, 1, 0, 1), datetime(2024, 1, 1, 0, 5), 0, 2)
    assert sorted(r.sample_id for r in known.collect()) == [1, 2, 3]
    users = spark.createDataFrame([(2, "B")], "user_id int, username string")
    objects = spark.createDataFrame([(3, "O", "T", "TABLE")], "object_id int, owner string, object_name string, object_type string")
    procs = spark.createDataFrame([(1, 1, "P", "Q", "R")], "object_id int, subprogram_id int, owner string, object_name string, procedure_name string")
    rows = enrich_runs(known, users, objects, procs, ("sample_id",), ("session_id", "inst_id")).collect()
    assert {(r.run_samples, r.run_time_waited_s, r.time_waited_s, r.is_top_level, r.username, r.curr_obj_name, r.plsql_procedure) for r in rows} == {
        (3, 4.5, 1.5, "N", None, "T", "R")}
    assert {r.run_total_seconds for r in rows} == {120.0} and len({r.run_part_key for r in rows}) == 1


def _report_inputs(spark):
    fields = spark.createDataFrame(
        [("d1", 5, 1, 1, "00ab", "m", "a", "p"), ("d1", 6, 1, 1, "00CD", "m", "a", "p")],
        "deadlock_id string, session_id int, session_serial int, inst_id int, blocking_xid string, app_name string, action string, os_program string")
    schema = "sample_id int, snap_id int, dbid int, session_id int, session_serial int, inst_id int, xid string, module string, action string, program string, blocking_session int, blocking_session_serial int, blocking_inst_id int, current_obj int, time_waited bigint"
    samples = spark.createDataFrame([
        (1, 1, 1, 5, 1, 1, "x", "seen", None, None, 9, 1, 1, 3, 2_000_000), (1, 1, 1, 9, 1, 1, "00AB", None, None, None, None, None, None, None, 0),
        (2, 1, 1, 5, 1, 1, "x", "seen", None, None, 9, 1, 1, 3, 2_000_000), (1, 1, 1, 8, 1, 1, "y", "not logged", None, None, 9, 1, 1, 3, 1)], schema)
    samples = samples.withColumns({
        "plsql_entry_object_id": F.lit(4), "plsql_entry_subprogram_id": F.lit(5), "plsql_object_id": F.lit(None).cast("int"), "plsql_subprogram_id": F.lit(5),
        "sample_time": F.expr("timestampadd(MINUTE, sample_id, timestamp_ntz'2024-01-01')")})
    snaps = spark.createDataFrame([(1, 1, 1)], "snap_id int, dbid int, instance_number int").withColumn("end_interval_time", F.expr("timestamp_ntz'2024-01-02'"))
    objects = spark.createDataFrame([(3, "O", "T", "TABLE")], "object_id int, owner string, object_name string, object_type string")
    procs = spark.createDataFrame([(4, 5, "P", "Q", "R", "2")], "object_id int, subprogram_id int, owner string, object_name string, procedure_name string, overload string")
    return fields, samples, snaps, objects, procs


def test_deadlock_report_keeps_unseen(spark):
    got = deadlock_report(*_report_inputs(spark)).collect()
    assert sorted((r.session_id, r.sample_id, r.module, r.action, r.program, r.blocking_xid, r.curr_obj_name, r.time_waited_s) for r in got) == [
        (5, 1, "seen", "a", "p", "00AB", "T", 2.0), (6, None, "m", "a", "p", "00CD", None, None)]
    assert [(r.plentry_object, r.plentry_procedure, r.plentry_overload, r.plsql_object) for r in got if r.session_id == 5] == [("Q", "R", "2", None)]
    for since, seen in ((datetime(2024, 1, 1, 0, 1), 1), (datetime(2024, 1, 1, 0, 2), None), (datetime(2024, 1, 3), None)):
        got = deadlock_report(*_report_inputs(spark), since=since).collect()
        assert len(got) == 2 and {r.session_id: r.sample_id for r in got}[5] == seen


def test_deadlock_report_scans_only_logged_sessions(spark, tmp_path):
    fields, samples, *dims = _report_inputs(spark)
    samples.write.parquet(str(tmp_path / "samples"))
    report = deadlock_report(fields, spark.read.parquet(str(tmp_path / "samples")), *dims)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    above = [[x.strip(" :+-") for x in plan.split("\n")[:i]] for i, line in enumerate(plan.split("\n")) if "Relation [sample_id" in line and "parquet" in line]
    assert above and all(any("LeftSemi" in x for x in lines) for lines in above)
