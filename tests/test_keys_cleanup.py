import pytest
from pyspark.sql import functions as F

from tidewatch.operators import cleanup, keys


def test_uncovered_keys(spark):
    s = spark.createDataFrame
    cons = s([("A", "T", "full", "R"), ("A", "T", "partial", "R"), ("A", "T", "wrong", "R"), ("A", "T", "none", "R"), ("A", "T", "check", "C"),
              ("A", "GONE", "dropped", "R"), ("B", "T", "other", "R")], "owner string, table_name string, constraint_name string, constraint_type string")
    cols = s([("A", "full", "c2", 1), ("A", "full", "c1", 2), ("A", "partial", "c1", 1), ("A", "partial", "c9", 2), ("A", "wrong", "c2", 1),
              ("A", "none", "x", 1), ("A", "check", "x", 1), ("A", "dropped", "x", 1), ("B", "other", "x", 1)],
             "owner string, constraint_name string, column_name string, position int")
    idx = s([("I", "ix", "A", "T"), ("I", "ix2", "A", "T")], "owner string, index_name string, table_owner string, table_name string")
    icols = s([("I", "ix", "c1", 1), ("I", "ix", "c2", 2), ("I", "ix2", "c1", 1), ("I", "ix2", "c5", 2)], "index_owner string, index_name string, column_name string, column_position int")
    bin_ = s([("A", "GONE", "TABLE"), ("A", "T", "INDEX")], "owner string, object_name string, type string")
    got = keys.uncovered_keys(cons, cols, idx, icols, bin_, owner="A").collect()
    assert sorted((r.constraint_name, r.column_name, r.nearest_index_name) for r in got if r.nearest_index_name) == [
        ("partial", "c1", "ix"), ("partial", "c1", "ix2")]
    assert sorted((r.constraint_name, r.column_name) for r in got if not r.nearest_index_name) == [("none", "x"), ("partial", "c9"), ("wrong", "c2")]
    assert {r.owner for r in keys.uncovered_keys(cons, cols, idx, icols, bin_).collect()} == {"A", "B"}


def test_unused_attributes(spark):
    attrs = spark.createDataFrame([("I", "C1"), ("I", "C2"), ("I", "C3"), ("I", "C4"), ("J", "C1")], "index_name string, column_name string")
    plans = spark.createDataFrame(
        [("I", '"C1"=:1 AND "T"."C2">5', None, '"T".ROWID[ROWID,10], "C3"[NUMBER,22]', "T"), ("I", None, 'NVL("C1",0)=1', None, "T"), ("J", None, None, None, "T")],
        "index_name string, access string, filter string, projection string, table_name string")
    plans = plans.withColumn("projection", keys.plan_identifiers(F.col("projection"), F.col("table_name")))
    got = keys.unused_attributes(attrs, plans, ["index_name"], "column_name", ["access", "filter", "projection"])
    assert sorted(tuple(r) for r in got.collect()) == [("I", "C2"), ("I", "C4"), ("J", "C1")]


def test_plan_identifiers_takes_table_literally(spark):
    df = spark.createDataFrame([('"A$B".ROWID[ROWID,10], "C"', "A$B"), ("ROWID[ROWID,10]", "X"), ('"Z".ROWID[ROWID,10]', "X")], "p string, t string")
    got = [r.x for r in df.select(keys.plan_identifiers(F.col("p"), F.col("t")).alias("x")).collect()]
    assert got == [', "C"', "", '"Z".']


def test_invalid_objects(spark):
    df = spark.createDataFrame([("A", "VALID"), ("A", None), ("A", "INVALID"), ("B", "N/A")], "owner string, status string")
    assert keys.invalid_objects(df).count() == 3
    assert sorted(tuple(r) for r in keys.invalid_by_owner(df).collect()) == [("A", 2), ("B", 1)]


@pytest.mark.parametrize("members,want", [([1, 2], [3]), ([1, None], []), ([], [1, 3, None]), ([9], [1, 3])])
def test_not_in(spark, members, want):
    df = spark.createDataFrame([(1,), (3,), (None,)], "x int")
    other = spark.createDataFrame([(m,) for m in members], "m int")
    assert sorted((r.x for r in keys.not_in(df, "x", other, "m").collect()), key=str) == sorted(want, key=str)


def test_mine_keys_and_foreign_partitions(spark):
    s = spark.createDataFrame
    names = ["WRH$_A_11_5", "WRH$_A_11_MXSN", "WRH$_A_12_7", "WRH$_A_MXDB_MXSN", "WRH$_A_MXDB_9", "NOTHING", "WRH$_A_11_5"]
    segs = s([("WRH$_A", n, "TABLE PARTITION") for n in names] + [("OTHER", "WRH$_A_99_1", "TABLE PARTITION"), ("WRH$_I", "WRH$_I_13_1", "INDEX PARTITION")],
             "segment_name string, partition_name string, segment_type string")
    snaps = s([(11, 1, 5, "t1"), (14, 1, 2, "t0")], "dbid bigint, instance_number int, snap_id bigint, startup_time string")
    got = keys.mine_keys(segs, snaps, s([(11, 1)], "dbid bigint, inst_id int"), s([(1, "t1")], "instance_number int, startup_time string"),
                         s([(11, 1, "t1")], "dbid bigint, instance_number int, startup_time string")).collect()
    rows = {(r.seg_dbid, r.seg_snap_id): (r.instance_number, r.db_rank, r.first_snap, r.is_already_in_wdi, r.is_already_in_ws) for r in got}
    assert rows == {
        (11, 0): (1, 1, 1, 1, 0), (11, 5): (1, 1, 0, 1, 1), (11, 2**20): (1, 1, 0, 1, 0), (12, 7): (None, 2, 1, 0, 0),
        (13, 1): (None, 3, 1, 0, 0), (14, 2): (None, 4, 1, 0, 0)}
    foreign = keys.foreign_partitions(segs, s([(11,)], "dbid bigint")).collect()
    assert sorted(r.partition_name for r in foreign) == ["WRH$_A_12_7", "WRH$_A_MXDB_9"]


def test_usage_report(spark):
    s = spark.createDataFrame
    objs = s([("A", "I1", "T"), ("A", "I2", "T")], "owner string, index_name string, table_name string")
    lines = s([("A", "I1", "q1", 1), ("A", "I1", "q2", 1), (None, "I1", "q1", 1)], "object_owner string, object_name string, sql_id string, plan_hash_value int")
    stats = s([("q1", 1, "SQL Developer", "APP", 1), ("q1", 1, "APEX:APP 10:20", "APP", 2), ("q2", 1, None, "USER7", 1), ("q2", 1, "m", "APP", 1)],
              "sql_id string, plan_hash_value int, module string, parsing_schema_name string, snap_id int").withColumns({"dbid": F.lit(1), "instance_number": F.lit(1)})
    snaps = s([(1, 1, 1, 100), (2, 1, 1, 200)], "snap_id int, dbid int, instance_number int, begin_interval_time int")
    texts = s([("q2", "x dbms_stats Sys_Op_CountChg"), ("q1", "dbms_stats")], "sql_id string, sql_text string")
    got = {(r.index_name, r.is_user_query, r.is_dbms_stats_query): (r["rows"], r.first_use, r.last_use, r.sql_ids, r.modules)
           for r in keys.usage_report(objs, lines, stats, snaps, texts).collect()}
    assert got == {
        ("I1", "Y", "N"): (1, 100, 100, "q1", "SQL Developer"), ("I1", "N", "N"): (1, 200, 200, "q1", "APEX:APP ..."),
        ("I1", "Y", "Y"): (1, 100, 100, "q2", None), ("I1", "N", "Y"): (1, 100, 100, "q2", "m"), ("I2", None, None): (1, None, None, None, None)}


def test_orphans_template_and_update(spark):
    s = spark.createDataFrame
    dim = s([(1, 1, "a"), (1, 2, "a"), (None, 1, "a")], "dbid int, inst int, v string")
    fact = s([(1, 1), (1, 1), (None, 1)], "dbid int, inst int")
    assert [tuple(r) for r in cleanup.purge_orphans(dim, fact, ["dbid", "inst"]).collect()] == [(1, 1, "a")]
    known = s([(1, 10, "old"), (1, 20, "new"), (2, 5, "x")], "inst int, started int, host string")
    required = s([(1, 30), (1, 10), (1, 20), (2, 5), (3, 1)], "inst int, started int")
    added = cleanup.insert_from_template(known, required, ["inst"], "started")
    assert sorted(tuple(r) for r in added.collect()) == [(1, 10, "old"), (1, 20, "new"), (1, 30, "new"), (2, 5, "x")]
    literal = cleanup.insert_from_template(known, required, ["inst"], "started", literal=True)
    assert sorted(tuple(r) for r in literal.collect()) == [(1, 10, "new"), (1, 10, "old"), (1, 20, "new"), (1, 30, "new"), (2, 5, "x")]
    table = s([(1, 0, None), (2, 0, 3), (9, 7, 0)], "inst int, started int, status int")
    got = cleanup.update_from_max(table, known, ["inst"], "started", "status")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 20, 0), (2, 5, 0), (9, None, 0)]


def test_multi_insert(spark):
    rows = spark.createDataFrame([(1, 1, None), (2, 1, 1), (3, 2, 1), (4, 0, 0)], "id int, first int, known int")
    got = cleanup.multi_insert(rows, {"inst": (F.col("first") == 1) & ~F.col("known").eqNullSafe(1), "snap": F.col("known") == 0})
    assert sorted((r.id, r.target) for r in got.collect()) == [(1, "inst"), (4, "snap")]
    both = cleanup.multi_insert(rows, {"a": F.col("id") > 2, "b": F.col("id") > 3})
    assert sorted((r.id, r.target) for r in both.collect()) == [(3, "a"), (4, "a"), (4, "b")]


def test_purge_by_catalog(spark):
    s = spark.createDataFrame
    tables = {"h": s([(1, 1, 5), (1, 1, 6), (2, 1, 5)], "dbid int, instance_number int, snap_id int"), "d": s([(1, 0), (3, 0)], "dbid int, v int"),
              "ok": s([(5,)], "snap_id int"), "free": s([(1,)], "other int"), "kept": s([(9,)], "dbid int")}
    catalog = s([(n, c) for n, t in tables.items() for c in t.columns], "table_name string, column_name string")
    snaps = s([(1, 1, 5, 0)], "dbid int, instance_number int, snap_id int, startup_time int")
    insts = s([(1, 1, 0)], "dbid int, instance_number int, startup_time int")
    left = cleanup.purge_by_catalog(catalog, tables, snaps, insts, skip=["kept"])
    assert {n: sorted(tuple(r) for r in df.collect()) for n, df in left.items()} == {"h": [(1, 1, 5)], "d": [(1, 0)], "ok": [(5,)]}
    assert {r.table_name: r.rows_deleted for r in cleanup.purge_report(tables, left).collect()} == {"h": 2, "d": 1, "ok": 0}


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_cover_by_prefix_sets(spark, tmp_path):
    """Any order of the key's columns, longer indexes, doubled and broken keys; every table is read few times."""
    s = spark.createDataFrame
    cons = s([("A", "T", k, "R") for k in ("abc", "cab", "ab", "gap", "null", "bd")] + [("A", "U", "abc2", "R")], "owner string, table_name string, constraint_name string, constraint_type string")
    columns = {"abc": "abc", "cab": "cab", "ab": "ab", "bd": "bd", "abc2": "abc"}
    cols = s([("A", k, c, i + 1) for k, v in columns.items() for i, c in enumerate(v)] + [("A", "gap", "a", 1), ("A", "gap", "b", 3), ("A", "null", None, 1)],
             "owner string, constraint_name string, column_name string, position int")
    idx = s([("I", "long", "A", "T"), ("I", "other", "A", "T")], "owner string, index_name string, table_owner string, table_name string")
    icols = s([("I", "long", c, i + 1) for i, c in enumerate("bcad")] + [("I", "other", "d", 1), ("I", "other", None, 2)], "index_owner string, index_name string, column_name string, column_position int")
    bin_ = s([], "owner string, object_name string, type string")
    frames = []
    for i, f in enumerate((cons, cols, idx, icols, bin_)):
        f.write.parquet(str(tmp_path / str(i)))
        frames.append(spark.read.parquet(str(tmp_path / str(i))))
    found = keys.uncovered_keys(*frames)
    got = {}
    for r in found.collect():
        got.setdefault(r.constraint_name, set()).add((r.column_name, r.nearest_index_name))
    assert got == {
        "ab": {("a", None), ("b", "long")}, "gap": {("a", "long"), ("b", "long")}, "null": {(None, None)}, "bd": {("b", "long"), ("d", "other")},
        "abc2": {("a", None), ("b", None), ("c", None)}}
    assert _scans(found) <= 6


def test_usage_counts_pairs_of_lines_and_statistics(spark):
    """Every pair of plan line and statistics row counts, though no such pair is a row anywhere."""
    s = spark.createDataFrame
    objs = s([("A", "I1", "T")], "owner string, index_name string, table_name string")
    lines = s([("A", "I1", "q", 1)] * 5 + [("A", "I1", "q", 2)] * 3 + [("A", "I1", "r", 1)] * 2, "object_owner string, object_name string, sql_id string, plan_hash_value int")
    stats = s([("q", 1, "m", "APP", n % 3) for n in range(7)] + [("q", 2, "m", "APP", 0)] * 4 + [("r", 1, "k", "APP", 1), ("s", 1, "k", "APP", 1)],
              "sql_id string, plan_hash_value int, module string, parsing_schema_name string, snap_id int").withColumns({"dbid": F.lit(1), "instance_number": F.lit(1)})
    snaps = s([(n, 1, 1, 100 * n) for n in range(3)], "snap_id int, dbid int, instance_number int, begin_interval_time int")
    texts = s([("q", "x")], "sql_id string, sql_text string")
    report = keys.usage_report(objs, lines, stats, snaps, texts)
    rows = report.collect()
    assert [(r["rows"], r.first_use, r.last_use, r.sql_ids, r.modules) for r in rows] == [(5 * 7 + 3 * 4 + 2, 0, 200, "q, r", "k, m")]
    plan = report._jdf.queryExecution().optimizedPlan().toString().split("\n")
    met = next(i for i, line in enumerate(plan) if "Join Inner, ((sql_id" in line and "plan_hash_value" in line)
    below = [line for line in plan[met + 1 :] if line.strip(" :+-")]
    assert sum("Aggregate [" in line for line in below) >= 2  # both sides are counted before they meet
