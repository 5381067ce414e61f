from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.nulls import is_truthy, quote_name
from tidewatch.operators.space import classify_segments, next_power_of_two, right_size, segment_dop, space_balance
from tidewatch.plans.maintenance import container_plan, invalid_levels, maintenance_plan

GB = 1024**3


def test_next_power_of_two(spark):
    cases = {1: 1, 2: 2, 3: 4, 8: 8, 9: 16, 2**29: 2**29, 2**29 + 1: 2**30, 2**40: 2**40}
    df = spark.createDataFrame([(n,) for n in cases], "n bigint")
    assert {r.n: r.p for r in df.select("n", next_power_of_two(F.col("n")).alias("p")).collect()} == cases


def test_space_balance_missing_sides(spark):
    make = lambda rows: spark.createDataFrame(rows, "tablespace_name string, bytes bigint")
    got = space_balance(make([("a", 4 * GB), ("b", 2 * GB), ("z", 0)]), make([("a", GB), ("c", GB), ("z", 0)]), make([("a", GB), ("a", GB), ("d", GB)])).collect()
    rows = {r.tablespace_name: (r.total_gb, r.used_gb, r.free_gb, r.free_pct, r.segs, r.segs_gb) for r in got}
    assert rows == {
        "a": (4.0, 3.0, 1.0, 25.0, 2, 2.0), "b": (2.0, None, None, None, None, None), "c": (None, None, 1.0, None, None, None),
        "d": (None, None, None, None, 1, 1.0), "z": (0.0, 0.0, 0.0, None, None, None)}


def test_right_size(spark):
    extents = spark.createDataFrame([("T", 1, 100, 28), ("T", 1, 2000, 46), ("SYSTEM", 3, 1, 1)], "tablespace_name string, file_id int, block_id bigint, blocks bigint")
    files = spark.createDataFrame(
        [("T", 1, "/a/1", 64 * 2**20, 1280, "YES"), ("T", 2, "/a/2", 8 * 2**20, 1280, "NO"), ("SYSTEM", 3, "/a/3", 1, 1, "NO")],
        "tablespace_name string, file_id int, file_name string, bytes bigint, increment_by bigint, autoextensible string")
    spaces = spark.createDataFrame([("T", 8192, 2**20, "PERMANENT"), ("SYSTEM", 8192, 1, "PERMANENT")], "tablespace_name string, block_size int, next_extent bigint, contents string")
    got = {r.file_id: r for r in right_size(extents, files, spaces).collect()}
    assert set(got) == {1, 2}
    one, two = got[1], got[2]
    # 2048 blocks of 8 KiB are 16 MB exactly; the file grows by 10 MB.
    assert (one.last_block_id, one.rounding_mb, one.min_mb, one.opt_mb, one.max_mb) == (2046, 10.0, 16, 20, 16)
    assert one.sql_opt == "alter database datafile 1 resize 20m;" and one.opt_savings_pct == 69.0
    assert (two.last_block_id, two.min_mb, two.sql_opt, two.sql_min) == (None, 8, None, None)


def test_segment_dop(spark):
    mb = 2**20
    rows = [("A", "s1", 64 * mb), ("A", "s2", 1024 * mb), ("A", "s2", 1024 * mb), ("A", "s3", 64 * 2**20 * mb), ("A", "s0", 0), ("HR", "s9", mb)]
    df = spark.createDataFrame(rows, "owner string, segment_name string, bytes bigint").withColumns({
        "partition_name": F.lit(None).cast("string"), "segment_type": F.lit("TABLE"), "tablespace_name": F.lit("D"), "block_id": F.lit(1)})
    assert {r.segment_name: r.dop for r in segment_dop(df).collect()} == {"s0": 1, "s1": 1, "s2": 5, "s3": 16}
    assert {r.segment_name: r.dop for r in segment_dop(df, 3, 1024).collect()} == {"s0": 1, "s1": 1, "s2": 1, "s3": 3}


def _segments(spark, how):
    rows = [("OWN", "TAB", None, "TABLE", 5.0, 4), ("OWN", "Mixed", None, "TABLE", 1.0, 1), ("OWN", "IX", None, "INDEX", 2.0, 1), ("OWN", "IOT_IX", None, "INDEX", 9.0, 1),
            ("OWN", "LOB1", None, "LOBSEGMENT", 3.0, 2), ("OWN", "LOBP", "SYS_P1", "LOB PARTITION", 4.0, 1), ("OWN", "VAR1", None, "LOBSEGMENT", 6.0, 1),
            ("OWN", "LIX", None, "LOBINDEX", 1.0, 1), ("OWN", "CL", None, "CLUSTER", 7.0, 1), ("TWO", "PT", "P1", "TABLE PARTITION", 2.5, 1)]
    segs = spark.createDataFrame(rows, "owner string, segment_name string, partition_name string, segment_type string, size_mb double, dop int").withColumn(
        "tablespace_name", F.when(F.col("owner") == "TWO", "Ts2").otherwise("TS"))
    s = spark.createDataFrame
    return classify_segments(
        segs, s([("OWN", "IX", "NORMAL", "OWN", "TAB"), ("OWN", "IOT_IX", "IOT - TOP", "OWN", "IOT"), ("OWN", "LIX", "LOB", "OWN", "TAB")],
                "owner string, index_name string, index_type string, table_owner string, table_name string"),
        s([("OWN", "LOB1", "TAB", "BODY"), ("OWN", "LOBP", "PTAB", "BODY"), ("OWN", "VAR1", "TAB", "LIST")], "owner string, segment_name string, table_name string, column_name string"),
        s([("OWN", "VAR1", "TAB", "LIST")], "owner string, lob_name string, parent_table_name string, parent_table_column string"),
        s([("OWN", "PTAB", "BODY", "LOBP", "SYS_P1", "P2023")], "table_owner string, table_name string, column_name string, lob_name string, lob_partition_name string, partition_name string"),
        s([], "table_owner string, table_name string, column_name string, lob_name string, lob_subpartition_name string, subpartition_name string"),
        s([], "owner string, table_name string, parent_table_name string, parent_table_column string"), **how)


@pytest.mark.parametrize("how", [{}, dict(hot_rows=1, chunks=3)], ids=["plain", "split"])
def test_classification_and_plan(spark, how):
    classified = _segments(spark, how)
    order = [r.segment_name for r in sorted(classified.collect(), key=lambda r: r.row_no)]
    assert order == ["Mixed", "PT", "TAB", "CL", "IOT_IX", "LOB1", "LOBP", "VAR1", "IX"]
    assert {r.rows_total for r in classified.collect()} == {9}
    plan = sorted(maintenance_plan(classified, "TMP", online="Y", statistics="1", **how).collect(), key=lambda r: r.i)
    assert [r.i for r in plan] == list(range(1, len(plan) + 1)) and {r.n for r in plan} == {len(plan)} and len(plan) == 24
    assert [(r.block, r.cmd) for r in plan] == sorted((r.block, r.cmd) for r in plan)
    texts = [r.step for r in plan]
    assert texts[0] == "alter user own quota unlimited on tmp; -- 1/24"
    assert texts[2].startswith("select count(1) as leftovers_in_transient_tbs from dba_segments where tablespace_name = 'TMP';")
    assert [t.split(" quota")[0] for t in texts if "quota 0" in t] == ["alter user two", "alter user own"]
    moves = {t.split(" -- ")[0] for t in texts}
    assert {
        "alter table own.tab move tablespace tmp parallel 4 online;", 'alter table own."Mixed" move tablespace ts online;',
        "alter table own.iot move tablespace tmp online;", "alter index own.ix rebuild online tablespace ts compute statistics;",
        "alter table own.tab move parallel 2 online lob (body) store as lob1 (tablespace tmp);",
        "alter table own.ptab move partition p2023 online lob (body) store as (tablespace tmp);",
        "alter table own.tab move online varray list store as lob var1 (tablespace ts);",
        '-- WARNING: Dunno how to move cluster "OWN"."CL";', 'alter table two.pt move partition p1 tablespace "Ts2" online;'} <= moves
    own = [r for r in plan if r.block.startswith("10:") and r.block.endswith(":01:move to transient") and "two." not in r.step]
    assert "own.ix" in own[0].step and '"Mixed"' in own[-1].step
    back = [r for r in plan if r.block.endswith("persistent") and "two." not in r.step]
    assert '"Mixed"' in back[0].step and "own.ix" in back[-1].step
    alone = maintenance_plan(classified, **how).collect()
    assert len(alone) == 9 and all("tablespace ${" not in r.step or "lob" in r.step for r in alone)


def test_container_plan(spark):
    files = spark.createDataFrame(
        [("DATA", 1, "/u/a.dbf", 8192 * 100, 100, 12800, 131072, "YES"), ("DATA", 7, r"C:\ora\b.dbf", 8192 * 100, 100, 12800, 131072, "NO"),
         ("UNDO1", 2, "/u/u", 1, 1, 1, 1, "NO"), ("USERS", 3, "/u/v", 1, 1, 1, 1, "NO"), ("IDX", 4, "/u/i.dbf", 8192 * 100, 100, 12800, 131073, "YES")],
        "tablespace_name string, file_id int, file_name string, bytes bigint, blocks bigint, increment_by bigint, maxblocks bigint, autoextensible string")
    got = {r.tablespace_name: r for r in container_plan(files, datetime(2024, 5, 6, 7)).collect()}
    assert set(got) == {"DATA", "IDX"} and got["DATA"].data_file_path == "C:\\ora\\"
    assert got["IDX"].sql_create == ("create smallfile tablespace \"IDX$N_20240506_07\" datafile '/u/idx.20240506_07.dbf' size 100m"
                                     " autoextend on next 100m maxsize 2g;")
    assert got["DATA"].sql_rename_old == 'alter tablespace "DATA" rename to "DATA$O_20240506_07";'


def test_invalid_levels(spark):
    s = spark.createDataFrame
    whole = s([("A", "I1", "NORMAL", "UNUSABLE", None), ("A", "I2", "NORMAL", "VALID", "NO"), ("A", "I3", "NORMAL", "N/A", "YES"),
               ("A", "I4", "IOT - TOP", "UNUSABLE", "NO"), ("SYS", "I5", "NORMAL", "UNUSABLE", "NO"), ("A", "I6", "NORMAL", None, "NO")],
              "owner string, index_name string, index_type string, status string, partitioned string")
    parts = s([("A", "I3", "p1", "UNUSABLE", 0), ("A", "I3", "P2", "UNUSABLE", 2)], "index_owner string, index_name string, partition_name string, status string, subpartition_count int")
    subs = s([("A", "I3", "SP", "UNUSABLE"), ("A", "I3", "SQ", "USABLE")], "index_owner string, index_name string, subpartition_name string, status string")
    assert sorted((r.level, r.sql) for r in invalid_levels(whole, parts, subs, "TRUE").collect()) == [
        (0, "alter index a.i1 rebuild online;"), (1, 'alter index a.i3 rebuild partition "p1" online;'), (2, "alter index a.i3 rebuild subpartition sp online;")]


def test_quote_name(spark):
    df = spark.createDataFrame([("ABC_1",), ("Abc",), ('"x y"',), ('"a"."b"',), (None,)], "n string")
    assert [r.q for r in df.select(quote_name(F.col("n")).alias("q")).collect()] == ["abc_1", '"Abc"', '"x y"', '"a"."b"', None]
    for bad in ("A B", 'a"b', "1ABC", ""):
        with pytest.raises(Exception, match="not a safe name"):
            spark.createDataFrame([(bad,)], "n string").select(quote_name(F.col("n"))).collect()
    assert [is_truthy(x) for x in ("Y", "yes", "TRUE", "t", "1", "no", "", None, True)] == [True] * 5 + [False] * 3 + [True]
