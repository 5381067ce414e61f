import os

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.patterns import SectionKind, key_value, section_heads, sections
from tidewatch.session import staged, work_folder
from tidewatch.sources import readers, tables
from tidewatch.sources.readers import read_log_lines


def test_purges_agree(spark):
    rows = spark.range(0, 3500).select("id", F.lit("x").alias("v"))
    high = 2333
    for low, bound in ((1, high), (0, 1999), (1000, 1999), (500, 600), (9000, 9999), (0, 3499)):
        want = sorted(i for i in range(3500) if not low <= i <= bound)
        database = work_folder(spark, "purge")
        name = database.rsplit("/", 1)[1].replace("-", "_")
        spark.sql(f"CREATE DATABASE {name} LOCATION '{database}'")
        tables.create_range_table(rows, f"{name}.t", "id", 1000)
        by_partition = tables.purge_partitions(spark, f"{name}.t", "id", 1000, low, bound)
        assert sorted(r.id for r in by_partition.collect()) == want
        left = [p for p in os.listdir(f"{database}/t") if p.startswith("bucket=")]
        assert len(left) == len({i // 1000 for i in want})
        assert sorted(r.id for r in tables.purge_range(rows, "id", low, bound).collect()) == want
        keys = spark.range(low, bound + 1)
        assert sorted(r.id for r in tables.purge_keys(rows, keys.union(keys), "id").collect()) == want


def test_partitioned_rewrite_is_pruned(spark):
    rows = spark.range(100).select("id", F.expr("date_add(date'2024-01-01', cast(id % 4 as int))").alias("d"))
    table = tables.rewrite_partitioned(rows, "day", F.col("d"), work_folder(spark, "days"))
    one = table.where(F.col("day") == F.lit("2024-01-02").cast("date"))
    assert one.count() == 25
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_measurement_store(spark):
    make = lambda rows: spark.createDataFrame(rows, "stat string, v bigint")
    store = tables.MeasurementStore(spark, work_folder(spark, "store"), ["stat"], ["v"])
    store.save_pre(1, make([("a", 1), ("gone", 9)]))
    store.save_pre(2, make([("a", 100)]))
    store.save_pre(1, make([("a", 2), ("b", 3)]))
    store.save_post(1, make([("a", 10), ("c", 4)]))
    store.save_post(1, make([("a", 12)]))
    got = {(r.run_id, r.stat): (r.v_pre, r.v_post, r.d_pre is not None) for r in store.read().collect()}
    assert got == {(1, "a"): (2, 12, True), (1, "b"): (3, None, True), (1, "c"): (None, 4, True), (2, "a"): (100, None, True)}


def test_report_and_target_files(spark):
    path = work_folder(spark, "reports")
    tables.write_reports(spark.createDataFrame([("a.html", 1), ("b.html", 2)], "file_name string, n int"), path)
    assert sorted(d for d in os.listdir(path) if "=" in d) == ["file_name=a.html", "file_name=b.html"]
    path = work_folder(spark, "targets")
    tables.write_targets(spark.createDataFrame([("t1", 1), ("t2", 2), ("t1", 3)], "target string, n int"), path)
    assert spark.read.parquet(f"{path}/target=t1").count() == 2


def test_staged(spark):
    df = staged(spark.range(3), "numbers")
    assert df.count() == 3 and df.columns == ["id"]


def test_log_mining_from_files(spark):
    folder = work_folder(spark, "logs")
    os.makedirs(folder)
    lines = ["noise", "Global Wait-For-Graph for GES Deadlock ID=[1_2_3]", "------", "Session Number : 12", "Instance: 1", "-----",
             "End of Global WFG for GES Deadlock", "Global blockers dump start:----", "User: 5", "Global blockers dump end:----", "tail"]
    for name in ("a.trc", "b.trc"):
        with open(f"{folder}/{name}", "w") as out:
            out.write("\n".join(lines) + "\n")
    rows = read_log_lines(spark, folder)
    assert sorted((r.trace_filename, r.line_number, r.payload) for r in rows.collect()) == sorted(
        (n, i + 1, p) for n in ("a.trc", "b.trc") for i, p in enumerate(lines))
    p = F.col("payload")
    kinds = [
        SectionKind("WFG", (p.rlike(r"(?i)^\s*global\s+wait-for-graph.*for\s+GES\s+deadlock"), p.rlike("^-+")),
                    (p.rlike("^-+"), p.rlike(r"(?i)^\s*end\s+of\s+global\s+WFG\s+for\s+GES\s+deadlock"))),
        SectionKind("blockers", (p.like("Global blockers dump start:%"),), (p.like("Global blockers dump end:%"),)),
    ]
    found = sections(rows, ["trace_filename"], ["line_number"], kinds)
    headed = section_heads(found, ["trace_filename"], ["line_number"], deadlock_id=F.nullif(F.regexp_extract("payload", r"\d+_\d+_\d+", 0), F.lit("")))
    got = key_value(headed, "payload").where("trace_filename = 'a.trc'").orderBy("line_number").collect()
    assert [(r.line_number, r.section, r.kind, r.deadlock_id) for r in got] == [
        *[(i, 1, "WFG", "1_2_3") for i in range(2, 8)], *[(i, 2, "blockers", None) for i in range(8, 11)]]
    assert [(r["var"], r["value"]) for r in got[2:4]] == [("Session Number", "12"), ("Instance", "1")]


def test_purges_keep_rows_without_and_with_negative_keys(spark, tmp_path):
    rows = [(k, str(k)) for k in [None, -1000, -5, -1, 0, 5, 999, 1000, 1500, 2500]]
    df = spark.createDataFrame(rows, "k bigint, v string")
    assert {r.k for r in tables.purge_range(df, "k", 0, 999).collect()} == {None, -1000, -5, -1, 1000, 1500, 2500}
    spark.sql(f"CREATE DATABASE purge_signs LOCATION '{tmp_path}/db'")
    tables.create_range_table(df, "purge_signs.t", "k", 1000)
    assert {r.k for r in tables.purge_partitions(spark, "purge_signs.t", "k", 1000, 0, 999).collect()} == {None, -1000, -5, -1, 1000, 1500, 2500}
    assert {r.k for r in tables.purge_partitions(spark, "purge_signs.t", "k", 1000, -3, 1200).collect()} == {None, -1000, -5, 1500, 2500}
    spark.sql("DROP DATABASE purge_signs CASCADE")


def test_store_replaced_by_nothing_and_post_time(spark, tmp_path):
    store = tables.MeasurementStore(spark, str(tmp_path / "store"), ["k"], ["m"])
    rows = spark.createDataFrame([("a", 1), (None, 2)], "k string, m bigint")
    store.save_pre(1, rows)
    store.save_pre(2, rows)
    store.save_post(2, spark.createDataFrame([(None, 5), ("b", 6)], "k string, m bigint"))
    got = {r.k: (r.m_pre, r.m_post, r.d_pre is not None, r.d_post is not None) for r in store.read().where("run_id = 2").collect()}
    assert got == {"a": (1, None, True, False), None: (2, 5, True, True), "b": (None, 6, True, True)}
    store.save_pre(1, rows.limit(0))
    assert {r.run_id for r in store.read().collect()} == {2}


def test_ordered_text_round_trip(spark, tmp_path):
    rows = [(i * 7 % 3000, f"line {i * 7 % 3000}") for i in range(3000)] + [(3000, None), (3001, ""), (3002, "é: x")]
    df = spark.createDataFrame(rows, "n int, t string").repartition(5)
    tables.write_ordered_text(df, ["n"], "t", str(tmp_path / "a"), tasks=6)
    assert len([f for f in os.listdir(tmp_path / "a") if f.startswith("part-")]) > 1
    want = [f"line {i}" for i in range(3000)] + ["", "", "é: x"]
    got = readers.read_ordered_text(spark, str(tmp_path / "a")).orderBy("line_number").collect()
    assert [(r.line_number, r.line) for r in got] == list(enumerate(want, 1))
    tables.write_ordered_text(df, ["-n"], "t", str(tmp_path / "b"))
    assert [r.line for r in readers.read_ordered_text(spark, str(tmp_path / "b")).orderBy("line_number").collect()] == want[::-1]
    tables.write_ordered_text(df.limit(0), ["n"], "t", str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == 0


def test_header_state_across_blocks_and_parts(spark, tmp_path):
    """Header lines hold over file blocks and over the files of one log, and never over logs."""
    pattern = r"^\*\*\* BY:\((\w*)\)"
    lines = {"x": [], "y": []}
    for log, rows in lines.items():
        for i in range(400):
            rows.append(f"*** BY:({'' if i == 350 else log + str(i)})" if i % 50 == 25 and i != 125 else f"{log} line {i} " + "z" * 30)
    for log, rows in lines.items():
        os.makedirs(tmp_path / "files", exist_ok=True)
        (tmp_path / "files" / f"{log}.trc").write_text("\n".join(rows) + "\n")
        os.makedirs(tmp_path / "parts" / f"log={log}")
        for n in range(4):
            (tmp_path / "parts" / f"log={log}" / f"part-{n:05d}.txt").write_text("\n".join(rows[n * 100 : n * 100 + 100]) + "\n")
    (tmp_path / "files" / "empty.trc").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        for folder, parts in (("files", False), ("parts", True)):
            got = readers.read_log_lines(spark, str(tmp_path / folder), {"by": pattern}, parts)
            assert got.rdd.getNumPartitions() > 0
            found = sorted((r.trace_filename.removesuffix(".trc"), r.line_number, r.payload, r.by) for r in got.collect())
            want = []
            for log, rows in lines.items():
                by = None
                for n, text in enumerate(rows, 1):
                    by = text[8:-1] if text.startswith("***") else by
                    want.append((log, n, text, by))
            assert found == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_read_traces(spark, tmp_path):
    from datetime import datetime

    from tidewatch.operators.deadlocks import read_traces

    text = ["before", "*** 2024-01-01T10:00:00.5+01:00 (DB(1))", "*** SESSION ID:(12.34) 2024-01-01", "*** CONTAINER ID:(3) x", "*** FUNCTION:(kjddpgt)", "a",
            "*** 2024-01-02 00:00:00", "b"]
    (tmp_path / "one.trc").write_text("\n".join(text))
    got = read_traces(spark, str(tmp_path)).orderBy("line_number").collect()
    assert [(r.payload, r.session_id, r.serial, r.con_uid, r.function_name) for r in got][-3:] == [(p, 12, 34, 3, "kjddpgt") for p in text[-3:]]
    assert got[0].line_time is None and got[1].line_time == datetime(2024, 1, 1, 10, 0, 0, 500000)
    late = read_traces(spark, str(tmp_path), since=datetime(2024, 1, 2)).collect()
    assert sorted(r.line_number for r in late) == [7, 8]


def test_a_killed_replacement_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    store = tables.MeasurementStore(spark, str(tmp_path / "store"), ["k"], ["m"])
    make = lambda *rows: spark.createDataFrame(rows, "k string, m bigint")
    with pytest.raises(ValueError):
        store.read()
    store.save_pre(1, make(("a", 1)))
    store.save_pre(2, make(("b", 2)))
    seen = lambda: {(r.run_id, r.k): (r.m_pre, r.m_post) for r in store.read().collect()}
    before = {(1, "a"): (1, None), (2, "b"): (2, None)}
    # killed after the new version was written, but before it was committed
    with monkeypatch.context() as patched:
        patched.setattr(tables.MeasurementStore, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        for save, rows in ((store.save_pre, make(("x", 9))), (store.save_post, make(("a", 9))), (store.save_pre, make(("x", 9)).limit(0))):
            with pytest.raises(KeyboardInterrupt):
                save(1, rows)
            assert seen() == before
    # killed while the new version was being written
    fails = make(("a", 3)).withColumn("m", F.expr("if(k = 'a', raise_error('lost'), m)").cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        store.save_pre(1, fails)
    assert seen() == before
    store.save_post(1, make(("a", 5), ("c", 6)))
    assert seen() == {(1, "a"): (1, 5), (1, "c"): (None, 6), (2, "b"): (2, None)}
    again = tables.MeasurementStore(spark, str(tmp_path / "store"), ["k"], ["m"])
    again.save_pre(1, make(("z", 0)).limit(0))
    assert seen() == {(2, "b"): (2, None)}


def test_different_numbers_are_counted_in_bounded_memory(spark):
    """Exact with repeats, across the maps' borders and without rows; no aggregate is keyed by the numbers themselves."""
    from tidewatch.operators.generate import sequence_rows
    from tidewatch.queries.tables import _summed

    rows = sequence_rows(spark, 70_000).unionByName(sequence_rows(spark, 40_000))
    got = _summed(rows)
    assert tuple(got.first()) == (110_000, sum(range(70_000)) + sum(range(40_000)), 69_999, 70_000)
    assert tuple(_summed(sequence_rows(spark, 0)).first()) == (0, None, None, 0)
    assert "count(distinct" not in got._jdf.queryExecution().analyzed().toString()
    assert sequence_rows(spark, 30_000_000).rdd.getNumPartitions() >= 30


def test_log_lines_are_read_once(spark, tmp_path):
    """Numbers and header state of many small blocks, from one reading of the text and no sort of its lines."""
    from tidewatch.sources.readers import read_log_lines

    lines = [f"*** BY {i}" if i % 50 == 0 else f"line {i} | *** BY" for i in range(1, 1200)]
    (tmp_path / "one.trc").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.trc").write_text("no header\n*** BY x\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = read_log_lines(spark, str(tmp_path), {"by": r"^\*\*\* BY (\w+)", "never": r"^nothing (\d)"})
        got = sorted((r.trace_filename, r.line_number, r.payload, r.by, r.never) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    want = [("one.trc", n, line, str(n // 50 * 50) if n >= 50 else None, None) for n, line in enumerate(lines, 1)]
    assert got == sorted([*want, ("two.trc", 1, "no header", None, None), ("two.trc", 2, "*** BY x", "x", None)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "rlike" not in plan.lower()
