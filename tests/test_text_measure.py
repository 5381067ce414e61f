import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import generate, measure, text
from tidewatch.operators.statistics import daily_rollup, interval_report, snapshot_span, snapshots_in_range, stats_detail
from datetime import datetime

SPLIT = dict(hot_rows=1, chunks=4)


def test_text_forms(spark):
    cases = {
        'FULL(@"SEL$1" "T"@"SEL$1")': "FULL(@{qblk} {obj})",
        'LEADING(@"SEL$1F" "A"@"SEL$1F" "B"@"SEL$2" "C"."D")': "LEADING(@{qblk} {list_of_objects})",
        'INDEX(@"UPD$1" "T"@"UPD$1" ("T"."X" "T"."Y"))': "INDEX(@{qblk} {obj} ({list_of_objects}))",
        "OPT_PARAM('_b_tree' 'true')": "OPT_PARAM({string} {string})",
        "CARD((1 2) (3 44)) 5 6": "CARD({list_of_number_pairs}) {list_of_numbers}",
        "PQ((7 8)) 9": "PQ({number_pair}) {number}",
        'USE(@"APEX$INNER" "V"@"GV_X")': "USE(@{qblk} {obj})",
        "lower": "lower", "": "",
    }
    df = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "id int, hint string")
    got = {r.text_sample: (r.form, r.keyword) for r in text.text_forms(df, "hint", "id").collect()}
    assert {h: form for h, (form, _) in got.items()} == cases
    assert got["OPT_PARAM('_b_tree' 'true')"][1] == "OPT_PARAM" and got["lower"][1] is None
    many = spark.range(5000).select("id", F.concat(F.lit("F "), F.col("id").cast("string")).alias("hint"))
    row = text.text_forms(many, "hint", "id", exact=True).first()
    assert row.form == "F {number}" and row.ids == 5000 and abs(row.ids_estimate - 5000) < 250
    odd = spark.createDataFrame([(None, "A 1"), (1, "A 2"), (1, "A 1"), (2, None), (None, None), (None, "B")], "id int, hint string")
    got = {r.form: (r.text_sample, r.id_sample, r.ids, r.ids_estimate) for r in text.text_forms(odd, "hint", "id", exact=True).collect()}
    assert got == {"A {number}": ("A 1", 1, 1, 1), None: (None, 2, 1, 1), "B": ("B", None, 0, 0)}


def test_xml(spark):
    rows = [(1, "<o><d><h>a</h><h><![CDATA[b<c]]></h></d></o>"), (2, "<o><d/></o>"), (3, None), (4, "<o><d><h>z</h></d></o>"), (5, "<o><d><h>cut"), (6, "")]
    df = spark.createDataFrame(rows, "id int, x string")
    assert sorted((tuple(r) for r in text.xml_explode(df, "x", "/o/d/h/text()", "h").collect()), key=str) == [
        (1, False, "a"), (1, False, "b<c"), (4, False, "z"), (5, True, None), (6, True, None)]
    docs = spark.createDataFrame([(1, "<R><ROW><A>x</A><B>5</B></ROW><ROW><A>y</A><B>50</B></ROW></R>"), (2, "<R><ROW><A>z</A></ROW></R>"), (3, None), (4, "<R><ROW>")], "id int, x string")
    schema = T.StructType([T.StructField("A", T.StringType()), T.StructField("B", T.LongType())])
    assert sorted((tuple(r) for r in text.xml_rows(docs, "x", "ROW", schema).collect()), key=str) == [
        (1, False, "x", 5), (1, False, "y", 50), (2, False, "z", None), (4, True, None, None)]
    wrong = spark.createDataFrame([(1, "<R><ROW><A>x</A><B>none</B></ROW><ROW><A> y </A><B> 7 </B></ROW></R>")], "id int, x string")
    assert sorted(tuple(r) for r in text.xml_rows(wrong, "x", "ROW", schema).collect()) == [(1, False, "x", None), (1, False, "y", 7)]
    assert [tuple(r) for r in text.xml_rows(docs, "x", "ROW", schema, below=("B", 50)).collect()] == [(1, False, "x", 5), (4, True, None, None)]


@pytest.mark.parametrize("how", [{}, SPLIT], ids=["plain", "split"])
def test_string_agg(spark, how):
    rows = [("a", 1, "x"), ("a", 2, None), ("a", 3, "y"), ("b", 1, None), ("c", 1, None), ("c", 2, None)] + [("h", i, str(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int, t string")

    def agg(*args):
        return {r.k: r.s for r in text.string_agg_affix(df, ["k"], ["i"], "t", "s", *args, **how).collect()}

    plain = agg(",")
    assert (plain["a"], plain["b"], plain["c"], plain["h"]) == ("x,,y", None, ",", ",".join(map(str, range(50))))
    assert agg(None)["a"] == "xy" and agg(None)["c"] is None
    assert agg("-", "<", ">")["b"] == "<>" and agg("-", None, ">")["a"] == "x--y>"


def test_join_list(spark):
    df = spark.createDataFrame([(["a", None, "b"],), ([],), (None,)], "v array<string>")
    pick = lambda *a: [r.s for r in df.select(text.join_list(F.col("v"), *a).alias("s")).collect()]
    assert pick(", ") == ["a, , b", "", None]
    assert pick(None, "(", ")") == ["(ab)", "()", "()"]


def test_matching(spark):
    base = spark.createDataFrame([(1, "select 1", "fix abc", "MANUAL-LOAD"), (2, "select 2", None, "AUTO"), (3, "select 3", "INC-7 fix", "MANUAL"), (4, None, "none", "MANUAL")],
                                 "plan int, sql_text string, description string, origin string")
    texts = spark.createDataFrame([("q2", "select 2"), ("q2", "select 2"), ("q3", "select 3")], "sql_id string, sql_text string")
    one = text.lookup_text(texts, "sql_id", "q2")
    assert sorted((r.plan, r.matched_text) for r in text.match_text_or_tag(base, one, ["INC-7", "abc"]).collect()) == [(1, False), (2, True), (3, False)]
    assert [r.plan for r in text.manual_baselines(base, texts).collect()] == [3]
    with pytest.raises(LookupError):
        text.lookup_text(texts, "sql_id", "q9")
    with pytest.raises(ValueError):
        text.lookup_text(texts, "sql_id", "Q2'")


def test_unpivot_round_trip(spark):
    wide = spark.createDataFrame([(1, 5, None), (2, 7, 8)], "k int, CPU_TIME bigint, SORTS bigint")
    tall = measure.unpivot_counters(wide, ["k"], ["CPU_TIME", "SORTS"])
    assert sorted((tuple(r) for r in tall.collect()), key=str) == [(1, "cpu_time", 5), (1, "sorts", None), (2, "cpu_time", 7), (2, "sorts", 8)]
    back = tall.groupBy("k").pivot("stat_name", ["cpu_time", "sorts"]).agg(F.max("stat_value"))
    assert sorted(tuple(r) for r in back.collect()) == [(1, 5, None), (2, 7, 8)]
    assert len(measure.COUNTERS) == len(set(measure.COUNTERS)) == 47


def test_merge_post(spark):
    saved = spark.createDataFrame([("a", 10, None, 1), ("b", 5, 6, 1), ("c", None, None, 1)], "k string, v_pre int, v_post int, inst int")
    post = spark.createDataFrame([("a", 15, 2), ("d", 7, 2), ("c", None, 2)], "k string, v int, inst int")
    got = {r.k: (r.v_pre, r.v_post, r.v_diff, r.inst) for r in measure.merge_post(saved, post, ["k"], ["v"]).collect()}
    assert got == {"a": (10, 15, 5, 1), "b": (5, 6, 1, 1), "c": (None, None, None, 1), "d": (None, 7, 7, 2)}


def test_diff_nonzero(spark):
    schema = "k string, total_waits int, total_timeouts int, time_waited_micro int"
    pre = spark.createDataFrame([("pre", 1, 1, 1), ("same", 2, None, 2), ("both", 2, 2, None), ("nulls", None, None, None)], schema)
    post = spark.createDataFrame([("post", 3, None, 0), ("same", 2, 0, 2), ("both", 5, 2, 4), ("zero", 0, 0, 0), ("nulls", None, 1, None)], schema)
    cols = measure.EVENT_DECIDERS
    got = {tuple(r) for r in measure.diff_nonzero(pre, post, ["k"], cols).collect()}
    assert got == {("post", 3, None, 0), ("both", 3, 0, 4), ("nulls", 0, 1, 0)}
    strict = {tuple(r) for r in measure.diff_nonzero(pre, post, ["k"], cols, null_as_zero=False).collect()}
    assert strict == {("post", 3, None, 0), ("both", 3, 0, None)}


@pytest.mark.parametrize("how", [{}, SPLIT], ids=["plain", "split"])
def test_run_statistics(spark, how):
    rows = [(10 + i, 1, "cpu time", v) for i, v in enumerate([1_000_000, 3_000_000, 2_000_000, 10_000_000])]
    rows += [(20 + i, 1, "cpu time", v) for i, v in enumerate([5, 5, 5])] + [(30 + i, 1, "heap size", v) for i, v in enumerate([-2097152, 2097152, -2097152, 2097152, 0])]
    rows += [(40 + i, 1, "flat", 7) for i in range(5)] + [(50, 1, "single", 7)]
    df = spark.createDataFrame(rows, "run_id int, stat_class_id int, stat_name string, stat_value_diff bigint")
    stats = measure.run_class_stats(df, **how)
    got = {(r.run_class, r.stat_name): (r.median, r.stddev_pct, r.runs) for r in stats.collect()}
    assert got == {(1, "cpu time"): (2_500_000.0, 163.0, 4), (3, "heap size"): (0.0, None, 4), (4, "flat"): (7.0, 0.0, 5)}
    labelled = measure.label_units(stats.select("run_class", "stat_class_id", "stat_name", "median"), "median")
    pivot = {r.stat_name: (r.run_1, r.run_3, r.run_4, r.run_5) for r in measure.pivot_runs(labelled, "run_class", measure.RUN_CLASSES, "median").collect()}
    assert pivot == {"cpu time [s]": (2.5, None, None, None), "heap size [MB]": (None, 0.0, None, None), "flat": (None, None, 7.0, None)}


def test_labels(spark):
    names = ["parse time", "a bytes", "read bytes from cache", "x size", "timer", "cpu_time", "cputime", "sharable_mem", "io_bytes"]
    df = spark.createDataFrame([(n, 1048576.0) for n in names], "stat_name string, v double")
    spaced = [(r.stat_name, r.v) for r in measure.label_units(df, "v").collect()]
    assert spaced[:5] == [("parse time [s]", 1.049), ("a bytes [MB]", 1.0), ("read bytes from cache [MB]", 1.0), ("x size [MB]", 1.0), ("timer", 1048576.0)]
    under = dict((r.stat_name, r.v) for r in measure.label_units(df, "v", measure.UNDERSCORED_UNITS, None).collect())
    assert under["cpu_time [s]"] == 1.048576 and under["cputime"] == 1048576.0 and under["sharable_mem [MB]"] == under["io_bytes [MB]"] == 1.0


def test_generators(spark):
    total = lambda df: df.agg(F.count("x"), F.sum("x")).first()
    # The counts and sums of the three ways of the original workload.
    assert tuple(total(generate.sequence_rows(spark, 2_002_225))) == (2_002_225, 2_004_451_474_200)
    assert tuple(total(generate.sequence_grid(spark, 2_000_000))) == (1_999_396, 2_000_203_755_984)
    rows = generate.random_rows(spark.range(1, 2001)).collect()
    assert {tuple(len(v) for v in r[1:]) for r in rows} == {(1, 2, 8, 32)} and len({r.col_32 for r in rows}) == 2000
    assert rows == generate.random_rows(spark.range(1, 2001)).collect()
    log = {r.doc_id: r for r in generate.log_rows(spark.range(1, 301), "id").collect()}
    assert (log[17].object_type, log[17].mess_dict_id, log[18].object_type, log[3].message_type, log[4].message_type, log[5].message_type) == ("DOC", 17, None, "I", "W", "E")
    assert log[5].message_date == datetime(2022, 1, 1, 0, 1) and (log[5].id, log[5].message_name) == (-5, "archive_5")


@pytest.mark.parametrize("how", [{}, SPLIT], ids=["plain", "split"])
def test_assign_ids(spark, how):
    df = spark.createDataFrame([(i, None if i % 2 else i) for i in range(40)], "o int, id bigint")
    got = {r.o: r.id for r in generate.assign_ids(df, "id", ["o"], **how).collect()}
    assert got == {i: i if i % 2 == 0 else 1 + 10 * (i // 2) for i in range(40)}


def test_intervals_and_reports(spark):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    snaps = spark.createDataFrame([(1, 1, n, t(n - 1), t(n)) for n in range(1, 7)] + [(2, 1, 3, t(2), t(3))],
                                  "dbid int, instance_number int, snap_id int, begin_interval_time timestamp_ntz, end_interval_time timestamp_ntz")
    db = spark.createDataFrame([(1,)], "dbid int")
    hit = snapshots_in_range(snaps, db, t(2), t(3, 30))
    assert sorted((r.snap_id, r.file_name) for r in hit.collect()) == [(n, f"instance_1.20240101_0{n}0000.html") for n in (2, 3, 4)]
    span = snapshot_span(snaps, db, t(2), t(3, 30)).first()
    assert (span.report_from, span.snap_id_to, span.file_name) == (1, 4, "instance_1.from_20240101_010000.to_20240101_040000.html")
    stats = spark.createDataFrame([(1, 1, n, "q", 10 * n) for n in range(1, 7)] + [(1, 1, 3, "q", 1)], "dbid int, instance_number int, snap_id int, sql_id string, v int")
    single = interval_report(hit, stats, ["sql_id"], ["v"]).collect()
    assert sorted((r["rows"], r.v) for r in single) == [(1, 20), (1, 40), (2, 31)]
    whole = interval_report(snapshot_span(snaps, db, t(2), t(3, 30)), stats, ["sql_id"], ["v"]).first()
    assert (whole["rows"], whole.v) == (4, 91)


def test_rollup_and_detail(spark):
    from tidewatch.operators import statistics as st
    names = {n for part in (st.DAILY_COUNTS, st.DAILY_MB, st.DAILY_SECONDS, st.DETAIL_COUNTS, st.DETAIL_MS, st.DETAIL_MB) for _, n in part}
    rows = spark.createDataFrame([(1, 1, "q", "m1", "S", 5), (2, 1, "q", "m1", "R", 5), (3, 1, "q", None, "S", None), (3, 1, "z", "m9", "S", 5)],
                                 "snap_id int, instance_number int, sql_id string, module string, parsing_schema_name string, v bigint")
    rows = rows.withColumns({**{f"{n}_delta": F.col("v") * 1_048_576 for n in names}, **{f"{n}_total": F.col("v") * 2_097_152 for n in names},
                             "action": F.lit(None).cast("string"), "plan_hash_value": F.lit(1), "parsing_user_id": F.lit(4),
                             "parsing_schema_id": F.lit(6), "force_matching_signature": F.lit(99), "sql_profile": F.lit(None).cast("string")})
    snaps = spark.createDataFrame([(1, 1, datetime(2024, 1, 1, 5)), (2, 1, datetime(2024, 1, 1, 9)), (3, 1, datetime(2024, 1, 2, 1))],
                                  "snap_id int, instance_number int, begin_interval_time timestamp_ntz")
    days = {r.occurrence: r for r in daily_rollup(rows, snaps, "q").collect()}
    assert set(days) == {"2024-01-01 monday", "2024-01-02 tuesday"}
    monday = days["2024-01-01 monday"]
    assert (monday.execs, monday.pio_reads_mb, monday.ela_time_s, monday.users, monday.modules) == (10 * 1_048_576, 10.0, 10.486, "R|S", "m1")
    assert days["2024-01-02 tuesday"].execs is None and days["2024-01-02 tuesday"].modules is None
    users = spark.createDataFrame([(4, "U4")], "user_id int, username string")
    detail = {r.snap_id: r for r in stats_detail(rows.where("sql_id = 'q'"), snaps, users).collect()}
    assert [(detail[i]["rank"], detail[i].p_user) for i in (1, 2, 3)] == [(2, "U4"), (1, "U4"), (1, "U4")]
    assert (detail[2].sql_f_m_sig, detail[2].sql_profile, detail[2].p_schema_id, detail[2].p_schema) == (99, None, 6, "R")
    assert (detail[1].execs_d, detail[1].t_ela_ms, detail[1].io_ph_read_d_mb) == (5 * 1_048_576, 5 * 2097.152, 5.0)
    assert sorted(r.snap_id for r in stats_detail(rows.where("sql_id = 'q'"), snaps, users, latest_only=True).collect()) == [2, 3]


def test_latest_detail_is_narrowed_before_joins(spark):
    """One row per snapshot and group goes into the joins, and it is the newest."""
    stats = spark.range(2000).select(
        (F.col("id") % 2).alias("snap_id"), F.lit(1).alias("instance_number"), F.lit("m").alias("module"), F.lit("a").alias("action"),
        F.lit("q").alias("sql_id"), F.lit(1).alias("plan_hash_value"), F.lit(0).alias("force_matching_signature"), F.lit("p").alias("sql_profile"),
        F.lit(1).alias("parsing_schema_id"), F.lit("s").alias("parsing_schema_name"), (F.col("id") % 7).alias("parsing_user_id"),
        F.col("id").alias("event_id"), F.col("id").alias("executions_delta"))
    snaps = spark.sql("SELECT id AS snap_id, 1 AS instance_number, timestamp_ntz'2024-01-01' + make_dt_interval(0, CAST(id AS int)) AS begin_interval_time FROM range(2)")
    users = spark.range(7).select(F.col("id").alias("user_id"), F.lit("u").alias("username"))
    got = stats_detail(stats, snaps, users, latest_only=True, tie=["event_id"])
    assert [(r.snap_id, r.execs_d) for r in got.collect()] == [(1, 1999)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max_by") >= 2 and plan.rindex("max_by") > plan.rindex("Join")
