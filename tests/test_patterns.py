import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.patterns import SectionKind, greedy_pack, key_value, ordered_fields, pack_lists, section_heads, sections

HOW = pytest.mark.parametrize("how", [{}, dict(hot_rows=1, chunks=5)], ids=["plain", "split"])


@HOW
def test_sections_two_kinds(spark, how):
    """The pattern (H D .*? D F) | (S .*? E) as a reluctant regular expression per key."""
    rng = random.Random(11)
    data, want = [], []
    for key in [None, 1, 2, 3, 4, 5, 6]:
        line = "".join(rng.choice("HDFSExHDS") for _ in range(rng.choice([3, 20, 150])))
        if key == 6:
            line = "HDF" + "S" + "HDxDDF" + "ES" + "H" * 3 + "DDFx" + "HDSxE" + "S"
        data += [(key, i, c) for i, c in enumerate(line)]
        for n, m in enumerate(re.finditer(r"HD.*?DF|S.*?E", line)):
            want += [(key, i, n + 1, "graph" if m[0][0] == "H" else "dump") for i in range(*m.span())]
    df = spark.createDataFrame(data, "k int, i int, c string")
    c = F.col("c")
    kinds = [
        SectionKind("graph", (c == "H", c == "D"), (c == "D", c == "F")),
        SectionKind("dump", (c == "S",), (c == "E",)),
    ]
    got = sections(df, ["k"], ["i"], kinds, **how)
    assert sorted([(r.k, r.i, r.section, r.kind) for r in got.collect()], key=str) == sorted(want, key=str)
    given = sections(df, ["k"], ["i"], kinds, facts={"opener": c, "nothing": F.lit(None).cast("int")}, **how).collect()
    assert len(given) == len(want) and all(r.opener == ("H" if r.kind == "graph" else "S") and r.nothing is None for r in given)
    heads = section_heads(got, ["k"], ["i"], opener=F.col("c")).collect()
    assert len(heads) == len(want) and all(r.opener == ("H" if r.kind == "graph" else "S") for r in heads)


@HOW
@pytest.mark.parametrize("reset", [False, True])
def test_ordered_fields(spark, how, reset):
    rng = random.Random(5)
    data, want = [], set()
    for key in range(6):
        line = [rng.choice("abcx") for _ in range(rng.choice([2, 30, 200]))]
        data += [(key, i, c) for i, c in enumerate(line)]
        state, at, match, n = 0, [], 0, 0
        for i, c in enumerate(line):
            if reset and c == "a":
                state, at = 0, []
            if c == "abc"[state]:
                match += state == 0
                at.append(i)
                state += 1
            if state == 3:
                want.add((key, match, *at))
                state, at = 0, []
    df = spark.createDataFrame(data, "k int, i int, c string")
    symbols = {s: F.col("c") == s for s in "abc"}
    fields = {f"{s}_at": (s, F.col("i")) for s in "abc"}
    got = ordered_fields(df, ["k"], ["i"], symbols, fields, reset_on_start=reset, **how).collect()
    assert {(r.k, r.match, r.a_at, r.b_at, r.c_at) for r in got} == want


@HOW
@pytest.mark.parametrize("alone", [True, False])
def test_greedy_pack(spark, how, alone):
    rng = random.Random(9)
    data, want = [], {}
    for key in range(4):
        sizes = [rng.choice([1, 5, 12, 30, 47, 48, 49, 60]) for _ in range(rng.choice([1, 40, 120]))]
        data += [(key, i, "n" * s) for i, s in enumerate(sizes)]
        group, members = 0, None
        for i, s in enumerate(sizes):
            trial = None if members is None else members + [s]
            fits = trial is not None and sum(trial) + 2 * len(trial) + 2 * (len(trial) - 1) <= 50
            if fits:
                members = trial
            else:
                group += 1
                members = [s] if s + 2 <= 50 and not (alone and i == 0) else None
            want[key, i] = group
    df = spark.createDataFrame(data, "k int, i int, name string")
    got = greedy_pack(df, ["k"], ["i"], "name", limit=50, first_alone=alone, **how).collect()
    assert {(r.k, r.i): r.pack for r in got} == want


def test_greedy_pack_reference_limit(spark):
    """Quoted lists of exactly 3800 fit, 3801 do not."""
    rows = [(1, 1, "x" * 5), (1, 2, "a" * 1896), (1, 3, "b" * 1898), (2, 1, "x"), (2, 2, "a" * 1897), (2, 3, "b" * 1898)]
    df = spark.createDataFrame(rows, "k int, i int, name string")
    got = {(r.k, r.i): r.pack for r in greedy_pack(df, ["k"], ["i"], "name").collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 3): 2, (2, 1): 1, (2, 2): 2, (2, 3): 3}


def test_key_value(spark):
    df = spark.createDataFrame([("  Session Number :  12 ",), ("no pair",), ("a: b: c",), (None,)], "p string")
    assert [(r["var"], r["value"]) for r in key_value(df, "p").collect()] == [
        ("Session Number", "12"), (None, None), ("a", "b: c"), (None, None)]


def test_deadlock_trace(spark):
    from tidewatch.operators.deadlocks import deadlock_sections, deadlock_sessions, lock_transaction

    def block(session, level=True):
        return ["USER session identified by: x", "{", "OS Program Name: p", "Application Name: Desktop Client 9", "Action Name: Complete Case Activity now",
                "Current SQL: q", f"Session Number: {session}", "Session Serial Number: 7", "Instance: 2", "}", "waiting for 1 lock (transaction)", "{",
                *(["Lock Level: KJUSEREX"] if level else []), "Resource Name: TX 0xab.0x1[ext]", f"GES Transaction ID: G{session}", "}"]

    body = [*block(1), *block(2, level=False), *block(3)]
    lines = ["Global Wait-For-Graph for GES Deadlock ID=[4_5_6]", "---", *body, "----", "end of global WFG for GES deadlock"]
    rows = [("f", 1, 2, 3, i, "kjddpgt", p) for i, p in enumerate(["before", *lines, "after"])]
    schema = "trace_filename string, session_id int, serial int, con_uid int, line_number bigint, function_name string, payload string"
    for how in ({}, dict(hot_rows=1, chunks=6)):
        mined = deadlock_sections(spark.createDataFrame(rows, schema), **how)
        assert mined.count() == len(lines) and {r.deadlock_id for r in mined.collect()} == {"4_5_6"}
        names = dict(short_app=r"^(Desktop\s+Client).*$", short_action=r"^(Complete\s+Case\s+Activity).*$")
        got = sorted(deadlock_sessions(mined, **names, **how).collect(), key=lambda r: r.match)
        # The second block lacks its lock level, so its match runs on into the third block.
        assert [(r.session_id, r.ges_xid, r.blocking_xid, r.app_name, r.action, r.inst_id) for r in got] == [
            (1, "G1", "000000ab00000001", "Desktop Client", "Complete Case Activity", 2),
            (2, "G3", "000000ab00000001", "Desktop Client", "Complete Case Activity", 2)]
        fresh = deadlock_sessions(mined, reset_on_start=True, **names, **how).collect()
        assert sorted((r.session_id, r.ges_xid) for r in fresh) == [(1, "G1"), (3, "G3")]
    df = spark.createDataFrame([("TX 0x123456789a.0x[x]",), ("TM 0x1.0x2",)], "r string")
    assert [r.x for r in df.select(lock_transaction(F.col("r")).alias("x")).collect()] == ["3456789a00000000", "TM 0x1.0x2"]


def test_pack_lists(spark):
    rows = [(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 1, None), (2, 2, "x" * 60), (None, 1, "n")]
    packed = greedy_pack(spark.createDataFrame(rows, "k int, i int, name string"), ["k"], ["i"], "name", limit=10)
    got = {(r.k, r.pack): (r.part_list, r.parts) for r in pack_lists(packed, ["k"], ["i"], "name").collect()}
    assert got == {(1, 1): ('"a"', 1), (1, 2): ('"b", "c"', 2), (2, 1): (None, 1), (2, 2): (f'"{"x" * 60}"', 1), (None, 1): ('"n"', 1)}


@pytest.mark.parametrize("split", [False, True])
def test_only_marks_go_through_python(spark, split):
    """No text column of the rows is in an Arrow schema."""
    df = spark.createDataFrame([(1, i, c, "payload") for i, c in enumerate("aHDxDFb" * 5)], "k int, i int, c string, payload string")
    how = dict(hot_rows=1, chunks=4) if split else {}
    c = F.col("c")
    plans = [
        sections(df, ["k"], ["i"], [SectionKind("g", (c == "H", c == "D"), (c == "D", c == "F"))], **how),
        ordered_fields(df, ["k"], ["i"], {"H": c == "H", "F": c == "F"}, {"p": ("H", F.col("payload"))}, **how),
        greedy_pack(df, ["k"], ["i"], "payload", limit=30, **how)]
    for frame in plans:
        plan = frame._jdf.queryExecution().analyzed().toString()
        arrow = [line for line in plan.split("\n") if "MapInArrow" in line or "FlatMapGroupsInArrow" in line]
        assert arrow and not any("payload" in line or " c#" in line for line in arrow)


def test_sections_of_a_cut_key_read_rows_once(spark, tmp_path):
    """Once the marked rows are written, the rows are read a single time more, whatever the number of passes over marks."""
    path = str(tmp_path / "lines")
    spark.createDataFrame([(1, i, c) for i, c in enumerate("aHDxDFb" * 5)], "k int, i int, c string").write.parquet(path)
    c = F.col("c")
    found = sections(spark.read.parquet(path), ["k"], ["i"], [SectionKind("g", (c == "H", c == "D"), (c == "D", c == "F"))],
                     hot_rows=1, chunks=4, facts={"at": F.col("i")})
    scans = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Relation" in line and "c#" in line.replace("_chunk#", "")]
    assert len(scans) == 1
    assert sorted((r.i, r.section, r["at"]) for r in found.collect()) == [(7 * n + i, n + 1, 7 * n + 1) for n in range(5) for i in range(1, 6)]


@pytest.mark.parametrize("chunks", [1, 2, 7, 30])
def test_sections_across_ranges(spark, chunks):
    """Sections that open, close or go on where a key is cut, openings and closings of two rows cut in the middle,
    kinds that never close, and keys of one row: the same as by a regular expression, however rows are cut."""
    rng = random.Random(chunks)
    lines = ["H", "HD", "DF", "HDDF", "HDHDS", "S" * 9, "HD" + "x" * 40 + "DF", "HDSSxE", "SHDDF", "ESHDE" * 6, "HDD" * 5 + "F"]
    lines += ["".join(rng.choice("HDFSEx") for _ in range(rng.choice([1, 2, 3, 60]))) for _ in range(20)]
    want = [(key, i, n + 1, m[0][0], m.start()) for key, line in enumerate(lines)
            for n, m in enumerate(re.finditer(r"HD.*?DF|S.*?E", line)) for i in range(*m.span())]
    df = spark.createDataFrame([(key, i, c, "text") for key, line in enumerate(lines) for i, c in enumerate(line)], "k int, i int, c string, payload string")
    c = F.col("c")
    kinds = [SectionKind("H", (c == "H", c == "D"), (c == "D", c == "F")), SectionKind("S", (c == "S",), (c == "E",))]
    found = sections(df, ["k"], ["i"], kinds, hot_rows=1, chunks=chunks, facts={"at": F.col("i")})
    assert sorted((r.k, r.i, r.section, r.kind, r["at"]) for r in found.collect()) == sorted(want)
    # All columns are sorted and shuffled for one pass only; what is left to do on them is a join with a row for each range.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Window", "Sort [k", "Union"))


def test_sections_facts_keep_their_types(spark):
    rows = [(1, i, c) for i, c in enumerate("aHxFHF")]
    df = spark.createDataFrame(rows, "k int, i int, c string").withColumns({
        "t": F.timestamp_micros(F.col("i") + 1), "n": F.col("i").cast("decimal(9,2)"), "a": F.array("c", F.lit(None))})
    kind = SectionKind("g", (F.col("c") == "H",), (F.col("c") == "F",))
    facts = {"time": F.col("t"), "local": F.col("t").cast("timestamp_ntz"), "day": F.col("t").cast("date"), "n2": F.col("n"), "list": F.col("a")}
    found = sections(df, ["k"], ["i"], [kind], hot_rows=1, chunks=3, facts=facts)
    first = {r.i: r for r in df.collect()}
    got = found.collect()
    assert [(r.i, r.section) for r in sorted(got)] == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)]
    for r in got:
        head = first[1 if r.section == 1 else 4]
        assert (r.time, r.day, r.n2, r.list) == (head.t, head.t.date(), head.n, head.a) and r.local is not None


def test_fields_are_sorted_once(spark):
    """Rows meet their labels where they are sorted: after that, only matches are shuffled."""
    df = spark.createDataFrame([(k, i, c) for k in range(3) for i, c in enumerate("abxc" * 4)], "k int, i int, c string")
    found = ordered_fields(df, ["k"], ["i"], {s: F.col("c") == s for s in "abc"}, {"at": ("b", F.col("i"))}, hot_rows=1, chunks=5)
    assert sorted((r.k, r.match, r["at"]) for r in found.collect()) == [(k, n + 1, 4 * n + 1) for k in range(3) for n in range(4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Window", "Union"))
