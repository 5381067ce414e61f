"""Overlap, tuple exclusion and containment against all pairs."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import joins
from tidewatch.operators.cleanup import left_intact, purge_by_catalog, purge_report
from tidewatch.operators.statistics import report_lines


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_overlap_of_all_lengths(spark, keys):
    rng = random.Random(3)

    def spans(n, tag):
        out = []
        for i in range(n):
            low = rng.randint(-2000, 2000)
            out.append((rng.choice([1, 1, 1, 2, None]), low, low + rng.choice([0, 0, 1, 2, 3, 7, 8, 9, 100, 1500, 10**6]), f"{tag}{i}"))
        return out + [(1, None, 5, f"{tag}x"), (1, 5, None, f"{tag}y"), (1, 9, 3, f"{tag}z"), (1, 7, 7, f"{tag}p"), (1, 7, 7, f"{tag}p")]

    a, b = spans(120, "a"), spans(90, "b")
    left = spark.createDataFrame(a, "k int, low long, high long, a string")
    right = spark.createDataFrame(b, "k int, start int, end int, b string")
    if not keys:
        left, right = left.drop("k"), right.drop("k")
    got = joins.overlap_join(left, right, keys, ("low", "high"))
    assert got.columns == ([*keys, "low", "high", "a", "start", "end", "b"])
    fine = lambda x: x[1] is not None and x[2] is not None and x[1] <= x[2]
    want = [(x[3], y[3]) for x, y in itertools.product(a, b) if fine(x) and fine(y) and x[1] <= y[2] and y[1] <= x[2] and (not keys or (x[0] is not None and x[0] == y[0]))]
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want) and len(want) > 500
    assert not any(n in _plan(got) for n in ("CartesianProduct", "NestedLoop"))


def test_overlap_of_times_and_empty_sides(spark):
    day = datetime(2024, 3, 1)
    left = spark.createDataFrame([(1, day, day + timedelta(hours=5)), (2, day - timedelta(days=400), day + timedelta(days=400))], "a int, start timestamp_ntz, end timestamp_ntz")
    right = spark.createDataFrame([(i, day + timedelta(hours=i), day + timedelta(hours=i, minutes=59)) for i in range(-2, 8)], "b int, low timestamp_ntz, high timestamp_ntz")
    got = joins.overlap_join(left, right, (), ("start", "end"), ("low", "high")).collect()
    assert sorted((r.a, r.b) for r in got) == [(1, i) for i in range(6)] + [(2, i) for i in range(-2, 8)]
    assert joins.overlap_join(left.limit(0), right, (), ("start", "end"), ("low", "high")).collect() == []
    with pytest.raises(ValueError):
        joins.overlap_join(left, left)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_tuple_exclusion(spark, width):
    rng = random.Random(width)
    values = [None, 1, 2, 3, 4, 5, 6]
    names = [f"c{i}" for i in range(width)]
    for members in (0, 1, 6, 25):
        for nulls in (True, False):
            rows = [tuple(rng.choice(values) for _ in names) for _ in range(200)]
            listed = [tuple(rng.choice(values if nulls else values[1:]) for _ in names) for _ in range(members)]
            df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{n} int" for n in names))
            other = spark.createDataFrame(listed, ", ".join(f"m{n} int" for n in names))
            got = joins.not_in_tuple(df, names, other, [f"m{n}" for n in names])
            differs = lambda r, m: any(a is not None and b is not None and a != b for a, b in zip(r, m))
            want = [i for i, r in enumerate(rows) if all(differs(r, m) for m in listed)]
            assert sorted(r.id for r in got.collect()) == want and got.columns == df.columns
            assert "NestedLoop" not in _plan(got) and "CartesianProduct" not in _plan(got)


def test_purge_leaves_listed_tables_alone(spark):
    ids = spark.createDataFrame([(1, 1), (2, 2)], "dbid int, snap_id int")
    tables = {n: spark.createDataFrame([(1, 1), (3, 3)], "dbid int, snap_id int") for n in ("a", "b", "c")} | {"d": ids}
    catalog = spark.createDataFrame([("SYS", n, c) for n in tables for c in ("dbid", "snap_id")], "owner string, table_name string, column_name string")
    excluded = spark.createDataFrame([("SYS", "a"), ("APP", "b"), (None, "c")], "owner string, table_name string")
    remaining = purge_by_catalog(catalog, tables, ids, ids, excluded=excluded)
    assert sorted(remaining) == ["b", "d"]
    report = purge_report(tables, remaining)
    assert {r.table_name: r.rows_deleted for r in report.collect()} == {"b": 1, "d": 0} and left_intact(report).first()[0] == 1


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_contains(spark, most_bytes):
    rng = random.Random(8)
    words = [rng.choice("ab") + rng.choice(["", "é", "😀", "x", "xy"]) for _ in range(30)]
    texts = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 40])))) for i in range(80)] + [(90, None), (91, ""), (92, "a" * 5000), (None, "aé b"), (5, "again aé")]
    patterns = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 6])))) for i in range(60)]
    patterns += [(70, None), (71, ""), (72, "a"), (73, "a"), (74, "a" * 13), (75, "a" * 12), (76, "😀"), (77, "never there"), (None, "aé b")]
    df, ps = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(patterns, "pid int, text string")
    got = joins.contains_join(df, ps, "id", "text", "pid", "text", most_bytes)
    want = [(i, p) for (i, t), (p, w) in itertools.product(texts, patterns) if t and w and w in t]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 300
    assert joins.contains_join(df.limit(0), ps, "id", "text", "pid", "text", most_bytes).collect() == []
    assert joins.contains_join(df, ps.limit(0), "id", "text", "pid", "text", most_bytes).collect() == []


def test_report_lines(spark):
    rows = [("b.html", "x", 2, 5), ("a.html", "y", 1, 1), ("a.html", "x", 3, None), ("a.html", None, 1, 4)]
    report = spark.createDataFrame(rows, "file_name string, kind string, rows int, cents int")
    got = sorted(map(tuple, report_lines(report, ["kind"], ["cents"]).collect()))
    assert got == [
        ("a.html", 1, "report a.html"), ("a.html", 2, "x: rows 3, cents 0"), ("a.html", 3, "y: rows 1, cents 1"), ("a.html", 4, ": rows 1, cents 4"),
        ("a.html", 5, "all: rows 5, cents 5"), ("b.html", 1, "report b.html"), ("b.html", 2, "x: rows 2, cents 5"), ("b.html", 3, "all: rows 2, cents 5")]
    assert report_lines(report.limit(0), ["kind"], ["cents"]).collect() == []
    many = spark.range(20_000).select(F.lit("f").alias("file_name"), F.format_string("%05d", "id").alias("kind"), F.lit(1).alias("rows"), F.col("id").alias("cents"))
    lines = report_lines(many, ["kind"], ["cents"]).orderBy("line_number").collect()
    assert len(lines) == 20_002 and lines[7].line == "00006: rows 1, cents 6" and lines[-1].line == f"all: rows 20000, cents {sum(range(20_000))}"
