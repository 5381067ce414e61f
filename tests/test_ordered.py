import random

import pytest

from tidewatch.operators.ordered import latest_per_key, number_rows
from tidewatch.operators.runs import run_segments
from pyspark.sql import functions as F

SPLIT = dict(hot_rows=1, chunks=5)
PLAIN = {}


def expected_runs(rows, max_gap, on_break):
    """Row-by-row matcher over one key's (sample, state, value) rows."""
    out, run, number, broken, previous = [], None, 0, False, None
    for sample, state, value in sorted(rows, key=lambda r: r[0]):
        starts = previous is None or state != previous[1]
        if not starts and state is None and not 0 < sample - previous[0] <= max_gap:
            if on_break == "split":
                starts = True
            else:
                broken = True
        if starts:
            number, broken, run = number + 1, False, []
            out.append((number, run))
        if not broken:
            run.append((sample, value))
        previous = (sample, state)
    return {
        sample: (n, i + 1, len(run), run[0][0], run[-1][0], sum(v for _, v in run))
        for n, run in out
        for i, (sample, _) in enumerate(run)
    }


@pytest.mark.parametrize("how", [PLAIN, SPLIT], ids=["plain", "split"])
@pytest.mark.parametrize("on_break", ["drop", "split"])
def test_run_segments_against_matcher(spark, how, on_break):
    rng = random.Random(7)
    data, want = [], {}
    for key in [None, 1, 2, 3, 4, 5]:
        sample, rows = 0, []
        for _ in range(rng.choice([1, 8, 60]) if key != 1 else 200):
            sample += rng.choice([1, 1, 2, 9, 10, 11, 12])
            rows.append((sample, rng.choice([None, None, None, "a", "b"]), rng.randint(0, 9)))
        if key == 2:  # one unbroken run through all chunks, then a long broken null stretch
            rows = [(i, "a" if i < 60 else None, 1) for i in [*range(100), *range(200, 260)]]
        data += [(key, *r) for r in rows]
        for sample, values in expected_runs(rows, 10, on_break).items():
            want[(key, sample)] = values
    df = spark.createDataFrame(data, "k int, sample bigint, state string, v bigint")
    df = df.withColumn("t", (F.col("sample") * 10))
    got = run_segments(df, ["k"], ["sample"], "state", "t", ["v"], on_break=on_break, **how).collect()
    found = {
        (r.k, r.sample): (r.run_id, r.run_row, r.run_samples, r.run_start_sample, r.run_end_sample, r.run_v)
        for r in got
    }
    assert found == want
    assert all(r.run_start_time == r.run_start_sample * 10 for r in got)


@pytest.mark.parametrize("how", [PLAIN, SPLIT], ids=["plain", "split"])
@pytest.mark.parametrize("keys", [["k"], []], ids=["keyed", "global"])
@pytest.mark.parametrize("order", [["v", "id"], ["-v", "id"], ["name"], ["-at", "id"]])
def test_number_rows(spark, how, keys, order):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.randint(0, 30), i, f"name{rng.randint(0, 10**6):07d}-{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "k int, v int, id int, name string")
    df = df.withColumn("at", F.expr("timestampadd(MINUTE, v * 977, timestamp_ntz'2024-01-01 00:00:00')"))
    got = number_rows(df, keys, order, "rn", total="n", **how).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        groups.setdefault(r.k if keys else 0, []).append(r)
    for members in groups.values():
        column, sign = order[0].lstrip("-"), -1 if order[0][0] == "-" else 1
        members.sort(key=lambda r: r.rn)
        assert [r.rn for r in members] == list(range(1, len(members) + 1))
        assert {r.n for r in members} == {len(members)}
        base = members[0]["at"]
        ranks = [
            (r[column] if column == "name" else sign * ((r["at"] - base).total_seconds() if column == "at" else r[column]), r.id)
            for r in members
        ]
        assert ranks == sorted(ranks)


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (None, 1, "z"), (None, 3, None)], "k int, t int, s string")
    got = latest_per_key(df, ["k"], [F.col("t")]).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(1, 7, "y"), (None, 3, None)], key=str)


ZONES = ["UTC", "America/New_York"]


@pytest.fixture(params=ZONES)
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def odd_rows(spark):
    """Ties, nulls in every order column, a common start of names, clocks that go back."""
    rng = random.Random(11)
    rows = []
    for i in range(600):
        key = rng.choice([1, 1, 1, 2, None])
        second = 1_730_610_000 + rng.randrange(20) * 900  # around a change of clocks
        name = rng.choice([None, "common start of names " + str(rng.randrange(40)), "zz"])
        rows.append((i, key, rng.choice([None, second, second, second]), name, rng.choice([None, 0.5, float("nan"), -2.0]), rng.choice(["a", "b", None])))
    df = spark.createDataFrame(rows, "id int, k int, s bigint, name string, x double, state string")
    return df.withColumn("t", F.timestamp_seconds("s")).withColumn("n", F.to_timestamp_ntz(F.date_format("t", "yyyy-MM-dd HH:mm:ss")))


@pytest.mark.parametrize("order", [["t", "id"], ["-t", "id"], ["name", "x", "id"], ["-name", "-x", "-id"], ["n", "-id"], ["x", "t", "name", "id"]])
def test_split_and_plain_numbers_agree(spark, zone, order):
    df = odd_rows(spark)
    plain = {r.id: (r.no, r.n_all) for r in number_rows(df, ["k"], order, "no", "n_all").collect()}
    split = {r.id: (r.no, r.n_all) for r in number_rows(df, ["k"], order, "no", "n_all", hot_rows=1, chunks=9).collect()}
    assert split == plain and len(split) == 600
    whole = {r.id: r.no for r in number_rows(df, [], order, "no", hot_rows=1, chunks=9).collect()}
    assert whole == {r.id: r.no for r in number_rows(df, [], order, "no").collect()}


@pytest.mark.parametrize("order", [["s", "name", "id"], ["-s", "id"]])
def test_split_and_plain_runs_agree(spark, order):
    df = odd_rows(spark).withColumn("v", F.lit(1))
    plain, split = (
        sorted(map(tuple, run_segments(df, ["k"], order, "state", "t", ["v"], max_gap=1000, on_break="split", **how).drop("x").collect()), key=str)
        for how in (PLAIN, dict(hot_rows=1, chunks=9)))
    assert plain == split


def test_chunks_are_balanced(spark):
    from tidewatch.operators.ordered import CHUNK, split_hot_groups

    rows = [(1, 0, "the same start of every name " + str(i)) for i in range(4000)] + [(2, i, "x") for i in range(2000)] + [(1, 0, "zzz")]
    df = spark.createDataFrame(rows, "k int, hour int, name string")
    out, split = split_hot_groups(df, ["k"], ["hour", "name"], hot_rows=100, chunks=10)
    sizes = {(r.k, r[CHUNK]): r["count"] for r in out.groupBy("k", CHUNK).count().collect()}
    assert split and max(sizes.values()) <= 2 * 600 and len(sizes) >= 10
