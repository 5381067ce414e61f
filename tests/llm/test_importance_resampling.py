"""Resampling against a plain version on odd rows and ties, and the SQL answer."""

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
from compare import canonical  # noqa: E402

from tidewatch.llm import queries  # noqa: E402
from tidewatch.llm.importance_resampling import drawn, resample  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(rows, target, most=1, buckets=10_000, percent=10, least=20):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        grams = [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    s, t = Counter(b for _, x in rows for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    corpus, goal = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (corpus + buckets) / ((s[b] + 1) * (goal + buckets))))
    out = []
    for key, text in rows:
        n, found = features(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for i, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[5] = i
    return sorted(map(tuple, out), key=str)


ROWS = [(i, " ".join(f"W{(i * j) % 97} É字{j % 5}-a" for j in range(i % 40))) for i in range(300)] + [
    (1000, None), (1001, ""), (1002, " \n!"), (None, "word " * 30), (1003, "k " * 19), (1004, "K " * 20), (1005, "Ünï-CODE9 " * 40_000)]
TARGET = ["w1 w2 w3 word", None, "", "É字1 a a"]


@pytest.mark.parametrize(("most", "buckets", "percent"), [(1, 10_000, 10), (2, 64, 35), (3, 1000, 100), (1, 7, 0)])
def test_plain(spark, most, buckets, percent):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resample(docs, target, most_words=most, buckets=buckets, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == plain(ROWS, TARGET, most, buckets, percent)


def test_repeated_rows_are_cut_exactly(spark):
    rows = [(7, "same words again " * 10)] * 60 + [(8, "other words " * 15)] * 40 + [(9, "few")] * 5
    got = resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([("same",)], "text string"), percent=33)
    assert sorted(r.rank for r in got.collect() if r.rank) == list(range(1, 34))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, ["same"], percent=33)


def test_cutoff_is_exact(spark):
    rows = [(i * 37 % 11, i * 53 % 13 - 6, i) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    order = [-F.col("a"), F.col("b"), F.col("c")]
    for wanted in (0, 1, 36, 37, 200, 399, 400):
        got = df.where(drawn(df, order, wanted)).collect()
        assert sorted(map(tuple, got)) == sorted(sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:wanted])


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "a b " * 20, 1, 2, 3, "x") for i in range(20)], "doc_id long, text string, score int, rank int, key int, buckets string")
    target = spark.createDataFrame([("a",)], "text string").selectExpr("text", "5 AS key", "6 AS draw")
    got = resample(docs, target)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(r.rank for r in got.collect() if r.rank) == [1, 2]
    assert resample(docs.limit(0), target).collect() == []
    assert len(resample(docs, target.limit(0)).collect()) == 20


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES["op13_importance_resampling"])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(map(canonical, r)) for r in cursor.fetchall())
    frame = queries.QUERIES["op13_importance_resampling"](spark, FOLDER)
    assert frame.columns == names and sorted(tuple(canonical(v) for v in r) for r in frame.collect()) == want
