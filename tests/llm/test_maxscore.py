"""MaxScore against all inner products."""

import os
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
from compare import canonical  # noqa: E402

from tidewatch.llm import maxscore, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k, every):
    kept = [
        (i, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)) for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, own) in enumerate(kept):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for m, (i, v) in enumerate(kept) if m != n)[:k]
            out += [(q, place + 1, i, -score) for place, (score, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("least", [20, 8192])
def test_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(maxscore, "LEAST_ROWS", least)
    monkeypatch.setattr(maxscore, "CELL_BYTES", least * 8)
    monkeypatch.setattr(maxscore, "SEED_ROWS", 20)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=12) * rng.integers(0, 2, 12)).tolist(), 0) for i in range(300)]
    rows += [(i, [0.5] * 12, 0) for i in range(300, 420)]
    rows += [(500, None, 0), (505, [1.0, None] + [0.0] * 10, 0), (510, [float("nan")] * 12, 0), (515, [float("inf")] + [0.0] * 11, 0)]
    rows += [(None, [1.0] * 12, 0), (520, [2.0], 0), (525, [], 0), (0, [9.0] * 12, 0), (5, rows[5][1], 0)]
    rows += [(7, [8.0] * 12, 0)] * 3 + [(10, [7.0] * 12, 0)] * 9 + [(10, [7.5] * 12, 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, maxscore.top_k(frame, F.col("vec_id") % 5 == 0, 5).collect()))
    assert got == brute(rows, 5, 5)


def test_rows_of_one_id_are_candidates_each(spark):
    rows = [(0, [1.0], 0), (1, [0.5], 0), (1, [0.9], 0), (0, [0.25], 0)]
    got = sorted(map(tuple, maxscore.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, 5).collect()))
    assert got == brute(rows, 5, 100) and len(got) == 6


def test_few_rows(spark):
    rows = [(0, [1e5, 3e6], 1), (1, [2e5, -1e6], 1), (2, [1.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, maxscore.top_k(frame, F.col("vec_id") == 0, 5).collect())) == brute(rows, 5, 100)
    assert maxscore.top_k(frame.limit(0), F.col("vec_id") == 0, 5).collect() == []
    assert maxscore.top_k(frame.limit(1), F.col("vec_id") == 0, 5).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    cursor = con.execute(queries.ORACLES["op2_maxscore"])
    columns = [d[0] for d in cursor.description]
    want = sorted(tuple(canonical(v) for _, v in sorted(zip(columns, r))) for r in cursor.fetchall())
    frame = queries.QUERIES["op2_maxscore"](spark, FOLDER)
    assert sorted(tuple(canonical(r[c]) for c in sorted(columns)) for r in frame.collect()) == want
