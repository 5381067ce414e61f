"""The mix against a plain queue, and its rules on odd inputs."""

import hashlib
import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
from compare import canonical  # noqa: E402

from tidewatch.llm import queries  # noqa: E402
from tidewatch.llm.source_mix import mix  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


def plain(rows, weights=(5, 2, 1), most=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    totals = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(totals.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * totals[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(most * totals[s]) for s in over}
        left -= sum(most * totals[s] for s in over)
        open_ -= over
    place = lambda k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16)
    queue, upto = [], dict.fromkeys(names, 0)
    ordered = sorted(((place(k), -1 if k is None else k, size(t), s, i) for i, (k, t, s) in enumerate(rows)), key=lambda r: r[:3])
    for n in range(most):
        for _, _, z, s, i in ordered:
            if z and upto[s] < target[s]:
                queue.append(((upto[s] + z) / target[s], names.index(s), z, i))
            upto[s] += z
    used, taken = 0, [0] * len(rows)
    for _, _, z, i in sorted(queue):
        used += z
        if used > sum(totals.values()):
            break
        taken[i] += z
    return [(k, size(t), totals[s], round(target[s], 6), n) for (k, t, s), n in zip(rows, taken)]


def test_plain_queue(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), f"s{i % 5}") for i in range(200)] + [(i, "w " * 40, "hot") for i in range(200, 500)]
    rows += [(501, None, "s0"), (502, "", None), (503, "a b c", None), (503, "a b c", None), (None, "x y", "s1"), (504, "w " * 60_000, "s2"), (505, " \n\x0b", "only blank")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("x", "size")
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mix(docs).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 9, 9)], "doc_id long, text string, source string, size int, rank int")
    assert [(r.size, r.taken) for r in mix(docs).collect()] == [(2, 2)]
    assert mix(docs.limit(0)).collect() == []
    assert [(r.size, r.taken) for r in mix(docs.selectExpr("doc_id", "cast(null AS string) AS text", "source")).collect()] == [(0, 0)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    cursor = con.execute(queries.ORACLES["op8_source_mix"])
    names = sorted(d[0] for d in cursor.description)
    want = sorted(tuple(canonical(v) for _, v in sorted(zip([d[0] for d in cursor.description], r))) for r in cursor.fetchall())
    frame = queries.QUERIES["op8_source_mix"](spark, FOLDER)
    assert sorted(frame.columns) == names
    assert sorted(tuple(canonical(r[c]) for c in names) for r in frame.collect()) == want
