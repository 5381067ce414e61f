"""Cuts against plain string slices, exact round trips, and the SQL answer."""

import hashlib
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
from compare import canonical  # noqa: E402

from tidewatch.llm import queries  # noqa: E402
from tidewatch.llm.fill_in_middle import STRIDE, code_points, fill_in_middle, restored  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


def plain(key, text, transformed=90, spm=20):
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= transformed:
        return key, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return key, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def odd_rows():
    rows = [(i, "añ€😀\n$1\\E" * (i % 7) + "<P <S M> >"[: i % 11]) for i in range(300)]
    rows += [(1000 + i, "😀x" * (STRIDE // 2) + "é" * i) for i in range(3)] + [(1010 + i, " \r\x00" * (STRIDE * 3 + i)) for i in range(3)]
    rows += [(400, None), (401, ""), (402, "a<P>b"), (403, "<M>"), (None, "no key, some text"), (404, "same"), (404, "same"), (404, "other")]
    return rows + [(500 + i, "😀 long 字 " * 200_000) for i in range(2)]


def test_plain_slices_and_round_trip(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    assert sorted(got, key=str) == sorted((plain(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert sorted((r.doc_id, r.back) for r in made.where("doc_id IS NOT NULL").collect()) == sorted((k, t or "") for k, t in rows if k is not None)


def test_code_points(spark):
    texts = ["", "x", "😀", "é" * STRIDE, "é" * (STRIDE - 1), "😀" * (STRIDE + 1), "\n" * (3 * STRIDE), "a\r\n " * 1234]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", code_points(F.col("t")).alias("n")).collect()
    assert all(r.n == len(r.t) for r in got)


def test_other_settings(spark):
    docs = spark.createDataFrame([(i, f"text number {i} $a") for i in range(50)], "doc_id long, text string")
    marks = ("[$1]", "{\\}", "(*)")
    made = fill_in_middle(docs, transformed_percent=100, spm_percent=50, markers=marks)
    rows = made.withColumn("back", restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in rows} == {"psm", "spm"} and all(r.back == r.text and r.output != r.text for r in rows)
    assert all(sum(r.output.count(m) for m in marks) == 3 for r in rows)
    for bad in (("<a>", "<a>", "<b>"), ("<P>", "><S", "<M>"), ("", "x", "y")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, markers=bad)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(7, "some text", 1, "a", 2, "b", 3)], "doc_id long, text string, row int, `_text` string, `_n` int, `_h1` string, form int")
    got = fill_in_middle(docs)
    assert got.columns == ["doc_id", "text", "row", "_text", "_n", "_h1", "n", "form", "prefix_chars", "middle_chars", "output"]
    row = got.first()
    assert (row.row, row["_text"], row["_n"], row["_h1"], row.n) == (1, "a", 2, "b", 9) and row.form in ("plain", "psm", "spm")
    assert fill_in_middle(docs.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    cursor = con.execute(queries.ORACLES["op12_fill_in_middle"])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(map(canonical, r)) for r in cursor.fetchall())
    frame = queries.QUERIES["op12_fill_in_middle"](spark, FOLDER)
    assert frame.columns == names and sorted(tuple(canonical(v) for v in r) for r in frame.collect()) == want
