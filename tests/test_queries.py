"""Every registered query against its SQL answer, on the smallest tables."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from compare import TABLES, canonical  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from tidewatch.queries import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES) and set(oracle_sql()) <= set(queries()) >= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, FOLDER)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(tuple(canonical(v) for _, v in sorted(zip(columns, row))) for row in cursor.fetchall())
    got = sorted(tuple(canonical(r[c]) for c in sorted(columns)) for r in frame.collect())
    assert got == want


def test_entry(spark):
    frame = entry(spark)
    assert frame.count() == 756 and frame.select("user_id", "run_id").distinct().count() == 552


def test_run_enrich_takes_every_sample(spark):
    """No time, day or snapshot is left out: the rows are those of the runs of all samples."""
    from tidewatch.operators.runs import run_segments
    from tidewatch.queries.inputs import event_samples
    from tidewatch.queries.sessions import ENRICH_KEYS

    samples = event_samples(spark.read.parquet(f"{FOLDER}/events.parquet"))
    runs = run_segments(samples, ENRICH_KEYS, ["sample_id", "event_id"], "xid", "sample_time")
    got = QUERIES["run_enrich"](spark, FOLDER)
    assert sorted(r.event_id for r in got.select("event_id").collect()) == sorted(r.event_id for r in runs.select("event_id").collect())


def test_blocked_latest_takes_every_blocked_sample(spark, con):
    """Samples of all blocked sessions count, whatever their statement."""
    from tidewatch.queries.inputs import EVENT_SAMPLES

    blocked = con.execute(f"""WITH {EVENT_SAMPLES} SELECT DISTINCT a.session_id, a.sql_exec_id FROM event_samples a JOIN event_samples b
      ON b.sample_id = a.sample_id AND b.inst_id = a.inst_id AND b.blocking_session = a.session_id WHERE a.sql_id = 'error'""").fetchall()
    got = QUERIES["blocked_latest"](spark, FOLDER).select("session_id", "sql_exec_id").collect()
    assert blocked and sorted(tuple(r) for r in got) == sorted(blocked)
