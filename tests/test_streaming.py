"""The stream against the same plan on the whole table, with rows out of order, late rows and a restart."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from tidewatch.streaming.peaks import run_once, session_peaks

SCHEMA = "sample_time timestamp, inst_id int, session_id int, session_serial int, qc_instance_id int, qc_session_id int, qc_session_serial int, v long"
T0 = datetime(2024, 3, 1)


def _rows(n, seed, start=0, hours=72):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        at, s = T0 + timedelta(hours=start, seconds=rng.randrange(hours * 3600)), rng.randrange(6)
        if rng.random() < 0.4:
            rows.append((at, rng.randrange(2), 100 + s, 1, rng.randrange(2), s, 1, rng.randrange(50)))
        else:
            rows.append((at, rng.randrange(2), s, 1, None, None, None, rng.choice([None, rng.randrange(80)])))
    return rows


def _plain(rows, least):
    totals = defaultdict(lambda: [0, 0, 0, False])
    for at, inst, s, serial, qi, qs, qr, v in rows:
        key = (at.replace(minute=0, second=0), *((inst, s, serial) if qi is None else (qi, qs, qr)))
        t = totals[key]
        t[0] += v or 0
        t[1] += qi is None
        t[2] += qi is not None
        t[3] |= v is not None
    best = {}
    for (at, *session), (total, parents, children, known) in totals.items():
        if parents and known and total >= least:
            key = (at.replace(hour=0), *session)
            best[key] = max(best.get(key, (-1,)), (total, at, children))
    return {k: (v[0], v[1], v[2]) for k, v in best.items()}


def _got(df):
    return {(r.span_start, r.inst_id, r.session_id, r.session_serial): (r.peak_value, r.peak_at, r.child_rows) for r in df.collect()}


def test_stream_equals_table(spark, tmp_path):
    rows = _rows(1500, 1)
    table = spark.createDataFrame(rows, SCHEMA)
    assert _got(session_peaks(table, "v", 40)) == _plain(rows, 40)

    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    shuffled = random.Random(2).sample(rows, len(rows))

    def write(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        return run_once(session_peaks(stream, "v", 40, late="4 days"), sink, state)

    for at in range(0, 900, 300):  # any order, within the four days
        write(shuffled[at : at + 300])
    assert run().count() == 0  # nothing is final yet
    for at in range(900, 1500, 300):
        write(shuffled[at : at + 300])
    write([(T0 + timedelta(days=20), 0, 0, 1, None, None, None, None)])  # a beat closes all spans before it
    found = run()  # a second run goes on from the first one's state
    assert _got(found) == _plain(rows, 40) and found.count() == len(_plain(rows, 40))
    write([(T0 + timedelta(hours=1), 0, 0, 1, None, None, None, 10_000)])  # too late: its span is final
    write([(T0 + timedelta(days=40), 0, 0, 1, None, None, None, None)])
    assert _got(run()) == _plain(rows, 40)


def test_state_and_shuffle_hold_sums(spark, tmp_path):
    spark.createDataFrame(_rows(10, 3), SCHEMA).write.parquet(str(tmp_path / "in"))
    plan = session_peaks(spark.read.parquet(str(tmp_path / "in")), "v", 40)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum") and plan.count("partial_max") and "Window " not in plan
