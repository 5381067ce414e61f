"""Measurement queries: counters, differences, run statistics, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import measure
from tidewatch.queries.inputs import K_SQL, day_number, k_of
from tidewatch.queries.registry import Tables, query
from tidewatch.session import work_folder
from tidewatch.sources.tables import MeasurementStore

# The first day of the events, as a day number: runs are numbered from it.
FIRST_DAY = 19_723

COUNTED = ("elapsed_time", "fetches", "executions", "sorts", "io_interconnect_bytes", "runtime_mem")


def _wide(events: DataFrame) -> DataFrame:
    """Per user and event type, some counters; one is null for errors."""
    cents, k = F.round(F.col("value") * 100).cast("bigint"), k_of(F.col("props")).cast("bigint")
    return events.groupBy(F.col("user_id").alias("sql_id"), F.col("event_type").alias("child")).agg(
        F.sum(cents).alias("ELAPSED_TIME"), F.sum(k).alias("FETCHES"), F.count(F.lit(1)).alias("EXECUTIONS"),
        F.sum(F.when(F.col("event_type") != "error", k)).alias("SORTS"), F.max(cents).alias("IO_INTERCONNECT_BYTES"),
        F.min(k).alias("RUNTIME_MEM"),
    )


WIDE = f"""wide AS (
  SELECT user_id AS sql_id, event_type AS child, sum(cents)::BIGINT AS elapsed_time, sum(k)::BIGINT AS fetches, count(*) AS executions,
    sum(CASE WHEN event_type <> 'error' THEN k END)::BIGINT AS sorts, max(cents) AS io_interconnect_bytes, min(k) AS runtime_mem
  FROM (SELECT *, round(value * 100)::BIGINT AS cents, {K_SQL}::BIGINT AS k FROM events) GROUP BY 1, 2
)"""


@query("unpivot_counters", f"""
WITH {WIDE} SELECT sql_id, child, stat_name, stat_value FROM wide
UNPIVOT INCLUDE NULLS (stat_value FOR stat_name IN ({", ".join(COUNTED)}))""")
def unpivot_counters_query(t: Tables):
    return measure.unpivot_counters(_wide(t.events), ["sql_id", "child"], [c.upper() for c in COUNTED])


def _totals(events: DataFrame, until: Column) -> DataFrame:
    """Running totals of users by event type as they stood at some day."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return events.where(until).groupBy("user_id", F.col("event_type").alias("stat_name")).agg(F.sum(cents).alias("stat_value"))


EARLY, LATE = "day <= 3", "day >= 2"
TOTALS = f"""d AS (SELECT *, epoch_us(ts) // 86400000000 - {FIRST_DAY} AS day, round(value * 100)::BIGINT AS cents FROM events),
pre AS (SELECT user_id, event_type AS stat_name, sum(cents)::BIGINT AS v FROM d WHERE {EARLY} GROUP BY 1, 2),
post AS (SELECT user_id, event_type AS stat_name, sum(cents)::BIGINT AS v FROM d WHERE {LATE} GROUP BY 1, 2)"""


def _dated(t: Tables) -> DataFrame:
    return t.events.withColumn("day", day_number(F.col("ts")) - FIRST_DAY)


def _store(t: Tables) -> MeasurementStore:
    return MeasurementStore(t.spark, work_folder(t.spark, "measurements"), ["user_id", "stat_name"], ["stat_value"])


@query("measure_pre", f"""
WITH {TOTALS} SELECT 11 AS run_id, user_id, stat_name, v AS stat_value_pre, NULL::BIGINT AS stat_value_post FROM pre
UNION ALL SELECT 10, user_id, stat_name, v, NULL FROM post""")
def measure_pre_query(t: Tables):
    store, dated = _store(t), _dated(t)
    store.save_pre(10, _totals(dated, F.expr(EARLY)))
    store.save_pre(11, _totals(dated, F.expr(EARLY)))
    store.save_pre(10, _totals(dated, F.expr(LATE)))
    return store.read().drop("d_pre", "d_post")


@query("measure_diff", f"""
WITH {TOTALS} SELECT 10 AS run_id, user_id, stat_name, pre.v AS stat_value_pre, post.v AS stat_value_post, post.v - coalesce(pre.v, 0) AS stat_value_diff
FROM pre FULL JOIN post USING (user_id, stat_name)""")
def measure_diff_query(t: Tables):
    store, dated = _store(t), _dated(t)
    store.save_pre(10, _totals(dated, F.expr(EARLY)))
    store.save_post(10, _totals(dated, F.expr(LATE)))
    return measure.with_difference(store.read().drop("d_pre", "d_post"), ["stat_value"])


MEASURED = ("total_waits", "total_timeouts", "time_waited", "average_wait", "max_wait", "time_waited_micro")


def _waits(events: DataFrame, until: str) -> DataFrame:
    """Per user and event type, wait counters as they stood at some day; one can be null."""
    k, cents = k_of(F.col("props")).cast("bigint"), F.round(F.col("value") * 100).cast("bigint")
    return events.where(until).groupBy("user_id", F.col("event_type").alias("event")).agg(
        F.count(F.lit(1)).alias("total_waits"), F.sum(F.when(k > 50, 1)).alias("total_timeouts"), F.sum(k).alias("time_waited"),
        F.min(k).alias("average_wait"), F.max(k).alias("max_wait"), F.sum(cents).alias("time_waited_micro"),
    )


WAITS = f"""d AS (SELECT *, epoch_us(ts) // 86400000000 - {FIRST_DAY} AS day, round(value * 100)::BIGINT AS cents, {K_SQL}::BIGINT AS k FROM events),
""" + ", ".join(f"""{name} AS (SELECT user_id, event_type AS event, count(*) AS total_waits, sum(CASE WHEN k > 50 THEN 1 END)::BIGINT AS total_timeouts,
  sum(k)::BIGINT AS time_waited, min(k) AS average_wait, max(k) AS max_wait, sum(cents)::BIGINT AS time_waited_micro
  FROM d WHERE {rule} GROUP BY 1, 2)""" for name, rule in (("pre", EARLY), ("post", "event_type <> 'view' OR day > 3")))
POST_RULE = "event_type <> 'view' or day > 3"


def _waits_diff(null_as_zero: bool) -> str:
    columns = []
    for m in MEASURED:
        if null_as_zero:
            value = f"CASE WHEN post.user_id IS NULL THEN 0 WHEN pre.user_id IS NULL THEN post.{m} ELSE coalesce(post.{m}, 0) - coalesce(pre.{m}, 0) END"
        else:
            value = f"CASE WHEN pre.user_id IS NULL THEN post.{m} ELSE post.{m} - pre.{m} END"
        columns.append(f"{value} AS {m}")
    join = "FULL" if null_as_zero else "RIGHT"
    return f"""WITH {WAITS}, x AS (
  SELECT user_id, event, {", ".join(columns)} FROM pre {join} JOIN post USING (user_id, event)
) SELECT * FROM x WHERE total_waits <> 0 OR total_timeouts <> 0 OR time_waited_micro <> 0"""


@query("event_diff", _waits_diff(True))
def event_diff_query(t: Tables):
    dated = _dated(t)
    return measure.diff_nonzero(_waits(dated, EARLY), _waits(dated, POST_RULE), ["user_id", "event"])


@query("stat_diff", _waits_diff(False))
def stat_diff_query(t: Tables):
    dated = _dated(t)
    return measure.diff_nonzero(_waits(dated, EARLY), _waits(dated, POST_RULE), ["user_id", "event"], null_as_zero=False)


@query("changed_events", f"""
WITH {WAITS} SELECT user_id, event, post.total_waits - coalesce(pre.total_waits, 0) AS waits_diff,
  post.total_timeouts - coalesce(pre.total_timeouts, 0) AS timeouts_diff, post.max_wait - coalesce(pre.max_wait, 0) AS max_diff
FROM pre FULL JOIN post USING (user_id, event) WHERE waits_diff <> 0 OR timeouts_diff <> 0 OR max_diff <> 0""")
def changed_events_query(t: Tables):
    dated = _dated(t)
    keys, short = ["user_id", "event"], {"total_waits": "waits", "total_timeouts": "timeouts", "max_wait": "max"}
    pick = lambda df: df.select(*keys, *[F.col(a).alias(b) for a, b in short.items()])
    pre = pick(_waits(dated, EARLY)).withColumnsRenamed({b: f"{b}_pre" for b in short.values()})
    saved = pre.withColumns({f"{b}_post": F.lit(None).cast("bigint") for b in short.values()})
    merged = measure.merge_post(saved, pick(_waits(dated, POST_RULE)), keys, list(short.values()))
    return measure.any_nonzero(merged, [f"{b}_diff" for b in short.values()]).select(*keys, *[f"{b}_diff" for b in short.values()])


def _run_stats(events: DataFrame) -> DataFrame:
    """Days are dealt into runs, and runs into four classes of four; users' amounts and counts are statistics."""
    cents, k = F.round(F.col("value") * 100).cast("bigint"), k_of(F.col("props")).cast("bigint")
    days = _run_days(events)
    wide = days.groupBy("run_id", F.col("event_type")).agg(
        (F.sum(cents) * 1000).alias("busy time"), F.sum(k * 10_000).alias("buffer size"), F.sum(k * 777).alias("sent bytes"),
        F.max(cents).alias("read bytes from cache"), (F.count(F.lit(1)) - F.count(F.lit(1))).alias("nothing"), F.min(k).alias("lowest"),
    )
    names = ("busy time", "buffer size", "sent bytes", "read bytes from cache", "nothing", "lowest")
    tall = wide.unpivot(["run_id", "event_type"], list(names), "name", "stat_value_diff")
    return tall.select(
        "run_id", F.length("event_type").alias("stat_class_id"), F.concat("event_type", F.lit(" "), "name").alias("stat_name"), "stat_value_diff"
    )


def _run_days(events: DataFrame) -> DataFrame:
    day = day_number(F.col("ts")) - FIRST_DAY
    return events.withColumn("run_id", (10 * (1 + F.floor(day / 4) % 4) + day % 4).cast("int"))


RUN_STATS = f"""base AS (
  SELECT *, (10 * (1 + (day // 4) % 4) + day % 4)::INT AS run_id FROM (
    SELECT *, epoch_us(ts) // 86400000000 - {FIRST_DAY} AS day, round(value * 100)::BIGINT AS cents, {K_SQL}::BIGINT AS k FROM events)
), tall AS (
  SELECT run_id, length(event_type)::INT AS stat_class_id, event_type || ' ' || name AS stat_name, v AS stat_value_diff FROM (
    SELECT run_id, event_type, unnest(['busy time', 'buffer size', 'sent bytes', 'read bytes from cache', 'nothing', 'lowest']) AS name,
      unnest([sum(cents) * 1000, sum(k * 10000), sum(k * 777), max(cents), 0, min(k)])::BIGINT AS v FROM base GROUP BY run_id, event_type)
), stats AS (
  SELECT (run_id // 10)::BIGINT AS run_class, stat_class_id, stat_name, median(stat_value_diff)::DOUBLE AS median, stddev_samp(stat_value_diff) AS stddev,
    count(*) AS runs FROM tall WHERE stat_value_diff <> 0 GROUP BY ALL
), kept AS (SELECT * FROM stats WHERE runs >= 4 AND (median <> 0 OR stddev <> 0))"""


@query("run_class_stats", f"""
WITH {RUN_STATS} SELECT run_class, stat_class_id, stat_name, median, round(stddev, 6) AS stddev, round(100 * stddev / nullif(median, 0)) AS stddev_pct, runs FROM kept""")
def run_class_stats_query(t: Tables):
    return measure.run_class_stats(_run_stats(t.events)).withColumn("stddev", F.round("stddev", 6))


SPACED_SQL = """CASE WHEN stat_name LIKE '% time' THEN stat_name || ' [s]'
    WHEN stat_name LIKE '% size' OR stat_name LIKE '% bytes' OR stat_name LIKE '% bytes from cache' THEN stat_name || ' [MB]' ELSE stat_name END AS stat_name,
  CASE WHEN stat_name LIKE '% time' THEN round(median / 1000000, 3)
    WHEN stat_name LIKE '% size' OR stat_name LIKE '% bytes' OR stat_name LIKE '% bytes from cache' THEN round(median / 1048576, 3) ELSE median END AS median"""


@query("label_units", f"WITH {RUN_STATS} SELECT run_class, stat_class_id, {SPACED_SQL} FROM kept")
def label_units_query(t: Tables):
    stats = measure.run_class_stats(_run_stats(t.events)).select("run_class", "stat_class_id", "stat_name", "median")
    return measure.label_units(stats, "median")


@query("pivot_runs_class", f"""
WITH {RUN_STATS}, labelled AS (SELECT run_class, stat_class_id, {SPACED_SQL} FROM kept)
SELECT stat_class_id, stat_name, max(CASE WHEN run_class = 1 THEN median END) AS run_1, max(CASE WHEN run_class = 2 THEN median END) AS run_2, max(CASE WHEN run_class = 3 THEN median END) AS run_3, max(CASE WHEN run_class = 4 THEN median END) AS run_4, max(CASE WHEN run_class = 5 THEN median END) AS run_5
FROM labelled GROUP BY 1, 2""")
def pivot_runs_class_query(t: Tables):
    stats = measure.run_class_stats(_run_stats(t.events)).select("run_class", "stat_class_id", "stat_name", "median")
    return measure.pivot_runs(measure.label_units(stats, "median"), "run_class", measure.RUN_CLASSES, "median")


def _user_stats(events: DataFrame) -> DataFrame:
    wide = _run_days(events).groupBy("run_id", F.col("user_id").alias("sql_id")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint") * 1000).alias("elapsed_time"),
        F.sum(k_of(F.col("props")).cast("bigint") * 100_000).alias("sharable_mem"),
        F.max(k_of(F.col("props")).cast("bigint") * 10_000).alias("physical_read_bytes"), F.count(F.lit(1)).alias("executions"),
    )
    return wide.unpivot(["run_id", "sql_id"], ["elapsed_time", "sharable_mem", "physical_read_bytes", "executions"], "stat_name", "stat_value_diff")


@query("pivot_runs_id", f"""
WITH {RUN_STATS}, u AS (
  SELECT run_id, user_id AS sql_id, unnest(['elapsed_time', 'sharable_mem', 'physical_read_bytes', 'executions']) AS n,
    unnest([sum(cents * 1000), sum(k * 100000), max(k * 10000), count(*)])::BIGINT AS v FROM base GROUP BY run_id, user_id
), labelled AS (
  SELECT run_id, sql_id, CASE WHEN n LIKE '%!_mem' ESCAPE '!' OR n LIKE '%!_bytes' ESCAPE '!' THEN n || ' [MB]' WHEN n LIKE '%!_time' ESCAPE '!' THEN n || ' [s]' ELSE n END AS stat_name,
    CASE WHEN n LIKE '%!_mem' ESCAPE '!' OR n LIKE '%!_bytes' ESCAPE '!' THEN v / 1048576 WHEN n LIKE '%!_time' ESCAPE '!' THEN v / 1000000 ELSE v::DOUBLE END AS x
  FROM u WHERE run_id < 50
)
SELECT sql_id, stat_name, 
  max(CASE WHEN run_id = 10 THEN x END) AS run_10, max(CASE WHEN run_id = 11 THEN x END) AS run_11,
  max(CASE WHEN run_id = 12 THEN x END) AS run_12, max(CASE WHEN run_id = 13 THEN x END) AS run_13,
  max(CASE WHEN run_id = 20 THEN x END) AS run_20, max(CASE WHEN run_id = 21 THEN x END) AS run_21,
  max(CASE WHEN run_id = 22 THEN x END) AS run_22, max(CASE WHEN run_id = 23 THEN x END) AS run_23,
  max(CASE WHEN run_id = 30 THEN x END) AS run_30, max(CASE WHEN run_id = 31 THEN x END) AS run_31,
  max(CASE WHEN run_id = 32 THEN x END) AS run_32, max(CASE WHEN run_id = 33 THEN x END) AS run_33,
  max(CASE WHEN run_id = 40 THEN x END) AS run_40, max(CASE WHEN run_id = 41 THEN x END) AS run_41,
  max(CASE WHEN run_id = 42 THEN x END) AS run_42, max(CASE WHEN run_id = 43 THEN x END) AS run_43 FROM labelled GROUP BY 1, 2""")
def pivot_runs_id_query(t: Tables):
    stats = _user_stats(t.events).where(F.col("run_id") < 50)
    labelled = measure.label_units(stats, "stat_value_diff", measure.UNDERSCORED_UNITS, digits=None)
    return measure.pivot_runs(labelled, "run_id", measure.RUN_IDS, "stat_value_diff")
