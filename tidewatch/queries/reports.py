"""Statistics, interval, space and maintenance queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import space, statistics
from tidewatch.operators.joins import overlap_join
from tidewatch.plans import maintenance
from tidewatch.queries.inputs import K_SQL, day_number, hour_number, inst_of, k_of
from tidewatch.queries.registry import Tables, query
from tidewatch.session import work_folder
from tidewatch.sources.readers import read_ordered_text
from tidewatch.sources.tables import write_ordered_text

# Statistic name → what stands in for it: an expression over k and cents, in both languages.
STAND_INS = {
    "executions": "1", "rows_processed": "k", "px_servers_execs": "k * 2", "parse_calls": "k + 1", "fetches": "k * 3",
    "sorts": "cents", "buffer_gets": "cents * 2", "disk_reads": "cents + k", "physical_read_requests": "k * 5",
    "optimized_physical_reads": "k * 7", "physical_write_requests": "k * 11", "direct_writes": "k * 13",
    "physical_read_bytes": "cents * 70001", "physical_write_bytes": "cents * 50021",
    "io_interconnect_bytes": "cents * 30011", "elapsed_time": "cents * 1009", "cpu_time": "cents * 503",
    "plsexec_time": "k * 1013", "iowait": "k * 2003", "clwait": "k * 3001", "apwait": "cents * 401", "ccwait": "cents * 307",
    "loads": "k * 17", "javexec_time": "k * 19",
}


def event_stats(events: DataFrame) -> DataFrame:
    """Events as interval statistics: the hour is the snapshot."""
    base = events.select(
        "event_id", "user_id", "event_type", "ts", k_of(F.col("props")).cast("bigint").alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"), inst_of(F.col("props")).alias("instance_number"),
    )
    deltas = {f"{n}_delta": F.expr(f"cast({e} as bigint)") for n, e in STAND_INS.items()}
    totals = {f"{n}_total": F.expr(f"cast({e} as bigint) * 10") for n, e in STAND_INS.items()}
    return base.withColumns(
        {
            **deltas, **totals,
            "snap_id": hour_number(F.col("ts")), "sql_id": F.col("event_type"), "plan_hash_value": F.col("k") % 3,
            "module": F.when(F.col("k") < 90, F.concat(F.lit("m"), F.floor(F.col("k") / 30).cast("string"))),
            "action": F.lit(None).cast("string"), "parsing_schema_name": F.upper("event_type"),
            "parsing_user_id": F.col("user_id"), "parsing_schema_id": F.col("user_id") % 10,
            "force_matching_signature": F.col("k") * 1_000_003 + 7,
            "sql_profile": F.when(F.col("k") % 4 == 0, F.concat(F.lit("prof"), F.col("k").cast("string"))),
        }
    )


def hourly_snapshots(events: DataFrame) -> DataFrame:
    return events.groupBy(inst_of(F.col("props")).alias("instance_number"), hour_number(F.col("ts")).alias("snap_id")).agg(
        F.min("ts").alias("begin_interval_time"), F.max("ts").alias("end_interval_time")
    )


EVENT_STATS = f"""event_stats AS (
  SELECT *, epoch_us(ts) // 3600000000 AS snap_id, event_type AS sql_id, k % 3 AS plan_hash_value,
    CASE WHEN k < 90 THEN 'm' || k // 30 END AS module, NULL::VARCHAR AS action, upper(event_type) AS parsing_schema_name,
    user_id AS parsing_user_id, user_id % 10 AS parsing_schema_id, k * 1000003 + 7 AS force_matching_signature,
    CASE WHEN k % 4 = 0 THEN 'prof' || k END AS sql_profile, (1 + k // 50)::INT AS instance_number,
    {", ".join(f"({e})::BIGINT AS {n}_delta, ({e})::BIGINT * 10 AS {n}_total" for n, e in STAND_INS.items())}
  FROM (SELECT event_id, user_id, event_type, ts, {K_SQL}::BIGINT AS k, round(value * 100)::BIGINT AS cents FROM events)
), hourly AS (
  SELECT instance_number, snap_id, min(ts) AS begin_interval_time, max(ts) AS end_interval_time
  FROM event_stats GROUP BY instance_number, snap_id
)"""


DAILY_SQL = """
  sum(executions_delta)::BIGINT AS execs, sum(rows_processed_delta)::BIGINT AS rows, sum(px_servers_execs_delta)::BIGINT AS execs_px,
  sum(parse_calls_delta)::BIGINT AS parses, sum(fetches_delta)::BIGINT AS fetches, sum(sorts_delta)::BIGINT AS sorts,
  sum(buffer_gets_delta)::BIGINT AS io_buffers, sum(disk_reads_delta)::BIGINT AS io_reads,
  sum(physical_read_requests_delta)::BIGINT AS pio_reads, sum(optimized_physical_reads_delta)::BIGINT AS pio_reads_opt,
  sum(physical_write_requests_delta)::BIGINT AS pio_writes, sum(direct_writes_delta)::BIGINT AS io_writes_dir,
  round(sum(physical_read_bytes_delta)::DOUBLE / 1048576, 0) AS pio_reads_mb,
  round(sum(physical_write_bytes_delta)::DOUBLE / 1048576, 0) AS pio_writes_mb,
  round(sum(io_interconnect_bytes_delta)::DOUBLE / 1048576, 0) AS io_netw_mb,
  round(sum(elapsed_time_delta)::DOUBLE / 1000000, 3) AS ela_time_s, round(sum(cpu_time_delta)::DOUBLE / 1000000, 3) AS cpu_time_s,
  round(sum(plsexec_time_delta)::DOUBLE / 1000000, 3) AS pls_time_s, round(sum(iowait_delta)::DOUBLE / 1000000, 3) AS wait_io_s,
  round(sum(clwait_delta)::DOUBLE / 1000000, 3) AS wait_cl_s, round(sum(apwait_delta)::DOUBLE / 1000000, 3) AS wait_app_s,
  round(sum(ccwait_delta)::DOUBLE / 1000000, 3) AS wait_cc_s"""


@query("daily_rollup", f"""
WITH {EVENT_STATS}
SELECT lower(strftime(begin_interval_time, '%Y-%m-%d %A')) AS occurrence, instance_number, {DAILY_SQL},
  string_agg(DISTINCT parsing_schema_name, '|' ORDER BY parsing_schema_name) AS users,
  string_agg(DISTINCT module, '|' ORDER BY module) AS modules
FROM event_stats JOIN hourly USING (snap_id, instance_number) GROUP BY 1, 2""")
def daily_rollup_query(t: Tables):
    return statistics.daily_rollup(event_stats(t.events), hourly_snapshots(t.events))


DETAIL_SQL = """
  executions_total AS execs, executions_delta AS execs_d, fetches_total AS fetches, fetches_delta AS fetches_d, sorts_total AS sorts,
  sorts_delta AS sorts_d, px_servers_execs_total AS px_execs, px_servers_execs_delta AS px_execs_d, loads_total AS loads,
  loads_delta AS loads_d, parse_calls_total AS parses, parse_calls_delta AS parses_d, rows_processed_total AS rows,
  rows_processed_delta AS rows_d, buffer_gets_total AS io_lios, buffer_gets_delta AS io_lios_d, disk_reads_total AS io_reads,
  disk_reads_delta AS io_reads_d, physical_read_requests_total AS io_ph_reads, physical_read_requests_delta AS io_ph_reads_d,
  direct_writes_total AS io_dir_writes, direct_writes_delta AS io_dir_writes_d, physical_write_requests_total AS io_ph_writes,
  physical_write_requests_delta AS io_ph_writes_d, elapsed_time_total / 1000 AS t_ela_ms, elapsed_time_delta / 1000 AS t_ela_d_ms,
  cpu_time_total / 1000 AS t_cpu_ms, cpu_time_delta / 1000 AS t_cpu_d_ms, iowait_total / 1000 AS t_iowait_ms,
  iowait_delta / 1000 AS t_iowait_d_ms, clwait_total / 1000 AS t_clwait_ms, clwait_delta / 1000 AS t_clwait_d_ms,
  javexec_time_total / 1000 AS t_java_ms, javexec_time_delta / 1000 AS t_java_d_ms, plsexec_time_total / 1000 AS t_plsql_ms,
  plsexec_time_delta / 1000 AS t_plsql_d_ms, apwait_total / 1000 AS t_apwait_ms, apwait_delta / 1000 AS t_apwait_d_ms,
  ccwait_total / 1000 AS t_ccwait_ms, ccwait_delta / 1000 AS t_ccwait_d_ms, physical_read_bytes_total / 1048576 AS io_ph_read_mb,
  physical_read_bytes_delta / 1048576 AS io_ph_read_d_mb, physical_write_bytes_total / 1048576 AS io_ph_write_mb,
  physical_write_bytes_delta / 1048576 AS io_ph_write_d_mb, io_interconnect_bytes_total / 1048576 AS io_cluster_mb,
  io_interconnect_bytes_delta / 1048576 AS io_cluster_d_mb"""


STATS_DETAIL = f"""
WITH {EVENT_STATS}, ranked AS (
  SELECT s.*, begin_interval_time, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_name END AS p_user,
    row_number() OVER (PARTITION BY module, action, sql_id, plan_hash_value, begin_interval_time::DATE
      ORDER BY begin_interval_time DESC, event_id DESC) AS rank
  FROM event_stats s JOIN hourly USING (snap_id, instance_number) LEFT JOIN customer ON c_custkey = parsing_user_id
)
SELECT begin_interval_time, rank, snap_id, instance_number AS inst_id, sql_id, plan_hash_value, module, action, parsing_user_id,
  p_user, force_matching_signature AS sql_f_m_sig, sql_profile, parsing_schema_id AS p_schema_id, parsing_schema_name AS p_schema, {DETAIL_SQL} FROM ranked"""


def _stats_detail(t: Tables, latest_only: bool) -> DataFrame:
    users = t.customer.where(F.col("c_mktsegment") != "MACHINERY").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username")
    )
    return statistics.stats_detail(
        event_stats(t.events), hourly_snapshots(t.events), users, latest_only, tie=["event_id"]
    )


@query("stats_detail", STATS_DETAIL)
def stats_detail_query(t: Tables):
    return _stats_detail(t, False)


@query("stats_detail_latest", STATS_DETAIL + " WHERE rank = 1")
def stats_detail_latest_query(t: Tables):
    return _stats_detail(t, True)


RANGE = datetime(2024, 1, 5, 6), datetime(2024, 1, 20, 18)
RANGE_SQL = "end_interval_time >= TIMESTAMP '2024-01-05 06:00:00' AND begin_interval_time <= TIMESTAMP '2024-01-20 18:00:00'"


def daily_intervals(events: DataFrame) -> DataFrame:
    """Each user's active time of a day as an interval of that user's instance."""
    return events.groupBy(
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("dbid"),
        F.col("user_id").alias("instance_number"), day_number(F.col("ts")).alias("snap_id"),
    ).agg(F.min("ts").alias("begin_interval_time"), F.max("ts").alias("end_interval_time"))


def current_database(region: DataFrame) -> DataFrame:
    return region.where(F.col("r_name") == "AMERICA").select(F.col("r_regionkey").alias("dbid"))


INTERVALS = f"""intervals AS (
  SELECT CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS dbid, user_id AS instance_number,
    epoch_us(ts) // 86400000000 AS snap_id, min(ts) AS begin_interval_time, max(ts) AS end_interval_time
  FROM events GROUP BY 1, 2, 3
), in_range AS (
  SELECT *, 'instance_' || instance_number || '.' || strftime(end_interval_time, '%Y%m%d_%H%M%S') || '.html' AS file_name
  FROM intervals WHERE {RANGE_SQL} AND dbid = (SELECT r_regionkey FROM region WHERE r_name = 'AMERICA')
), spans AS (
  SELECT dbid, instance_number, min(snap_id) AS snap_id_from, min(begin_interval_time) AS begin_interval_time,
    max(snap_id) AS snap_id_to, max(end_interval_time) AS end_interval_time FROM in_range GROUP BY dbid, instance_number
), named_spans AS (
  SELECT *, snap_id_from - 1 AS report_from, 'instance_' || instance_number || '.from_' || strftime(begin_interval_time, '%Y%m%d_%H%M%S')
    || '.to_' || strftime(end_interval_time, '%Y%m%d_%H%M%S') || '.html' AS file_name FROM spans
)"""


@query("snapshots_in_range", f"WITH {INTERVALS} SELECT * FROM in_range")
def snapshots_in_range_query(t: Tables):
    return statistics.snapshots_in_range(daily_intervals(t.events), current_database(t.region), *RANGE)


@query("snapshot_span", f"WITH {INTERVALS} SELECT * FROM named_spans")
def snapshot_span_query(t: Tables):
    return statistics.snapshot_span(daily_intervals(t.events), current_database(t.region), *RANGE)


def interval_stats(events: DataFrame) -> DataFrame:
    return events.select(
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("dbid"), F.col("user_id").alias("instance_number"),
        day_number(F.col("ts")).alias("snap_id"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


@query("interval_report", f"""
WITH {INTERVALS}
SELECT file_name, event_type, count(*) AS rows, sum(round(value * 100)::BIGINT)::BIGINT AS cents
FROM events JOIN in_range ON dbid = CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AND instance_number = user_id
  AND snap_id = epoch_us(ts) // 86400000000
GROUP BY file_name, event_type""")
def interval_report_query(t: Tables):
    intervals = statistics.snapshots_in_range(daily_intervals(t.events), current_database(t.region), *RANGE)
    return statistics.interval_report(intervals, interval_stats(t.events), ["event_type"], ["cents"])


@query("report_lines", f"""
WITH {INTERVALS}, r AS (
  SELECT file_name, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents
  FROM events JOIN in_range ON dbid = CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AND instance_number = user_id
    AND snap_id = epoch_us(ts) // 86400000000
  GROUP BY file_name, event_type
), l AS (
  SELECT file_name, 1 AS part, '' AS place, 'report ' || file_name AS line FROM (SELECT DISTINCT file_name FROM r)
  UNION ALL SELECT file_name, 2, event_type, event_type || ': rows ' || n || ', cents ' || cents FROM r
  UNION ALL SELECT file_name, 3, '', 'all: rows ' || sum(n) || ', cents ' || sum(cents) FROM r GROUP BY file_name
)
SELECT file_name, row_number() OVER (PARTITION BY file_name ORDER BY part, place) AS line_number, line FROM l""")
def report_lines_query(t: Tables):
    intervals = statistics.snapshots_in_range(daily_intervals(t.events), current_database(t.region), *RANGE)
    report = statistics.interval_report(intervals, interval_stats(t.events), ["event_type"], ["cents"])
    return statistics.report_lines(report, ["event_type"], ["cents"])


@query("interval_overlap", """
WITH days AS (SELECT DISTINCT epoch_us(ts) // 86400000000 AS day FROM events), sessions AS (
  SELECT user_id, event_type, week, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us
  FROM (SELECT *, epoch_us(ts) // 86400000000 // 7 AS week FROM events UNION ALL SELECT *, -1 FROM events) GROUP BY ALL
)
SELECT user_id, event_type, week, day, first_us, last_us FROM sessions JOIN days
ON first_us <= day * 86400000000 + 86399999999 AND day * 86400000000 <= last_us""")
def interval_overlap_query(t: Tables):
    """Sessions of a week, and of all time, against the days they touch: short and long intervals together."""
    day = day_number(F.col("ts"))
    days = t.events.select(day.alias("day")).distinct().withColumns({
        "day_from": F.col("day") * 86_400_000_000, "day_to": F.col("day") * 86_400_000_000 + 86_399_999_999})
    weeks = t.events.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.explode(F.array(F.floor(day / 7), F.lit(-1))).alias("week"))
    sessions = weeks.groupBy("user_id", "event_type", "week").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return overlap_join(sessions, days, (), ("first_us", "last_us"), ("day_from", "day_to")).drop("day_from", "day_to")


@query("span_report", f"""
WITH {INTERVALS}
SELECT file_name, event_type, count(*) AS rows, sum(round(value * 100)::BIGINT)::BIGINT AS cents
FROM events JOIN named_spans ON dbid = CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AND instance_number = user_id
  AND epoch_us(ts) // 86400000000 > report_from AND epoch_us(ts) // 86400000000 <= snap_id_to
GROUP BY file_name, event_type""")
def span_report_query(t: Tables):
    spans = statistics.snapshot_span(daily_intervals(t.events), current_database(t.region), *RANGE)
    return statistics.interval_report(spans, interval_stats(t.events), ["event_type"], ["cents"])


@query("space_balance", """
WITH f AS (
  SELECT c_mktsegment || c_nationkey AS tablespace_name, sum(round(abs(c_acctbal) * 1000000)::BIGINT)::DOUBLE / 1048576 / 1024 AS total
  FROM customer WHERE c_nationkey <> 3 GROUP BY 1
), s AS (
  SELECT 'BUILDING' || s_nationkey AS tablespace_name, sum(round(abs(s_acctbal) * 1000000)::BIGINT)::DOUBLE / 1048576 / 1024 AS free
  FROM supplier GROUP BY 1
), g AS (
  SELECT c_mktsegment || c_nationkey AS tablespace_name, count(*) AS segs, sum(round(o_totalprice * 1000)::BIGINT)::DOUBLE / 1048576 / 1024 AS segs_gb
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1
)
SELECT tablespace_name, round(total, 2) AS total_gb, round(total - free, 2) AS used_gb, round(free, 2) AS free_gb,
  round(100 * (free / nullif(total, 0))) AS free_pct, segs, round(segs_gb, 2) AS segs_gb
FROM f FULL JOIN s USING (tablespace_name) FULL JOIN g USING (tablespace_name)""")
def space_balance_query(t: Tables):
    segment = F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("tablespace_name")
    size = lambda c, unit: F.round(F.abs(F.col(c)) * unit).cast("bigint").alias("bytes")
    files = t.customer.where(F.col("c_nationkey") != 3).select(segment, size("c_acctbal", 1_000_000))
    free = t.supplier.select(
        F.concat(F.lit("BUILDING"), F.col("s_nationkey").cast("string")).alias("tablespace_name"), size("s_acctbal", 1_000_000)
    )
    segments = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).where(
        F.col("c_mktsegment") != "MACHINERY"
    ).select(segment, size("o_totalprice", 1_000))
    return space.space_balance(files, free, segments)


def supplier_extents(t: Tables) -> DataFrame:
    """Line items as extents of their supplier's file."""
    owner = t.supplier.select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("segment_name"),
        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("owner"),
    )
    return t.lineitem.join(owner, "l_suppkey").select(
        "owner", F.col("owner").alias("tablespace_name"), "segment_name",
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("P_"), "l_returnflag")).alias("partition_name"),
        extent_type().alias("segment_type"), F.col("l_suppkey").alias("file_id"),
        F.col("l_orderkey").alias("block_id"), F.col("l_quantity").cast("bigint").alias("blocks"),
        (F.col("l_quantity").cast("bigint") * 1_048_576).alias("bytes"),
    )


def extent_type() -> Column:
    line = F.concat("l_returnflag", "l_linestatus")
    return (
        F.when(line == "AF", "TABLE PARTITION").when(line == "AO", "LOB PARTITION").when(line == "RF", "INDEX PARTITION")
        .when(line == "RO", "TABLE SUBPARTITION").when(line == "NF", "INDEX").otherwise("LOBSEGMENT")
    )


EXTENTS = """extents AS (
  SELECT 'NATION_' || s_nationkey AS owner, 'NATION_' || s_nationkey AS tablespace_name, s_name AS segment_name,
    CASE WHEN l_returnflag <> 'N' THEN 'P_' || l_returnflag END AS partition_name,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'TABLE PARTITION' WHEN 'AO' THEN 'LOB PARTITION' WHEN 'RF' THEN 'INDEX PARTITION'
      WHEN 'RO' THEN 'TABLE SUBPARTITION' WHEN 'NF' THEN 'INDEX' ELSE 'LOBSEGMENT' END AS segment_type,
    l_suppkey AS file_id, l_orderkey AS block_id, l_quantity::BIGINT AS blocks, l_quantity::BIGINT * 1048576 AS bytes
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
), segs AS (
  SELECT owner, segment_name, partition_name, segment_type, tablespace_name, max(block_id) AS last_block_id,
    sum(bytes)::DOUBLE / 1048576 AS size_mb
  FROM extents GROUP BY owner, segment_name, partition_name, segment_type, tablespace_name
), sized AS (
  SELECT *, least(6, greatest(1, round(log2(size_mb / 8))))::INT AS dop FROM segs
)"""


def supplier_files(t: Tables) -> DataFrame:
    size = F.floor(F.abs("s_acctbal")).cast("bigint") + 1
    return t.supplier.select(
        F.col("s_suppkey").alias("file_id"),
        F.concat(F.lit("/data/"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name", F.lit(".dbf")).alias("file_name"),
        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("tablespace_name"),
        (size * 1_048_576).alias("bytes"), (size * 128).alias("blocks"), (size * 1280).alias("maxblocks"),
        ((F.col("s_nationkey") + 1) * 256).cast("bigint").alias("increment_by"),
        F.when(F.col("s_acctbal") > 4000, "YES").otherwise("NO").alias("autoextensible"),
    )


FILES = """files AS (
  SELECT s_suppkey AS file_id, '/data/' || s_nationkey || '/' || s_name || '.dbf' AS file_name, 'NATION_' || s_nationkey AS tablespace_name,
    (floor(abs(s_acctbal))::BIGINT + 1) AS mb, ((s_nationkey + 1) * 256)::BIGINT AS increment_by,
    CASE WHEN s_acctbal > 4000 THEN 'YES' ELSE 'NO' END AS autoextensible FROM supplier
)"""


@query("right_size", f"""
WITH {EXTENTS}, {FILES}, x AS (
  SELECT file_id, max(block_id + blocks) AS last_block_id FROM extents GROUP BY file_id
), tbs AS (
  SELECT n_name AS tablespace_name, 4096 * (1 + n_regionkey) AS block_size, CASE WHEN n_regionkey <> 2 THEN n_nationkey * 1000000 + 1 END AS next_extent
  FROM nation WHERE n_regionkey <> 4
), d AS (
  SELECT f.*, last_block_id, block_size, greatest(8, coalesce(ceil(next_extent / 1048576), 8),
    coalesce(CASE WHEN autoextensible = 'YES' THEN increment_by * block_size / 1048576 END, 8)) AS rounding_mb,
    (2 + coalesce(last_block_id, 0)) * block_size / 1048576 AS needed
  FROM files f JOIN tbs USING (tablespace_name) LEFT JOIN x USING (file_id)
), g AS (
  SELECT *, (ceil(needed / 8) * 8)::BIGINT AS min_mb, ceil(ceil(needed / rounding_mb) * rounding_mb)::BIGINT AS opt_mb FROM d
), p AS (
  SELECT *, CASE WHEN min_mb > 1 THEN 1::BIGINT << length(bin(min_mb - 1)) ELSE 1 END AS max_mb FROM g
)
SELECT tablespace_name, file_name, file_id, last_block_id, block_size, mb::DOUBLE AS current_mb, rounding_mb, min_mb, opt_mb, max_mb,
  round((mb - opt_mb) / 1024, 1) AS opt_savings_gb, round(100 * (1 - opt_mb / mb), 0) AS opt_savings_pct,
  CASE WHEN mb <> opt_mb THEN 'alter database datafile ' || file_id || ' resize ' || opt_mb || 'm;' END AS sql_opt,
  round((mb - min_mb) / 1024, 1) AS max_savings_gb, round(100 * (1 - min_mb / mb), 0) AS max_savings_pct,
  CASE WHEN mb <> min_mb THEN 'alter database datafile ' || file_id || ' resize ' || min_mb || 'm;' END AS sql_min,
  'alter database datafile ' || file_id || ' autoextend on maxsize ' || max_mb || 'm;' AS sql_max
FROM p""")
def right_size_query(t: Tables):
    tablespaces = t.nation.where(F.col("n_regionkey") != 4).select(
        F.col("n_name").alias("tablespace_name"), (4096 * (1 + F.col("n_regionkey"))).alias("block_size"),
        F.when(F.col("n_regionkey") != 2, F.col("n_nationkey") * 1_000_000 + 1).alias("next_extent"),
        F.lit("PERMANENT").alias("contents"),
    )
    return space.right_size(supplier_extents(t), supplier_files(t), tablespaces)


@query("segment_dop", f"WITH {EXTENTS} SELECT * FROM sized")
def segment_dop_query(t: Tables):
    return space.segment_dop(supplier_extents(t), max_dop=6, mb_per_thread=8)


def _classified(t: Tables) -> DataFrame:
    """Suppliers' account balances decide what their segments belong to."""
    s = t.supplier.select(
        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("owner"), "s_name", F.col("s_acctbal").alias("b")
    )
    indexes = s.where("b > 3000").select(
        "owner", F.col("s_name").alias("index_name"), F.when(F.col("b") > 8000, "LOB").when(F.col("b") > 6000, "IOT - TOP").otherwise("NORMAL").alias("index_type"),
        F.col("owner").alias("table_owner"), F.concat(F.lit("T_"), "owner").alias("table_name"),
    )
    lobs = s.where("b < 5000").select(
        "owner", F.col("s_name").alias("segment_name"), F.lit("DOCS").alias("table_name"), F.lit("Body").alias("column_name")
    )
    varrays = s.where("b < 1500").select(
        "owner", F.col("s_name").alias("lob_name"), F.lit("DOCS").alias("parent_table_name"), F.lit("BODY").alias("parent_table_column")
    )
    parts = lobs.select(
        F.col("owner").alias("table_owner"), "table_name", "column_name", F.col("segment_name").alias("lob_name"),
        F.lit("P_A").alias("lob_partition_name"), F.lit("DOCS_A").alias("partition_name"),
        F.lit("P_R").alias("lob_subpartition_name"), F.lit("DOCS_R").alias("subpartition_name"),
    )
    nested = s.where("b > 9000").select(
        "owner", F.col("s_name").alias("table_name"), F.lit("PARENT").alias("parent_table_name"), F.lit("KIDS").alias("parent_table_column")
    )
    segments = space.segment_dop(supplier_extents(t), max_dop=6, mb_per_thread=8)
    return space.classify_segments(segments, indexes, lobs, varrays, parts, parts, nested)


CLASSIFIED = f"""{EXTENTS}, joined AS (
  SELECT s.*, CASE WHEN b > 8000 THEN 'LOB' WHEN b > 6000 THEN 'IOT - TOP' WHEN b > 3000 THEN 'NORMAL' END AS index_type,
    CASE WHEN b > 3000 THEN owner END AS index_table_owner, CASE WHEN b > 3000 THEN 'T_' || owner END AS index_table,
    CASE WHEN b < 5000 THEN owner END AS lob_table_owner, CASE WHEN b < 5000 THEN 'DOCS' END AS lob_table,
    CASE WHEN b < 5000 THEN 'Body' END AS lob_column, CASE WHEN b < 1500 THEN 'DOCS' END AS varray_table,
    CASE WHEN b < 1500 THEN 'BODY' END AS varray_column,
    CASE WHEN b < 5000 AND partition_name = 'P_A' THEN 'DOCS_A' END AS lob_table_partition,
    CASE WHEN b < 5000 AND partition_name = 'P_R' THEN 'DOCS_R' END AS lob_table_subpartition,
    CASE WHEN b > 9000 THEN 'PARENT' END AS nested_table, CASE WHEN b > 9000 THEN 'KIDS' END AS nested_column
  FROM sized s JOIN (SELECT s_name, s_acctbal AS b FROM supplier) ON s_name = segment_name
), ranked AS (
  SELECT *, CASE WHEN index_type = 'IOT - TOP' THEN 2 WHEN segment_type LIKE 'INDEX%' THEN 9 WHEN segment_type LIKE 'LOB%' THEN 5 ELSE 1 END AS class_rank
  FROM joined WHERE index_type IS DISTINCT FROM 'LOB'
), classified AS (
  SELECT *, row_number() OVER (ORDER BY class_rank, size_mb, owner, segment_name, partition_name NULLS LAST, segment_type, tablespace_name) AS row_no,
    count(*) OVER () AS rows_total FROM ranked
)"""


@query("classify_segments", f"WITH {CLASSIFIED} SELECT * FROM classified")
def classify_segments_query(t: Tables):
    return _classified(t)


def _quote(x: str) -> str:
    return f"CASE WHEN {x} = upper({x}) AND regexp_full_match({x}, '[A-Z][A-Z0-9_$#]*') THEN lower({x}) ELSE '\"' || {x} || '\"' END"


def _maintenance_sql() -> str:
    own = f"{_quote('owner')} || '.' || {_quote('segment_name')}"
    lob_table = f"{_quote('lob_table_owner')} || '.' || {_quote('lob_table')}"
    par = "CASE WHEN dop > 1 THEN ' parallel ' || dop ELSE '' END"
    to = "' tablespace ${tablespace}'"
    part = _quote("partition_name")
    lob = f"' lob (' || {_quote('lob_column')} || ') store as'"
    return f"""
WITH {CLASSIFIED}, texts AS (
  SELECT owner, tablespace_name, row_no, CASE
    WHEN segment_type = 'INDEX' AND index_type = 'IOT - TOP' THEN
      'alter table ' || {_quote('index_table_owner')} || '.' || {_quote('index_table')} || ' move' || {to} || {par} || ' online'
    WHEN segment_type = 'TABLE PARTITION' THEN 'alter table ' || {own} || ' move partition ' || {part} || {to} || {par} || ' online'
    WHEN segment_type = 'TABLE SUBPARTITION' THEN 'alter table ' || {own} || ' move subpartition ' || {part} || {to} || {par} || ' online'
    WHEN segment_type = 'INDEX' THEN 'alter index ' || {own} || ' rebuild online' || {to} || {par} || ' compute statistics'
    WHEN segment_type = 'INDEX PARTITION' THEN 'alter index ' || {own} || ' rebuild partition ' || {part} || ' online' || {to} || {par} || ' compute statistics'
    WHEN segment_type IN ('LOBSEGMENT', 'LOB PARTITION') AND (lob_table IS NULL OR lob_column IS NULL) THEN
      '-- WARNING: Dunno how to move ' || lower(segment_type) || ' "' || owner || '"."' || segment_name || '"'
    WHEN segment_type = 'LOBSEGMENT' AND varray_table IS NOT NULL THEN 'alter table ' || {lob_table} || ' move' || {par} || ' online varray '
      || {_quote('lob_column')} || ' store as lob ' || {_quote('segment_name')} || ' (tablespace ${{tablespace}})'
    WHEN segment_type = 'LOBSEGMENT' THEN 'alter table ' || {lob_table} || ' move' || {par} || ' online'
      || {lob} || ' ' || {_quote('segment_name')} || ' (tablespace ${{tablespace}})'
    WHEN segment_type = 'LOB PARTITION' THEN 'alter table ' || {lob_table} || ' move partition '
      || coalesce({_quote('lob_table_partition')}, '') || {par} || ' online' || {lob} || ' (tablespace ${{tablespace}})'
    END AS txt FROM classified
), owners AS (SELECT DISTINCT owner FROM texts), steps AS (
  SELECT '10:' || md5(tablespace_name) || ':01:move to transient' AS block,
    row_number() OVER (PARTITION BY tablespace_name ORDER BY row_no DESC) AS cmd, replace(txt, '${{tablespace}}', 'tmp_move') || ';' AS s FROM texts
  UNION ALL SELECT '10:' || md5(tablespace_name) || ':02:move back to persistent',
    row_number() OVER (PARTITION BY tablespace_name ORDER BY row_no), replace(txt, '${{tablespace}}', {_quote('tablespace_name')}) || ';' FROM texts
  UNION ALL SELECT '01:grant quota on transient', row_number() OVER (ORDER BY owner), 'alter user ' || {_quote('owner')} || ' quota unlimited on tmp_move;' FROM owners
  UNION ALL SELECT '91:revoke quota on transient', row_number() OVER (ORDER BY owner DESC), 'alter user ' || {_quote('owner')} || ' quota 0 on tmp_move;' FROM owners
  UNION ALL SELECT b, 0, 'select count(1) as leftovers_in_transient_tbs from dba_segments where tablespace_name = ''TMP_MOVE'';'
    FROM (VALUES ('02:leftovers in transient'), ('92:leftovers in transient')) v(b)
), numbered AS (
  SELECT block, cmd, row_number() OVER (ORDER BY block, cmd) AS i, count(*) OVER () AS n, s FROM steps
)
SELECT block, cmd, i, n, s || ' -- ' || i || '/' || n AS step FROM numbered"""


@query("maintenance_plan", _maintenance_sql())
def maintenance_plan_query(t: Tables):
    return maintenance.maintenance_plan(_classified(t), "TMP_MOVE", online="yes", statistics="yes")


@query("maintenance_text", f"""
WITH plan AS ({_maintenance_sql()}) SELECT row_number() OVER (ORDER BY block, cmd) AS line_number, step AS line FROM plan""")
def maintenance_text_query(t: Tables):
    """The plan as a script of several files, read back in order."""
    plan = maintenance.maintenance_plan(_classified(t), "TMP_MOVE", online="yes", statistics="yes")
    path = work_folder(t.spark, "script")
    write_ordered_text(plan, ["block", "cmd"], "step", path, tasks=4)
    return read_ordered_text(t.spark, path)


@query("container_plan", f"""
WITH {FILES}, newest AS (
  SELECT *, row_number() OVER (PARTITION BY tablespace_name ORDER BY file_id DESC) AS r FROM files
), c AS (
  SELECT *, 8192.0::DOUBLE AS bs, regexp_replace(file_name, '[^/]+$', '') AS folder, round(increment_by * 8192 / 1048576)::BIGINT AS step,
    ceil(mb * 1280 * 8192.0 / 1048576 / 1024)::BIGINT AS lim FROM newest WHERE r = 1
)
SELECT tablespace_name, file_id, file_name, bs AS block_size_b, folder AS data_file_path,
  'create smallfile tablespace "' || tablespace_name || '$N_20240131_12" datafile ''' || folder || lower(tablespace_name) || '.20240131_12.dbf'' size '
    || step || 'm' || CASE WHEN autoextensible = 'YES' THEN ' autoextend on next ' || step || 'm maxsize ' || lim || 'g;' ELSE '' END AS sql_create,
  'alter tablespace "' || tablespace_name || '" rename to "' || tablespace_name || '$O_20240131_12";' AS sql_rename_old,
  'alter tablespace "' || tablespace_name || '$N_20240131_12" rename to "' || tablespace_name || '";' AS sql_rename_new
FROM c""")
def container_plan_query(t: Tables):
    return maintenance.container_plan(supplier_files(t), datetime(2024, 1, 31, 12))


@query("invalid_levels", f"""
WITH l0 AS (
  SELECT upper(p_brand) AS owner, 'P' || p_partkey AS index_name, 0 AS level, NULL::VARCHAR AS subobject_name, '' AS part FROM part
  WHERE p_type <> 'STANDARD' AND p_type <> 'SMALL' AND p_size <> 1
), l1 AS (
  SELECT lower(o_orderpriority) AS owner, 'O' || o_orderkey AS index_name, 1 AS level, o_orderstatus AS subobject_name, ' partition ' || lower(o_orderstatus) AS part
  FROM orders WHERE o_orderstatus <> 'F'
), l2 AS (
  SELECT 'S' || l_suppkey AS owner, 'L' || l_orderkey AS index_name, 2 AS level, l_returnflag || l_linenumber AS subobject_name,
    ' subpartition ' || lower(l_returnflag) || l_linenumber AS part FROM lineitem WHERE l_linestatus = 'O'
)
SELECT owner, index_name, level, subobject_name, 'alter index ' || {_quote('owner')} || '.' || lower(index_name) || ' rebuild' || part || ' online;' AS sql
FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE owner NOT IN ('SYS', 'SYSTEM')""")
def invalid_levels_query(t: Tables):
    status = F.when(F.col("p_type") == "STANDARD", "VALID").when(F.col("p_type") == "SMALL", "USABLE").otherwise("UNUSABLE")
    indexes = t.part.select(
        F.upper("p_brand").alias("owner"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("index_name"),
        F.when(F.col("p_size") == 1, "IOT - TOP").otherwise("NORMAL").alias("index_type"),
        status.alias("status"), F.when(F.col("p_size") > 25, "NO").alias("partitioned"),
    )
    partitions = t.orders.select(
        F.lower("o_orderpriority").alias("index_owner"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("index_name"),
        F.col("o_orderstatus").alias("partition_name"), F.lit(0).alias("subpartition_count"),
        F.when(F.col("o_orderstatus") == "F", "VALID").otherwise("UNUSABLE").alias("status"),
    )
    subpartitions = t.lineitem.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("index_owner"),
        F.concat(F.lit("L"), F.col("l_orderkey").cast("string")).alias("index_name"),
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("subpartition_name"),
        F.when(F.col("l_linestatus") == "O", "UNUSABLE").otherwise("USABLE").alias("status"),
    )
    return maintenance.invalid_levels(indexes, partitions, subpartitions, online=True)
