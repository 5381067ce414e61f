"""Interval statistics: daily roll-up, detail with recency, intervals and their reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.nulls import null_if_blank, text_concat
from tidewatch.functions.times import moment
from tidewatch.operators.ordered import latest_per_key, number_rows

# Fixed values: (output name, statistic) of the daily roll-up, by unit.
DAILY_COUNTS = (
    ("execs", "executions"), ("rows", "rows_processed"), ("execs_px", "px_servers_execs"),
    ("parses", "parse_calls"), ("fetches", "fetches"), ("sorts", "sorts"), ("io_buffers", "buffer_gets"),
    ("io_reads", "disk_reads"), ("pio_reads", "physical_read_requests"),
    ("pio_reads_opt", "optimized_physical_reads"), ("pio_writes", "physical_write_requests"),
    ("io_writes_dir", "direct_writes"),
)
DAILY_MB = (
    ("pio_reads_mb", "physical_read_bytes"), ("pio_writes_mb", "physical_write_bytes"),
    ("io_netw_mb", "io_interconnect_bytes"),
)
DAILY_SECONDS = (
    ("ela_time_s", "elapsed_time"), ("cpu_time_s", "cpu_time"), ("pls_time_s", "plsexec_time"),
    ("wait_io_s", "iowait"), ("wait_cl_s", "clwait"), ("wait_app_s", "apwait"), ("wait_cc_s", "ccwait"),
)
# Fixed values: (output name, statistic) of the detail, by unit; each has a total and a delta.
DETAIL_COUNTS = (
    ("execs", "executions"), ("fetches", "fetches"), ("sorts", "sorts"), ("px_execs", "px_servers_execs"),
    ("loads", "loads"), ("parses", "parse_calls"), ("rows", "rows_processed"), ("io_lios", "buffer_gets"),
    ("io_reads", "disk_reads"), ("io_ph_reads", "physical_read_requests"), ("io_dir_writes", "direct_writes"),
    ("io_ph_writes", "physical_write_requests"),
)
DETAIL_MS = (
    ("t_ela", "elapsed_time"), ("t_cpu", "cpu_time"), ("t_iowait", "iowait"), ("t_clwait", "clwait"),
    ("t_java", "javexec_time"), ("t_plsql", "plsexec_time"), ("t_apwait", "apwait"), ("t_ccwait", "ccwait"),
)
DETAIL_MB = (
    ("io_ph_read", "physical_read_bytes"), ("io_ph_write", "physical_write_bytes"),
    ("io_cluster", "io_interconnect_bytes"),
)

SNAPSHOT_KEYS = ("snap_id", "instance_number")


def file_stamp(time: Column) -> Column:
    return F.date_format(time, "yyyyMMdd_HHmmss")


def daily_rollup(
    stats: DataFrame,
    snapshots: DataFrame,
    sql_id: str | None = None,
    keys: Sequence[str] = SNAPSHOT_KEYS,
) -> DataFrame:
    """Statistics per day and instance, for one statement or for all.

    Rows are first summed per day, instance, schema and module, so the two distinct lists are
    collected from a small remainder.
    """
    if sql_id is not None:
        stats = stats.where(F.col("sql_id") == sql_id)
    rows = stats.join(snapshots.select(*keys, "begin_interval_time"), list(keys))
    group = [F.lower(F.date_format("begin_interval_time", "yyyy-MM-dd EEEE")).alias("occurrence"), F.col("instance_number")]
    measured = [name for part in (DAILY_COUNTS, DAILY_MB, DAILY_SECONDS) for _, name in part]
    fine = rows.groupBy(*group, "parsing_schema_name", "module").agg(
        *[F.sum(f"{name}_delta").alias(name) for name in measured]
    )
    return fine.groupBy("occurrence", "instance_number").agg(
        *[F.sum(name).alias(out) for out, name in DAILY_COUNTS],
        *[F.round(F.sum(name) / 1_048_576, 0).alias(out) for out, name in DAILY_MB],
        *[F.round(F.sum(name) / 1_000_000, 3).alias(out) for out, name in DAILY_SECONDS],
        null_if_blank(F.array_join(F.array_sort(F.collect_set("parsing_schema_name")), "|")).alias("users"),
        null_if_blank(F.array_join(F.array_sort(F.collect_set("module")), "|")).alias("modules"),
    )


def stats_detail(
    stats: DataFrame,
    snapshots: DataFrame,
    users: DataFrame,
    latest_only: bool = False,
    keys: Sequence[str] = SNAPSHOT_KEYS,
    tie: Sequence[str] = ("instance_number", "snap_id"),
    hot_rows: int | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Total and delta of every statistic in readable units, ranked newest first within
    module, action, statement, plan and day. ``latest_only`` keeps rank 1.

    Rows of one snapshot have its time, so for ``latest_only`` each task keeps the newest by ``tie`` of
    every snapshot before any join: rows between tasks grow with snapshots, not with statistics.
    """
    names = ["module", "action", "sql_id", "plan_hash_value"]
    if latest_only:
        stats = latest_per_key(stats, [*names, *keys], [F.col(c) for c in tie])
    rows = stats.join(snapshots.select(*keys, "begin_interval_time"), list(keys))
    known = users.select(F.col("user_id").alias("parsing_user_id"), F.col("username").alias("p_user"))
    rows = rows.join(known, "parsing_user_id", "left")
    rows = rows.withColumn("_day", F.to_date("begin_interval_time"))
    group = [*names, "_day"]
    if latest_only:
        newest = latest_per_key(rows, group, [F.col("begin_interval_time"), *[F.col(c) for c in tie]])
        ranked = newest.withColumn("rank", F.lit(1).cast("bigint"))
    else:
        order = ["-begin_interval_time", *[f"-{c}" for c in tie]]
        ranked = number_rows(rows, group, order, "rank", hot_rows=hot_rows, chunks=chunks)
    units = [(out, name, 1, "") for out, name in DETAIL_COUNTS]
    units += [(out, name, 1_000, "_ms") for out, name in DETAIL_MS]
    units += [(out, name, 1_048_576, "_mb") for out, name in DETAIL_MB]
    measures = []
    for out, name, divisor, unit in units:
        for suffix, mark in (("total", ""), ("delta", "_d")):
            source = f"{name}_{suffix}"
            if source in stats.columns:
                column = F.col(source)
                measures.append((column if divisor == 1 else column / divisor).alias(f"{out}{mark}{unit}"))
    return ranked.select(
        "begin_interval_time", "rank", "snap_id", F.col("instance_number").alias("inst_id"),
        "sql_id", "plan_hash_value", F.col("force_matching_signature").alias("sql_f_m_sig"), "module", "action", "sql_profile",
        F.col("parsing_schema_id").alias("p_schema_id"), F.col("parsing_schema_name").alias("p_schema"), "parsing_user_id", "p_user", *measures,
    )


def snapshots_in_range(
    snapshots: DataFrame, database: DataFrame, time_from: datetime, time_to: datetime
) -> DataFrame:
    """Intervals of the current database that overlap the range, with a report file name."""
    overlap = (F.col("end_interval_time") >= moment(snapshots, "end_interval_time", time_from)) & (
        F.col("begin_interval_time") <= moment(snapshots, "begin_interval_time", time_to)
    )
    current = database.select("dbid").distinct()
    name = text_concat("instance_", F.col("instance_number"), ".", file_stamp(F.col("end_interval_time")), ".html")
    return snapshots.where(overlap).join(current, "dbid", "left_semi").withColumn("file_name", name)


def snapshot_span(snapshots: DataFrame, database: DataFrame, time_from: datetime, time_to: datetime) -> DataFrame:
    """The overlapping intervals merged into one per database and instance."""
    spans = snapshots_in_range(snapshots, database, time_from, time_to).groupBy("dbid", "instance_number").agg(
        F.min("snap_id").alias("snap_id_from"),
        F.min("begin_interval_time").alias("begin_interval_time"),
        F.max("snap_id").alias("snap_id_to"),
        F.max("end_interval_time").alias("end_interval_time"),
    )
    name = text_concat(
        "instance_", F.col("instance_number"), ".from_", file_stamp(F.col("begin_interval_time")),
        ".to_", file_stamp(F.col("end_interval_time")), ".html",
    )
    return spans.withColumns({"report_from": F.col("snap_id_from") - 1, "file_name": name})


def interval_report(intervals: DataFrame, stats: DataFrame, group: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """What happened in each interval, tagged with its report file.

    Takes single intervals (``snap_id``) or spans (``snap_id_from``, ``snap_id_to``). A
    statistics row of snapshot n describes the time from snapshot n - 1 to n, so it belongs
    to the interval ending at n. Rows are summed per snapshot before they meet intervals.
    """
    keys = ["dbid", "instance_number"]
    fine = stats.groupBy(*keys, "snap_id", *group).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(m).alias(m) for m in measures]
    )
    if "snap_id" in intervals.columns:
        matched = fine.join(intervals.select(*keys, "snap_id", "file_name"), [*keys, "snap_id"])
    else:
        spans = intervals.select(*keys, "report_from", "snap_id_to", "file_name")
        inside = (F.col("snap_id") > F.col("report_from")) & (F.col("snap_id") <= F.col("snap_id_to"))
        matched = fine.join(spans, keys).where(inside)
    return matched.groupBy("file_name", *group).agg(
        F.sum("rows").alias("rows"), *[F.sum(m).alias(m) for m in measures]
    )


def report_lines(report: DataFrame, group: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The text of every interval's report: (file_name, line_number, line).

    A report begins with its name, lists its rows by the group columns and ends with the
    sums. It is written by a table function that is called once per report and reads its rows in order,
    one at a time, so a report of any length needs no memory. Null names read as empty.
    """
    measures = ["rows", *measures]

    class Lines:
        def __init__(self):
            self.number, self.sums, self.name = 0, [0] * len(measures), None

        def _line(self, text):
            self.number += 1
            return self.name, self.number, text

        def eval(self, row):
            if not self.number:
                self.name = row["file_name"]
                yield self._line(f"report {self.name}")
            values = [row[m] or 0 for m in measures]
            self.sums = [a + b for a, b in zip(self.sums, values)]
            label = " / ".join("" if row[g] is None else str(row[g]) for g in group)
            yield self._line(f"{label}: " + ", ".join(f"{m} {v}" for m, v in zip(measures, values)))

        def terminate(self):
            if self.number:
                yield self._line("all: " + ", ".join(f"{m} {v}" for m, v in zip(measures, self.sums)))

    lines = F.udtf(Lines, returnType="file_name string, line_number bigint, line string")
    rows = report.select("file_name", *group, *[F.col(m).cast("bigint").alias(m) for m in measures])
    return lines(rows.asTable().partitionBy("file_name").orderBy(*[F.asc_nulls_last(g) for g in group]))
