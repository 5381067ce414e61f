"""Benchmark measurement: unpivot, before/after differences, run statistics, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import match_by, number_rows, same_keys

# The statement counters that a measurement records.
COUNTERS = (
    "elapsed_time", "cpu_time",
    "loads", "invalidations", "parse_calls", "executions", "avoided_executions", "px_servers_executions",
    "fetches", "end_of_fetch_count", "rows_processed",
    "users_opening", "users_executing",
    "open_versions", "loaded_versions", "kept_versions", "serializable_aborts",
    "child_latch",
    "im_scans", "im_scan_bytes_inmemory", "im_scan_bytes_uncompressed",
    "buffer_gets", "disk_reads", "direct_reads", "direct_writes", "sorts",
    "physical_write_requests", "physical_write_bytes", "physical_read_requests", "physical_read_bytes",
    "optimized_phy_read_requests",
    "locked_total", "pinned_total",
    "io_interconnect_bytes", "io_cell_uncompressed_bytes", "io_cell_offload_returned_bytes",
    "io_cell_offload_eligible_bytes",
    "sharable_mem", "persistent_mem", "runtime_mem", "typecheck_mem",
    "application_wait_time", "concurrency_wait_time", "user_io_wait_time", "cluster_wait_time",
    "plsql_exec_time", "java_exec_time",
)
# Measures of a wait event, and those that decide whether it changed.
EVENT_MEASURES = ("total_waits", "total_timeouts", "time_waited", "average_wait", "max_wait", "time_waited_micro")
EVENT_DECIDERS = ("total_waits", "total_timeouts", "time_waited_micro")

# Fixed values: (name pattern, label, divisor), first match wins; ``!`` escapes.
SPACED_UNITS = (
    ("% time", " [s]", 1_000_000),
    ("% size", " [MB]", 1_048_576),
    ("% bytes", " [MB]", 1_048_576),
    ("% bytes from cache", " [MB]", 1_048_576),
)
UNDERSCORED_UNITS = (
    ("%!_mem", " [MB]", 1_048_576),
    ("%!_bytes", " [MB]", 1_048_576),
    ("%!_time", " [s]", 1_000_000),
)
RUN_CLASSES = (1, 2, 3, 4, 5)
RUN_IDS = (10, 11, 12, 13, 20, 21, 22, 23, 30, 31, 32, 33, 40, 41, 42, 43)


def unpivot_counters(df: DataFrame, keys: Sequence[str], counters: Sequence[str] = COUNTERS) -> DataFrame:
    """Wide counters as (stat_name, stat_value), nulls kept, summed per key and name."""
    tall = df.unpivot(list(keys), list(counters), "stat_name", "stat_value")
    return tall.groupBy(*keys, F.lower("stat_name").alias("stat_name")).agg(F.sum("stat_value").alias("stat_value"))


def merge_post(saved: DataFrame, post: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Upsert post values into saved rows by key.

    ``saved`` has ``<measure>_pre`` and ``<measure>_post``; ``post`` has ``<measure>``. Saved
    rows without a new value keep what they had; new rows have a null pre value. The key is
    unique on both sides; a null in it matches a null.
    """
    others = [c for c in post.columns if c not in (*keys, *measures)]
    left = saved.withColumns({f"_old_{c}": F.col(c) for c in others if c in saved.columns}).drop(
        *others, *[f"{m}_diff" for m in measures]
    )
    fresh = post.withColumn("_seen", F.lit(True)).withColumnsRenamed({k: f"_post_{k}" for k in keys})
    joined = left.join(fresh, same_keys(left, fresh, [(k, f"_post_{k}") for k in keys]), "full")
    joined = joined.withColumns({k: F.when(F.col("_seen"), F.col(f"_post_{k}")).otherwise(F.col(k)) for k in keys})
    columns = {m: F.when(F.col("_seen"), F.col(m)).otherwise(F.col(f"{m}_post")).alias(f"{m}_post") for m in measures}
    kept = [F.coalesce(f"_old_{c}", c).alias(c) if c in saved.columns else F.col(c) for c in others]
    out = joined.select(*keys, *kept, *[F.col(f"{m}_pre") for m in measures], *columns.values())
    return with_difference(out, measures)


def with_difference(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """``<measure>_diff`` = post − pre, a missing pre counting as 0."""
    return df.withColumns(
        {f"{m}_diff": F.col(f"{m}_post") - F.coalesce(F.col(f"{m}_pre"), F.lit(0)) for m in measures}
    )


def diff_nonzero(
    pre: DataFrame,
    post: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str] = EVENT_MEASURES,
    deciders: Sequence[str] = EVENT_DECIDERS,
    null_as_zero: bool = True,
) -> DataFrame:
    """Difference of two measurements by key, keeping rows in which a decider is not zero.

    A row only in ``post`` keeps its own values. With ``null_as_zero`` a row only in ``pre``
    is taken over unchanged, which makes its differences zero; without, it is left out, and
    a null on either side of a subtraction stays null.
    """
    a, b = pre.alias("a"), post.alias("b").withColumn("_in_post", F.lit(True))
    a = a.withColumn("_in_pre", F.lit(True))
    joined = a.withColumnsRenamed({m: f"_pre_{m}" for m in measures}).join(
        b, list(keys), "full" if null_as_zero else "right"
    )

    def difference(m: str) -> Column:
        before, after = F.col(f"_pre_{m}"), F.col(m)
        if null_as_zero:
            after = F.when(F.col("_in_post"), after).otherwise(before)
            both = F.coalesce(after, F.lit(0)) - F.coalesce(before, F.lit(0))
        else:
            both = after - before
        return F.when(F.col("_in_pre"), both).otherwise(after).alias(m)

    return any_nonzero(joined.select(*keys, *[difference(m) for m in measures]), deciders)


def any_nonzero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which some column is known and not zero."""
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(c) != 0)
    return df.where(changed)


def median_per_key(
    df: DataFrame, keys: Sequence[str], value: str, out: str, hot_rows: int | None = None, chunks: int | None = None
) -> DataFrame:
    """Exact median of the known values per key, by position, so that no task holds a group."""
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    placed = number_rows(known, keys, [value], "_rn", total="_n", hot_rows=hot_rows, chunks=chunks)
    middle = F.col("_rn").isin(F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / 2))
    return placed.where(middle).groupBy(*keys).agg(F.avg(value).alias(out))


def run_class_stats(
    df: DataFrame, min_runs: int = 4, hot_rows: int | None = None, chunks: int | None = None
) -> DataFrame:
    """Per run class and statistic: median, sample deviation, deviation in percent, runs.

    The class is the tens of the run id. Zero differences are left out first; classes with
    few runs, or with neither a median nor a deviation, last. The median is the built-in one, which
    keeps the distinct values of a class; with ``hot_rows`` it is found by position instead, for
    classes of any number of runs.
    """
    keys = ["run_class", "stat_class_id", "stat_name"]
    rows = df.where(F.col("stat_value_diff") != 0).withColumn("run_class", F.expr("run_id div 10"))
    rows = rows.withColumn("stat_value_diff", F.col("stat_value_diff").cast("double"))
    measures = [F.stddev("stat_value_diff").alias("stddev"), F.count(F.lit(1)).alias("runs")]
    if hot_rows is None:
        stats = rows.groupBy(*keys).agg(*measures, F.median("stat_value_diff").alias("median")).where(F.col("runs") >= min_runs)
    else:
        medians = median_per_key(rows, keys, "stat_value_diff", "median", hot_rows, chunks)
        stats = match_by(rows.groupBy(*keys).agg(*measures).where(F.col("runs") >= min_runs), medians, keys, "inner")
    percent = F.round(100 * F.col("stddev") / F.nullif(F.col("median"), F.lit(0.0)))
    return stats.where((F.col("median") != 0) | (F.col("stddev") != 0)).withColumn("stddev_pct", percent)


def label_units(
    df: DataFrame, value: str, rules: Sequence[tuple[str, str, int]] = SPACED_UNITS, digits: int | None = 3
) -> DataFrame:
    """Append the unit to each statistic's name and scale its value, by name pattern."""
    name = F.col("stat_name")
    label, scaled = F, F
    for pattern, unit, divisor in rules:
        hit = F.like(name, F.lit(pattern), F.lit("!"))
        number = F.col(value) / divisor
        label = label.when(hit, F.concat(name, F.lit(unit)))
        scaled = scaled.when(hit, number if digits is None else F.round(number, digits))
    return df.withColumns({"_label": label.otherwise(name), value: scaled.otherwise(F.col(value))}).withColumn(
        "stat_name", F.col("_label")
    ).drop("_label")


def pivot_runs(df: DataFrame, run: str, values: Sequence[int], value: str, prefix: str = "run_") -> DataFrame:
    """One column per listed run, grouped by every remaining column.

    Where a cell has several values the least is taken.
    """
    group = [c for c in df.columns if c not in (run, value)]
    pivoted = df.groupBy(*group).pivot(run, list(values)).agg(F.min(value))
    return pivoted.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values})
