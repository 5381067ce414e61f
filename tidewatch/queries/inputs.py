"""The given tables in the shape of telemetry inputs, in Spark and as SQL of the same name.

The SQL forms are common table expressions that the checking queries start with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(column: Column) -> Column:
    """Amounts with two decimals, so that sums do not depend on their order."""
    return column.cast("decimal(18,2)")


def money_sum(column: Column) -> Column:
    return F.sum(money(column)).cast("double")


def hour_number(ts: Column) -> Column:
    return (F.unix_date(ts.cast("date")).cast("bigint") * 24 + F.hour(ts)).cast("bigint")


def day_number(ts: Column) -> Column:
    return F.unix_date(ts.cast("date")).cast("bigint")


def k_of(props: Column) -> Column:
    return F.regexp_extract(props, r"(\d+)", 1).cast("int")


def inst_of(props: Column) -> Column:
    return (1 + F.floor(k_of(props) / 50)).cast("int")


def event_samples(events: DataFrame) -> DataFrame:
    """Events as session samples: the hour is the sample number, two event types are states."""
    k, value = k_of(F.col("props")), F.col("value")
    state = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type"))
    return events.select(
        "event_id",
        hour_number(F.col("ts")).alias("sample_id"),
        F.col("ts").alias("sample_time"),
        day_number(F.col("ts")).alias("snap_id"),
        F.lit(1).cast("bigint").alias("dbid"),
        inst_of(F.col("props")).alias("inst_id"),
        F.col("user_id").alias("session_id"),
        F.lit(1).alias("session_serial"),
        "user_id",
        F.when(k >= 50, "batch").alias("module"),
        state.alias("xid"),
        F.col("event_type").alias("sql_id"),
        F.when(k >= 25, F.col("event_type")).otherwise("none").alias("top_level_sql_id"),
        (k * 7).cast("bigint").alias("current_obj"),
        F.floor(k / 20).cast("int").alias("plsql_entry_object_id"),
        F.floor(k / 4).cast("int").alias("plsql_entry_subprogram_id"),
        F.floor(k / 20).cast("int").alias("plsql_object_id"),
        F.floor(k / 10).cast("int").alias("plsql_subprogram_id"),
        (F.round(value * 100).cast("bigint") * 10000).alias("wait_time"),
        (k.cast("bigint") * 1000000).alias("time_waited"),
        (k.cast("bigint") * 500000).alias("pga_allocated"),
        (F.round(value * 100).cast("bigint") * 7000).alias("temp_space_allocated"),
        k.cast("bigint").alias("blocking_session"),
        F.lit(1).alias("blocking_session_serial"),
        inst_of(F.col("props")).alias("blocking_inst_id"),
        F.unix_date(F.col("ts").cast("date")).cast("bigint").alias("sql_exec_id"),
        F.date_trunc("DAY", F.col("ts")).cast("timestamp_ntz").alias("sql_exec_start"),
    )


K_SQL = r"regexp_extract(props, '\d+')::INT"

EVENT_SAMPLES = r"""event_samples AS (
  SELECT event_id, epoch_us(ts) // 3600000000 AS sample_id, ts AS sample_time,
    epoch_us(ts) // 86400000000 AS snap_id, 1::BIGINT AS dbid, 1 + k // 50 AS inst_id,
    user_id AS session_id, 1 AS session_serial, user_id,
    CASE WHEN k >= 50 THEN 'batch' END AS module,
    CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END AS xid,
    event_type AS sql_id, CASE WHEN k >= 25 THEN event_type ELSE 'none' END AS top_level_sql_id,
    (k * 7)::BIGINT AS current_obj, k // 20 AS plsql_entry_object_id, k // 4 AS plsql_entry_subprogram_id,
    k // 20 AS plsql_object_id, k // 10 AS plsql_subprogram_id,
    round(value * 100)::BIGINT * 10000 AS wait_time, k::BIGINT * 1000000 AS time_waited,
    k::BIGINT * 500000 AS pga_allocated, round(value * 100)::BIGINT * 7000 AS temp_space_allocated,
    k::BIGINT AS blocking_session, 1 AS blocking_session_serial, 1 + k // 50 AS blocking_inst_id,
    epoch_us(ts) // 86400000000 AS sql_exec_id, date_trunc('day', ts)::TIMESTAMP AS sql_exec_start
  FROM (SELECT *, regexp_extract(props, '\d+')::INT AS k FROM events)
)"""


def event_snapshots(samples: DataFrame) -> DataFrame:
    """The days of the samples as snapshots of each instance."""
    return samples.groupBy("dbid", F.col("inst_id").alias("instance_number"), "snap_id").agg(
        F.min("sample_time").alias("begin_interval_time"), F.max("sample_time").alias("end_interval_time")
    )


def part_objects(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("object_id"), F.col("p_brand").alias("owner"),
        F.col("p_name").alias("object_name"), F.col("p_type").alias("object_type"),
    )


def nation_procedures(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_regionkey").alias("object_id"), F.col("n_nationkey").alias("subprogram_id"),
        F.lit("APP").alias("owner"), F.concat(F.lit("PKG_"), F.col("n_regionkey").cast("string")).alias("object_name"),
        F.when(F.col("n_nationkey") >= 10, F.col("n_name")).alias("procedure_name"),
        F.when(F.col("n_nationkey") >= 15, (F.col("n_nationkey") % 3).cast("string")).alias("overload"),
    )


def customer_sessions(customer: DataFrame) -> DataFrame:
    """Sessions still there: customers whose balance is not negative; some have no user name."""
    return customer.where("c_acctbal >= 0").select(
        F.col("c_nationkey").alias("inst_id"), F.col("c_custkey").alias("session_id"), F.lit(1).alias("session_serial"),
        F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("os"), F.col("c_custkey").cast("string"))).alias("os_user"),
    )


def customer_users(customer: DataFrame) -> DataFrame:
    """Customers as users; one market segment is left out, so that names can be missing."""
    return customer.where(F.col("c_mktsegment") != "MACHINERY").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username")
    )


DIMENSIONS = """users AS (
  SELECT c_custkey AS user_id, c_name AS username FROM customer WHERE c_mktsegment <> 'MACHINERY'
), objects AS (
  SELECT p_partkey AS object_id, p_brand AS owner, p_name AS object_name, p_type AS object_type FROM part
), procedures AS (
  SELECT n_regionkey AS object_id, n_nationkey AS subprogram_id, 'APP' AS owner,
    'PKG_' || n_regionkey AS object_name, CASE WHEN n_nationkey >= 10 THEN n_name END AS procedure_name,
    CASE WHEN n_nationkey >= 15 THEN (n_nationkey % 3)::VARCHAR END AS overload
  FROM nation
)"""
