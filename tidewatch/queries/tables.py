"""Generated rows and rewritten tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import generate
from tidewatch.queries.registry import Tables, query
from tidewatch.session import work_folder
from tidewatch.sources import tables


def _summed(numbers: DataFrame) -> DataFrame:
    """Rows, sum, highest and exact number of different ones, which are set as bits: a map of 4 KB for a range of 32,768 numbers."""
    maps = numbers.groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("x").alias("total"), F.max("x").alias("highest"),
        F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("seen"))
    return maps.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("total").alias("total"), F.max("highest").alias("highest"),
        F.coalesce(F.sum(F.bitmap_count("seen")), F.lit(0)).alias("different"))


@query("seq_range", """
SELECT count(*) AS rows, sum(x)::BIGINT AS total, max(x) AS highest, count(DISTINCT x) AS different
FROM (SELECT row_number() OVER () - 1 AS x FROM lineitem)""")
def seq_range_query(t: Tables):
    return _summed(generate.sequence_rows(t.spark, t.lineitem.count()))


@query("seq_cross", """
WITH n AS (SELECT count(*) AS n FROM lineitem), d AS (SELECT unnest(range(floor(sqrt(n))::BIGINT)) AS x, trunc(sqrt(n) + 1)::BIGINT AS stride FROM n)
SELECT count(*) AS rows, sum(a.x * a.stride + b.x)::BIGINT AS total, max(a.x * a.stride + b.x) AS highest,
  count(DISTINCT a.x * a.stride + b.x) AS different FROM d a CROSS JOIN d b""")
def seq_cross_query(t: Tables):
    return _summed(generate.sequence_grid(t.spark, t.lineitem.count()))


def _random_sql(n: int) -> str:
    return f"upper(substr(md5('rows-{n}:' || o_orderkey || ':0'), 1, {n})) AS col_{n}"


@query("random_rows", f"SELECT o_orderkey AS id, {', '.join(_random_sql(n) for n in (1, 2, 8, 32))} FROM orders")
def random_rows_query(t: Tables):
    return generate.random_rows(t.orders, "o_orderkey")


def _log_sql(preload: bool, seconds: int) -> str:
    return f"""
SELECT {'-' if preload else ''}o_orderkey AS id, {'o_orderkey' if preload else 'NULL::BIGINT'} AS process_log_oid,
  CASE WHEN o_orderkey % 100 = 17 THEN 'DOC' END AS object_type, o_orderkey AS doc_id,
  TIMESTAMP '2022-01-01' + to_seconds(o_orderkey * {seconds}) AS message_date, CASE WHEN o_orderkey % 100 = 17 THEN o_orderkey END AS mess_dict_id,
  (['I', 'W', 'E'])[o_orderkey % 3 + 1] AS message_type, '{'archive' if preload else 'iteration'}_' || o_orderkey AS message_name,
  NULL::VARCHAR AS synch_tag, 'X' AS partition_key FROM orders"""


@query("log_rows", _log_sql(True, 12))
def log_rows_query(t: Tables):
    return generate.log_rows(t.orders, "o_orderkey")


@query("log_rows_inserts", _log_sql(False, 60))
def log_rows_inserts_query(t: Tables):
    return generate.log_rows(t.orders, "o_orderkey", seconds=60, preload=False)


@query("assign_ids", """
SELECT o_orderkey, 1 + 10 * (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS id FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, -o_orderkey FROM orders WHERE o_orderstatus <> 'P'""")
def assign_ids_query(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") != "P", -F.col("o_orderkey")).alias("id"))
    return generate.assign_ids(rows, "id", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


# A third of the keys is removed, as a closed range from 1.
# Some keys are null and some negative; their rows stay.
PURGED = """
WITH keyed AS (SELECT *, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN -l_orderkey ELSE l_orderkey END AS key FROM lineitem)
SELECT * FROM keyed WHERE key IS NULL OR NOT key BETWEEN 1 AND (SELECT max(l_orderkey) // 3 FROM lineitem)"""


def _keyed(t: Tables) -> DataFrame:
    number, key = F.col("l_linenumber"), F.col("l_orderkey")
    return t.lineitem.withColumn("key", F.when(number == 7, None).when(number == 6, -key).otherwise(key))


def _bound(t: Tables) -> int:
    return t.lineitem.agg(F.max("l_orderkey")).first()[0] // 3


@query("purge_range", PURGED)
def purge_range_query(t: Tables):
    return tables.purge_range(_keyed(t), "key", 1, _bound(t))


@query("purge_keys", """
SELECT * FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def purge_keys_query(t: Tables):
    finished = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.purge_keys(t.lineitem, finished, "l_orderkey")


@query("purge_partitions", PURGED)
def purge_partitions_query(t: Tables):
    # A database of its own keeps the managed table, and the files it drops, in the shared folder.
    path = work_folder(t.spark, "ranges")
    database = path.rsplit("/", 1)[1].replace("-", "_")
    t.spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    name = f"{database}.lines"
    width = max(1, _bound(t) // 7)  # a share of the key range, so that partitions do not grow in number with it
    tables.create_range_table(_keyed(t), name, "key", width)
    return tables.purge_partitions(t.spark, name, "key", width, 1, _bound(t)).drop("bucket")


@query("partitioned_rewrite", """
SELECT ts::DATE AS day, event_type, count(*) AS rows, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1, 2""")
def partitioned_rewrite_query(t: Tables):
    days = tables.rewrite_partitioned(t.events, "day", F.to_date("ts"), work_folder(t.spark, "events-by-day"))
    return days.groupBy("day", "event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    )
