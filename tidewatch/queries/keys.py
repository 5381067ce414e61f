"""Key, usage, id and purge queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import cleanup, keys
from tidewatch.operators.joins import not_in_tuple
from tidewatch.queries.inputs import day_number
from tidewatch.queries.registry import Tables, query


def _brand_columns(t: Tables) -> DataFrame:
    """Each order's brands as the columns of a key, in the order of their first line."""
    first = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey", "p_brand").agg(
        F.min("l_linenumber").alias("line")
    )
    # At most one row per brand and order, so a window holds no more rows than there are brands.
    by_line = Window.partitionBy("l_orderkey").orderBy("line", "p_brand")
    return first.select("l_orderkey", "p_brand", F.row_number().over(by_line).cast("bigint").alias("position"))


@query("uncovered_keys", """
WITH b AS (
  SELECT l_orderkey, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), p_brand) AS position
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, p_brand
), c AS (
  SELECT 'APP' AS owner, o_custkey AS table_name, o_orderkey AS constraint_name, p_brand AS column_name, position AS column_position,
    max(position) OVER (PARTITION BY o_orderkey) AS n
  FROM orders JOIN b ON l_orderkey = o_orderkey
  WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
), i AS (
  SELECT o_custkey AS table_name, o_orderkey AS index_name, p_brand AS column_name, position FROM orders JOIN b ON l_orderkey = o_orderkey
  WHERE o_orderstatus = 'O'
), m AS (
  SELECT c.*, i.index_name, count(i.column_name) OVER (PARTITION BY c.table_name, c.constraint_name, i.index_name) AS matched
  FROM c LEFT JOIN i ON i.table_name = c.table_name AND i.column_name = c.column_name AND i.position <= c.n
), a AS (
  SELECT *, count(CASE WHEN n <= matched THEN 1 END) OVER (PARTITION BY table_name, constraint_name) AS covering FROM m
)
SELECT owner, table_name, constraint_name, column_position, column_name, CASE WHEN index_name IS NOT NULL THEN 'IX' END AS nearest_index_owner,
  index_name AS nearest_index_name, CASE WHEN n <= matched THEN 'Y' ELSE 'N' END AS is_covering_index
FROM a WHERE covering = 0""")
def uncovered_keys_query(t: Tables):
    columns = _brand_columns(t).withColumnsRenamed({"p_brand": "column_name", "l_orderkey": "o_orderkey"})
    constraints = t.orders.select(
        F.lit("APP").alias("owner"), F.col("o_custkey").alias("table_name"), F.col("o_orderkey").alias("constraint_name"),
        F.when(F.col("o_orderstatus") == "F", "R").otherwise("C").alias("constraint_type"),
    )
    constraint_columns = columns.select(
        F.lit("APP").alias("owner"), F.col("o_orderkey").alias("constraint_name"), "column_name", "position"
    )
    indexes = t.orders.where(F.col("o_orderstatus") == "O").select(
        F.lit("IX").alias("owner"), F.col("o_orderkey").alias("index_name"), F.lit("APP").alias("table_owner"),
        F.col("o_custkey").alias("table_name"),
    )
    index_columns = columns.select(
        F.lit("IX").alias("index_owner"), F.col("o_orderkey").alias("index_name"), "column_name",
        F.col("position").alias("column_position"),
    )
    dropped = t.customer.where(F.col("c_acctbal") < 0).select(
        F.lit("APP").alias("owner"), F.col("c_custkey").alias("object_name"), F.lit("TABLE").alias("type")
    )
    return keys.uncovered_keys(constraints, constraint_columns, indexes, index_columns, dropped)


@query("usage_report", """
WITH uses AS (
  SELECT l_partkey, o_orderdate, o_orderkey, regexp_replace(CASE o_orderpriority WHEN '1-URGENT' THEN 'SQL Developer'
      WHEN '2-HIGH' THEN 'APEX:APP 10:' || o_custkey ELSE o_orderpriority END, 'APEX:APP\\s+\\d+:\\d+', 'APEX:APP ...') AS module,
    CASE WHEN o_orderpriority = '1-URGENT' OR o_custkey < 100 THEN 'Y' ELSE 'N' END AS is_user_query,
    CASE WHEN o_orderstatus = 'P' THEN 'Y' ELSE 'N' END AS is_dbms_stats_query
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), g AS (
  SELECT l_partkey, is_user_query, is_dbms_stats_query, min(o_orderdate) AS first_use, max(o_orderdate) AS last_use, count(*) AS rows,
    string_agg(DISTINCT 'q' || o_orderkey, ', ' ORDER BY 'q' || o_orderkey) AS sql_ids, string_agg(DISTINCT module, ', ' ORDER BY module) AS modules
  FROM uses GROUP BY l_partkey, is_user_query, is_dbms_stats_query
)
SELECT p_brand AS index_owner, 'P' || p_partkey AS index_name, p_type AS table_name, is_user_query, is_dbms_stats_query, first_use, last_use,
  coalesce(rows, 1) AS rows, sql_ids, modules
FROM part LEFT JOIN g ON l_partkey = p_partkey""")
def usage_report_query(t: Tables):
    name = lambda c: F.concat(F.lit("P"), F.col(c).cast("string"))
    sql_id = F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("sql_id")
    objects = t.part.select(F.col("p_brand").alias("owner"), name("p_partkey").alias("index_name"), F.col("p_type").alias("table_name"))
    plan_lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_brand").alias("object_owner"), name("l_partkey").alias("object_name"),
        F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("sql_id"), F.lit(1).alias("plan_hash_value"),
    )
    module = F.when(F.col("o_orderpriority") == "1-URGENT", "SQL Developer").when(
        F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("APEX:APP 10:"), F.col("o_custkey").cast("string"))
    ).otherwise(F.col("o_orderpriority"))
    stats = t.orders.select(
        sql_id, F.lit(1).alias("plan_hash_value"), module.alias("module"),
        F.when(F.col("o_custkey") < 100, F.concat(F.lit("USER"), F.col("o_custkey").cast("string"))).otherwise("APP").alias("parsing_schema_name"),
        day_number(F.col("o_orderdate")).alias("snap_id"), F.lit(1).alias("dbid"), F.lit(1).alias("instance_number"),
    )
    snapshots = t.orders.select(
        day_number(F.col("o_orderdate")).alias("snap_id"), F.lit(1).alias("dbid"), F.lit(1).alias("instance_number"),
        F.col("o_orderdate").alias("begin_interval_time"),
    ).distinct()
    texts = t.orders.select(
        sql_id,
        F.when(F.col("o_orderstatus") == "P", "select /* dbms_stats */ SYS_OP_COUNTCHG(x) ").otherwise("select sys_op_countchg(y)").alias("sql_text"),
    )
    return keys.usage_report(objects, plan_lines, stats, snapshots, texts)


@query("unused_attributes", """
WITH a AS (
  SELECT DISTINCT lang, unnest(regexp_extract_all(b.text, '[a-z]+')) AS word FROM benchmark b, (SELECT DISTINCT lang FROM documents) l
), w AS (
  SELECT DISTINCT lang, unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents
)
SELECT a.lang, a.word FROM a LEFT JOIN w ON w.lang = a.lang AND w.word = a.word WHERE w.word IS NULL""")
def unused_attributes_query(t: Tables):
    words = t.benchmark.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    # Every language is to have every benchmark word: the few languages are listed in each word's row.
    langs = t.documents.agg(F.collect_set("lang").alias("langs")).scalar()
    attributes = words.distinct().select(F.explode(langs).alias("lang"), "word")
    return keys.unused_attributes(attributes, t.documents, ["lang"], "word", ["text"], pattern="[a-z]+", quote="")


@query("invalid_objects", """
SELECT o_orderkey AS object_id, o_orderpriority AS owner, CASE o_orderstatus WHEN 'F' THEN 'VALID' WHEN 'O' THEN 'INVALID' END AS status
FROM orders WHERE o_orderstatus <> 'F'""")
def invalid_objects_query(t: Tables):
    return keys.invalid_objects(_objects(t))


@query("invalid_by_owner", """
SELECT o_orderpriority AS owner, count(*) AS invalid_objects FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def invalid_by_owner_query(t: Tables):
    return keys.invalid_by_owner(_objects(t))


def _objects(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "VALID").when(F.col("o_orderstatus") == "O", "INVALID")
    return t.orders.select(F.col("o_orderkey").alias("object_id"), F.col("o_orderpriority").alias("owner"), status.alias("status"))


def _named_segments(t: Tables) -> DataFrame:
    """Orders as partitions of telemetry tables, their names carrying two ids or open ends."""
    dbid = F.when(F.col("o_orderpriority") == "1-URGENT", "MXDB").otherwise(F.col("c_nationkey").cast("string"))
    snap = F.when(F.col("o_orderstatus") == "P", "MXSN").otherwise((F.col("o_custkey") * 3).cast("string"))
    ending = F.when(F.col("o_orderpriority") == "5-LOW", "_X").otherwise("")
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.lit("SYS").alias("owner"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "OTHER").otherwise("WRH$_STAT").alias("segment_name"),
        F.concat(F.lit("WRH$_STAT_"), dbid, F.lit("_"), snap, ending).alias("partition_name"),
        F.when(F.col("o_orderstatus") == "O", "TABLE PARTITION").otherwise("INDEX PARTITION").alias("segment_type"),
    )


NAMED_SEGMENTS = r"""segments AS (
  SELECT 'SYS' AS owner, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'OTHER' ELSE 'WRH$_STAT' END AS segment_name,
    'WRH$_STAT_' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'MXDB' ELSE c_nationkey::VARCHAR END || '_'
      || CASE WHEN o_orderstatus = 'P' THEN 'MXSN' ELSE (o_custkey * 3)::VARCHAR END
      || CASE WHEN o_orderpriority = '5-LOW' THEN '_X' ELSE '' END AS partition_name,
    CASE WHEN o_orderstatus = 'O' THEN 'TABLE PARTITION' ELSE 'INDEX PARTITION' END AS segment_type
  FROM orders JOIN customer ON c_custkey = o_custkey
), mined AS (
  SELECT *, nullif(regexp_extract(partition_name, 'WR[^$]*\$.*_(\d+|MXDB)_(\d+|MXSN)$', 1), '') AS seg_dbid,
    nullif(regexp_extract(partition_name, 'WR[^$]*\$.*_(\d+|MXDB)_(\d+|MXSN)$', 2), '') AS seg_snap_id
  FROM segments WHERE segment_name LIKE 'WR%'
)"""


def _known_snapshots(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).where(F.col("o_orderpriority") == "3-MEDIUM").select(
        F.col("c_nationkey").cast("bigint").alias("dbid"), (F.col("o_custkey") * 3).alias("snap_id"),
        F.lit(1).alias("instance_number"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("startup_time"),
    )


@query("mine_keys", f"""
WITH {NAMED_SEGMENTS}, ws AS (
  SELECT c_nationkey::BIGINT AS dbid, o_custkey * 3 AS snap_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '3-MEDIUM'
), s AS (SELECT DISTINCT seg_dbid, seg_snap_id FROM mined WHERE seg_dbid <> 'MXDB'), ext AS (
  SELECT seg_dbid::BIGINT AS d, seg_snap_id::BIGINT AS n FROM s WHERE seg_snap_id <> 'MXSN'
  UNION SELECT seg_dbid::BIGINT, 0 FROM s WHERE seg_snap_id = 'MXSN' UNION SELECT seg_dbid::BIGINT, 1048576 FROM s WHERE seg_snap_id = 'MXSN'
  UNION SELECT dbid, snap_id FROM ws
), r AS (
  SELECT d AS seg_dbid, CASE WHEN n_regionkey < 3 THEN n_regionkey END AS instance_number,
    CASE WHEN n_regionkey < 3 THEN TIMESTAMP '2024-01-01' END AS startup_time, n AS seg_snap_id,
    dense_rank() OVER (ORDER BY d) AS db_rank,
    CASE WHEN n_regionkey IN (1, 2) THEN 1 ELSE 0 END AS is_already_in_wdi,
    CASE WHEN n_regionkey = 1 AND EXISTS (SELECT 1 FROM ws WHERE ws.dbid = d AND ws.snap_id = n) THEN 1 ELSE 0 END AS is_already_in_ws
  FROM ext JOIN nation ON n_nationkey = d
)
SELECT *, (row_number() OVER (PARTITION BY seg_dbid, instance_number ORDER BY seg_snap_id) = 1)::INT AS first_snap FROM r""")
def mine_keys_query(t: Tables):
    startup = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("startup_time")
    nation = t.nation.select(F.col("n_nationkey").cast("bigint").alias("dbid"), "n_regionkey")
    databases = nation.where(F.col("n_regionkey") < 3).select("dbid", F.col("n_regionkey").alias("inst_id"))
    instances = t.region.select(F.col("r_regionkey").alias("instance_number"), startup)
    known = nation.where(F.col("n_regionkey").isin(1, 2)).select("dbid", F.col("n_regionkey").alias("instance_number"), startup)
    return keys.mine_keys(_named_segments(t), _known_snapshots(t), databases, instances, known)


@query("foreign_partitions", f"""
WITH {NAMED_SEGMENTS}
SELECT owner, segment_name, partition_name, segment_type, seg_dbid, seg_snap_id FROM mined
WHERE seg_dbid IS NOT NULL AND segment_type LIKE 'TABLE%' AND seg_dbid NOT IN (SELECT n_nationkey::VARCHAR FROM nation WHERE n_regionkey = 1)
  AND NOT (seg_dbid = 'MXDB' AND seg_snap_id = 'MXSN')""")
def foreign_partitions_query(t: Tables):
    current = t.nation.where(F.col("n_regionkey") == 1).select(F.col("n_nationkey").alias("dbid"))
    return keys.foreign_partitions(_named_segments(t), current)


@query("foreign_ids", """
SELECT c_nationkey AS dbid, count(*) AS snaps, min(o_orderkey) AS min_snap_id, max(o_orderkey) AS max_snap_id
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY 1""")
def foreign_ids_query(t: Tables):
    current = t.nation.where(F.col("n_regionkey") == 2).select(F.col("n_nationkey").alias("dbid"))
    return keys.foreign_ids(_order_snapshots(t), current)


@query("id_extents", """
SELECT c_nationkey AS dbid, count(*) AS snaps, min(o_orderkey) AS min_snap_id, max(o_orderkey) AS max_snap_id
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def id_extents_query(t: Tables):
    return keys.id_extents(_order_snapshots(t))


def _order_snapshots(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").alias("dbid"), F.col("o_orderkey").alias("snap_id")
    )


@query("purge_orphans", """
WITH d AS (SELECT DISTINCT user_id AS dbid, event_type AS instance_number, ts::DATE::TIMESTAMP AS startup_time FROM events)
SELECT * FROM d WHERE EXISTS (SELECT 1 FROM events WHERE user_id = dbid AND event_type = instance_number AND ts::DATE = startup_time::DATE AND value >= 50)""")
def purge_orphans_query(t: Tables):
    rows = t.events.select(
        F.col("user_id").alias("dbid"), F.col("event_type").alias("instance_number"),
        F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("startup_time"), "value",
    )
    return cleanup.purge_orphans(rows.drop("value").distinct(), rows.where(F.col("value") >= 50), ["dbid", "instance_number", "startup_time"])


@query("insert_from_template", """
WITH known AS (SELECT o_custkey AS instance, o_orderdate AS startup_time, max(o_orderkey) AS host, max(o_orderpriority) AS version FROM orders GROUP BY 1, 2),
required AS (SELECT o_custkey AS instance, max(l_shipdate) AS startup_time FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
t AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY startup_time DESC) AS r FROM known)
SELECT * FROM known UNION ALL
SELECT q.instance, q.startup_time, host, version FROM required q JOIN t ON t.instance = q.instance AND r = 1
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.instance = q.instance AND k.startup_time = q.startup_time)""")
def insert_from_template_query(t: Tables):
    known = t.orders.groupBy(F.col("o_custkey").alias("instance"), F.col("o_orderdate").alias("startup_time")).agg(
        F.max("o_orderkey").alias("host"), F.max("o_orderpriority").alias("version")
    )
    required = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("instance")).agg(
        F.max("l_shipdate").alias("startup_time")
    )
    return cleanup.insert_from_template(known, required, ["instance"], "startup_time")


@query("update_from_max", """
SELECT o_orderkey, o_custkey, (SELECT max(ts) FROM events WHERE user_id = o_custkey) AS startup_time,
  0 AS status FROM orders""")
def update_from_max_query(t: Tables):
    table = t.orders.select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").alias("startup_time"),
        F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).alias("status"),
    )
    source = t.events.select(F.col("user_id").alias("o_custkey"), F.col("ts").alias("startup_time"))
    return cleanup.update_from_max(table, source, ["o_custkey"], "startup_time", "status")


@query("multi_insert", """
SELECT o_orderkey, o_custkey, 'instances' AS target FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IS DISTINCT FROM 'F'
UNION ALL SELECT o_orderkey, o_custkey, 'snapshots' FROM orders WHERE o_totalprice > 100000""")
def multi_insert_query(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    tagged = cleanup.multi_insert(rows, {
        "instances": (F.col("o_orderpriority") == "1-URGENT") & ~F.col("o_orderstatus").eqNullSafe("F"),
        "snapshots": F.col("o_totalprice") > 100_000,
    })
    return tagged.select("o_orderkey", "o_custkey", "target")


@query("purge_by_catalog", """
SELECT 'events' AS table_name, (SELECT count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS rows_deleted
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P'))
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'part', 0""")
def purge_by_catalog_query(t: Tables):
    snapshots = t.orders.where(F.col("o_orderstatus") != "P").select(F.col("o_custkey").alias("dbid"), F.col("o_orderkey").alias("snap_id"))
    instances = t.customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("dbid"))
    tables = {
        "orders": t.orders.select(F.col("o_custkey").alias("dbid"), F.col("o_orderkey").alias("snap_id"), "o_totalprice"),
        "lineitem": t.lineitem.select(F.col("l_orderkey").alias("snap_id"), "l_quantity"),
        "events": t.events.select(F.col("user_id").alias("dbid"), "value"),
        "part": t.part.select(F.col("p_partkey").alias("snap_id"), "p_name").join(
            t.orders.select(F.col("o_orderkey").alias("snap_id")).where(F.col("o_orderstatus") != "P"), "snap_id", "left_semi"),
        "region": t.region,
    }
    tables["customer"] = t.customer.select(F.col("c_custkey").alias("dbid"), "c_name")  # on the list of tables left alone
    rows = [("APP", name, column) for name, df in tables.items() for column in df.columns]
    catalog = t.spark.createDataFrame(rows, "owner string, table_name string, column_name string")
    excluded = t.spark.createDataFrame([("APP", "customer"), ("SYS", "orders"), (None, "nothing")], "owner string, table_name string")
    remaining = cleanup.purge_by_catalog(catalog, tables, snapshots, instances, excluded=excluded)
    return cleanup.purge_report(tables, remaining)


@query("tuple_exclusion", """
WITH m AS (
  SELECT CASE WHEN c_acctbal < -990 THEN NULL ELSE c_custkey END AS cust, CASE WHEN c_custkey % 3 = 0 THEN 'F' WHEN c_custkey % 3 = 1 THEN 'O' END AS status
  FROM customer WHERE c_acctbal < 0 AND (c_acctbal >= -990 OR c_custkey % 3 = 0)
), o AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS cust, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS status FROM orders
)
SELECT o_orderkey, cust, status FROM o
WHERE NOT EXISTS (SELECT 1 FROM m WHERE (o.cust = m.cust) IS NOT FALSE AND (o.status = m.status) IS NOT FALSE)""")
def tuple_exclusion_query(t: Tables):
    """Orders whose (customer, status) is surely none of a list with nulls in both columns."""
    third = F.col("c_custkey") % 3
    members = t.customer.where((F.col("c_acctbal") < 0) & ((F.col("c_acctbal") >= -990) | (third == 0))).select(
        F.when(F.col("c_acctbal") >= -990, F.col("c_custkey")).alias("cust"), F.when(third == 0, "F").when(third == 1, "O").alias("status"))
    orders = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_custkey")).alias("cust"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("status"))
    return not_in_tuple(orders, ["cust", "status"], members, ["cust", "status"])
