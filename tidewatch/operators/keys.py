"""Keys without cover, attributes without use, invalid objects, mined and foreign ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.nulls import not_true, null_if_blank
from tidewatch.operators.ordered import match_by, number_rows
from tidewatch.session import staged

# A quoted identifier with an optional quoted table before it.
QUOTED_IDENTIFIER = r'("[A-Z][A-Z0-9_$#]*"\.)?"[A-Z][A-Z0-9_$#]*"'
# Partition names carrying two ids, their open-ended marks, and the upper bound.
PARTITION_NAME = r"WR[^$]*\$.*_(\d+|MXDB)_(\d+|MXSN)$"
ANY_DATABASE, ANY_SNAPSHOT, LAST_SNAPSHOT = "MXDB", "MXSN", 2**20


def uncovered_keys(
    constraints: DataFrame,
    constraint_columns: DataFrame,
    indexes: DataFrame,
    index_columns: DataFrame,
    recycle_bin: DataFrame,
    owner: str | None = None,
) -> DataFrame:
    """Reference constraints that no index covers, with the nearest candidates.

    An index covers a key of n columns when every key column is among its first n, which is when
    the set of its first n columns is the key's set. So each index offers the sets of its
    prefixes, and a key is looked up among those of its table: one equality, however many keys and
    indexes a table has. Candidates, the indexes with one of the columns among their first n, are
    listed for the uncovered keys only. The columns of one index are staged as one row.

    A key with a null or missing column is covered by none. Columns of an index are distinct.
    """
    dropped = recycle_bin.where(F.col("type") == "TABLE").select("owner", F.col("object_name").alias("table_name"))
    wanted = constraints.where(F.col("constraint_type") == "R")
    if owner is not None:
        wanted = wanted.where(F.col("owner") == owner)
    wanted = wanted.join(dropped.distinct(), ["owner", "table_name"], "left_anti")
    key = ["owner", "table_name", "constraint_name"]
    columns = wanted.select(*key).join(
        constraint_columns.select("owner", "constraint_name", "column_name", F.col("position").alias("column_position")),
        ["owner", "constraint_name"],
    )
    keyed = columns.groupBy(*key).agg(
        F.max("column_position").alias("key_columns"), F.collect_list(F.struct("column_position", "column_name")).alias("_columns"))
    places = indexes.join(
        index_columns.select(F.col("index_owner").alias("owner"), "index_name", "column_name",
                             F.col("column_position").alias("index_position")),
        ["owner", "index_name"],
    )
    indexed = staged(
        places.groupBy("table_owner", "table_name", F.col("owner").alias("index_owner"), "index_name").agg(
            F.collect_list(F.struct("index_position", "column_name")).alias("_places")), "indexes")

    def column_set(members: Column) -> Column:
        names = F.transform(members, lambda m: m["column_name"])
        return F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull())))

    first = F.transform("_places", lambda p: column_set(F.filter("_places", lambda q: q["index_position"] <= p["index_position"])))
    prefixes = indexed.select("table_owner", F.col("table_name").alias("_table"), F.explode(first).alias("_prefix"))
    looked_up = keyed.withColumn("_set", column_set(F.col("_columns")))
    uncovered = looked_up.join(
        prefixes,
        (F.col("owner") == F.col("table_owner")) & (F.col("table_name") == F.col("_table")) & (F.col("_set") == F.col("_prefix"))
        & (F.size("_set") == F.col("key_columns")),
        "left_anti",
    )
    uncovered = uncovered.select(*key, "key_columns", F.inline("_columns"))
    offered = indexed.select("table_owner", "table_name", "index_owner", "index_name", F.inline("_places"))
    nearest = uncovered.alias("c").join(
        offered.alias("i"),
        (F.col("c.owner") == F.col("i.table_owner"))
        & (F.col("c.table_name") == F.col("i.table_name"))
        & (F.col("c.column_name") == F.col("i.column_name"))
        & (F.col("i.index_position") <= F.col("c.key_columns")),
        "left",
    )
    return nearest.select(
        *[f"c.{k}" for k in key], "c.column_position", "c.column_name",
        F.col("i.index_owner").alias("nearest_index_owner"), F.col("i.index_name").alias("nearest_index_name"),
        F.lit("N").alias("is_covering_index"),
    )


def plan_identifiers(projection: Column, table: Column) -> Column:
    """Projection text without its row-address entry, whose table name is taken literally."""
    address = F.concat(F.lit('("\\Q'), table, F.lit('\\E"\\.)?ROWID\\[ROWID,10\\]'))
    return F.regexp_replace(projection, address, F.lit(""))


def unused_attributes(
    attributes: DataFrame,
    texts: DataFrame,
    keys: Sequence[str],
    attribute: str,
    columns: Sequence[Column | str],
    pattern: str = QUOTED_IDENTIFIER,
    quote: str = '"',
) -> DataFrame:
    """Attributes named in none of the texts of their key.

    Every match of the pattern counts; names qualified by a table do not. Words are made
    distinct in each row before they are exploded, and again before they are shuffled.
    """
    found = [F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(pattern), F.lit(0)) for c in columns]
    words = F.array_distinct(F.flatten(F.array(*[F.coalesce(f, F.array().cast("array<string>")) for f in found])))
    named = texts.select(*keys, F.explode(words).alias("_word")).where(~F.col("_word").contains('"."')).distinct()
    wanted = attributes.withColumn("_word", F.concat(F.lit(quote), F.col(attribute), F.lit(quote)))
    return wanted.join(named, [*keys, "_word"], "left_anti").drop("_word")


def invalid_objects(objects: DataFrame) -> DataFrame:
    """Objects not known to be valid; an unknown status is not valid."""
    return objects.where(not_true(F.col("status") == "VALID"))


def invalid_by_owner(objects: DataFrame) -> DataFrame:
    return invalid_objects(objects).groupBy("owner").agg(F.count(F.lit(1)).alias("invalid_objects"))


def mined_names(segments: DataFrame) -> DataFrame:
    """Database and snapshot ids read from partition names."""
    named = segments.where(F.col("segment_name").like("WR%"))
    return named.withColumns(
        {
            "seg_dbid": null_if_blank(F.regexp_extract("partition_name", PARTITION_NAME, 1)),
            "seg_snap_id": null_if_blank(F.regexp_extract("partition_name", PARTITION_NAME, 2)),
        }
    )


def mine_keys(
    segments: DataFrame, snapshots: DataFrame, databases: DataFrame, instances: DataFrame, known_instances: DataFrame
) -> DataFrame:
    """Ids that partition names speak of, and whether they are known already.

    An open-ended snapshot stands for both the lowest and the highest id. Adds the dense rank
    of the database, a first-of-instance mark, and two already-present flags.
    """
    ids = mined_names(segments).where(F.col("seg_dbid") != ANY_DATABASE).select("seg_dbid", "seg_snap_id").distinct()
    open_ended = F.col("seg_snap_id") == ANY_SNAPSHOT
    bounds = F.when(open_ended, F.array(F.lit(0).cast("bigint"), F.lit(LAST_SNAPSHOT).cast("bigint"))).otherwise(
        F.array(F.expr("try_cast(seg_snap_id as bigint)"))
    )
    mined = ids.select(F.col("seg_dbid").cast("bigint").alias("seg_dbid"), F.explode(bounds).alias("seg_snap_id"))
    known = snapshots.select(F.col("dbid").alias("seg_dbid"), F.col("snap_id").alias("seg_snap_id"))
    # Rows, ranks and firsts all start from the ids, which are worked out once.
    ids = staged(mined.unionByName(known).distinct(), "ids")

    running = databases.select(F.col("dbid").alias("seg_dbid"), "inst_id").join(
        instances.select(F.col("instance_number").alias("inst_id"), "startup_time"), "inst_id"
    ).withColumnRenamed("inst_id", "instance_number")
    rows = ids.join(running, "seg_dbid", "left")
    instance_keys = {"dbid": "seg_dbid", "instance_number": "instance_number", "startup_time": "startup_time"}
    have_instance = known_instances.select(*[F.col(a).alias(b) for a, b in instance_keys.items()]).distinct()
    rows = rows.join(have_instance.withColumn("_wdi", F.lit(1)), list(instance_keys.values()), "left")
    snap_keys = {**instance_keys, "snap_id": "seg_snap_id"}
    have_snapshot = snapshots.select(*[F.col(a).alias(b) for a, b in snap_keys.items()]).distinct()
    rows = rows.join(have_snapshot.withColumn("_ws", F.lit(1)), list(snap_keys.values()), "left")

    # Ranks and firsts come from aggregates of the ids, not from windows over all rows.
    ranks = number_rows(ids.select("seg_dbid").distinct(), [], ["seg_dbid"], "db_rank")
    rows = rows.withColumn("_known_startup", F.when(F.col("_wdi") == 1, F.col("startup_time")))
    group = ["seg_dbid", "instance_number", "_known_startup"]
    firsts = rows.groupBy(*group).agg(F.min("seg_snap_id").alias("_first"))
    rows = match_by(match_by(rows, firsts, group), ranks, ["seg_dbid"])
    return rows.select(
        "seg_dbid", "instance_number", "startup_time", "seg_snap_id", "db_rank",
        (F.col("seg_snap_id") == F.col("_first")).cast("int").alias("first_snap"),
        F.coalesce("_wdi", F.lit(0)).alias("is_already_in_wdi"),
        F.coalesce("_ws", F.lit(0)).alias("is_already_in_ws"),
    )


def not_in(df: DataFrame, column: str, members: DataFrame, member: str) -> DataFrame:
    """SQL ``NOT IN``: empty when the set holds a null, and a null is in no answer unless the
    set is empty. The two facts about the set come as one-row scalar subqueries."""
    facts = members.agg(F.count(F.lit(1)).alias("n"), F.count(member).alias("known"))
    size = facts.select("n").scalar()
    clear = facts.select(F.col("n") == F.col("known")).scalar()
    absent = df.join(
        members.select(F.col(member).alias(column)).distinct(), column, "left_anti"
    )
    return absent.where(clear & (F.col(column).isNotNull() | (size == 0)))


def foreign_ids(snapshots: DataFrame, current: DataFrame, member: str = "dbid") -> DataFrame:
    """Count and extent of the snapshots of every database that is not a current one."""
    return id_extents(not_in(snapshots, "dbid", current, member))


def id_extents(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("dbid").agg(
        F.count(F.lit(1)).alias("snaps"), F.min("snap_id").alias("min_snap_id"), F.max("snap_id").alias("max_snap_id")
    )


def foreign_partitions(segments: DataFrame, current: DataFrame, member: str = "dbid") -> DataFrame:
    """Table partitions of other databases: the list that a purge would drop.

    Ids are compared as text because a name may carry an open-ended mark instead of a number.
    """
    named = mined_names(segments).where(F.col("seg_dbid").isNotNull() & F.col("segment_type").like("TABLE%"))
    as_text = current.select(F.col(member).cast("string").alias("_id"))
    foreign = not_in(named, "seg_dbid", as_text, "_id")
    return foreign.where(~((F.col("seg_dbid") == ANY_DATABASE) & (F.col("seg_snap_id") == ANY_SNAPSHOT)))


def usage_report(
    objects: DataFrame, plan_lines: DataFrame, stats: DataFrame, snapshots: DataFrame, texts: DataFrame,
    user_schema: str = "^USER",
) -> DataFrame:
    """How each object is used: by users or internally, first and last, how often, by what.

    An object never used keeps one row, which counts 1. Plan lines and statistics meet many to
    many, so both are counted first: lines per object and plan, statistics per plan, flags and
    module. Only these counts meet, and are multiplied.
    """
    # Client tools whose statements are user queries; marks of statistics gathering.
    user_tools = ("SQL Developer", "sqldev.exe", "PL/SQL Developer", "plsqldev.exe")
    internal_marks = " dbms_stats ", "sys_op_countchg"
    snap_keys, plan = ["snap_id", "dbid", "instance_number"], ["sql_id", "plan_hash_value"]
    internal = texts.where(
        F.col("sql_text").contains(internal_marks[0]) & F.lower("sql_text").contains(internal_marks[1])
    ).select("sql_id", F.lit("Y").alias("_internal")).distinct()
    lines = plan_lines.where(F.col("object_owner").isNotNull() & F.col("object_name").isNotNull()).groupBy(
        F.col("object_owner").alias("index_owner"), F.col("object_name").alias("index_name"), *plan
    ).agg(F.count(F.lit(1)).alias("_lines"))

    by_user = F.when(F.col("module").isin(*user_tools) | F.col("parsing_schema_name").rlike(user_schema), "Y").otherwise("N")
    shown = F.regexp_replace("module", r"APEX:APP\s+\d+:\d+", "APEX:APP ...")
    per_snapshot = stats.groupBy(*plan, *snap_keys, by_user.alias("is_user_query"), shown.alias("module")).agg(F.count(F.lit(1)).alias("_n"))
    timed = per_snapshot.join(snapshots.select(*snap_keys, "begin_interval_time"), snap_keys)
    counted = timed.groupBy(*plan, "is_user_query", "module").agg(
        F.sum("_n").alias("_n"), F.min("begin_interval_time").alias("_first"), F.max("begin_interval_time").alias("_last"))
    counted = counted.join(internal, "sql_id", "left").withColumn("is_dbms_stats_query", F.coalesce("_internal", F.lit("N"))).drop("_internal")

    used = lines.join(counted, plan).groupBy("index_owner", "index_name", "is_user_query", "is_dbms_stats_query").agg(
        F.sum(F.col("_lines") * F.col("_n")).alias("rows"), F.min("_first").alias("first_use"), F.max("_last").alias("last_use"),
        null_if_blank(F.array_join(F.array_sort(F.collect_set("sql_id")), ", ")).alias("sql_ids"),
        null_if_blank(F.array_join(F.array_sort(F.collect_set("module")), ", ")).alias("modules"),
    )
    listed = objects.select(F.col("owner").alias("index_owner"), "index_name", "table_name")
    return listed.join(used, ["index_owner", "index_name"], "left").withColumn("rows", F.coalesce("rows", F.lit(1)))
