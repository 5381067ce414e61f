"""Generators of maintenance steps from classified segments, files and invalid indexes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.nulls import is_truthy, not_true, quote_name, text_concat
from tidewatch.operators.ordered import latest_per_key, number_rows
from tidewatch.operators.space import MB, OTHER_CONTAINERS, SYSTEM_CONTAINERS
from tidewatch.session import staged

TARGET = "${tablespace}"

# Statuses of usable indexes, and schemas whose indexes are left alone.
USABLE = ("USABLE", "VALID")
LEFT_ALONE = (
    "SYS", "SYSTEM", "DBSNMP", "XDB", "WMSYS", "OUTLN", "SH", "IX", "OE", "HR", "AUDSYS", "CTXSYS",
    "DBSFWUSER", "GSMADMIN_INTERNAL", "OJVMSYS",
)


def _qualified(owner: str, name: str) -> Column:
    return text_concat(quote_name(F.col(owner)), ".", quote_name(F.col(name)))


def move_text(has_transient: bool, online: bool, statistics: bool) -> Column:
    """The statement that would move a classified segment, with a placeholder for the target."""
    target = f" tablespace {TARGET}" if has_transient else ""
    on = " online" if online else ""
    stats = " compute statistics" if statistics else ""
    parallel = F.when(F.col("dop") > 1, text_concat(" parallel ", F.col("dop")))
    kind, part = F.col("segment_type"), quote_name(F.col("partition_name"))
    segment, lob = quote_name(F.col("segment_name")), quote_name(F.col("lob_column"))
    own, lob_table = _qualified("owner", "segment_name"), _qualified("lob_table_owner", "lob_table")
    whole = F.col("partition_name").isNull()

    def table(name: Column, *what: Column | str) -> Column:
        return text_concat("alter table ", name, " move", *what, target, parallel, on)

    def index(*what: Column | str) -> Column:
        return text_concat("alter index ", own, " rebuild", *what, on, target, parallel, stats)

    def large_object(store: Column, *what: Column | str) -> Column:
        return text_concat("alter table ", lob_table, " move", *what, parallel, on, store)

    into = f" (tablespace {TARGET})"
    lob_store = text_concat(" lob (", lob, ") store as", into)
    warning = text_concat(
        "-- WARNING: Dunno how to move ", F.lower(kind), ' "', F.col("owner"), '"."', F.col("segment_name"), '"'
    )
    unknown = kind.isin("LOBSEGMENT", "LOB PARTITION", "LOB SUBPARTITION") & (F.col("lob_table").isNull() | F.col("lob_column").isNull())
    return (
        F.when(unknown, warning)  # the catalog does not say whose large object it is
        .when((kind == "TABLE") & whole, table(own))
        .when(kind == "NESTED TABLE", table(own))
        .when((kind == "INDEX") & (F.col("index_type") == "IOT - TOP"), table(_qualified("index_table_owner", "index_table")))
        .when(kind == "TABLE PARTITION", table(own, " partition ", part))
        .when(kind == "TABLE SUBPARTITION", table(own, " subpartition ", part))
        .when((kind == "INDEX") & whole, index())
        .when(kind == "INDEX PARTITION", index(" partition ", part))
        .when(kind == "INDEX SUBPARTITION", index(" subpartition ", part))
        .when((kind == "LOBSEGMENT") & F.col("varray_table").isNotNull(),
              large_object(text_concat(" varray ", lob, " store as lob ", segment, into)))
        .when(kind == "LOBSEGMENT", large_object(text_concat(" lob (", lob, ") store as ", segment, into)))
        .when(kind == "LOB PARTITION", large_object(lob_store, " partition ", quote_name(F.col("lob_table_partition"))))
        .when(kind == "LOB SUBPARTITION", large_object(lob_store, " subpartition ", quote_name(F.col("lob_table_subpartition"))))
        .otherwise(warning)
    )


def maintenance_plan(
    classified: DataFrame,
    transient: str | None = None,
    online: str | bool = False,
    statistics: str | bool = False,
    hot_rows: int | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """All steps of moving segments out of their containers and back, numbered i of n.

    ``block`` orders the phases. Inside a container the largest-ranked segment moves out
    first and the smallest moves back first.
    """
    # Several branches read the texts, so the classification is worked out once.
    texts = staged(
        classified.select(
            "owner", "tablespace_name", "row_no",
            move_text(transient is not None, is_truthy(online), is_truthy(statistics)).alias("_text"),
        ),
        "move-texts",
    )
    # One numbering per container serves both ways: the i-th of n to come back is the (n + 1 - i)-th to go.
    numbered = number_rows(texts, ["tablespace_name"], ["row_no"], "cmd", total="of", hot_rows=hot_rows, chunks=chunks)
    prefix = F.concat(F.lit("10:"), F.md5("tablespace_name"))

    def move(label: str, cmd: Column, target: Column) -> Column:
        text = F.concat(F.replace(F.col("_text"), F.lit(TARGET), target), F.lit(";"))
        return F.struct(F.concat(prefix, F.lit(label)).alias("block"), cmd.alias("cmd"), text.alias("_step"))

    moves = [move(":02:move back to persistent", F.col("cmd"), quote_name(F.col("tablespace_name")))]
    if transient is None:
        return _numbered(numbered.select(F.inline(F.array(*moves))))
    name = quote_name(F.lit(transient))
    moves.append(move(":01:move to transient", F.col("of") + 1 - F.col("cmd"), name))

    def quota(label: str, order: Column, amount: str) -> Column:
        # One row per owner, of which a database has some thousands at most.
        cmd = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)).cast("bigint")
        text = text_concat("alter user ", quote_name(F.col("owner")), f" quota {amount} on ", name, ";")
        return F.struct(F.lit(label).alias("block"), cmd.alias("cmd"), text.alias("_step"))

    owners = texts.select("owner").distinct().select(
        quota("01:grant quota on transient", F.asc_nulls_last("owner"), "unlimited").alias("grant"),
        quota("91:revoke quota on transient", F.desc_nulls_last("owner"), "0").alias("revoke"))
    check = F.lit(
        "select count(1) as leftovers_in_transient_tbs from dba_segments "
        f"where tablespace_name = '{transient}';"
    )
    checks = classified.sparkSession.range(1).select(
        F.explode(F.array(F.lit("02:leftovers in transient"), F.lit("92:leftovers in transient"))).alias("block"),
        F.lit(0).cast("bigint").alias("cmd"), check.alias("_step"),
    )
    steps = numbered.select(F.inline(F.array(*moves)))
    return _numbered(steps.unionByName(owners.select(F.inline(F.array("grant", "revoke")))).unionByName(checks))


def _numbered(steps: DataFrame) -> DataFrame:
    """Number the steps by block and command without sorting them all in one task.

    A block's commands are numbered already (from 1, or a single 0), so only the block sizes
    have to be accumulated: two rows per container and four more, in a catalog that has some
    thousands of containers at most.
    """
    one_task = Window.partitionBy(F.lit(0))
    before = one_task.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = steps.groupBy("block").agg(F.count(F.lit(1)).alias("_size")).select(
        "block",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(one_task).alias("n"),
    )
    i = F.col("_before") + F.greatest(F.col("cmd"), F.lit(1))
    return steps.join(blocks, "block").select(
        "block", "cmd", i.alias("i"), "n",
        text_concat(F.col("_step"), " -- ", i, "/", F.col("n")).alias("step"),
    )


def container_plan(files: DataFrame, now: datetime) -> DataFrame:
    """For each container its newest file, and the texts that would create a fresh container
    beside it and exchange the two names."""
    names = F.col("tablespace_name")
    wanted = files.where(~names.isin(*SYSTEM_CONTAINERS, *OTHER_CONTAINERS) & ~names.like("UNDO%"))
    newest = latest_per_key(wanted, ["tablespace_name"], [F.col("file_id")])
    stamp = now.strftime("%Y%m%d_%H")
    block_size = F.col("bytes") / F.col("blocks")
    step = F.round(F.col("increment_by") * block_size / MB).cast("bigint")
    limit = F.ceil(F.col("maxblocks") * block_size / MB / 1024)
    folder = F.regexp_replace("file_name", r"[^/\\]+$", "")
    extend = F.when(
        F.col("autoextensible") == "YES", text_concat(" autoextend on next ", step, "m maxsize ", limit, "g;")
    )
    create = text_concat(
        'create smallfile tablespace "', names, f'$N_{stamp}" datafile \'', folder, F.lower(names),
        f".{stamp}.dbf' size ", step, "m", extend,
    )
    rename = 'alter tablespace "', names
    return newest.select(
        "tablespace_name", "file_id", "file_name",
        block_size.alias("block_size_b"), folder.alias("data_file_path"),
        create.alias("sql_create"),
        text_concat(*rename, '" rename to "', names, f'$O_{stamp}";').alias("sql_rename_old"),
        text_concat(*rename, f'$N_{stamp}" rename to "', names, '";').alias("sql_rename_new"),
    )


def invalid_levels(
    indexes: DataFrame, partitions: DataFrame, subpartitions: DataFrame, online: str | bool = False
) -> DataFrame:
    """Unusable indexes, index partitions and subpartitions, with the text that would rebuild each."""
    suffix = (" online" if is_truthy(online) else "") + ";"
    unusable = ~F.col("status").isin(*USABLE)

    def level(df: DataFrame, number: int, owner: str, what: str, part: Column) -> DataFrame:
        text = text_concat("alter index ", _qualified(owner, "index_name"), " rebuild", what, quote_name(part), suffix)
        return df.where(~F.col(owner).isin(*LEFT_ALONE)).select(
            F.col(owner).alias("owner"), "index_name", F.lit(number).alias("level"), part.alias("subobject_name"), text.alias("sql")
        )

    whole = indexes.where(
        unusable & ~F.col("index_type").isin("IOT - TOP") & not_true(F.col("partitioned") == "YES")
    )
    parts = partitions.where(unusable & (F.col("subpartition_count") <= 0))
    return (
        level(whole, 0, "owner", "", F.lit(None).cast("string"))
        .unionByName(level(parts, 1, "index_owner", " partition ", F.col("partition_name")))
        .unionByName(level(subpartitions.where(unusable), 2, "index_owner", " subpartition ", F.col("subpartition_name")))
    )
