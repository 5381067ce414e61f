"""Storage space: balance, right-sizing, degree of parallelism, classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.nulls import not_true, text_concat
from tidewatch.operators.ordered import number_rows

# Containers and owners that no space analysis touches.
SYSTEM_CONTAINERS = ("SYSTEM", "SYSAUX")
OTHER_CONTAINERS = ("TEMP", "USERS")
SYSTEM_OWNERS = ("XDB", "SH", "OE", "IX", "HR")
MB = 1_048_576


def space_balance(files: DataFrame, free: DataFrame, segments: DataFrame) -> DataFrame:
    """Total, free and used space per container; a container may be missing on any side."""
    def sums(df: DataFrame, *columns: Column) -> DataFrame:
        return df.groupBy("tablespace_name").agg(*columns)

    gigabytes = F.sum("bytes") / MB / 1024
    joined = (
        sums(files, gigabytes.alias("_total"))
        .join(sums(free, gigabytes.alias("_free")), "tablespace_name", "full")
        .join(sums(segments, F.count(F.lit(1)).alias("segs"), gigabytes.alias("_segs")), "tablespace_name", "full")
    )
    return joined.select(
        "tablespace_name",
        F.round("_total", 2).alias("total_gb"),
        F.round(F.col("_total") - F.col("_free"), 2).alias("used_gb"),
        F.round("_free", 2).alias("free_gb"),
        F.round(100 * (F.col("_free") / F.nullif(F.col("_total"), F.lit(0.0)))).alias("free_pct"),
        "segs",
        F.round("_segs", 2).alias("segs_gb"),
    )


def next_power_of_two(n: Column) -> Column:
    """Smallest power of two not below a positive integer, by bit length."""
    one = F.lit(1).cast("bigint")
    return F.when(n > 1, F.call_function("shiftleft", one, F.length(F.bin(n - 1)))).otherwise(one)


def right_size(
    extents: DataFrame, files: DataFrame, tablespaces: DataFrame, growth_mb: int = 8, minimum_mb: int = 8
) -> DataFrame:
    """How small each data file can become, with the texts that would resize it."""
    own = ~F.col("tablespace_name").isin(*SYSTEM_CONTAINERS)
    last = extents.where(own).groupBy("tablespace_name", "file_id").agg(
        F.max(F.col("block_id") + F.col("blocks")).alias("last_block_id")
    )
    last = last.groupBy("file_id").agg(F.max("last_block_id").alias("last_block_id"))
    permanent = tablespaces.where(own & (F.col("contents") == "PERMANENT"))
    sized = files.join(permanent.select("tablespace_name", "block_size", "next_extent"), "tablespace_name")
    sized = sized.join(last, "file_id", "left")
    default = F.lit(growth_mb)
    extends = F.lower("autoextensible") == "yes"
    file_step = F.when(extends, F.col("increment_by") * F.col("block_size") / MB)
    rounding = F.greatest(
        F.lit(minimum_mb).cast("double"),
        F.coalesce(F.ceil(F.col("next_extent") / MB), default).cast("double"),
        F.coalesce(file_step, default).cast("double"),
    )
    needed = (F.lit(2) + F.coalesce("last_block_id", F.lit(0))) * F.col("block_size") / MB
    out = sized.select(
        "tablespace_name", "file_name", "file_id", "last_block_id", "block_size",
        (F.col("bytes") / MB).alias("current_mb"),
        rounding.alias("rounding_mb"),
        F.ceil(F.ceil(needed / growth_mb) * growth_mb).cast("bigint").alias("min_mb"),
        F.ceil(F.ceil(needed / rounding) * rounding).cast("bigint").alias("opt_mb"),
    )

    def saving(target: str) -> tuple[Column, Column]:
        gigabytes = F.round((F.col("current_mb") - F.col(target)) / 1024, 1)
        percent = F.round(100 * (1 - F.col(target) / F.nullif(F.col("current_mb"), F.lit(0.0))), 0)
        return gigabytes, percent

    def resize(target: str) -> Column:
        text = text_concat("alter database datafile ", F.col("file_id"), " resize ", F.col(target), "m;")
        return F.when(F.col("current_mb") != F.col(target), text)

    power = next_power_of_two(F.col("min_mb"))
    limit = text_concat("alter database datafile ", F.col("file_id"), " autoextend on maxsize ", F.col("max_mb"), "m;")
    return out.withColumns(
        {
            "opt_savings_gb": saving("opt_mb")[0], "opt_savings_pct": saving("opt_mb")[1], "sql_opt": resize("opt_mb"),
            "max_savings_gb": saving("min_mb")[0], "max_savings_pct": saving("min_mb")[1], "sql_min": resize("min_mb"),
            "max_mb": power,
        }
    ).withColumn("sql_max", limit)


def segment_dop(
    extents: DataFrame, max_dop: int | None = None, mb_per_thread: float | None = None,
    excluded_owners: Sequence[str] = SYSTEM_OWNERS,
) -> DataFrame:
    """Size of each segment, and how many threads its move deserves."""
    names = F.col("tablespace_name")
    wanted = ~names.isin(*SYSTEM_CONTAINERS, *OTHER_CONTAINERS) & ~names.like("UNDO%") & ~F.col("owner").isin(*excluded_owners)
    sized = extents.where(wanted).groupBy(
        "owner", "segment_name", "partition_name", "segment_type", "tablespace_name"
    ).agg(F.max("block_id").alias("last_block_id"), (F.sum("bytes") / MB).alias("size_mb"))
    threshold = max(1, 64 if mb_per_thread is None else mb_per_thread)
    threads = F.round(F.log2(F.col("size_mb") / threshold))
    dop = F.least(F.lit(16 if max_dop is None else max_dop), F.greatest(F.lit(1.0), threads))
    return sized.withColumn("dop", dop.cast("int"))


def classify_segments(
    segments: DataFrame,
    indexes: DataFrame,
    lobs: DataFrame,
    varrays: DataFrame,
    lob_partitions: DataFrame,
    lob_subpartitions: DataFrame,
    nested_tables: DataFrame,
    hot_rows: int | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Attach what each segment belongs to, and the order in which segments should move.

    Order: by class (plain objects, index-organised tables, LOBs, indexes), then by size.
    Rows are numbered within their class and shifted by the sizes of the classes before.
    """
    out = segments.join(
        indexes.select("owner", F.col("index_name").alias("segment_name"), "index_type",
                       F.col("table_owner").alias("index_table_owner"), F.col("table_name").alias("index_table")),
        ["owner", "segment_name"], "left",
    ).where(not_true(F.col("index_type") == "LOB"))
    # Class ranks.
    rank = (
        F.when(F.col("index_type") == "IOT - TOP", 2)
        .when(F.col("segment_type").like("INDEX%"), 9)
        .when(F.col("segment_type").like("LOB%"), 5)
        .otherwise(1)
    )
    out = out.withColumn("class_rank", rank)
    # The joins below keep one row per segment, so sizes and places in a class are known already,
    # from narrow rows. At most four sizes, one per class.
    by_class = Window.partitionBy(F.lit(0))
    before = by_class.orderBy("class_rank").rowsBetween(Window.unboundedPreceding, -1)
    sizes = out.groupBy("class_rank").agg(F.count(F.lit(1)).alias("_n")).select(
        "class_rank",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_class).alias("rows_total"),
    )
    ties = ["size_mb", "owner", "segment_name", "partition_name", "segment_type", "tablespace_name"]
    out = number_rows(out, ["class_rank"], ties, "_in_class", hot_rows=hot_rows, chunks=chunks)
    out = out.join(
        lobs.select("owner", "segment_name", F.col("owner").alias("lob_table_owner"),
                    F.col("table_name").alias("lob_table"), F.col("column_name").alias("lob_column")),
        ["owner", "segment_name"], "left",
    )
    out = out.join(
        varrays.select("owner", F.col("lob_name").alias("segment_name"), F.col("parent_table_name").alias("varray_table"),
                       F.col("parent_table_column").alias("varray_column")),
        ["owner", "segment_name"], "left",
    )
    for parts, level in ((lob_partitions, "partition"), (lob_subpartitions, "subpartition")):
        dim = parts.select(
            F.col("table_owner").alias("lob_table_owner"), F.col("table_name").alias("lob_table"),
            F.col("column_name").alias("lob_column"), F.col("lob_name").alias("segment_name"),
            F.col(f"lob_{level}_name").alias("partition_name"), F.col(f"{level}_name").alias(f"lob_table_{level}"),
        )
        keys = ["lob_table_owner", "lob_table", "lob_column", "segment_name", "partition_name"]
        out = out.join(dim, keys, "left")
    out = out.join(
        nested_tables.select("owner", F.col("table_name").alias("segment_name"),
                             F.col("parent_table_name").alias("nested_table"),
                             F.col("parent_table_column").alias("nested_column")),
        ["owner", "segment_name"], "left",
    )
    return (
        out.join(F.broadcast(sizes), "class_rank")
        .withColumn("row_no", F.col("_in_class") + F.col("_before"))
        .drop("_in_class", "_before")
    )
