"""Ordered computations that stay balanced when one key holds most of the rows.

A window over a key puts all rows of that key in one task. That is right for ordinary keys
and wrong for a key holding a third of the table. ``split_hot_groups`` finds such keys and
cuts only them into ordered chunks, at quantiles of the whole order tuple, so that no
(key, chunk) group is much larger than an average shuffle partition. Ordered operators then
work inside (key, chunk) and carry state between chunks through summaries: one row per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import shuffle_width

CHUNK = "_chunk"
WHOLE = -1  # the chunk number of keys that are not cut
HOT_ROWS = 1_000_000
HOT_ROWS_SETTING = "spark.tidewatch.hotRows"
SAMPLES_PER_CHUNK = 32
LEAST_RANGE = 1 << 15  # rows for which a further range is worth a task
CHUNKS_PER_PARTITION = 4  # so that the partitions, which get chunks by hash, are of much the same size


def order_by(order: Sequence[str]) -> list[Column]:
    """Sort columns from names; a leading ``-`` means descending. Nulls always come last."""
    return [
        F.col(name[1:]).desc_nulls_last() if name.startswith("-") else F.col(name).asc_nulls_last()
        for name in order
    ]


def same_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality of the named column pairs."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def match_by(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys, null matching null, keeping one copy of the keys."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    pairs = [(k, f"_r_{i}") for i, k in enumerate(keys)]
    joined = left.join(renamed, same_keys(left, renamed, pairs), how)
    return joined.drop(*[name for _, name in pairs])


def comparable(df: DataFrame, order: Sequence[str], prefix: str = "") -> Column:
    """A struct without nulls or time zones that sorts as ``order_by(order)`` does.

    Times are exact microseconds, so they never step back when clocks do. ``prefix`` stands before
    the names of the columns to read.
    """
    parts = []
    for i, name in enumerate(order):
        down, column = name.startswith("-"), F.col(prefix + name.lstrip("-"))
        kind = df.schema[prefix + name.lstrip("-")].dataType
        if isinstance(kind, T.TimestampType):
            value = F.unix_micros(column)
        elif isinstance(kind, T.TimestampNTZType):
            clock = F.hour(column) * 3600 + F.minute(column) * 60
            value = (F.unix_date(column.cast("date")).cast("bigint") * 86_400 + clock) * 1_000_000 + (
                F.extract(F.lit("SECOND"), column) * 1_000_000).cast("bigint")
        elif isinstance(kind, T.DateType):
            value = F.unix_date(column).cast("bigint")
        elif isinstance(kind, (T.IntegralType, T.BooleanType)):
            value = column.cast("bigint")
        else:
            value = column
        parts.append(column.isNull().alias(f"null_{i}"))
        if isinstance(kind, (T.FloatType, T.DoubleType)):  # NaN is the largest number
            parts.append(F.coalesce(F.isnan(column) != F.lit(down), F.lit(False)).alias(f"nan_{i}"))
            value = F.when(~F.isnan(column), column.cast("double"))
        if down:
            if isinstance(kind, T.StringType):
                digits = F.translate(F.hex(F.encode(column, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210")
                value = F.concat(digits, F.lit("G"))  # an end above every digit: the longer text comes first
            elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
                value = -value
            elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.IntegralType, T.BooleanType)):
                value = F.bitwise_not(value)
            else:
                raise ValueError(f"no descending order for {kind.simpleString()}: {name}")
        parts.append(value.alias(f"value_{i}"))
    return F.struct(*parts)


def _two_levels(borders: list) -> tuple[list, list[list]]:
    """Sorted borders as every n-th one, and those between, so that a row compares with few."""
    step = max(1, math.isqrt(len(borders) + 1))
    return borders[step - 1 :: step], [borders[i : i + step - 1] for i in range(0, len(borders) + 1, step)]


def split_hot_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    hot_rows: int | None = None,
    chunks: int | None = None,
) -> tuple[DataFrame, bool]:
    """Add the chunk number, and say whether any key had to be cut.

    A key is hot when it holds more than ``hot_rows`` rows (by default the session setting
    ``spark.tidewatch.hotRows``, or a million) and more than a quarter of the share of one shuffle
    partition; fewer keys than ``chunks`` can be, so their list is small by construction. A hot
    key gets as many chunks as it holds such shares, cut at quantiles of a sample of its own
    order tuples. A row in a lower chunk never sorts after one in a higher chunk; only rows
    equal in the whole order share a chunk whatever their number. Keys that are not cut have
    the chunk number ``WHOLE``. One pass counts; a second, if a key is hot, samples.
    """
    spark = df.sparkSession
    width = chunks or max(2, CHUNKS_PER_PARTITION * shuffle_width(spark))
    if hot_rows is None:
        hot_rows = int(spark.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))
    counted = Observation()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).observe(counted, F.sum("_rows").alias("total"))
    largest = counts.orderBy(F.desc("_rows")).limit(width + 1).collect()
    limit = max(hot_rows, (counted.get["total"] or 0) // width if largest else 0)
    heavy = [row for row in largest if row["_rows"] > limit]
    if not heavy:
        return df.withColumn(CHUNK, F.lit(WHOLE)), False

    place = comparable(df, order)
    wanted = {tuple(row)[:-1]: -(-row["_rows"] // max(1, limit)) for row in heavy}
    share = min(1.0, SAMPLES_PER_CHUNK * sum(wanted.values()) / sum(row["_rows"] for row in heavy))
    placed = df.select(*keys, place.alias("_place"))
    key_schema = T.StructType([df.schema[k] for k in keys])
    if keys:
        placed = match_by(placed, F.broadcast(spark.createDataFrame(list(wanted), key_schema)), keys, "inner")
    sampled: dict[tuple, list] = {key: [] for key in wanted}
    for row in placed.sample(share, 7).collect():
        sampled[tuple(row)[:-1]].append(row["_place"])
    kind = placed.schema["_place"].dataType
    cut = []
    for key, tuples in sampled.items():
        tuples.sort()
        ends = [tuples[len(tuples) * i // wanted[key]] for i in range(1, wanted[key])] if tuples else []
        cut.append((*key, *_two_levels(sorted(set(ends)))))
    levels = T.StructType([T.StructField("_tops", T.ArrayType(kind)), T.StructField("_between", T.ArrayType(T.ArrayType(kind)))])
    listed = spark.createDataFrame(cut, T.StructType(key_schema.fields + levels.fields))
    if not keys:
        listed, df = listed.withColumn("_all", F.lit(True)), df.withColumn("_all", F.lit(True))
    flagged = match_by(df, F.broadcast(listed), keys or ["_all"])
    flagged = flagged.withColumn("_place", F.when(F.col("_tops").isNotNull(), comparable(df, order)))

    def reached(borders: Column) -> Column:
        return F.size(F.filter(borders, lambda b: b <= F.col("_place")))

    flagged = flagged.withColumn("_top", reached(F.col("_tops")))
    step = F.size(F.element_at("_between", 1)) + 1
    chunk = F.col("_top") * step + reached(F.element_at("_between", F.col("_top") + 1))
    chunk = F.when(F.col("_tops").isNull(), F.lit(WHOLE)).otherwise(chunk).cast("int")
    return flagged.withColumn(CHUNK, chunk).drop("_place", "_top", "_tops", "_between", "_all"), True


def ordered_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int | None = None, chunks: int | None = None) -> DataFrame:
    """The rows by key and order: cut into ranges, each of which one task sorts.

    Rows of one key and equal order share a range; a key's rows lie in one range or in successive
    ones. A range has about ``hot_rows`` rows (as in ``split_hot_groups``) at most, fewer if there are tasks to share
    the work among; ``chunks`` sets the number of ranges.
    """
    if chunks is None:
        spark = df.sparkSession
        hot_rows = hot_rows or int(spark.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))
        rows, width = df.count(), max(2, CHUNKS_PER_PARTITION * shuffle_width(spark))
        chunks = max(1, -(-rows // max(hot_rows, LEAST_RANGE)), min(width, -(-rows // min(hot_rows, LEAST_RANGE))))
    by = [*[F.col(k) for k in keys], *order_by(order)]
    return df.repartitionByRange(chunks, *by).sortWithinPartitions(*by)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    total: str | None = None,
    hot_rows: int | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Exact ``row_number`` per key (or over the whole table), optionally with the group size."""
    rows, split = split_hot_groups(df, keys, order, hot_rows, chunks)
    group = [*keys, CHUNK]
    local = Window.partitionBy(*group)
    number = F.row_number().over(local.orderBy(*order_by(order))).cast("bigint")
    size = F.count(F.lit(1)).over(local)
    if not split:
        out = rows.withColumn(name, number)
        return (out.withColumn(total, size) if total else out).drop(CHUNK)

    # One row per chunk.
    across = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = across.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.where(F.col(CHUNK) != WHOLE)
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_all", F.sum("_n").over(across))
        .drop("_n")
    )
    out = rows.withColumn(name, number)
    if total:
        out = out.withColumn(total, size)
    out = match_by(out, offsets, group)
    out = out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
    if total:
        out = out.withColumn(total, F.coalesce("_all", total))
    return out.drop("_before", "_all", CHUNK)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest order value per key, as a map-side combined aggregate.

    The order must end in a unique column. Nulls rank lowest.
    """
    newest = F.max_by(F.struct("*"), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select("_row.*")
