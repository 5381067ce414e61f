"""Generated rows: dense sequences, assigned ids, random texts, log rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.ordered import number_rows


ROWS_PER_TASK = 1_000_000


def _numbers(spark: SparkSession, n: int) -> DataFrame:
    """0 … n − 1, in as many tasks as bound the rows of each, but not fewer than there are cores."""
    return spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK)))


def sequence_rows(spark: SparkSession, n: int) -> DataFrame:
    """The numbers 0 … n − 1 as column ``x``, generated in parallel."""
    return _numbers(spark, n).withColumnRenamed("id", "x")


def sequence_grid(spark: SparkSession, n: int) -> DataFrame:
    """Numbers from two coordinates below the root of n: a × (trunc(√n + 1)) + b.

    The coordinates come from one range by division, so nothing is cross-joined. The stride
    is greater than the side unless √n is whole, which leaves gaps; they are part of the result.
    """
    side, stride = math.floor(math.sqrt(n)), math.trunc(math.sqrt(n) + 1)
    return _numbers(spark, side * side).select((F.expr(f"id div {side}") * stride + F.col("id") % side).alias("x"))


def assign_ids(
    df: DataFrame, column: str, order: Sequence[str], start: int = 1, step: int = 10,
    hot_rows: int | None = None, chunks: int | None = None,
) -> DataFrame:
    """Keep given ids; give the rows without one the next values of a sequence, in order."""
    missing = number_rows(df.where(F.col(column).isNull()), [], order, "_rn", hot_rows=hot_rows, chunks=chunks)
    filled = missing.withColumn(column, start + step * (F.col("_rn") - 1)).drop("_rn")
    return df.where(F.col(column).isNotNull()).unionByName(filled)


def random_text(seed: Column, length: int, salt: str) -> Column:
    """A repeatable text of hexadecimal digits in capitals, drawn from hashes of the seed."""
    blocks = [F.md5(F.concat_ws(":", F.lit(salt), seed.cast("string"), F.lit(i))) for i in range(-(-length // 32))]
    return F.upper(F.substring(F.concat(*blocks), 1, length))


def random_rows(ids: DataFrame, id_column: str = "id", lengths: Sequence[int] = (1, 2, 8, 32), salt: str = "rows") -> DataFrame:
    """A row per id with one random text of each length, the same in every execution."""
    texts = [random_text(F.col(id_column), n, f"{salt}-{n}").alias(f"col_{n}") for n in lengths]
    return ids.select(F.col(id_column).alias("id"), *texts)


def log_rows(numbers: DataFrame, number: str, seconds: int = 12, preload: bool = True) -> DataFrame:
    """A log row per number: type and object by its remainder, time by its multiple.

    The preload has negative ids and archive names; otherwise ids and names are those of
    timed inserts.
    """
    # The message types, the marked remainder, the first moment.
    i = F.col(number).cast("bigint")
    kind = F.when(i % 3 == 0, "I").when(i % 3 == 1, "W").otherwise("E")
    marked = i % 100 == 17
    moment = F.timestamp_add("SECOND", i * seconds, F.lit("2022-01-01 00:00:00").cast("timestamp_ntz"))
    return numbers.select(
        (-i if preload else i).alias("id"),
        (i if preload else F.lit(None).cast("bigint")).alias("process_log_oid"),
        F.when(marked, "DOC").alias("object_type"),
        i.alias("doc_id"),
        moment.alias("message_date"),
        F.when(marked, i).alias("mess_dict_id"),
        kind.alias("message_type"),
        F.concat(F.lit("archive_" if preload else "iteration_"), i.cast("string")).alias("message_name"),
        F.lit(None).cast("string").alias("synch_tag"),
        F.lit("X").alias("partition_key"),
    )
