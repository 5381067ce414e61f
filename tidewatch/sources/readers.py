"""Inputs: tables and text logs."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.session import staged

# Executors need not have this package installed: ship the helpers below by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_log_lines(spark: SparkSession, path: str, headers: Mapping[str, str] | None = None, parts: bool = False) -> DataFrame:
    """Text log lines as (trace_filename, line_number, payload) and one column per header, numbered from 1 per log.

    ``headers`` maps a column to a pattern with one group. A line that matches sets the column,
    for itself and the lines after it in the same log, until another line sets it anew; lines
    before the first have null, and a group that matches nothing sets the empty text.

    A log is a file, told from others by its whole path. With ``parts`` it is a folder, whose files
    in the order of their names (shorter names first) make up the log, as ``write_ordered_text``
    leaves them; its name is then the folder's, without the ``column=`` that partitions have.

    A large file is read by many tasks, block by block, and once. Numbers and header state are worked out
    inside a block, as its lines are read, and written with them; the last line of each block carries
    them on to the blocks after it, so no task ever holds a whole file. Of the lines' text only the headers'
    values go through Python.
    """
    headers = dict(headers or {})
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("payload"))
    # Most lines are no header: one pattern says so, and only headers are tried with each.
    header = F.col("payload").rlike(_any_pattern([*headers.values()])) if headers else F.lit(False)
    values = F.when(header, F.struct(*[
        F.when(F.col("payload").rlike(pattern), F.regexp_extract("payload", pattern, 1)).alias(name) for name, pattern in headers.items()
    ] or [F.lit(None).cast("string").alias("nothing")]))
    texts = T.StructType([T.StructField(name, T.StringType()) for name in headers or ["nothing"]])
    kind = T.StructType([T.StructField("line", T.LongType()), T.StructField("last", T.BooleanType()), T.StructField("header", texts)])
    run = _numbered(to_arrow_type(kind))

    def number(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return run(batches)

    # Not deterministic: the order of the lines counts.
    place = F.arrow_udf(number, kind).asNondeterministic()(F.xxhash64("_path"), F.col("_block"), values)
    rows = lines.withColumn("_place", place).select(
        "_path", "_block", "payload", "_place.line", "_place.last", *[F.col(f"_place.header.{name}").alias(f"_{name}") for name in headers])
    rows = staged(rows, "lines")

    log = F.regexp_replace("_path", "/[^/]*$", "") if parts else F.col("_path")
    earlier = Window.partitionBy(log).orderBy(F.length("_path"), "_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    name = F.element_at(F.split(log, "/"), -1)
    name = F.url_decode(F.replace(F.regexp_replace(name, "^[^=]*=", ""), F.lit("+"), F.lit("%2B"))) if parts else name
    summaries = rows.where("last").select(
        F.col("_path").alias("_at_path"), F.col("_block").alias("_at_block"), name.alias("trace_filename"),
        F.coalesce(F.sum("line").over(earlier), F.lit(0)).alias("_before"),
        *[F.last(f"_{name}", ignorenulls=True).over(earlier).alias(f"_from_{name}") for name in headers])
    placed = rows.join(F.broadcast(summaries), (F.col("_path") == F.col("_at_path")) & (F.col("_block") == F.col("_at_block")))  # a row for each block
    return placed.select(
        "trace_filename", (F.col("_before") + F.col("line")).alias("line_number"), "payload",
        *[F.coalesce(f"_{name}", f"_from_{name}").alias(name) for name in headers])


def _any_pattern(patterns: Sequence[str]) -> str:
    """A pattern that matches where any of them does; if all stand at a text's start, it is tried there only."""
    if all(p.startswith("^") and "|" not in p for p in patterns):
        return f"^(?:{'|'.join(f'(?:{p[1:]})' for p in patterns)})"
    return "|".join(f"(?:{p})" for p in patterns)


def _numbered(kind: pa.StructType):
    """Number of each line in its block, whether it is the block's last, and the last value of each header up to it."""
    texts = kind.field("header").type

    def run(batches):
        held, past, line, carried = None, None, 0, [None] * len(texts)

        def finished(next_is_new):
            number, changed, columns = held
            last = np.append(changed[1:], next_is_new)
            return pa.StructArray.from_arrays(
                [pa.array(number, pa.int64()), pa.array(last), pa.StructArray.from_arrays(columns, fields=list(texts))], fields=list(kind))

        for path, block, header in batches:
            a, b = path.to_numpy(zero_copy_only=False), block.to_numpy(zero_copy_only=False)
            if not len(a):
                continue
            changed = np.append(past != (a[0], b[0]), (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            row = np.arange(len(a))
            begin = np.maximum.accumulate(np.where(changed, row, -1))
            columns = []
            for j, (field, values) in enumerate(zip(texts, header.flatten())):
                at = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), row, -1))
                known = at >= np.maximum(begin, 0)
                pool = pa.concat_arrays([pa.array([carried[j]], field.type), values.cast(field.type)])
                columns.append(pool.take(pa.array(np.where(known, at + 1, 0), mask=~known & (begin >= 0))))
            if held is not None:
                yield finished(changed[0])
            held = np.where(begin >= 0, row - begin + 1, line + row + 1), changed, columns
            past, line, carried = (a[-1], b[-1]), int(held[0][-1]), [c[-1].as_py() for c in columns]
        if held is not None:
            yield finished(True)

    return run


def read_ordered_text(spark: SparkSession, path: str) -> DataFrame:
    """The lines of ``write_ordered_text`` as (line_number, line), in their order from 1 on."""
    return read_log_lines(spark, path, parts=True).select("line_number", F.col("payload").alias("line"))
