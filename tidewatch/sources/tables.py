"""Written tables: partitioned rewrites, purges, measurement store, report files.

Plain Parquet has no row-level changes, so every change is a rewrite: of nothing but the
touched partitions where the layout allows it. A table is never overwritten while it is read:
the new rows go to a folder of their own first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.nulls import not_true
from tidewatch.operators.measure import merge_post
from tidewatch.operators.ordered import match_by, order_by
from tidewatch.session import staged


# Fixed value: the name of the partition of rows without a partition value; Spark may show it as null.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def rewrite_partitioned(df: DataFrame, partition: str, expression: Column, path: str) -> DataFrame:
    """Write the rows partitioned by an expression and read them back.

    Rows are first gathered by partition value in balanced tasks: a large partition is split
    over several tasks, small ones share a task, and each writes few files.
    """
    df.withColumn(partition, expression).hint("rebalance", F.col(partition)).write.partitionBy(partition).parquet(path)
    return df.sparkSession.read.parquet(path)


def purge_range(table: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Rows outside the closed key range; a row without a key stays."""
    return table.where(not_true(F.col(key).between(low, high)))


def purge_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def create_range_table(df: DataFrame, name: str, key: str, width: int) -> None:
    """A catalog table partitioned into key ranges of the given width (``bucket``).

    Bucket b holds the keys from b * width on, negative ones too; rows without a key have a
    partition of their own.
    """
    rows = df.withColumn("bucket", F.expr(f"(`{key}` - pmod(`{key}`, {width})) div {width}"))
    rows.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").format("parquet").saveAsTable(name)


def purge_partitions(spark: SparkSession, name: str, key: str, width: int, low: int, high: int) -> DataFrame:
    """Remove a closed key range from a range table: drop the partitions inside it, rewrite
    the at most two partitions it only touches, and leave the others alone.

    Only partition names come to the driver.
    """
    specs = [row.partition.split("=", 1)[1] for row in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    buckets = sorted(int(spec) for spec in specs if spec != NO_KEY)
    met = [b for b in buckets if b * width <= high and (b + 1) * width - 1 >= low]
    dropped = [b for b in met if low <= b * width and (b + 1) * width - 1 <= high]
    touched = sorted(set(met) - set(dropped))
    if touched:
        kept = staged(purge_range(spark.table(name).where(F.col("bucket").isin(touched)), key, low, high), "boundary")
        left = {row.bucket for row in kept.select("bucket").distinct().collect()}
        dropped += [b for b in touched if b not in left]
        _replace_partitions(kept, name)
    for start in range(0, len(dropped), 500):
        batch = ", ".join(f"PARTITION (bucket={b})" for b in dropped[start : start + 500])
        spark.sql(f"ALTER TABLE {name} DROP {batch}")
    return spark.table(name)


def _replace_partitions(rows: DataFrame, name: str) -> None:
    """Overwrite the partitions present in the rows, and no others."""
    mode, conf = "spark.sql.sources.partitionOverwriteMode", rows.sparkSession.conf
    before = conf.get(mode)
    conf.set(mode, "dynamic")
    try:
        rows.write.insertInto(name, overwrite=True)
    finally:
        conf.set(mode, before)


def write_reports(report: DataFrame, path: str) -> None:
    """One folder per report file name."""
    report.hint("rebalance", F.col("file_name")).write.partitionBy("file_name").parquet(path)


def write_targets(tagged: DataFrame, path: str) -> None:
    """Rows tagged with a target, one folder per target, in one job."""
    tagged.write.partitionBy("target").parquet(path)


def write_ordered_text(df: DataFrame, order: Sequence[str], text: str, path: str, partition: str | None = None, tasks: int | None = None) -> None:
    """Write a text column as lines, so that the files in the order of their names hold the rows in order.

    Rows are dealt out by ranges of the order and sorted inside each range, so many tasks write
    and none sorts everything. With ``partition`` every value of that column has a folder of its
    own. Ranges are cut by the partition and order alone, so the order should tell rows apart. A
    null text is an empty line; a text that holds line feeds makes as many lines more.
    """
    columns = order_by([*([partition] if partition else []), *order])
    ranged = df.repartitionByRange(tasks, *columns) if tasks else df.repartitionByRange(*columns)
    lines = ranged.sortWithinPartitions(*columns).select(*([partition] if partition else []), F.col(text).cast("string").alias("value"))
    writer = lines.write.partitionBy(partition) if partition else lines.write
    writer.text(path)


class MeasurementStore:
    """Pre and post values of benchmark runs: one Parquet table, partitioned by run and version.

    A run is replaced by writing a new version of it beside the old one and then adding one row
    to the list of commits, which is one small file that appears whole or not at all. Readers take the
    version that a run's last commit names, so a replacement that is killed at any moment, or
    retried, leaves the rows before it readable, and one with no rows leaves none. Superseded and
    abandoned versions stay on disk and are never read. One writer at a time may replace a run.
    """

    COMMITS = "run_id long, version string, number long, columns string"

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], measures: Sequence[str]):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.measures = list(keys), list(measures)

    def _commits(self) -> DataFrame:
        """The list of commits; empty before the first one."""
        try:
            return self.spark.read.schema(self.COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.COMMITS)

    def _replace(self, run: int, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        tagged = rows.withColumns({"run_id": F.lit(run).cast("bigint"), "version": F.lit(version)})
        tagged.write.mode("append").partitionBy("run_id", "version").parquet(f"{self.path}/rows")
        self._commit(run, version, tagged.schema.json())

    def _commit(self, run: int, version: str, columns: str) -> None:
        last = self._commits().where(F.col("run_id") == run).agg(F.max("number")).first()[0] or 0
        added = self.spark.createDataFrame([(run, version, last + 1, columns)], self.COMMITS)
        added.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def save_pre(self, run: int, rows: DataFrame) -> None:
        """Replace everything saved for the run with fresh pre values."""
        kinds = {f.name: f.dataType for f in rows.schema}
        columns = {}
        for m in self.measures:
            columns[f"{m}_pre"] = F.col(m)
            columns[f"{m}_post"] = F.lit(None).cast(kinds[m])
        self._replace(run, rows.withColumns({**columns, "d_pre": F.current_timestamp(), "d_post": F.lit(None).cast("timestamp")}).drop(*self.measures))

    def save_post(self, run: int, rows: DataFrame) -> None:
        """Merge post values into the run, and say when; a new version of it, read from the old one."""
        saved = self.read().where(F.col("run_id") == run)
        merged = merge_post(saved.drop("run_id", "d_pre", "d_post"), rows, self.keys, self.measures)
        merged = match_by(merged.drop(*[f"{m}_diff" for m in self.measures]), saved.select(*self.keys, "d_pre", "d_post"), self.keys)
        merged = match_by(merged, rows.select(*self.keys, F.current_timestamp().alias("_now")), self.keys)
        merged = merged.withColumns({"d_pre": F.coalesce("d_pre", "_now"), "d_post": F.coalesce("_now", "d_post")}).drop("_now")
        self._replace(run, merged)

    def read(self) -> DataFrame:
        """The rows of every run's last committed version."""
        commits = self._commits()
        last = commits.groupBy("run_id").agg(F.max_by("version", "number").alias("version"))
        columns = commits.agg(F.max_by("columns", F.struct("number", "version"))).first()[0]
        if columns is None:
            raise ValueError(f"no run is saved in {self.path}")
        rows = self.spark.read.schema(T.StructType.fromJson(json.loads(columns))).parquet(f"{self.path}/rows")
        return rows.join(last, ["run_id", "version"], "left_semi").drop("version")
