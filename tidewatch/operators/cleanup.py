"""Repairing and purging dimension and fact tables, as rewritten DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.joins import not_in_tuple

from tidewatch.operators.ordered import latest_per_key


def purge_orphans(dimension: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dimension rows that at least one fact refers to."""
    return dimension.join(facts.select(*keys).distinct(), list(keys), "left_semi")


def insert_from_template(
    known: DataFrame, required: DataFrame, keys: Sequence[str], version: str, literal: bool = False
) -> DataFrame:
    """Known rows plus every required (keys, version) not among them, whose other columns
    come from the newest known row of the same keys. Keys without a known row add nothing.

    With ``literal`` a required row is left out when the template itself has its version,
    and not when an older known row has it.
    """
    template = latest_per_key(known, keys, [F.col(version)])
    if literal:
        missing = required.join(template.select(*keys, version), [*keys, version], "left_anti")
    else:
        missing = required.join(known.select(*keys, version).distinct(), [*keys, version], "left_anti")
    added = missing.select(*keys, version).join(template.drop(version), list(keys))
    return known.unionByName(added.select(*known.columns))


def update_from_max(table: DataFrame, source: DataFrame, keys: Sequence[str], column: str, status: str | None = None) -> DataFrame:
    """Set a column to the greatest source value of the same keys, null where there is none,
    and reset every status that is not 0."""
    newest = source.groupBy(*keys).agg(F.max(column).alias(f"_{column}"))
    out = table.join(newest, list(keys), "left").withColumn(column, F.col(f"_{column}")).drop(f"_{column}")
    if status is not None:
        out = out.withColumn(status, F.when(~F.col(status).eqNullSafe(0), 0).otherwise(F.col(status)))
    return out.select(*table.columns)


def multi_insert(source: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One copy of a source row for every target whose condition holds, tagged ``target``.

    The source is read once. Writing the result partitioned by ``target`` fills all targets
    in one job.
    """
    chosen = F.filter(F.array(*[F.when(rule, name) for name, rule in rules.items()]), lambda t: t.isNotNull())
    return source.withColumn("target", F.explode(chosen))


def tables_with_keys(catalog: DataFrame, keys: Sequence[str], needed: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """Which of the key columns each cataloged table has; tables with none of the needed ones
    are left out."""
    flags = catalog.groupBy("table_name").agg(*[F.count(F.when(F.col("column_name") == k, 1)).alias(k) for k in keys])
    has_needed = sum((F.col(k) for k in needed), F.lit(0)) > 0
    return flags.where(has_needed & ~F.col("table_name").isin(*skip))


def purge_by_catalog(
    catalog: DataFrame,
    tables: Mapping[str, DataFrame],
    snapshots: DataFrame,
    instances: DataFrame,
    keys: Sequence[str] = ("dbid", "instance_number", "snap_id", "startup_time"),
    snapshot_key: str = "snap_id",
    database_key: str = "dbid",
    skip: Sequence[str] = (),
    excluded: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """What remains of each cataloged table after rows without an owner are purged.

    A table having the snapshot key is checked against the snapshots, another against the
    database instances, on whichever of the keys it has. ``excluded`` lists tables left alone by
    (owner, table_name), with the null rules of a tuple ``NOT IN``; the catalog then has owners.
    Only the catalog answer, one row per table, comes to the driver.
    """
    remaining = {}
    if excluded is not None:
        catalog = not_in_tuple(catalog, ["owner", "table_name"], excluded, ["owner", "table_name"])
    for row in tables_with_keys(catalog, keys, [database_key, snapshot_key], skip).collect():
        owner = snapshots if row[snapshot_key] > 0 else instances
        own_keys = [k for k in keys if row[k] > 0 and k in owner.columns]
        remaining[row["table_name"]] = purge_orphans(tables[row["table_name"]], owner, own_keys)
    return remaining


def purge_report(tables: Mapping[str, DataFrame], remaining: Mapping[str, DataFrame]) -> DataFrame:
    """Rows deleted per purged table; a table left intact shows 0."""
    report = None
    for name in sorted(remaining):
        counted = remaining[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), (-F.col("n")).alias("d"))
        before = tables[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), F.col("n").alias("d"))
        part = counted.unionByName(before)
        report = part if report is None else report.unionByName(part)
    if report is None:
        return SparkSession.active().createDataFrame([], "table_name string, rows_deleted bigint")
    return report.groupBy("table_name").agg(F.sum("d").alias("rows_deleted"))


def left_intact(report: DataFrame) -> DataFrame:
    """How many tables of a ``purge_report`` lost no row."""
    return report.agg(F.count_if(F.col("rows_deleted") == 0).alias("left_intact"))
