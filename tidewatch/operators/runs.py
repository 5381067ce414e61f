"""Run segmentation of ordered samples, and enrichment of the runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordered import CHUNK, WHOLE, comparable, order_by, split_hot_groups


def run_segments(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    state: str,
    time: str,
    sums: Sequence[str] = (),
    max_gap: int = 10,
    on_break: str = "drop",
    hot_rows: int | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Split each key's ordered samples into runs of one state.

    The first order column is the sample number, or with a leading ``-`` counts down. A run starts at a key's first row or where
    the state changes, null counting as a state. A run of null state goes on only while the
    sample number grows by 1 to ``max_gap``; a row breaking that rule, and the rest of its
    stretch, is dropped (``on_break='drop'``) or opens a new run (``'split'``).

    Adds ``run_id``, ``run_row``, ``run_samples``, first and last sample and time, and
    ``run_<name>`` for every summed column.
    """
    if on_break not in ("drop", "split"):
        raise ValueError("on_break must be 'drop' or 'split'")
    rows, split = split_hot_groups(df, keys, order, hot_rows, chunks)
    tags = list(df.columns)
    names = [c.lstrip("-") for c in order]
    rows = rows.withColumns({"_state": F.col(state), "_pos": F.col(names[0]), "_seed": F.lit(False), "_order": comparable(df, order)})

    if split:
        needed = list(dict.fromkeys([*keys, *names, time, *sums, CHUNK, "_state", "_pos", "_seed", "_order"]))
        narrow = rows.where(F.col(CHUNK) != WHOLE).select(*needed)
        seeds = _last_of_previous_chunk(narrow, keys, order)
        marked = _mark(narrow.unionByName(seeds, allowMissingColumns=True), keys, order, max_gap, on_break)
        entries = _entries(marked, keys, order, time, sums, seeds)
        rows = rows.unionByName(entries, allowMissingColumns=True)
    marked = _mark(rows, keys, order, max_gap, on_break, entry=split)

    kept = marked.where((F.col("_bad") == 0) & _open_at_entry(split))
    piece = Window.partitionBy(*keys, CHUNK, "_piece")
    sample = _edge(order, time)
    kept = kept.withColumn("_row_in_piece", F.row_number().over(piece.orderBy(*order_by(order)))).withColumns(
        {
            "_n": F.count(F.lit(1)).over(piece),
            "_first": F.min(sample).over(piece),
            "_last": F.max(sample).over(piece),
            **{f"_sum_{c}": F.sum(c).over(piece) for c in sums},
        }
    )
    return _finish(kept, tags, split, order, time, sums)


def _edge(order: Sequence[str], time: str) -> Column:
    """A comparable record whose minimum and maximum are a run's first and last sample."""
    return F.struct("_order", F.col(order[0].lstrip("-")).alias("_sample"), F.col(time).alias("_at"))


def _mark(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    max_gap: int,
    on_break: str,
    entry: bool = False,
) -> DataFrame:
    """Number the pieces inside each chunk; piece 0 continues a run of an earlier chunk.

    A seed row, sorted first, carries the last sample of the previous chunk.
    """
    group = Window.partitionBy(*keys, CHUNK)
    ordered = group.orderBy(F.col("_seed").desc(), *order_by(order))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.col("_pos") - F.lag("_pos").over(ordered)
    step = -step if order[0].startswith("-") else step
    has_previous = F.lag(F.col("_pos").isNotNull()).over(ordered)
    starts = ~F.coalesce(has_previous, F.lit(False)) | ~F.col("_state").eqNullSafe(F.lag("_state").over(ordered))
    in_step = F.coalesce((step > 0) & (step <= max_gap), F.lit(False))
    breaks = ~starts & F.col("_state").isNull() & ~in_step
    if on_break == "split":
        starts, breaks = starts | breaks, F.lit(False)
    marked = rows.withColumns({"_start": ~F.col("_seed") & starts, "_break": ~F.col("_seed") & breaks})
    marked = marked.withColumn("_piece", F.sum(F.col("_start").cast("int")).over(so_far).cast("bigint"))
    in_piece = (
        Window.partitionBy(*keys, CHUNK, "_piece")
        .orderBy(F.col("_seed").desc(), *order_by(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    marked = marked.withColumn("_bad", F.max(F.col("_break").cast("int")).over(in_piece))
    if entry:
        marked = marked.withColumn("_entry", F.first("_entry").over(so_far))
        marked = marked.withColumn("_top_piece", F.max("_piece").over(group))
    return marked.where(~F.col("_seed")).drop("_start", "_break", "_seed")


def _last_of_previous_chunk(narrow: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    ends = narrow.groupBy(*keys, CHUNK).agg(
        F.max_by(F.struct("_state", "_pos"), "_order").alias("_end")
    )
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*keys).orderBy(CHUNK)))
    return ends.select(*keys, CHUNK, "_end._state", "_end._pos", F.lit(True).alias("_seed"))


def _entries(
    marked: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    time: str,
    sums: Sequence[str],
    seeds: DataFrame,
) -> DataFrame:
    """Per chunk: runs begun before it, and totals of the runs crossing its two borders."""
    sample = _edge(order, time)
    kept = F.col("_bad") == 0
    head, tail = F.col("_piece") == 0, F.col("_piece") == F.col("_pieces")

    def measures(part: Column, prefix: str) -> list[Column]:
        use = part & kept
        return [
            F.count(F.when(use, 1)).alias(f"{prefix}_n"),
            F.min(F.when(use, sample)).alias(f"{prefix}_first"),
            F.max(F.when(use, sample)).alias(f"{prefix}_last"),
            *[F.sum(F.when(use, F.col(c))).alias(f"{prefix}_sum_{c}") for c in sums],
        ]

    counted = marked.withColumn("_pieces", F.max("_piece").over(Window.partitionBy(*keys, CHUNK)))
    summary = counted.groupBy(*keys, CHUNK).agg(
        F.max("_pieces").alias("starts"),
        F.max(F.when(tail, F.col("_bad"))).alias("end_bad"),
        F.max(F.when(head, F.col("_bad"))).alias("head_bad"),
        *measures(head, "head"),
        *measures(tail & (F.col("_pieces") > 0), "tail"),
    )
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumns(
        {
            "base": F.coalesce(F.sum("starts").over(before), F.lit(0)),
            "open_run": F.coalesce(F.sum((F.col("starts") > 0).cast("int")).over(before), F.lit(0)),
        }
    )
    summary = summary.withColumn("tail_run", F.col("open_run") + (F.col("starts") > 0).cast("int"))
    broken = F.max("end_bad").over(Window.partitionBy(*keys, "tail_run").orderBy(CHUNK))
    summary = summary.withColumn("broken_after", broken)
    summary = summary.withColumn("broken", F.coalesce(F.lag("broken_after").over(by_chunk), F.lit(0)) == 1)

    # A run crossing borders gets one part from its first chunk's tail and one from the head
    # of each later chunk, until broken. Parts per run are at most the number of chunks.
    def part(which: str, run: str, live: Column) -> Column:
        fields = [F.when(live, F.col(f"{which}_n")).alias("n")]
        fields += [F.when(live, F.col(f"{which}_{e}")).alias(e) for e in ("first", "last")]
        fields += [F.when(live, F.col(f"{which}_sum_{c}")).alias(f"sum_{c}") for c in sums]
        return F.struct(F.lit(which).alias("which"), F.col(run).alias("run"), *fields)

    always = F.lit(True)
    parts = summary.select(
        *keys,
        CHUNK,
        "base",
        "broken",
        F.explode(F.array(part("head", "open_run", ~F.col("broken")), part("tail", "tail_run", always))).alias("p"),
    ).where((F.col("p.which") == "head") | F.col("p.first").isNotNull())
    run = Window.partitionBy(*keys, "p.run")
    earlier = run.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn(
        "t",
        F.struct(
            F.sum("p.n").over(run).alias("n"),
            F.coalesce(F.sum("p.n").over(earlier), F.lit(0)).alias("before"),
            F.min("p.first").over(run).alias("first"),
            F.max("p.last").over(run).alias("last"),
            *[F.sum(f"p.sum_{c}").over(run).alias(f"sum_{c}") for c in sums],
        ),
    )
    entry = parts.groupBy(*keys, CHUNK).agg(
        F.struct(
            F.max("base").alias("base"),
            F.max("broken").alias("broken"),
            F.max(F.when(F.col("p.which") == "head", F.col("t"))).alias("head"),
            F.max(F.when(F.col("p.which") == "tail", F.col("t"))).alias("tail"),
        ).alias("_entry")
    )
    # Both sides hold one row per chunk; a union and a second small aggregate avoid a
    # null-safe join of the two.
    both = seeds.unionByName(entry, allowMissingColumns=True)
    return both.groupBy(*keys, CHUNK).agg(
        F.max("_state").alias("_state"),
        F.max("_pos").alias("_pos"),
        F.max("_entry").alias("_entry"),
        F.lit(True).alias("_seed"),
    )


def _open_at_entry(split: bool) -> Column:
    if not split:
        return F.lit(True)
    return (F.col("_piece") > 0) | ~F.coalesce(F.col("_entry.broken"), F.lit(False))


def _finish(
    kept: DataFrame, tags: Sequence[str], split: bool, order: Sequence[str], time: str, sums: Sequence[str]
) -> DataFrame:
    def total(local: str, shared: str) -> Column:
        value = F.col(local)
        if not split:
            return value
        return (
            F.when(F.col("_piece") == 0, F.col(f"_entry.head.{shared}"))
            .when(
                (F.col("_piece") == F.col("_top_piece")) & F.col("_entry.tail").isNotNull(),
                F.col(f"_entry.tail.{shared}"),
            )
            .otherwise(value)
        )

    base = F.coalesce(F.col("_entry.base"), F.lit(0)) if split else F.lit(0)
    ahead = F.lit(0)
    if split:
        ahead = F.when(F.col("_piece") == 0, F.col("_entry.head.before")).otherwise(F.lit(0))
    first, last = total("_first", "first"), total("_last", "last")
    return kept.select(
        *tags,
        (F.col("_piece") + base).cast("bigint").alias("run_id"),
        (F.col("_row_in_piece") + ahead).cast("bigint").alias("run_row"),
        total("_n", "n").cast("bigint").alias("run_samples"),
        first["_sample"].alias("run_start_sample"),
        last["_sample"].alias("run_end_sample"),
        first["_at"].alias("run_start_time"),
        last["_at"].alias("run_end_time"),
        *[total(f"_sum_{c}", f"sum_{c}").alias(f"run_{c}") for c in sums],
    )
