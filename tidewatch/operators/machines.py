"""Finite-state labelling of ordered rows, distributed by key and, for hot keys, by chunk.

A machine reads one integer symbol per row. Rows are sorted by Spark inside (key, chunk)
and stream through the task batch by batch, so no group is ever held in memory. For a key
cut into chunks a first pass records what each chunk does to every possible state, a small
per-key pass chains those records, and the labelling pass then starts each chunk in its
right state.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.ordered import CHUNK, WHOLE, order_by

# Executors need not have this package installed: ship the few helpers below by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Subsequence:
    """Waits for symbols 0, 1, … in turn; bit s of a row's mask says it satisfies symbol s.

    With ``restart`` a row that satisfies symbol 0 abandons an unfinished match.
    """

    start = 0

    def __init__(self, symbols: int, restart: bool = False):
        self.width, self.restart = symbols, restart

    def step(self, state: int, mask: int) -> tuple[int, int]:
        if self.restart and mask & 1:
            state = 0
        if mask >> state & 1:
            return (state + 1) % self.width, int(state == 0)
        return state, 0

    def step_all(self, states: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
        if self.restart and mask & 1:
            states = np.zeros_like(states)
        hit = (mask >> states) & 1 == 1
        return np.where(hit, (states + 1) % self.width, states), (hit & (states == 0)).astype(np.int64)


class Table:
    """Explicit transitions: ``moves[symbol][state]`` is the next state; leaving 0 counts."""

    start = 0

    def __init__(self, moves: Sequence[Sequence[int]]):
        self.width = len(moves[0])
        self.moves = [list(m) for m in moves]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        after = self.moves[symbol][state]
        return after, int(state == 0 and after != 0)

    def step_all(self, states: np.ndarray, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        after = np.asarray(self.moves[symbol])[states]
        return after, ((states == 0) & (after != 0)).astype(np.int64)


class Packing:
    """Fills groups up to a capacity; the state is the weight used in the open group."""

    def __init__(self, capacity: int, first_alone: bool):
        self.capacity, self.first_alone = capacity, first_alone
        self.start = capacity + 1
        self.width = capacity + 2

    def step(self, used: int, weight: int) -> tuple[int, int]:
        if used > self.capacity and self.first_alone:
            return self.capacity, 1
        if used <= self.capacity and used + weight <= self.capacity:
            return used + weight, 0
        return min(weight, self.capacity), 1

    def step_all(self, used: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
        fits = used + weight <= self.capacity
        after = np.where(fits, used + weight, min(weight, self.capacity))
        if self.first_alone:
            after = np.where(used > self.capacity, self.capacity, after)
        return after, (~fits).astype(np.int64)


def _column(batch: pa.RecordBatch, name: str) -> list:
    """The numbers or truth values of a column; 0 or false where there is none."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False).tolist()


def _entries(batch: pa.RecordBatch) -> list | None:
    """State and count that rows set a chunk to; None for the rows that set nothing, or for all of them."""
    state, count = (batch.column(batch.schema.get_field_index(n)) for n in ("_w_state", "_w_count"))
    return None if state.null_count == len(state) else list(zip(state.to_pylist(), count.to_pylist()))


class _Effect:
    """State reached, and groups counted, from every entry state of one chunk so far.

    Entry states that have come to the same state go on as one, usually after a few rows;
    once all have, the machine is stepped like a single one.
    """

    def __init__(self, machine):
        self.machine = machine
        self.states = np.arange(machine.width)
        self.added = np.zeros(machine.width, dtype=np.int64)
        self.track = np.arange(machine.width)
        self.counts = np.zeros(machine.width, dtype=np.int64)
        self.steps = 0

    def step(self, symbol: int) -> None:
        if len(self.states) == 1:
            state, added = self.machine.step(int(self.states[0]), symbol)
            self.states[0] = state
            self.added[0] += added
            return
        self.states, added = self.machine.step_all(self.states, symbol)
        self.added += added
        self.steps += 1
        if self.steps % 16 == 0:
            self.merge()

    def merge(self) -> None:
        self.counts += self.added[self.track]
        self.states, together = np.unique(self.states, return_inverse=True)
        self.track = together[self.track]
        self.added = np.zeros(len(self.states), dtype=np.int64)

    def arrays(self) -> list[pa.Array]:
        self.merge()
        values = self.states[self.track].tolist(), self.counts.tolist()
        return [pa.array([v], pa.list_(pa.int64())) for v in values]


def _summarise(machine) -> Callable:
    """Per (key, chunk): what the chunk does to every entry state."""

    def run(batches):
        pending, effect = None, None

        def record():
            names = [n for n in pending.schema.names if not n.startswith("_w_")]
            columns = [pending.column(pending.schema.get_field_index(n)) for n in names]
            return pa.RecordBatch.from_arrays([*columns, *effect.arrays()], [*names, "_ends", "_counts"])

        for batch in batches:
            symbols, first = _column(batch, "_w_symbol"), _column(batch, "_w_first")
            for i, symbol in enumerate(symbols):
                if first[i]:
                    if pending is not None:
                        yield record()
                    pending, effect = batch.slice(i, 1), _Effect(machine)
                effect.step(symbol)
        if pending is not None:
            yield record()

    return run


def _chain(machine, chunk: str) -> Callable:
    """Per key: chain its chunks' records into the entry state and count of each chunk."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(chunk)
        state, count, states, counts = machine.start, 0, [], []
        ends, added = table.column("_ends"), table.column("_counts")
        for i in range(table.num_rows):
            states.append(state)
            counts.append(count)
            count += added[i].values[state].as_py()
            state = ends[i].values[state].as_py()
        kept = table.drop_columns(["_ends", "_counts"])
        return kept.append_column("_w_state", pa.array(states, pa.int64())).append_column(
            "_w_count", pa.array(counts, pa.int64())
        )

    return run


def _label(machine) -> Callable:
    """Run the machine over sorted rows, adding the state before and after and the count."""

    def run(batches):
        state, count = machine.start, 0
        for batch in batches:
            before, after, number = [], [], []
            symbols, firsts, entries = _column(batch, "_w_symbol"), _column(batch, "_w_first"), _entries(batch)
            for i, (symbol, first) in enumerate(zip(symbols, firsts)):
                if first:
                    state, count = machine.start, 0
                if entries is not None and entries[i][0] is not None:
                    state, count = entries[i]
                    before.append(state), after.append(state), number.append(count)
                    continue
                before.append(state)
                state, added = machine.step(state, symbol)
                count += added
                after.append(state), number.append(count)
            extra = [pa.array(x, pa.int64()) for x in (before, after, number)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *extra], [*batch.schema.names, "before", "after", "number"]
            )

    return run


def run_machine(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    symbol: str,
    machine,
    split: bool,
    also: Sequence[str] = (),
) -> DataFrame:
    """Keys, order and chunk of every row, with ``before``, ``after`` (states) and ``number`` (running count).

    ``df`` has its chunk numbers (``split``: whether any key was cut). Nothing but keys, order, chunk,
    symbol and the columns named in ``also``, which come out as they are, goes through Python: callers
    hand in the rows that can change the state and give the labels to the others with ``carried``.
    """
    group = [*keys, CHUNK]
    names = [n for n in dict.fromkeys(c.lstrip("-") for c in order) if n not in group]
    absent = F.lit(None).cast("bigint")
    also = [c for c in also if c not in group and c not in names]
    rows = df.select(*group, *names, *also, F.col(symbol).cast("bigint").alias("_w_symbol"), absent.alias("_w_state"), absent.alias("_w_count"))
    sorted_group = Window.partitionBy(*group).orderBy(F.col("_w_state").asc_nulls_last(), *order_by(order))
    first = F.row_number().over(sorted_group) == 1

    if split:
        narrow = rows.where(F.col(CHUNK) != WHOLE).withColumn("_w_first", first).select(*group, "_w_symbol", "_w_first")
        keyed = T.StructType([narrow.schema[c] for c in group])
        longs = T.ArrayType(T.LongType())
        effects = narrow.mapInArrow(_summarise(machine), T.StructType([*keyed, *_fields(("_ends", longs), ("_counts", longs))]))
        entry_schema = T.StructType([*keyed, *_fields(("_w_state", T.LongType()), ("_w_count", T.LongType()))])
        entries = effects.groupBy(*keys).applyInArrow(_chain(machine, CHUNK), entry_schema)
        rows = rows.unionByName(entries.withColumn("_w_entry", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumn("_w_first", first)
    added = _fields(("before", T.LongType()), ("after", T.LongType()), ("number", T.LongType()))
    labelled = rows.mapInArrow(_label(machine), T.StructType([*rows.schema, *added]))
    if split:
        labelled = labelled.where(F.col("_w_entry").isNull())
    return labelled.select(*group, *names, *also, "before", "after", "number")


def carried(rows: DataFrame, labels: DataFrame, keys: Sequence[str], order: Sequence[str], start: int = 0, also: Sequence[str] = ()) -> DataFrame:
    """Gives the labels of some rows (from ``run_machine``) to all rows.

    A labelled row gets its label; a row between labels the state after the last one, as
    ``before`` and ``after``, and its number; a row before all labels of its chunk the state
    ``start`` and number 0. Labels and rows meet by a running window inside (key, chunk), which
    holds one row at a time. The order must tell the rows of a key apart. Columns of the labels named
    in ``also`` are carried on like the state.
    """
    label = F.struct("before", "after", "number", *also)
    names = [n for n in dict.fromkeys(c.lstrip("-") for c in order) if n not in keys]
    tagged = rows.withColumns({"_w_label": F.lit(None).cast(labels.select(label.alias("x")).schema["x"].dataType), "_w_row": F.lit(1)})
    marks = labels.select(*keys, CHUNK, *names, label.alias("_w_label"), F.lit(0).alias("_w_row"))
    ordered = Window.partitionBy(*keys, CHUNK).orderBy(*order_by(order), "_w_row")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = tagged.unionByName(marks, allowMissingColumns=True)
    both = both.withColumns({"_w_last": F.last("_w_label", ignorenulls=True).over(running), "_w_own": F.lag("_w_row").over(ordered) == 0})
    after = F.coalesce("_w_last.after", F.lit(start))
    given = both.where("_w_row = 1").withColumns({
        "before": F.when(F.col("_w_own"), F.col("_w_last.before")).otherwise(after), "after": after,
        "number": F.coalesce("_w_last.number", F.lit(0)), **{c: F.col(f"_w_last.{c}") for c in also}})
    return given.drop("_w_label", "_w_row", "_w_last", "_w_own")


def _fields(*pairs) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in pairs]
