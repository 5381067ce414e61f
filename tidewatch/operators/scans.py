"""Finite-state labelling of all rows in one sorted pass, however many rows a key has.

Rows are cut into ranges of (key, order) and sorted, so that a range holds whole keys but for its
first and its last one. Only a hash of the key, a row's flags and the facts of the few rows that can
open a section go through Python; the other columns wait in the JVM. Labels of whole keys
are final at once. For a key that may go on in another range they are worked out for every state it
can be entered in, which is the same after a few rows as a rule, and a chain of one record
per range and cut key tells later which of them holds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.session import work_folder

# Executors need not have this package installed: ship the helpers below by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What a row's label is: final, one of several until the machine is in one state, relative to that
# place, or again one of several, where it counts what later ranges hold.
FINAL, EARLY, SETTLED, LATE = range(4)
OPEN, CLOSE = 0, 2  # bits of a kind's flags: first row of an opening or closing; the next bit says second row


def flag(kind: int, side: int, row: int) -> int:
    return 1 << (4 * kind + side + row)


def scanned(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], flags: Column, machine, lengths: Sequence[tuple[int, int]] = (),
    facts: Column | None = None, needed: int | None = None,
) -> DataFrame:
    """The rows with ``_label`` (``state``, ``number``, ``facts``): the machine's state at the row, its
    running count in the key, and the facts of the last row counted.

    ``rows`` are sorted ranges (``ordered_ranges``). Without ``lengths`` the flags are the machine's
    symbols, the state is that before the row, and rows without a ``needed`` bit are left out. With them, the
    rows of an opening and closing of each kind, flags are those of ``flag``, symbols say which kinds open
    and close, a kind opens only where it closes later, and the state is that of the section the row is in;
    other rows are left out. Of rows equal in key and order, the last one that can change the state
    labels all: the first of them as itself, the others as rows after it. Written once.
    """
    facts = F.lit(None).cast("struct<nothing:boolean>") if facts is None else facts
    kind = _nullable(rows.select(facts.alias("x")).schema["x"].dataType)
    label = T.StructType([T.StructField("state", T.IntegerType()), T.StructField("number", T.LongType()), T.StructField("facts", kind)])
    longs = T.ArrayType(T.LongType())
    record = T.StructType([
        *[T.StructField(n, T.LongType()) for n in ("hash", "other_hash", "head", "last_place")],
        *[T.StructField(n, longs) for n in ("border", "last_closing", "state", "number", "settled", "early", "late")],
        T.StructField("facts", T.ArrayType(kind))])
    scan = T.StructType([
        T.StructField("_zone", T.IntegerType()), T.StructField("_end", T.IntegerType()), T.StructField("_own", label),
        T.StructField("_either", T.ArrayType(label)), T.StructField("_record", T.BinaryType())])
    told = to_arrow_type(record)  # a record is one cell, so that the rows without one do not pay for its fields
    run = _scan(machine, list(lengths), needed, to_arrow_type(scan), told)

    def scan_range(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return run(batches)

    # Not deterministic: the rows' order counts, and must not be taken for idle.
    udf = F.arrow_udf(scan_range, scan).asNondeterministic()
    hashes = [*[F.xxhash64(F.lit(i), *keys) for i in (1, 2)], F.xxhash64(*dict.fromkeys(c.lstrip("-") for c in order))]
    found = rows.withColumns({"_range": F.spark_partition_id(), "_scan": udf(*hashes, flags.cast("bigint"), facts)})
    found = found.select(*rows.columns, "_range", "_scan.*")
    kept = F.lit(True) if needed is None else flags.cast("bigint").bitwiseAND(needed) != 0
    inside = ~F.col("_zone").isin(FINAL, SETTLED) | (F.col("_own.state") != 0) if lengths else F.lit(True)
    found = found.where((kept & inside) | F.col("_record").isNotNull())
    read, path = rows.sparkSession.read, work_folder(rows.sparkSession, "scanned")
    found.write.parquet(path)

    entry = T.StructType([
        T.StructField("_at", T.IntegerType()), T.StructField("_at_end", T.IntegerType()), T.StructField("_base", T.LongType()), T.StructField("_settled", T.LongType()),
        T.StructField("_early", T.IntegerType()), T.StructField("_late", T.IntegerType()), T.StructField("_facts", kind)])
    records = read.schema(found.select("_range", "_end", "_record").schema).parquet(path)
    records = records.where(F.col("_record").isNotNull()).repartition(1).sortWithinPartitions("_range", "_end")  # at most two for each range
    entries = records.mapInArrow(_chain(machine, list(lengths), to_arrow_type(entry), told), entry)
    found = read.schema(found.drop("_record").schema).parquet(path).where(kept)
    met = found.join(F.broadcast(entries), (F.col("_range") == F.col("_at")) & (F.col("_end") == F.col("_at_end")), "left")
    zone = F.col("_zone")
    chosen = F.when(zone.isin(FINAL, SETTLED), F.col("_own")).otherwise(F.try_element_at("_either", F.when(zone == EARLY, F.col("_early")).otherwise(F.col("_late")) + 1))
    met = met.withColumn("_chosen", chosen)
    before = F.when(zone == EARLY, F.col("_base")).when(zone.isin(SETTLED, LATE), F.col("_base") + F.col("_settled")).otherwise(F.lit(0))
    out = met.select(*rows.columns, F.struct(
        F.col("_chosen.state").alias("state"), (F.col("_chosen.number") + before).alias("number"),
        F.coalesce("_chosen.facts", "_facts").alias("facts")).alias("_label"))
    return out.where(F.col("_label.state") != 0) if lengths else out


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere, as written files have it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType))
    return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType)) if isinstance(kind, T.MapType) else kind


# -- a range ---------------------------------------------------------------------------------
class _Hypotheses:
    """A machine entered in every state, for each set of kinds that close in a later range, and for each
    set of ``border`` pairs, (kind, side), whose second row is the next range's first: all at once."""

    def __init__(self, machine, kinds: int, border: Sequence[tuple[int, int]]):
        self.machine, self.kinds, self.sets = machine, kinds, 1 << kinds
        spread = [sum(1 << (2 * k) for k in range(kinds) if s >> k & 1) for s in range(self.sets)]
        self.many, self.ways = (machine.width << kinds) << len(border), []
        for met in range(1 << len(border)):
            pairs = [pair for i, pair in enumerate(border) if met >> i & 1]
            closed = sum(1 << k for k, side in pairs if side == CLOSE)
            last = sum((1 if side == OPEN else 2) << (2 * k) for k, side in pairs)
            for later in range(self.sets):
                def more(unsure, closed=closed, last=last, later=later):
                    soon, late, at_border = unsure & (self.sets - 1), unsure >> kinds & (self.sets - 1), unsure >> (2 * kinds)
                    return spread[soon & (later | closed)] | spread[late & later] | (last if at_border else 0)
                self.ways.append(more)
        self.states, self.place, self.moves = [], {}, {}
        self.added: list[tuple] = []

    def id(self, states: tuple) -> int:
        if states not in self.place:
            self.place[states] = len(self.states)
            self.states.append(states)
        return self.place[states]

    def entered(self) -> int:
        return self.id(tuple(range(self.machine.width)) * len(self.ways))

    def settled(self, at: int) -> bool:
        return self.states[at] == (self.machine.start,) * len(self.states[at])

    def step(self, at: int, symbol: int, unsure: int) -> tuple[int, int]:
        move = self.moves.get((at, symbol, unsure))
        if move is None:
            width, states = self.machine.width, self.states[at]
            found = [self.machine.step(s, symbol | self.ways[h // width](unsure) if unsure else symbol) for h, s in enumerate(states)]
            self.added.append(tuple(a for _, a in found))
            move = self.moves[at, symbol, unsure] = self.id(tuple(s for s, _ in found)), len(self.added) - 1
        return move

    def walk(self, at: int, symbols: list, unsure: list, until_settled: bool) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Id reached, and for the symbols taken: states before and after, and counts added (symbols x hypotheses)."""
        before, after, added = [], [], []
        for symbol, u in zip(symbols, unsure):
            if until_settled and self.settled(at):
                break
            before.append(at)
            at, a = self.step(at, symbol, u)
            after.append(at), added.append(a)
        states, counted = np.array(self.states, np.int32), np.array(self.added or [()], np.int32)
        empty = np.empty((0, states.shape[1]), np.int32)
        return (at, *(x[y] if y else empty for x, y in ((states, before), (states, after), (counted, added))))


def _walk(machine, symbols: np.ndarray, resets: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States before and after each symbol, and what it adds to the count; a reset comes before its symbol."""
    moves, width, start, codes = {}, machine.width, machine.start, []
    first = state
    for symbol in (symbols * 2 + resets).tolist():
        key = symbol * width + state
        code = moves.get(key)
        if code is None:
            after, added = machine.step(start if symbol & 1 else state, symbol >> 1)
            code = moves[key] = after * 2 + added
        codes.append(code)
        state = code >> 1
    codes = np.array(codes, dtype=np.int64)
    after = (codes >> 1).astype(np.int32)
    before = np.append(np.int32(first), after[:-1])[: len(after)]
    before[resets] = start
    return before, after, (codes & 1).astype(np.int32)


@dataclass
class _Marks:
    """Of a range's rows: machine symbols, what is unsure in them (kinds that open if they close in a later range or at
    the border, or only if in a later range, and whether the row is at the border), and whether they may change the state."""

    symbols: np.ndarray
    unsure: np.ndarray
    marked: np.ndarray
    labelling: np.ndarray  # whether the row's label counts
    closings: list[np.ndarray]  # rows where a closing of each kind begins
    place: np.ndarray  # number of the row's order, the same for equal ones

    def last_labels(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of marks: the ones whose label counts for their place, and the first row that it is for."""
        counts = np.flatnonzero(self.labelling[at])
        places = self.place[at[counts]]
        last = counts[np.append(places[1:] != places[:-1], True)] if len(counts) else counts
        return last, self.firsts[self.place[at[last]]]

    def __post_init__(self):
        rows = np.flatnonzero(self.labelling)
        places = self.place[rows]
        new = np.append(True, places[1:] != places[:-1])[: len(rows)]
        self.firsts = np.zeros(int(self.place[-1]) + 1, np.int64)
        self.firsts[places[new]] = rows[new]


def _marked(flags: np.ndarray, place: np.ndarray, ends: np.ndarray, lengths: list, needed: int | None) -> _Marks:
    many = len(flags)
    everything = np.ones(many, bool)
    if not lengths:
        return _Marks(flags, np.zeros(many, np.int64), everything, everything if needed is None else flags & needed != 0, [], place)
    following = np.append(flags[1:], 0)
    following[ends - 1] = 0
    symbols, unsure, marked, closings = np.zeros(many, np.int64), np.zeros(many, np.int64), np.zeros(many, bool), []

    def begin(kind, side, rows):
        found = flags & flag(kind, side, 0) != 0
        at = np.flatnonzero(found & (following & flag(kind, side, 1) != 0) if rows == 2 else found)
        marked[at] = True
        if rows == 2:
            marked[at + 1] = True
        return at

    for k, (opening, closing) in enumerate(lengths):
        opens, closes = begin(k, OPEN, opening), begin(k, CLOSE, closing)
        end, opened = ends[np.searchsorted(ends, opens, side="right")], place[opens + opening - 1]
        last = np.searchsorted(closes, end) - 1
        sure = (last >= 0) & (np.append(place[closes], -1)[last] > opened)
        symbols[opens[sure]] |= 1 << (2 * k)
        soon = opened < place[end - 1]
        unsure[opens[~sure & soon]] |= 1 << k
        unsure[opens[~sure & ~soon]] |= 1 << (k + len(lengths))
        symbols[closes] |= 2 << (2 * k)
        closings.append(closes)
    return _Marks(symbols, unsure, marked, everything, closings, place)


class _Labels:
    """Labels of a range's rows; facts are known by the place of their row, -1 for those from before the range."""

    def __init__(self, rows: int):
        self.zone, self.end = np.zeros(rows, np.int32), np.full(rows, -1, np.int32)
        self.state, self.number, self.first = np.zeros(rows, np.int32), np.zeros(rows, np.int64), np.full(rows, -1, np.int64)
        self.either: list[tuple] = []  # (from, to, states, numbers, firsts), rows x alternatives

    def put(self, zone: int, at: np.ndarray, stop: int, own: np.ndarray, after: np.ndarray, number: np.ndarray, first: np.ndarray) -> None:
        """Labels of the rows ``at`` and those up to the next one."""
        if len(at):
            many, rows = np.diff(np.append(at, stop)), slice(at[0], stop)
            self.state[rows], self.number[rows], self.first[rows] = (np.repeat(x, many) for x in (after, number, first))
            self.state[at], self.zone[rows] = own, zone

    def put_either(self, zone: int, at: np.ndarray, stop: int, own: np.ndarray, after: np.ndarray, number: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The same for several hypotheses; gives the place of each one's label among the different ones."""
        if not len(at):
            return np.zeros(own.shape[1], np.int64)
        _, chosen, track = np.unique(np.vstack([own, after, number, first]), axis=1, return_index=True, return_inverse=True)
        many = np.diff(np.append(at, stop))
        states = np.repeat(after[:, chosen], many, axis=0)
        states[at - at[0]] = own[:, chosen]
        self.either.append((int(at[0]), stop, states, *(np.repeat(x[:, chosen], many, axis=0) for x in (number, first))))
        self.zone[at[0] : stop] = zone
        return track.reshape(-1)


def _cut_key(machine, lengths: list, labels: _Labels, marks: _Marks, start: int, stop: int, border: list) -> dict:
    """Labels of the rows of a key that may go on in another range, and what the range does to it."""
    marks.marked[start] = True
    if border:
        marks.marked[stop - 1] = True
        marks.unsure[stop - 1] |= 1 << (2 * len(lengths))
    at = start + np.flatnonzero(marks.marked[start:stop])
    symbols, unsure = marks.symbols[at], marks.unsure[at]
    ways = _Hypotheses(machine, len(lengths), border)
    zeros = np.zeros(ways.many, np.int64)
    kept, rows = marks.last_labels(at)
    own = (lambda before, after: np.maximum(before, after)) if lengths else (lambda before, after: before)

    def part(low, high):
        """Of the marks from low to high: those that label, their rows, and the row behind the last one's."""
        a, b = np.searchsorted(kept, (low, high))
        return kept[a:b] - low, rows[a:b], int(rows[b]) if b < len(rows) else stop

    reached, before, after, added = ways.walk(ways.entered(), symbols.tolist(), unsure.tolist(), True)
    n = len(before)
    number, first = np.cumsum(added, axis=0, dtype=np.int64), np.maximum.accumulate(np.where(added > 0, at[:n, None], -1), axis=0)
    chosen, first_rows, end = part(0, n)
    early = labels.put_either(EARLY, first_rows, end, *(x[chosen] for x in (own(before, after), after, number, first)))
    settled = total = number[-1] if n else zeros
    last, state, late = first[-1] if n else zeros - 1, np.array(ways.states[reached]), zeros

    later = np.flatnonzero(unsure[n:])
    m = n + int(later[0]) if len(later) else len(at)
    if m > n:
        before, after, added = _walk(machine, symbols[n:m], np.zeros(m - n, bool), machine.start)
        number, first = np.cumsum(added), np.maximum.accumulate(np.where(added > 0, at[n:m], -1))
        chosen, first_rows, end = part(n, m)
        labels.put(SETTLED, first_rows, end, *(x[chosen] for x in (own(before, after), after, number, first)))
        total, state, last = total + number[-1], np.full(ways.many, after[-1]), np.where(first[-1] >= 0, first[-1], last)
    if m < len(at):
        reached, before, after, added = ways.walk(ways.id(tuple(state.tolist())), symbols[m:].tolist(), unsure[m:].tolist(), False)
        opened = np.maximum.accumulate(np.where(added > 0, at[m:, None], -1), axis=0)
        first = np.where(opened >= 0, opened, np.where(state != machine.start, last, -1))
        number = np.cumsum(added, axis=0, dtype=np.int64) + (total - settled)
        chosen, first_rows, end = part(m, len(at))
        late = labels.put_either(LATE, first_rows, end, *(x[chosen] for x in (own(before, after), after, number, first)))
        total, state, last = settled + number[-1], np.array(ways.states[reached]), np.where(opened[-1] >= 0, opened[-1], last)
    return {"state": state, "number": total, "settled": settled, "early": early, "late": late, "first": last}


def _scan(machine, lengths: list, needed: int | None, kind: pa.StructType, record_kind: pa.StructType):
    """Labels of a range's rows, from Arrow columns of two hashes of the key, one of the order, the flags and the facts."""
    fact_kind = kind.field("_own").type.field("facts").type
    label_kind = kind.field("_own").type

    def run(batches):
        sizes, flags, facts, fact_rows, starts, hashes, moved, seen, past = [], [], [], [], [], [], [], 0, None
        for one, other, order, flag_column, fact_column in batches:
            a, b, o = (x.to_numpy(zero_copy_only=False) for x in (one, other, order))
            if not len(a):
                sizes.append(0)
                continue
            changed = np.append(past is None or past[:2] != (a[0], b[0]), (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            moved.append(changed | np.append(past is None or past[2] != o[0], o[1:] != o[:-1]))
            past = a[-1], b[-1], o[-1]
            new = np.flatnonzero(changed)
            starts.append(new + seen), hashes.append(np.stack([a[new], b[new]], axis=1))
            flags.append(flag_column.fill_null(0).to_numpy(zero_copy_only=False))
            told = np.flatnonzero(fact_column.is_valid().to_numpy(zero_copy_only=False))
            fact_rows.append(told + seen), facts.append(fact_column.take(pa.array(told)).cast(fact_kind))
            sizes.append(len(a))
            seen += len(a)
        if not seen:
            return
        flags, starts, hashes, fact_rows = (np.concatenate(x) for x in (flags, starts, hashes, fact_rows))
        facts = pa.concat_arrays(facts)
        ends = np.append(starts[1:], seen)
        marks = _marked(flags, np.cumsum(np.concatenate(moved)) - 1, ends, lengths, needed)
        labels, records = _Labels(seen), []
        for n, key in enumerate(sorted({0, len(starts) - 1})):
            start, stop = int(starts[key]), int(ends[key])
            labels.end[start:stop] = n
            border = [(k, side) for k, two in enumerate(lengths) for side, rows in zip((OPEN, CLOSE), two) if rows == 2 and flags[stop - 1] & flag(k, side, 0)]
            closings = [int(marks.place[c[i - 1]] - marks.place[start]) if (i := np.searchsorted(c, stop)) and c[i - 1] >= start else -1 for c in marks.closings]
            records.append((stop - 1, {
                "hash": int(hashes[key, 0]), "other_hash": int(hashes[key, 1]), "head": int(flags[start]),
                "last_place": int(marks.place[stop - 1] - marks.place[start]), "border": [4 * k + side for k, side in border], "last_closing": closings,
                **_cut_key(machine, lengths, labels, marks, start, stop, border)}))
        if len(starts) > 2:  # whole keys
            start, stop = int(starts[1]), int(starts[-1])
            marks.marked[starts[1:-1]] = True
            at = start + np.flatnonzero(marks.marked[start:stop])
            resets = np.isin(at, starts, assume_unique=True)
            before, after, added = _walk(machine, marks.symbols[at], resets, machine.start)
            number = np.cumsum(added)
            number -= (number - added)[resets][np.cumsum(resets) - 1]
            first = np.maximum.accumulate(np.where(added > 0, at, -1))
            kept, rows = marks.last_labels(at)
            labels.put(FINAL, rows, stop, *(x[kept] for x in (np.maximum(before, after) if lengths else before, after, number, first)))

        def told(rows):
            if not len(fact_rows):
                return pa.nulls(len(rows), fact_kind)
            place = np.minimum(np.searchsorted(fact_rows, rows), len(fact_rows) - 1)
            return facts.take(pa.array(place, mask=fact_rows[place] != rows))

        def struct(kind, *arrays):
            return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(arrays, kind)], fields=list(kind))

        def told_record(r):
            columns = []
            for f in record_kind:
                if f.name == "facts":
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(r["first"])], pa.int32()), told(r["first"]), type=f.type))
                else:
                    columns.append(pa.array([r[f.name].tolist() if isinstance(r[f.name], np.ndarray) else r[f.name]], f.type))
            batch = pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(record_kind)))
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch)
            return out.getvalue().to_pybytes()

        begin = 0
        for size in sizes:
            stop = begin + size
            part = slice(begin, stop)
            many, pieces = np.zeros(size, np.int32), []
            for x, y, states, numbers, firsts in labels.either:
                a, b = max(x, begin), min(y, stop)
                if a < b:
                    many[a - begin : b - begin] = states.shape[1]
                    pieces.append([z[a - x : b - x].ravel() for z in (states, numbers, firsts)])
            states, numbers, firsts = (np.concatenate(z) if pieces else np.empty(0, np.int64) for z in (zip(*pieces) if pieces else [()] * 3))
            either = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), struct(label_kind, states, numbers, told(firsts)), type=kind.field("_either").type)
            inside = np.where(labels.state[part] != 0, labels.first[part], -1)
            own = struct(label_kind, labels.state[part], labels.number[part], told(inside))
            here = [(at, r) for at, r in records if begin <= at < stop]
            index = np.zeros(size, np.int64)
            index[[at - begin for at, _ in here]] = np.arange(1, len(here) + 1)
            record = pa.array([told_record(r) for _, r in here], pa.binary()).take(pa.array(index - 1, mask=index == 0))
            yield struct(kind, labels.zone[part], labels.end[part], own, either, record)
            begin = stop

    return run


# -- all ranges ------------------------------------------------------------------------------
def _chain(machine, lengths: list, kind: pa.StructType, record_kind: pa.StructType):
    """From the records of cut keys, in order: which hypothesis holds in each range, and what to add to its labels."""
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        places = pa.Table.from_batches(held)
        table = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in places.column("_record").to_pylist()]).combine_chunks()
        plain = {f.name: table.column(f.name).to_pylist() for f in record_kind if f.name != "facts"}
        plain |= {n: places.column(n).to_pylist() for n in ("_range", "_end")}
        listed = table.column("facts").chunk(0)
        facts, begins = listed.flatten(), np.append(0, np.cumsum(listed.value_lengths().to_numpy()))
        known, rows = facts.is_valid().to_numpy(zero_copy_only=False), table.num_rows
        same = [i and plain["hash"][i] == plain["hash"][i - 1] and plain["other_hash"][i] == plain["other_hash"][i - 1] for i in range(rows)]
        starts, out = [i for i in range(rows) if not same[i]] + [rows], []
        for low, high in zip(starts, starts[1:]):
            heads = [*plain["head"][low + 1 : high], 0]
            border = [[(b // 4, b % 4) for b in x] for x in plain["border"][low:high]]
            whole = [{pair for pair in pairs if head & flag(*pair, 1)} for pairs, head in zip(border, heads)]
            end = [(-1, -1)] * len(lengths)  # range and place of each kind's last closing
            for j, i in enumerate(range(low, high)):
                for k in range(len(lengths)):
                    at = plain["last_place"][i] if (k, CLOSE) in whole[j] else plain["last_closing"][i][k]
                    if at >= 0:
                        end[k] = j, at
            state, count, fact = machine.start, 0, -1
            for j, i in enumerate(range(low, high)):
                later = sum(1 << k for k in range(len(lengths)) if end[k][0] > j)
                met = sum(1 << n for n, (k, side) in enumerate(border[j]) if (k, side) in whole[j] and (side == CLOSE or end[k] > (j + 1, 0)))
                h = ((met << len(lengths)) + later) * machine.width + state
                out.append((plain["_range"][i], plain["_end"][i], count, plain["settled"][i][h], plain["early"][i][h], plain["late"][i][h], fact))
                count, state = count + plain["number"][i][h], plain["state"][i][h]
                if known[begins[i] + h]:
                    fact = int(begins[i] + h)
        *numbers, fact = zip(*out)
        fact = np.array(fact, dtype=np.int64)
        entry = facts.take(pa.array(np.maximum(fact, 0), mask=fact < 0)).cast(kind.field("_facts").type)
        yield pa.RecordBatch.from_arrays([*[pa.array(x, f.type) for x, f in zip(numbers, kind)], entry], schema=pa.schema(list(kind)))

    return run
