"""Row patterns over ordered rows: delimited sections, ordered fields, greedy packing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.nulls import null_if_blank
from tidewatch.operators.machines import Packing, Subsequence, Table, carried, run_machine
from tidewatch.operators.ordered import comparable, match_by, ordered_ranges, split_hot_groups
from tidewatch.operators.scans import CLOSE, OPEN, flag, scanned


@dataclass(frozen=True)
class SectionKind:
    """A section opens with one or two adjacent rows and closes with one or two."""

    name: str
    opening: tuple[Column, ...]
    closing: tuple[Column, ...]


def sections(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    kinds: Sequence[SectionKind],
    hot_rows: int | None = None,
    chunks: int | None = None,
    facts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows inside the shortest, non-overlapping sections, in order of appearance.

    Kinds are alternatives tried in the given order at each row. An opening with no closing
    of its kind later in the same key opens nothing. Adds ``section`` (numbered from 1 per
    key), ``kind``, and the ``facts``: expressions on the first row of a section. The order must
    tell the rows of a key apart.

    All rows are sorted once; only the flags of rows that match part of an opening or closing, and the
    facts of those that may be a section's first, are looked at outside the JVM.
    """
    if any(not 1 <= len(side) <= 2 for k in kinds for side in (k.opening, k.closing)):
        raise ValueError("an opening or closing has one or two rows")
    facts = dict(facts or {})
    flags, opening, met = F.lit(0).cast("bigint"), 0, {}
    for i, k in enumerate(kinds):
        opening |= flag(i, OPEN, 0)
        for side, conditions in ((OPEN, k.opening), (CLOSE, k.closing)):
            for j, condition in enumerate(conditions):  # one that stands for several rows is worked out once
                met[id(condition)] = condition, met.get(id(condition), (None, 0))[1] | flag(i, side, j)
    for condition, bits in met.values():
        flags = flags + F.when(condition, bits).otherwise(0)
    lengths = [(len(k.opening), len(k.closing)) for k in kinds]
    moves, kind_of = _section_moves(lengths)
    said = F.when(F.col("_flags").bitwiseAND(opening) != 0, F.struct(*[c.alias(n) for n, c in (facts or {"said": F.lit(True)}).items()]))
    rows = ordered_ranges(df, keys, order, hot_rows, chunks).withColumn("_flags", flags)
    rows = scanned(rows, keys, order, F.col("_flags"), Table(moves), lengths, said)
    names = F.array(*[F.lit(None if k is None else kinds[k].name) for k in kind_of])
    return rows.select(
        *df.columns,
        F.col("_label.number").alias("section"),
        F.element_at(names, F.col("_label.state") + 1).alias("kind"),
        *[F.col(f"_label.facts.{n}").alias(n) for n in facts],
    )


def _section_moves(lengths: Sequence[tuple[int, int]]) -> tuple[list[list[int]], list[int | None]]:
    """Transition table over the open/close bits of all kinds, and the kind of each state."""
    kind_of, opening, inside, closing = [None], {}, {}, {}
    for kind, (open_rows, close_rows) in enumerate(lengths):
        for states, needed in ((opening, open_rows == 2), (inside, True), (closing, close_rows == 2)):
            if needed:
                states[kind] = len(kind_of)
                kind_of.append(kind)
    moves = []
    for bits in range(4 ** len(lengths)):
        row = [0] * len(kind_of)
        for kind in reversed(range(len(lengths))):
            if bits >> (2 * kind) & 1:
                row[0] = opening.get(kind, inside[kind])
            if kind in opening:
                row[opening[kind]] = inside[kind]
            closes = bits >> (2 * kind) & 2
            row[inside[kind]] = closing.get(kind, 0) if closes else inside[kind]
        moves.append(row)
    return moves, kind_of


def key_value(df: DataFrame, text: str) -> DataFrame:
    """Split ``name: value`` lines into trimmed ``var`` and ``value``; other lines give nulls."""
    # Fixed value: the line shape.
    line = r"^\s*([^:]+?)\s*:\s*(.+?)\s*$"
    paired = F.contains(F.col(text), F.lit(":"))
    return df.withColumns({
        name: F.when(paired, null_if_blank(F.regexp_extract(text, line, i))) for i, name in ((1, "var"), (2, "value"))})


def section_heads(df: DataFrame, keys: Sequence[str], order: Sequence[str], **facts: Column) -> DataFrame:
    """Attach facts computed on the first row of each section to all of its rows."""
    group = [*keys, "section"]
    first = F.min_by(F.struct(*[c.alias(n) for n, c in facts.items()]), comparable(df, order)).alias("_head")
    heads = df.groupBy(*group).agg(first).select(*group, *[F.col(f"_head.{n}").alias(n) for n in facts])
    return match_by(df, heads, group)


def ordered_fields(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    symbols: Mapping[str, Column],
    fields: Mapping[str, tuple[str, Column]],
    reset_on_start: bool = False,
    hot_rows: int | None = None,
    chunks: int | None = None,
    mask: Column | None = None,
) -> DataFrame:
    """One row per ordered, non-overlapping match of the symbols, with any rows in between.

    ``symbols`` maps each name, in order, to its condition. ``fields`` maps an output name to
    (symbol, expression on the row matched as that symbol). ``mask``, where the rows have it
    already, says the same as the conditions: bit i is set if the row satisfies the i-th symbol.
    All columns of ``df`` are sorted, so hand in no more than the fields need.
    """
    names = list(symbols)
    if mask is None:
        mask = F.lit(0)
        for i, name in enumerate(names):
            mask = mask + F.when(symbols[name], 1 << i).otherwise(0)
    rows = df.withColumn("_mask", mask).where("_mask > 0")
    # Only rows that can give a field or end a match are kept with their labels.
    needed = sum(1 << i for i in {len(names) - 1, *(names.index(symbol) for symbol, _ in fields.values())})
    rows = ordered_ranges(rows, keys, order, hot_rows, chunks)
    labelled = scanned(rows, keys, order, F.col("_mask"), Subsequence(len(names), reset_on_start), needed=needed)
    state = F.when(F.lit(reset_on_start) & (F.col("_mask").bitwiseAND(1) > 0), 0).otherwise(F.col("_label.state"))
    used = labelled.withColumn("_taken", state.cast("int"))
    used = used.where(F.expr("shiftright(_mask, _taken) & 1 = 1"))
    matched = used.groupBy(*keys, F.col("_label.number").alias("match")).agg(
        F.count_if(F.col("_taken") == len(names) - 1).alias("_done"),
        *[
            F.max(F.when(F.col("_taken") == names.index(symbol), value)).alias(out)
            for out, (symbol, value) in fields.items()
        ],
    )
    return matched.where("_done > 0").drop("_done")


def greedy_pack(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    limit: int = 3800,
    first_alone: bool = True,
    hot_rows: int | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Number consecutive texts into groups whose quoted, comma-separated list fits the limit.

    With ``first_alone`` the first text of a key forms its own group. A text too long for
    any group gets a group number of its own.
    """
    # A quoted name costs two quotes, and each name after the first a two-character separator.
    rows, split = split_hot_groups(df.withColumn("_weight", F.coalesce(F.length(text), F.lit(0)) + 4), keys, order, hot_rows, chunks)
    labels = run_machine(rows, keys, order, "_weight", Packing(limit + 2, first_alone), split)
    packed = carried(rows, labels, keys, order)
    return packed.select(*df.columns, F.col("number").alias("pack"))


def pack_lists(packed: DataFrame, keys: Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """One row per group of ``greedy_pack``: its members' quoted names in order, as one list text.

    A group's list fits the packing's limit, so it is one small cell; a name too long for any
    group is a list of its own. Null names are not listed, but a group of nothing else keeps its row.
    """
    quoted = F.concat(F.lit('"'), F.col(text), F.lit('"'))
    named = F.when(F.col(text).isNotNull(), F.struct(comparable(packed, order).alias("at"), quoted.alias("name")))
    members = F.array_sort(F.collect_list(named))
    return packed.groupBy(*keys, "pack").agg(
        null_if_blank(F.array_join(F.transform(members, lambda m: m["name"]), ", ")).alias("part_list"), F.count(F.lit(1)).alias("parts"))
