"""Joins that equality of columns does not express: overlapping intervals, texts that contain texts, tuple exclusion."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.ordered import comparable
from tidewatch.session import staged

# Executors need not have this package installed: ship the few helpers below by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of distinct patterns up to which one automaton of them is sent to every task.
AUTOMATON_BYTES = 8 << 20
#: Characters of the piece of a pattern that is looked up where the patterns are more.
PIECE = 12
BITS = 24


def _span(df: DataFrame, span: tuple[str, str]) -> list[Column]:
    """Start and end as whole numbers; null for a span without either or with its end before its start."""
    low, high = (comparable(df, [c])["value_0"] for c in span)
    good = low.isNotNull() & high.isNotNull() & (low <= high)
    return [F.when(good, low), F.when(good, high)]


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = (), left_span: tuple[str, str] = ("start", "end"),
    right_span: tuple[str, str] = ("start", "end"),
) -> DataFrame:
    """All pairs of rows with equal keys whose closed intervals share a point.

    Bounds are whole numbers, dates or times. The result has the columns of ``left``, then those
    of ``right`` but for the keys; other names must differ. Intervals with a null bound, or whose
    end lies before their start, meet nothing, nor do null keys.

    An interval belongs to the level of the power of two that its length fits in, where it
    touches two bins at most. Intervals of two levels meet in the bins of the higher one, and there
    only in the first bin that both touch, so each pair comes once. So a long interval is never cut
    into many bins, and what meets in a bin is no more than a constant times what overlaps. Both
    sides of the join are plain shuffles, which lets Spark split a bin that holds very much.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")

    def levelled(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        low, high = _span(df, span)
        rows = df.select(*keys, F.struct("*").alias("row"), low.alias("low"), high.alias("high")).where("low IS NOT NULL")
        return rows.withColumn("level", F.ceil(F.log2(F.col("high").cast("double") - F.col("low") + 1)).cast("int"))

    sides = [levelled(left, left_span), levelled(right, right_span)]
    levels = [sorted(r[0] for r in side.select("level").distinct().collect()) for side in sides]  # some sixty at most

    def binned(side: DataFrame, others: list[int], name: str) -> DataFrame:
        above = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col("level"))
        rows = side.withColumn("at", F.explode(F.concat(F.array("level"), above)))
        rows = rows.withColumns({"first": F.expr("shiftright(low, at)"), "last": F.expr("shiftright(high, at)")})
        return rows.select(
            *keys, "at", F.explode(F.sequence("first", "last")).alias("bin"),
            F.struct("row", "low", "high", "level", "first").alias(name))

    a, b = binned(sides[0], levels[1], "a"), binned(sides[1], levels[0], "b")
    met = a.join(b, [*keys, "at", "bin"]).where(
        (F.col("at") == F.greatest("a.level", "b.level")) & (F.col("bin") == F.greatest("a.first", "b.first"))
        & (F.col("a.low") <= F.col("b.high")) & (F.col("b.low") <= F.col("a.high")))
    return met.select(
        *[F.col("a.row").getField(c).alias(c) for c in left.columns], *[F.col("b.row").getField(c).alias(c) for c in right.columns if c not in keys])


def not_in_tuple(df: DataFrame, columns: Sequence[str], members: DataFrame, member_columns: Sequence[str]) -> DataFrame:
    """SQL's ``(a, b, ...) NOT IN (SELECT x, y, ...)``, nulls and all, by equality joins.

    A row stays if its tuple surely differs from every member, that is, if some column of it
    differs where neither side is null. A member's nulls, and a row's, equal anything. For every set of
    columns that members have nulls in (2 to the number of columns at most, found by one small
    job), rows and members meet on the columns that both have, as an anti-join per set.
    """
    names = [f"_m_{i}" for i in range(len(columns))]

    def known(cols: Sequence[str]) -> Column:
        return sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0))

    listed = members.select(*[F.col(c).alias(n) for c, n in zip(member_columns, names)]).distinct().withColumn("_known", known(names))
    out = df.withColumn("_has", known(columns))
    for (mask,) in sorted(tuple(r) for r in listed.select("_known").distinct().collect()):
        # What a row of each null pattern has to equal: the member's values where both have one.
        patterns = F.explode(F.array(*[F.lit(i) for i in range(1 << len(columns))])).alias("_of")
        some = listed.where(F.col("_known") == mask).select(patterns, *names)
        some = some.select("_of", *[F.when(F.col("_of").bitwiseAND(1 << i) != 0, F.col(n)).alias(n) for i, n in enumerate(names)]).distinct()
        same = F.col("_has") == F.col("_of")
        for i, (c, n) in enumerate(zip(columns, names)):
            if mask >> i & 1:
                same = same & F.col(c).eqNullSafe(F.col(n))
        out = out.join(some, same, "left_anti")
    return out.drop("_has")


def contains_join(
    texts: DataFrame, patterns: DataFrame, key: str, text: str, pattern_key: str, pattern: str, most_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """(key, pattern_key) of every text and every pattern that it contains, letter for letter.

    Null texts and patterns, and empty patterns, meet nothing. Rows that repeat a key are searched
    each. Up to ``most_bytes`` of distinct patterns, measured by one job, all are found in one walk
    over a text by an automaton that every task is sent. Beyond, a piece of each pattern (its rarest
    ``PIECE`` characters among the patterns, or all of a shorter one) is looked up among the pieces of
    the texts, of which a bitmap of fixed size lets few through, and what shares a piece is verified.
    """
    listed = patterns.select(F.col(pattern_key).alias("p_key"), F.col(pattern).alias("pattern")).where("pattern <> ''")
    distinct = listed.select("pattern").distinct()
    rows = texts.select(F.col(key).alias("t_key"), F.col(text).alias("text")).where("text IS NOT NULL")
    size = distinct.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    found = _by_automaton(rows, distinct) if size <= most_bytes else _by_pieces(rows, distinct)
    return found.join(listed, "pattern").select(F.col("t_key").alias(key), F.col("p_key").alias(pattern_key))


def _by_automaton(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(sorted(r[0] for r in distinct.collect()))  # of a checked size
    schema = T.StructType([T.StructField("t_key", rows.schema["t_key"].dataType), T.StructField("pattern", T.StringType())])

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in sent.value:
            automaton.add_word(word, word)
        if sent.value:
            automaton.make_automaton()
        for batch in batches:
            place, words = [], []
            for i, body in enumerate(batch.column(1).to_pylist() if sent.value else ()):
                held = {word for _, word in automaton.iter(body)}
                place += [i] * len(held)
                words += held
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), pa.array(words, pa.string())], names=["t_key", "pattern"])

    return rows.mapInArrow(run, schema)


def _pieces(body: str, size: int) -> np.ndarray:
    """64-bit hashes of all pieces of a text of the given length, in their order."""
    points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points) - size + 1
    value = np.full(max(n, 0), size, dtype=np.uint64)
    for i in range(size if n > 0 else 0):
        value = value * np.uint64(0x9E3779B97F4A7C15) + points[i : i + n] + np.uint64(1)
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29))


def _by_pieces(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    def every(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            parts = [_pieces(w, min(len(w), PIECE)) for w in words]
            sizes = [len(p) for p in parts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(len(words)), sizes))),
                pa.array(np.repeat([min(len(w), PIECE) for w in words], sizes), pa.int32()),
                pa.array(np.concatenate(parts).view(np.int64) if parts else [], pa.int64())], names=["pattern", "size", "piece"])

    pieces = staged(distinct.mapInArrow(every, "pattern string, size int, piece long"), "pieces")
    counted = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min_by(F.struct("size", "piece"), F.struct("n", "piece")).alias("at")
    chosen = staged(pieces.join(counted, "piece").groupBy("pattern").agg(rarest).select("pattern", "at.*"), "chosen")
    sizes = sorted(r[0] for r in chosen.select("size").distinct().collect())  # PIECE at most
    slot = F.col("piece").bitwiseAND((1 << BITS) - 1)
    bits = F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits")
    words = chosen.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(bits).toArrow()  # 2^(BITS - 6) rows at most
    bitmap = np.zeros(1 << (BITS - 6), dtype=np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def present(batches):
        bitmap = sent.value
        for batch in batches:
            place, held = [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                for size in sizes:
                    found = np.unique(_pieces(body, size))
                    at = (found & np.uint64((1 << BITS) - 1)).astype(np.int64)
                    found = found[(bitmap[at >> 6] >> (at & 63)) & 1 == 1]
                    place.append(np.full(len(found), i))
                    held.append(found)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.concatenate(place) if place else [], pa.int64())),
                pa.array(np.concatenate(held).view(np.int64) if held else [], pa.int64())], names=["row", "piece"])

    numbered = staged(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    shared = numbered.select("row", "text").mapInArrow(present, "row long, piece long")
    candidates = shared.join(chosen.select("pattern", "piece"), "piece").select("row", "pattern").distinct()
    met = numbered.join(candidates, "row").where(F.contains("text", "pattern"))
    return met.select("t_key", "pattern")
