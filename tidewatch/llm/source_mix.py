"""Mixing of sources to target weights by weighted fair queueing, with DataFrame operations only.

Every document of a source, in a shuffled order, gets a virtual finish time: the words of its
source up to and including it, divided by the source's target. Up to ``most`` passes over a
source queue one after the other. All queued documents are sorted by finish time over ranges
and cut where the total budget is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import written

RESULTS = ("doc_id", "source", "size", "source_size", "target", "copies", "taken")
WORD = r"[^\x20\x09-\x0D]+"
#: A source's documents are added up in this many pieces of its shuffled order, so that no source is one task's work.
PIECE_BITS = 10


def word_count(text: str) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cumulated(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Running sums over the whole frame in an order, without bringing it into one task.

    Rows are dealt out by ranges of the order and written; the ranges' totals are added up
    (one row each) and every range is summed on its own. ``sums``: new column to column.
    The order must tell rows apart.
    """
    ranges = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranges.select("*", *[F.sum(c).over(within).alias(n) for n, c in sums.items()]).join(totals, "_range")
    return summed.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds ``rank``, ``weight`` and ``target`` to (source, source_size).

    Sources weigh ``weights`` in turn, by code point, null last. The targets share the total
    size by weight, but none is above ``most`` times its source: with sources in the order of
    that bound per weight, the level at which all bounds above it and the weights below it use
    up the total is found from running sums.
    """
    nulls = F.col("source").isNull()
    ranked = cumulated(sizes.withColumn("_null", nulls).withColumn("_one", F.lit(1).cast("long")), ["_null", "source"], {"rank": "_one"})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    bounded = ranked.withColumn("weight", weight).withColumn("bound", F.col("source_size") * most)
    bounded = bounded.withColumn("ratio", F.col("bound") / F.col("weight")).select("source", "source_size", "rank", "weight", "bound", "ratio")
    filled = cumulated(bounded, ["ratio", "rank"], {"bounds": "bound", "weights": "weight"})
    whole = bounded.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole["size"] or 0) - F.col("bounds") + F.col("bound")) / (F.lit(whole["weight"] or 0) - F.col("weights") + F.col("weight"))
    found = filled.withColumn("level", level).where(F.col("ratio") >= F.col("level")).agg(F.min_by("level", F.struct("ratio", "rank"))).first()[0]
    target = F.least(F.lit(float(found or 0.0)) * F.col("weight"), F.col("bound").cast("double"))
    return bounded.select("source", "source_size", "rank", "weight", target.alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, key: str = "doc_id", text: str = "text", source: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, copies, taken).

    ``copies`` is how often the mix takes the document, ``taken`` the words of those copies. A
    source takes whole documents while its queue is below its target and the total budget (all
    words) lasts, so it ends within one document of the target unless the budget ends first.
    The order is a hash of the key; equal keys go by size, and rows equal in both are
    interchangeable. A null text has size 0; documents without words are never taken. An empty
    table gives no rows. The columns ``keep`` come along, but for those named like a result;
    others are not read.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")])
    queued = _decided(docs, weights, most, key, text, source, kept, None)
    results = ["doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")]
    return queued.select(*results, *[F.col("kept").getField(c).alias(c) for c in keep if c.lower() not in RESULTS])


def _place(key: str) -> Column:
    """A document's place in the shuffled order of its source."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _decided(
    docs: DataFrame, weights: tuple[int, ...], most: int, key: str, text: str, source: str, kept: Column, tie: Column | None
) -> DataFrame:
    """The queued documents and ``copies``. A source's order is place, key and ``tie`` (the size if none is given)."""
    sized = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), _place(key).alias("place"), kept.alias("kept"),
        (word_count(text) if tie is None else tie).alias("tie"))
    sized = written(sized, "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    targets = written(targets, "targets")
    budget = targets.agg(F.sum("source_size")).first()[0] or 0

    pieces = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    pieces = pieces.withColumn("piece", F.shiftright("place", 60 - PIECE_BITS))
    earlier = Window.partitionBy("rank").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy("rank", "piece").agg(F.sum("size").alias("total"))
    totals = totals.select("rank", "piece", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("rank", "piece").orderBy("place", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    queued = pieces.withColumn("within", F.sum("size").over(own)).join(totals, ["rank", "piece"])
    queued = queued.select("doc_id", "source", "size", "rank", "source_size", "target", "place", "tie", (F.col("before") + F.col("within")).alias("upto"), "kept")
    queued = written(queued, "queue")

    passes = F.array(*[F.lit(i).cast("long") for i in range(most)])
    upto = F.col("upto") + F.col("pass") * F.col("source_size")
    copies = queued.where("size > 0").select("size", "rank", "upto", "source_size", "target", F.explode(passes).alias("pass"))
    copies = copies.where(upto - F.col("size") < F.col("target"))
    copies = copies.select((upto / F.col("target")).alias("finish"), "rank", "size")
    cut = cumulated(copies, ["finish", "rank"], {"used": "size"}).where(F.col("used") <= budget)
    cut = cut.agg(F.max(F.struct("finish", "rank")).alias("last")).first()["last"]
    if cut is None:
        taken = F.lit(0).cast("long")
    else:
        last = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["rank"]).alias("rank"))

        def goes(n: int) -> Column:
            end = F.col("upto") + F.lit(n) * F.col("source_size")
            finish = F.struct((end / F.nullif(F.col("target"), F.lit(0.0))).alias("finish"), F.col("rank"))
            inside = (F.col("size") > 0) & (F.col("target") > 0) & (end - F.col("size") < F.col("target"))
            return (inside & (finish <= last)).cast("long")

        taken = sum((goes(n) for n in range(1, most)), goes(0))
    return queued.withColumn("copies", taken)


def take(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents that the mix takes: their rows as they were, each once, and ``copies``, how often it is taken.

    What is taken of a source n times or more is a beginning of its order, so one row per source, with
    the last document of each beginning, decides about all its documents; their texts are
    neither numbered nor shuffled. Rows of equal keys are told apart by their texts; rows equal in
    both go together. A column of ``docs`` named ``copies`` is replaced; other names do not matter.
    """
    tie = F.xxhash64(F.col(text))
    decided = _decided(docs, weights, most, key, text, source, F.lit(0), tie)
    order = F.struct("place", "doc_id", "tie")
    ends = [F.max(F.when(F.col("copies") >= n, order)).alias(f"end_{n}") for n in range(1, most + 1)]
    ends = written(decided.where("copies > 0").groupBy("source").agg(*ends), "ends")
    worded = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    here = F.struct(_place(key).alias("place"), F.col(key).alias("doc_id"), tie.alias("tie"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("of"), here.alias("here"), worded.alias("worded"))
    met = rows.where("worded").join(ends, F.col("of").eqNullSafe(F.col("source")))
    copies = sum((F.when(F.col("here") <= F.col(f"end_{n}"), 1).otherwise(0) for n in range(1, most + 1)), F.lit(0)).cast("long")
    columns = [c for c in docs.columns if c.lower() != "copies"]
    return met.withColumn("copies", copies).where("copies > 0").select(*[F.col("row").getField(c).alias(c) for c in columns], "copies")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS bound FROM sources),
filled AS (
  SELECT *, bound / weight AS ratio,
    (sum(source_size) OVER () - sum(bound) OVER w + bound)::DOUBLE / (sum(weight) OVER () - sum(weight) OVER w + weight)::DOUBLE AS level
  FROM weighed WINDOW w AS (ORDER BY bound / weight, rank ROWS UNBOUNDED PRECEDING)),
targets AS (
  SELECT source, source_size, rank, least((SELECT arg_min(level, ratio) FROM filled WHERE ratio >= level) * weight, bound::DOUBLE) AS target
  FROM filled),
queued AS (
  SELECT doc_id, size, t.rank, source_size, target,
    sum(size) OVER (PARTITION BY t.rank ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, pass, (upto + pass * source_size) / target AS finish FROM queued q, range(3) AS p(pass)
  WHERE size > 0 AND target > 0 AND upto + pass * source_size - size < target),
used AS (SELECT *, sum(size) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING) AS used FROM copies),
kept AS (SELECT rank, upto, count(*) AS n FROM used WHERE used <= (SELECT sum(size) FROM sized) GROUP BY rank, upto)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN coalesce(n, 0) ELSE 0 END * size)::BIGINT AS taken
FROM queued LEFT JOIN kept USING (rank, upto)
"""
