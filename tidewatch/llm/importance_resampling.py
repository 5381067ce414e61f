"""Importance resampling towards a target distribution: weights from hashed n-grams, a cutoff by counting.

A document's n-grams fall into buckets by CRC-32. A bucket's gain says how much more common it is
in the target than in the corpus; a document's weight is the mean gain of its n-grams, read from
one array. Weight plus a Gumbel number made from the key is the score, and the highest scores are
drawn. Scores are written once; exact counts over them bisect the cutoff, first on the score, then
on what orders rows equal in it, so nothing is sorted to find it. Only drawn rows are sorted, by
ranges, for their ranks.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import slices, written
from tidewatch.llm.source_mix import cumulated

#: Words are runs of ASCII letters and digits and of all other characters outside ASCII; UTF-8 keeps these apart bytewise.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
KNOWN_WORDS = 1 << 18  # words whose bucket a task remembers; forgotten ones are computed anew
THRESHOLDS = 15  # counted by one job: four halvings at once
FEATURES = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("draw", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("buckets", T.ArrayType(T.IntegerType(), False))])


class _Buckets(dict):
    """Bucket of a feature's bytes, remembered within a bound."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def words_of(text: str) -> list[bytes]:
    """Words of a text as UTF-8, with only A-Z lower-cased."""
    return WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").lower())


def bucketed(texts: DataFrame, buckets: int, most: int) -> DataFrame:
    """(key, draw, n_words, buckets) of (key, draw, text): the bucket of every run of 1 to ``most`` words, repeats included."""

    def run(batches):
        known = _Buckets(buckets)
        for batch, part in slices(batches, "text"):
            sizes, values, counts = [], [], []
            for text in part:
                words = words_of(text)
                found = [known[w] for w in words]
                for n in range(2, most + 1):
                    found += [known[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
                counts.append(len(words))
                sizes.append(len(found))
                values.append(np.array(found, dtype=np.int32))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(values) if values else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("draw"), pa.array(counts, pa.int64()), lists], names=FEATURES.names)

    return texts.select("key", "draw", "text").mapInArrow(run, FEATURES)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Number of features in every bucket, added up per task and then over all of them."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counted = features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, dtype=np.int64)
    for bucket, n in counted.collect():  # at most one row per bucket
        total[bucket] = n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln)`` of how much more common a bucket is in the target, each count raised by one."""
    s, t, b = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([
        math.floor(1000 * math.log(float((int(y) + 1) * (s + b)) / float((int(x) + 1) * (t + b)))) for x, y in zip(corpus, target)
    ], dtype=np.int64)


def gumbel(draw: int) -> int:
    """``floor(-1000 ln(-ln u))`` for the number u in (0, 1) that stands for 32 bits."""
    return math.floor(-1000 * math.log(-math.log((draw + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, n_words, n_features, weight, score): the floored mean gain of a document's features, and it with its Gumbel number."""
    sent = features.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches):
        gain = sent.value
        for batch in batches:
            lists = batch.column("buckets")
            sizes = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(gain[lists.flatten().to_numpy()])))
            ends = np.cumsum(sizes)
            weight = np.floor_divide(sums[ends] - sums[ends - sizes], np.maximum(sizes, 1))
            noise = np.array([gumbel(d) for d in batch.column("draw").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n_words"), *map(pa.array, (sizes, weight, weight + noise))],
                names=["key", "n_words", "n_features", "weight", "score"])

    return features.select("key", "draw", "n_words", "buckets").mapInArrow(
        run, "key long, n_words long, n_features long, weight long, score long")


def _bisected(rows: DataFrame, column: Column, wanted: int) -> tuple[int, int, bool]:
    """Least value with at least ``wanted`` rows up to it; rows below it; whether rows up to it are exactly ``wanted``.

    Every job counts the rows up to several thresholds over all rows, until one value is left or a
    threshold is met exactly.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    before = 0  # rows below ``low``
    while low < high:
        step = max(1, (high - low) // (THRESHOLDS + 1))
        tried = [low + step * i for i in range(THRESHOLDS) if low + step * i < high]
        held = rows.agg(*[F.count(F.when(column <= t, 1)) for t in tried]).first()
        for t, n in zip(tried, held):
            if n == wanted:
                return t, before, True
            if n > wanted:
                high = t
                break
            low, before = t + 1, n
    return low, before, False


def drawn(rows: DataFrame, order: Sequence[Column], wanted: int) -> Column:
    """A condition that holds for exactly the first ``wanted`` rows in an order of whole numbers that tells rows apart."""
    if wanted <= 0:
        return F.lit(False)
    tied, ends = rows, []
    for column in order:
        end, before, exact = _bisected(tied, column, wanted)
        ends.append(end)
        if exact:
            break
        wanted, tied = wanted - before, tied.where(column == end)
    here = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order[: len(ends)])])
    return here <= F.struct(*[F.lit(e).cast("long").alias(f"c{i}") for i, e in enumerate(ends)])


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", most_words: int = 1,
    buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024",
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document; ``rank`` is null for those not drawn.

    Features are all runs of 1 to ``most_words`` words. Of the documents with at least
    ``least_words`` words, ``percent`` of a hundred (rounded down) are drawn by highest score; ties go to
    the smaller key (a whole number), null keys last, then to fewer features; rows equal in all this are
    interchangeable. The Gumbel number comes from the SHA-256 of ``<seed>:<key>``, so reruns agree
    and repeated rows score alike; a null key counts as the empty text. Null texts have no words; a
    document without features weighs 0. An empty target or corpus is no fault, an empty table gives no
    rows. Only key and text are read, so other columns may have any names.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    named = docs.select(F.col(key).cast("long").alias("key"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("draw"), F.col(text).alias("text"))
    features = written(bucketed(named, buckets, most_words), "features")
    wanted = target.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("draw"), F.col(target_text).alias("text"))
    gain = gains(bucket_counts(features, buckets), bucket_counts(bucketed(wanted, buckets, most_words), buckets))
    rows = written(scored(features, gain).withColumn("place", F.monotonically_increasing_id()), "scores")

    allowed = rows.where(F.col("n_words") >= least_words)
    order = [-F.col("score"), F.col("key").isNull().cast("long"), F.coalesce("key", F.lit(0)), F.col("n_features"), F.col("place")]
    first = (F.col("n_words") >= least_words) & drawn(allowed, order, allowed.count() * percent // 100)
    chosen = rows.where(first).withColumns({f"order_{i}": c for i, c in enumerate(order)} | {"one": F.lit(1).cast("long")})
    ranked = cumulated(chosen, [f"order_{i}" for i in range(len(order))], {"rank": "one"})
    both = rows.where(~first).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked.select(*rows.columns, "rank"))
    return both.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank")


RESAMPLE_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS entry),
docs AS (
  SELECT row_number() OVER () AS row, doc_id, sha256('2024:' || coalesce(doc_id::VARCHAR, '')) AS digest,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
doc_words AS (SELECT row, unnest(words) AS word FROM docs),
target_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
spelled AS (
  SELECT word, list_transform(range(length(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT) AS bytes
  FROM (SELECT word FROM doc_words UNION SELECT word FROM target_words)),
hashed AS (
  SELECT word, xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM spelled, crc_table),
s AS (SELECT bucket, count(*) AS n FROM doc_words JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_words JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000))::DOUBLE
    / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))::DOUBLE))::BIGINT AS gain
  FROM (SELECT range AS bucket FROM range(10000)) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
sums AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS total FROM doc_words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row),
weighed AS (
  SELECT doc_id, row, coalesce(n, 0) AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(digest, 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM docs LEFT JOIN sums USING (row)),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS eligible
  FROM weighed WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score,
  CASE WHEN place <= eligible * 10 // 100 THEN place END::BIGINT AS rank
FROM weighed LEFT JOIN ranked USING (row)
"""
