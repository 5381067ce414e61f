"""What several operators share: folds, bounded samples, batches of text and hashed words."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import work_folder

BATCH_CHARS = 1 << 20
MIX_1, MIX_2, BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def packed(docs: DataFrame, text: str) -> DataFrame:
    """(rest, text): all other columns as one, so that no name of theirs meets a name of the work."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("rest"), F.col(text).alias("text"))


def unpacked(frame: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns that ``packed`` put away, in their order and under their names."""
    return frame.select(*[F.col("text").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in columns])


def fold(key: str, parts: int) -> Column:
    """Remainder of the CRC-32 of a key's decimal text; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors and the driver share."""
    return work_folder(spark, label)


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame written once to the shared folder and read back; this also cuts its lineage."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of the key, never more than twice that on average.

    Labels are counted first (one pass over two columns), so that rare labels come whole; the
    new column ``weight`` says how many rows each sampled one stands for. Null labels are left out.
    """
    present = df.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in present.groupBy(label).count().collect()}
    if not counts:
        return present.withColumn("weight", F.lit(1.0)).limit(0)
    place = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30))
    share = F.coalesce(*[
        F.when(F.col(label) == F.lit(value), F.lit(min(1 << 30, int((per_label << 30) / n)))) for value, n in counts.items()
    ])
    weight = F.coalesce(*[F.when(F.col(label) == F.lit(value), F.lit(max(1.0, n / per_label))) for value, n in counts.items()])
    return present.where(place < share).withColumn("weight", weight).limit(2 * per_label * len(counts))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, per_label: int) -> list[tuple[str, int, float]]:
    """(text, label, weight) of a bounded sample of labelled documents, in an order that repeats.

    The sample is drawn from the labels; only it meets the documents. At most four documents of
    one id are taken for each sampled label.
    """
    chosen = bounded_sample(labels.select(F.col(key).alias("k"), F.col(label).alias("label")), "label", "k", per_label)
    most = 4 * per_label * 2
    met = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").limit(4 * most).collect()
    return [(t or "", int(v), w) for _, t, v, w in sorted(((str(r.k), r.text, r.label, r.weight) for r in met), key=str)]


def maybe_in(df: DataFrame, column: str, keys: DataFrame, bits: int = 24) -> DataFrame:
    """The rows whose column may be among the keys (a frame of one column), for a join that follows.

    The keys' bitmap has at most 2^(bits - 6) rows of two numbers, whatever the number of keys,
    so it may be broadcast; rows that it lets through wrongly are left to the join.
    """
    def slot(value: str) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(1 << bits)).cast("int")

    key = slot(keys.columns[0])
    words = keys.select(F.shiftright(key, 6).alias("_word"), key.bitwiseAND(F.lit(63)).alias("_bit"))
    words = words.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    at = slot(column)
    passed = df.withColumns({"_at": F.shiftright(at, 6), "_flag": at.bitwiseAND(F.lit(63))}).join(F.broadcast(words), F.col("_at") == F.col("_word"))
    return passed.where("shiftrightunsigned(_bits, _flag) & 1 = 1").select(df.columns)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of Arrow batches whose texts (null: empty) together hold at most ``most`` characters, or one text."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def per_text(df: DataFrame, text: str, added: list[tuple[str, T.DataType]], compute: Callable, most: int = BATCH_CHARS) -> DataFrame:
    """Adds columns computed from the whole text: ``compute(texts)`` gives one array per new column."""
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField(n, t, True) for n, t in added])

    def run(batches):
        for batch, texts in slices(batches, text, most):
            columns = compute(texts)
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != text]
            names = [n for n in batch.schema.names if n != text] + [n for n, _ in added]
            yield pa.RecordBatch.from_arrays(kept + [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return df.mapInArrow(run, schema)


@lru_cache(maxsize=None)
def _class_table(kind: str) -> np.ndarray:
    """For each code point, whether it belongs to a word of the kind."""
    if kind == "ascii-spaced":
        table = np.ones(sys.maxunicode + 1, dtype=bool)
        table[[32, *range(9, 14)]] = False
        return table
    test = {"letters": str.isalpha, "alnum": str.isalnum, "spaced": lambda c: not c.isspace()}[kind]
    return np.fromiter((test(chr(i)) for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


@lru_cache(maxsize=None)
def _powers(size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(size, BASE, dtype=np.uint64), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(33))) * MIX_1
    h = (h ^ (h >> np.uint64(29))) * MIX_2
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of a list of texts: code points, borders, text number and 64-bit hash of each word.

    ``kind``: ``letters``, ``alnum``, ``spaced`` (split at Unicode white space) or
    ``ascii-spaced`` (split at ``[\\x20\\x09-\\x0D]``). ``points`` holds all texts, each
    followed by one line feed.
    """

    def __init__(self, texts: list[str], kind: str):
        joined = "\n".join(texts) + "\n"
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.text_ends = np.cumsum(sizes)
        self.mask = _class_table(kind)[self.points]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], self.mask, [False])).astype(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.lengths = self.ends - self.starts
        self.text_of = np.searchsorted(self.text_ends, self.starts, side="right")
        self.per_text = np.bincount(self.text_of, minlength=len(texts))

    def hashes(self, points: np.ndarray | None = None) -> np.ndarray:
        """Hash of each word's code points (``points``: others in their place)."""
        if not len(self.starts):
            return np.empty(0, dtype=np.uint64)
        chars = (self.points if points is None else points)[self.mask].astype(np.uint64) + np.uint64(1)
        offsets = np.cumsum(self.lengths) - self.lengths
        within = np.arange(len(chars)) - np.repeat(offsets, self.lengths)
        longest = 1 << int(max(6, np.ceil(np.log2(self.lengths.max() + 1))))
        return mixed(np.add.reduceat(chars * _powers(longest)[within], offsets) + self.lengths.astype(np.uint64) * MIX_1)


def first_in_group(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows, whether each begins a new group of equal keys."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new
