"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at the positions that a fixed mask selects, so substituted
words at the other positions do not change it. Seeds of test items and of documents are joined,
and every alignment that a common seed proposes is verified word by word: an item leaks into a
document if some window of it equals the document's words but for a few substitutions.

Most documents share no seed with any item. A bitmap of the items' seeds, of a fixed size
whatever the number of items, lets each task keep only documents that may share one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import BASE, Words, mixed, packed, slices, unpacked, written

# The masks. Together they hit every window of 13 words with at most 3 substitutions,
# and of 11 or 12 words with at most 2; the last one hits what shorter items leave between theirs.
MASKS = ("111011", "110100101", "111000101", "111")
WINDOW, SUBSTITUTIONS = 13, 3
#: Items of fewer words use the last mask too; items of fewer than ``SHORTEST`` have to be a whole text.
SHORT, SHORTEST = 11, 6
BITS = 25
BIN_CHARS = 4_000_000


def _seeds(hashes: np.ndarray, left: np.ndarray, total: np.ndarray):
    """(positions, seeds) of each mask, and of texts too short for masks, all whose words are one seed.

    ``left``: words from a position to its text's end; ``total``: words of its text.
    """
    for number, mask in enumerate(MASKS):
        whole = np.flatnonzero((left >= len(mask)) & (total >= SHORTEST))
        seed = np.full(len(whole), number + 1, dtype=np.uint64)
        for place in (i for i, c in enumerate(mask) if c == "1"):
            seed = seed * BASE + hashes[whole + place]
        yield whole, mixed(seed)
    for size in range(1, SHORTEST):
        whole = np.flatnonzero((total == size) & (left == size))
        seed = np.full(len(whole), len(MASKS) + size, dtype=np.uint64)
        for place in range(size):
            seed = seed * BASE + hashes[whole + place]
        yield whole, mixed(seed)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, each word's text and place in it, and how many words are left there."""
    words = Words([t.lower() for t in texts], "alnum")
    begins = np.cumsum(words.per_text) - words.per_text
    place = np.arange(len(words.starts)) - begins[words.text_of]
    return words.hashes(), words.text_of, place, words.per_text[words.text_of] - place


def _slots(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << BITS) - 1)
    return (seeds & low).astype(np.int64), ((seeds >> np.uint64(64 - BITS)) & low).astype(np.int64)


def _item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item_id, place, words) of every masked position of every item, or of a short item as a whole."""
    schema = T.StructType([
        T.StructField("seed", T.LongType()), items.schema["item_id"], T.StructField("place", T.IntegerType()),
        T.StructField("words", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch, texts in slices(batches, "text"):
            hashes, of, place, left = _words(texts)
            ends = np.searchsorted(of, np.arange(len(texts) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)))
            total = np.diff(ends)[of]
            for number, (at, seed) in enumerate(_seeds(hashes, left, total)):
                if number == len(MASKS) - 1:
                    at, seed = at[total[at] < SHORT], seed[total[at] < SHORT]
                text = pa.array(of[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed.view(np.int64)), batch.column(0).take(text), pa.array(place[at], pa.int32()), lists.take(text)], names=schema.names)

    return items.mapInArrow(run, schema)


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The seeds' bitmap, built by an aggregate of at most 2^(BITS - 6) rows."""
    low = (1 << BITS) - 1
    slot = F.explode(F.array(F.col("seed").bitwiseAND(F.lit(low)), F.shiftrightunsigned("seed", 64 - BITS).bitwiseAND(F.lit(low))))
    words = seeds.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), dtype=np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(bitmap.view(np.uint8), bitorder="little").view(bool) if len(words) else np.zeros(1 << BITS, dtype=bool)


def _possible(docs: DataFrame, text: str, bitmap: np.ndarray) -> DataFrame:
    """The rows that may share a seed, with a row number and the seeds and their places; written once."""
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    schema = T.StructType(numbered.schema.fields + [
        T.StructField("_seeds", T.ArrayType(T.LongType())), T.StructField("_places", T.ArrayType(T.IntegerType()))])

    def run(batches):
        bits = np.unpackbits(packed.value).view(bool)
        for batch, texts in slices(batches, text):
            hashes, of, place, left = _words(texts)
            found = []
            for at, seed in _seeds(hashes, left, place + left):
                one, two = _slots(seed)
                hit = np.flatnonzero(bits[one])
                hit = hit[bits[two[hit]]]
                found.append((at[hit], seed[hit]))
            at, seed = (np.concatenate(x) for x in zip(*found))
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, seed = at[order], seed[order]
            docs_hit, first = np.unique(of[at], return_index=True)
            ends = pa.array(np.append(first, len(at)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                *(c.take(pa.array(docs_hit)) for c in batch.columns),
                pa.ListArray.from_arrays(ends, pa.array(seed.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(place[at], pa.int32())),
            ], names=schema.names)

    return written(numbered.mapInArrow(run, schema), "possible")


def _best_window(equal: np.ndarray, window: int) -> tuple[int, int]:
    """(equal words, start) of the window with most equal words, the first of several."""
    sums = np.concatenate(([0], np.cumsum(equal)))
    inside = sums[window:] - sums[:-window]
    at = int(inside.argmax())
    return int(inside[at]), at


def _verify(texts: pa.Table, candidates: pa.Table) -> pa.Table:
    """Candidate alignments of the documents of one bin that hold, with their best windows."""
    names = ["_row", "item", "start", "n_window", "n_equal", "n_aligned"]
    out = []
    if len(texts) and len(candidates):
        hashes, of, _, _ = _words([t or "" for t in texts.column("text").to_pylist()])
        hashes = hashes.view(np.int64)
        ends = np.searchsorted(of, np.arange(len(texts) + 1))
        number = {r: i for i, r in enumerate(texts.column("_own").to_pylist())}
        for row, item, shift, words in zip(*(candidates.column(c).to_pylist() for c in ("_row", "item", "shift", "words"))):
            i = number[row]
            doc, words = hashes[ends[i] : ends[i + 1]], np.array(words)
            window = min(WINDOW, len(words))
            low, high = max(0, -shift), min(len(words), len(doc) - shift)
            if high - low < window or (len(words) < SHORTEST and len(doc) != len(words)):
                continue
            equal = words[low:high] == doc[low + shift : high + shift]
            most, at = _best_window(equal, window)
            if most >= window - (SUBSTITUTIONS * window // WINDOW if window >= SHORTEST else 0):
                out.append((row, item, low + shift + at, window, most, int(equal.sum())))
    columns = list(zip(*out)) or [[]] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def _leaks(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """Documents that may leak, with their row numbers, and the verified (row, item, ...) of leaks."""
    items = benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")).withColumn("_item", F.monotonically_increasing_id())
    items = written(items, "items")
    seeds = written(_item_seeds(items.select(F.col("_item").alias("item_id"), "text")), "item-seeds")
    rows = _possible(docs, text, _bitmap(seeds))
    hits = rows.select("_row", F.explode(F.arrays_zip("_seeds", "_places")).alias("hit")).select("_row", "hit.*")
    met = hits.join(seeds.select("seed", F.col("item_id").alias("item"), "place"), F.col("_seeds") == F.col("seed"))
    met = met.select("_row", "item", (F.col("_places") - F.col("place")).alias("shift")).distinct()
    words = seeds.dropDuplicates(["item_id"]).select(F.col("item_id").alias("item"), "words")
    chars = rows.agg(F.sum(F.length(text))).first()[0] or 0
    bin_of = F.pmod(F.xxhash64("_row"), F.lit(max(1, -(-chars // BIN_CHARS))))
    left = rows.select(bin_of.alias("bin"), F.col("_row").alias("_own"), F.col(text).alias("text")).groupBy("bin")
    right = met.join(words, "item").select(bin_of.alias("bin"), "_row", "item", "shift", "words").groupBy("bin")
    schema = "_row long, item long, start long, n_window long, n_equal long, n_aligned long"
    found = left.cogroup(right).applyInArrow(_verify, schema)
    # of several alignments of an item with a document, the one with most equal words, then the first
    best = found.groupBy("_row", "item").agg(F.max(F.struct("n_equal", "n_aligned", (-F.col("start")).alias("back"), "n_window")).alias("best"))
    best = best.join(items.select(F.col("_item").alias("item"), "item_id"), "item")
    return rows, best.select("_row", "item_id", (-F.col("best.back")).alias("start_word"), "best.n_window", "best.n_equal", "best.n_aligned")


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Each document and test item whose words overlap: (doc_id, item_id, start_word, n_window, n_equal, n_aligned).

    Words are runs of letters and digits in lower case. An item leaks if 13 of its words in a
    row meet the document's in the same order with at most 3 substitutions; an item of 6 to 12
    words has to be met as a whole, with at most 3/13 substituted. An item of fewer words is too
    short to be told from chance inside a text, so it leaks only into a document that has the same
    words and no others. Null and wordless texts are never reported. ``start_word`` is the best window's first word in the
    document, ``n_aligned`` the equal words of the whole alignment. Rows of equal ids are judged
    apart and all reported. Other columns are not read.
    """
    rows, found = _leaks(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), benchmark, "text", item, item_text)
    return rows.select("_row", "doc_id").join(found, "_row").drop("_row")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no test item leaks.

    All columns come back as they were, whatever their names. Null texts hold no item; rows are judged
    one by one, repeated ones alike; an empty table stays empty and an empty benchmark takes nothing.
    """
    numbered = written(packed(docs, text).withColumn("number", F.monotonically_increasing_id()), "numbered")
    rows, found = _leaks(numbered.select("number", "text"), benchmark, "text", "item_id", "text")
    leaking = rows.select("_row", "number").join(found.select("_row").distinct(), "_row").select("number")
    return unpacked(numbered.join(leaking, "number", "left_anti"), docs.columns, text)
