"""Similarity join on sets of word n-grams: MinHash bands find candidates, full sets verify them.

Texts with equal n-gram sets are one node, however many copies there are. Each node's MinHash
signature is cut into bands; nodes that share a band are tied to the band's smallest node, and
the components of these ties hold every candidate pair. Inside a component all pairs are
compared on their full n-gram sets, as products of incidence matrices; a large component is
dealt out as pairs of blocks, so that no task holds more than two blocks and no pair of a group
is ever written as a row. What leaves a block is one row per node: its links and the smallest
node it is linked to.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import BASE, MIX_2, Words, first_in_group, maybe_in, mixed, packed, slices, unpacked, written
from tidewatch.llm.components import components

BLOCK_NODES, BLOCK_GRAMS = 512, 400_000
BIN_GRAMS = 100_000
COLUMNS = 4096


def choose_bands(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` hashes that finds a pair at the threshold with the recall."""
    for rows in range(most, 0, -1):
        bands = most // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows
    raise ValueError("too few hashes for this recall")


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct n-grams of every text, sorted by both.

    Words are lower-cased and split at white space. A text of fewer than n words, but at least
    one, has one n-gram: all its words.
    """
    words = Words([t.lower() for t in texts], "spaced")
    hashes, counts = words.hashes(), words.per_text
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    begins = np.cumsum(counts) - counts
    value = np.zeros(len(hashes), dtype=np.uint64)
    left = counts[words.text_of] - (np.arange(len(hashes)) - begins[words.text_of])
    for i in range(min(n, len(hashes))):
        inside = left > i
        inside[len(hashes) - i :] = False
        shifted = np.zeros_like(hashes)
        shifted[: len(hashes) - i] = hashes[i:]
        value = np.where(inside, value * BASE + shifted, value)
    whole = (left >= n) | ((counts[words.text_of] < n) & (left == counts[words.text_of]))
    text, value = words.text_of[whole], mixed(value[whole] + np.uint64(1))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = first_in_group(text, value)
    return text[new], value[new]


def _node_ids(text: np.ndarray, grams: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For every text a 64-bit value of its n-gram set (0 without n-grams) and the set's size."""
    sizes = np.bincount(text, minlength=count)
    node = np.zeros(count, dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        node[some] = mixed(np.add.reduceat(mixed(grams ^ MIX_2), (np.cumsum(sizes) - sizes)[some]) + sizes[some].astype(np.uint64))
    return node.view(np.int64), sizes


def _bands(grams: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of texts that all have n-grams."""
    rng = np.random.default_rng(20_240_601)
    flips, factors = rng.integers(0, 1 << 32, (2, bands * rows), dtype=np.uint32)
    offsets, small = np.cumsum(sizes) - sizes, (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sizes), bands), dtype=np.uint64)
    for band in range(bands):
        value = np.full(len(sizes), band + 1, dtype=np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat((small ^ flips[k]) * (factors[k] | np.uint32(1)), offsets)
            value = mixed(value * BASE + least.astype(np.uint64))
        out[:, band] = value
    return out.view(np.int64)


def sketched(docs: DataFrame, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """The frame with a row number, its n-gram set's node and size and its band hashes, written once.

    Names begin with an underscore: ``_row``, ``_node``, ``_grams``, ``_bands``; texts without
    words have a null node.
    """
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    schema = T.StructType(numbered.schema.fields + [
        T.StructField("_node", T.LongType()), T.StructField("_grams", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch, texts in slices(batches, text):
            of, grams = _grams(texts, n)
            node, sizes = _node_ids(of, grams, len(texts))
            some = np.flatnonzero(sizes)
            lists = np.repeat(np.cumsum(np.append(0, (sizes > 0) * bands))[:1], len(texts) + 1)
            lists[1:] = np.cumsum((sizes > 0) * bands)
            flat = _bands(grams, sizes[some], bands, rows).ravel() if len(some) else np.empty(0, np.int64)
            arrays = [
                *batch.columns, pa.array(node, mask=sizes == 0), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(flat, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return written(numbered.mapInArrow(run, schema), "sketched")


def _intersections(members: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted sets."""
    m = len(members)
    if m == 2:
        both = len(np.intersect1d(members[0], members[1], assume_unique=True))
        return np.array([[len(members[0]), both], [both, len(members[1])]], dtype=np.float32)
    owner = np.repeat(np.arange(m), [len(x) for x in members])
    _, column, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((m, m), dtype=np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, last, COLUMNS):
        here = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        block = np.zeros((m, COLUMNS), dtype=np.float32)
        block[owner[here], column[here] - at] = 1
        total += block @ block.T
    return total


def _verify(table: pa.Table, n: int, threshold: float) -> pa.Table:
    """Links and smallest linked node of every node of one block pair or bin."""
    out = {"component": [], "node": [], "links": [], "root": []}
    component, node, copies, block = (table.column(c).to_numpy() for c in ("component", "node", "copies", "block"))
    one, two = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    of, grams = _grams([t or "" for t in table.column("text").to_pylist()], n)
    borders = np.searchsorted(of, np.arange(len(node) + 1))
    order = np.argsort(component, kind="stable")
    starts = np.flatnonzero(first_in_group(component[order]))
    for chosen in np.split(order, starts[1:]):
        sets = [grams[borders[i] : borders[i + 1]] for i in chosen]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        shared = _intersections(sets).astype(np.float64) if len(sets) > 1 else np.zeros((1, 1))
        linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
        np.fill_diagonal(linked, False)
        if one != two:
            linked &= block[chosen][:, None] != block[chosen][None, :]
        links = linked @ copies[chosen].astype(np.float64)
        root, before = node[chosen].copy(), None
        top = np.iinfo(np.int64).max
        while before is None or (root != before).any():
            before = root
            root = np.minimum(root, np.where(linked, root[None, :], top).min(axis=1))
        out["component"].append(component[chosen])
        out["node"].append(node[chosen])
        out["links"].append(links.astype(np.int64))
        out["root"].append(root)
    return pa.table({k: pa.array(np.concatenate(v), pa.int64()) for k, v in out.items()})


def _candidates(nodes: DataFrame) -> DataFrame:
    """(node, root) of all nodes that share a band with another, directly or through others."""
    bands = nodes.select(F.col("_node").alias("node"), F.explode("_bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("band", "a")
    shared = written(shared, "shared")
    ties = maybe_in(bands, "band", shared.select("band")).join(shared, "band").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    return components(written(ties, "ties"))


def linked_nodes(sketches: DataFrame, text: str, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Nodes with their copies and first row, and (node, links, class) of the nodes that have links."""
    least = F.min(F.struct("_row", "_grams", "_bands")).alias("first")
    nodes = sketches.where("_node IS NOT NULL").groupBy("_node").agg(least, F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.select("_node", "copies", "first.*"), "nodes")
    found = _candidates(nodes.select("_node", "_bands"))
    members = written(nodes.select("_node", "_row", "_grams", "copies").join(found, F.col("_node") == F.col("node")), "members")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.sum("_grams").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    bins = max(1, -(-(members.agg(F.sum("_grams")).first()[0] or 0) // BIN_GRAMS))
    placed = members.join(sizes.select("root", blocks.alias("blocks")), "root")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    whole = F.col("blocks") == 1
    group = F.when(whole, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")).alias("group")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    texts = sketches.select("_row", F.col(text).alias("text"))
    spread = placed.select("_row", "node", "copies", "block", F.col("root").alias("component"), group, whole.alias("whole"), other)
    spread = spread.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    spread = maybe_in(texts, "_row", members.select("_row")).join(spread, "_row").drop("_row")
    schema = "component long, node long, links long, root long"
    verified = spread.groupBy("group", "whole", "i", "j").applyInArrow(lambda t: _verify(t, n, threshold), schema)
    verified = written(verified, "verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0")
    classes = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return nodes, links.join(classes, "node").select("node", "links", F.col("root").alias("class"))


def near_duplicates(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, most_hashes: int = 128,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: (doc_id, class_id, n_links, n_copies).

    Two documents are linked if the Jaccard similarity of their n-gram sets is at least the
    threshold; equal sets have similarity 1. ``n_links`` counts the other documents linked to
    this one, ``n_copies`` the documents with its n-gram set, itself included; ``class_id`` is
    the smallest id among all documents reached over links. A pair at the threshold is found
    with the given recall, more similar ones with a higher one; nothing unlinked is reported.
    Null texts and texts without words have no n-gram, no link and a class of their own. A
    null id is no class id unless the class has no other. Sets are compared by 64-bit hashes.
    Other columns are not read.
    """
    bands, rows = choose_bands(threshold, recall, most_hashes)
    frame = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return _labelled(sketched(frame, "text", n, bands, rows), "text", n, threshold, "doc_id").select("doc_id", "class_id", "n_links", "n_copies")


def _labelled(sketches: DataFrame, text: str, n: int, threshold: float, label: str) -> DataFrame:
    """All rows of the sketches but their texts, with class_id (least ``label`` of the class), n_links, n_copies."""
    nodes, linked = linked_nodes(sketches, text, n, threshold)
    rows = sketches.drop("_bands", "_grams", text)
    least = rows.where("_node IS NOT NULL").groupBy("_node").agg(F.min(label).alias("least"))
    known = nodes.select("_node", "copies").join(least, "_node").join(linked, F.col("_node") == F.col("node"), "left")
    known = written(known.select("_node", "copies", "least", "links", F.coalesce("class", "_node").alias("class")), "known")
    classes = known.groupBy("class").agg(F.min("least").alias("class_id"))
    known = known.join(classes, "class").select(F.col("_node").alias("_own"), "class_id", "copies", "links")
    joined = rows.join(known, F.col("_node") == F.col("_own"), "left")
    return joined.withColumns({
        "class_id": F.when(F.col("_node").isNull(), F.col(label)).otherwise(F.col("class_id")),
        "n_copies": F.coalesce("copies", F.lit(1)).cast("long"),
        "n_links": (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long"),
    }).drop("_own", "copies", "links")


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, most_hashes: int = 128, text: str = "text") -> DataFrame:
    """The rows of ``docs``, but of each class of near duplicates only one; rows without words all stay.

    All columns come back as they were, whatever their names; which row of a class stays is
    arbitrary. Null texts have no words; an empty table stays empty.
    """
    bands, rows = choose_bands(threshold, recall, most_hashes)
    sketches = sketched(packed(docs, text), "text", n, bands, rows)
    labelled = _labelled(sketches.select("_row", "_node", "_grams", "_bands", "text"), "text", n, threshold, "_row")
    kept = labelled.where("_row = class_id").select("_row")
    return unpacked(sketches.join(kept, "_row"), docs.columns, text)
