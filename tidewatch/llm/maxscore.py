"""Exact top-k inner products by MaxScore over shards of integer vectors.

A vector's non-zero components are its terms; each shard keeps one posting column per term. For
a query, a term can add at most its bound over the shard, counted from the least the term can
add. Terms whose bounds together cannot lift a row to the k-th best score so far are
non-essential: only the essential postings are traversed, and the others are probed, largest
bound first, for the rows that can still compete. Shards are merged by a top-k per query.

Queries are a stated set, dealt into blocks; every shard meets every block once. Shards and
blocks have a bounded number of bytes, whatever the table's size, and neither is broadcast. Rows
equal in id and vector are one row with a number of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.session import shuffle_width

#: Rows of a shard and queries of a block: as many as fill the bytes, fewer while there are not cells enough for all tasks.
CELL_BYTES, LEAST_ROWS = 1 << 25, 4096
SEED_ROWS = 256


def quantised(vector: str, scale: int = 256) -> Column:
    """Components times the scale, rounded down; null for a vector that is null or has a null or non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


class Shard:
    """Posting columns of one shard, rows in the order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.copies, self.columns = ids[order], copies[order], np.ascontiguousarray(vectors[order].T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, scores and copies of the k best rows, ties to the smaller id; one copy of the query itself is left out."""
        columns, mine, copies = self.columns, np.ones(len(self.ids), dtype=bool), self.copies
        same = np.arange(*np.searchsorted(self.ids, [own, own + 1]))
        same = same[(columns[:, same] == query[:, None]).all(axis=0)]
        if len(same):
            copies = copies.copy()
            copies[same] -= 1
            mine = copies > 0
        bound = np.abs(query) * (self.high - self.low)
        least = np.minimum(query * self.low, query * self.high)  # each term's smallest share of a score
        seed = (query @ columns[:, :SEED_ROWS])[mine[:SEED_ROWS]]
        threshold = np.partition(seed, len(seed) - k)[len(seed) - k] if len(seed) >= k else None
        order = np.argsort(-bound, kind="stable")
        # what the terms from a place on can add at most, above the least of all terms
        ahead = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
        room = None if threshold is None else threshold - least.sum()
        essential = len(order) if room is None else int(np.searchsorted(-ahead, -room, side="left"))
        terms = order[:essential]
        score = query[terms] @ columns[terms] if essential else np.zeros(len(self.ids), dtype=columns.dtype)
        rest = least[order[essential:]].sum()
        rows = np.flatnonzero(mine if threshold is None else mine & (score + rest + ahead[essential] >= threshold))
        score = score[rows]
        for at in range(essential, len(order)):
            term = order[at]
            score = score + query[term] * columns[term][rows]
            rest = rest - least[term]
            if threshold is not None:
                if len(score) > 4 * k and at % 4 == 0:  # scores that rows are sure of raise the threshold
                    threshold = max(threshold, np.partition(score, len(score) - k)[len(score) - k] + rest)
                going = score + rest + ahead[at + 1] >= threshold
                rows, score = rows[going], score[going]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best], np.minimum(copies[rows[best]], k)


def _matrix(column, width: int, dtype) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    flat, sizes = column.combine_chunks().flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(column).to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(dtype)
    out = np.zeros((len(sizes), width), dtype=dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _search_block(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out = {"query_id": [], "number": [], "vec_id": [], "score": [], "copies": []}
    if len(rows) and len(queries):
        lengths = [pa.compute.max(pa.compute.list_value_length(t.column("terms"))).as_py() for t in (rows, queries)]
        width = max(1, *lengths)
        vectors, wanted = (_matrix(t.column("terms"), width, np.int64) for t in (rows, queries))
        reach = float(np.abs(vectors).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * width
        if 4 * reach < 2**53:  # then floating point is exact, and faster
            vectors, wanted = vectors.astype(np.float64), wanted.astype(np.float64)
        shard = Shard(rows.column("vec_id").to_numpy(), vectors, rows.column("copies").to_numpy())
        for own, number, query in zip(queries.column("vec_id").to_numpy(), queries.column("number").to_numpy(), wanted):
            ids, scores, copies = shard.search(own, query, k)
            found = (np.full(len(ids), own), np.full(len(ids), number), ids, scores.astype(np.int64), copies)
            for values, column in zip(found, out.values()):
                column.append(values)
    joined = {n: pa.array(np.concatenate(c) if c else np.empty(0), pa.int64()) for n, c in out.items()}
    return pa.table(joined)


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k highest inner products of every query row: (query_id, rank, vec_id, score).

    ``is_query`` is a condition on ``vec_id``. Candidates are all rows but the query's own, rows of
    its id among them. A row with a null id, or a null vector or component, or a non-finite one,
    takes no part; a shorter vector counts as filled up with zeros. Repeated rows are candidates
    each, and queries each: their results repeat. Ties go to the smaller id; with fewer than k
    candidates all are given. Scores are 64-bit integers and wrap around beyond that range.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), quantised(vector).alias("terms"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("terms").isNotNull())
    rows = rows.groupBy("vec_id", "terms").agg(F.count(F.lit(1)).alias("copies"))
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_query).alias("queries"), F.max(F.size("terms")).alias("width")).first()
    most = max(LEAST_ROWS, CELL_BYTES // (8 * max(1, sizes["width"] or 1)))
    shards, blocks = (max(1, -(-sizes[n] // most)) for n in ("rows", "queries"))
    while shards * blocks < shuffle_width(vectors.sparkSession) and sizes["rows"] > 2 * shards * LEAST_ROWS:
        shards *= 2

    def dealt(frame, own, parts, other, copies):
        """Each row in one of ``parts`` by its id and vector, once for each of the ``copies`` of the other side."""
        part = F.pmod(F.xxhash64("vec_id", "terms", F.lit(own)), F.lit(parts)).cast("int").alias(own)
        return frame.select(part, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other), "vec_id", "terms", "copies")

    data = dealt(rows, "shard", shards, "block", blocks).groupBy("shard", "block")
    queries = dealt(rows.where(is_query), "block", blocks, "shard", shards).withColumn("number", F.xxhash64("terms")).groupBy("shard", "block")
    found = data.cogroup(queries).applyInArrow(
        lambda left, right: _search_block(left, right, k), "query_id long, number long, vec_id long, score long, copies long"
    )
    # The k best of all shards; a row's copies stand side by side, so those before it are counted.
    order = Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
    place = F.row_number().over(order)
    best = found.withColumn("place", place).where(F.col("place") <= k)
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = best.withColumn("before", before).where(F.col("before") < k)
    ranks = F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(k)))
    best = best.select("query_id", "number", F.explode(ranks).alias("rank"), "vec_id", "score").withColumn("rank", F.col("rank").cast("int"))
    again = rows.where(is_query & (F.col("copies") > 1)).select("vec_id", F.xxhash64("terms").alias("number"), "copies")
    again = again.withColumnsRenamed({"vec_id": "query_id", "number": "same"})
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1)))).alias("_")
    repeated = best.join(again, (best["query_id"] == again["query_id"]) & (best["number"] == again["same"]), "left")
    return repeated.select(best["query_id"], "rank", "vec_id", "score", times).drop("_")
