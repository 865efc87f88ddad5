"""Approximate nearest neighbours by a hash-prefix forest.

Every tree is a sorted array of long hash strings (signs of random projections). A query descends to its longest
matching prefix in each tree; then all trees ascend together, one bit at a time, until the rows below the common
prefixes add up to `gather` times the shard's rows and hold k distinct ones; those candidates are ranked by exact inner product on the original
vectors. Inner product becomes an angle by one more coordinate that gives all rows of a shard the same norm.

Rows are dealt by a hash of their id to shards of about `shard_rows`, queries to blocks; each pair of them is one
group, so memory is bounded and no group of equal vectors meets in one task. The per-shard best are merged by a
window of at most shards x k rows a query. On data without contrast a forest has to look at much of a shard for
recall; the defaults do (recall on such data is audited in the tests and the README).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 32
FINITE = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> coalesce(abs(x) < double('Infinity'), false)) and exists(embedding, x -> x <> 0)"


def valid_vectors(embeddings: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """Rows with an id and a vector that is neither null nor zero and has finite components only."""
    return embeddings.where(f"{id_column} is not null and {FINITE}")


def matrix(column) -> np.ndarray:
    """Equal-length lists of numbers as a double matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1)


class Forest:
    """Sorted arrays of hash strings over the rows of x."""

    def __init__(self, x: np.ndarray, trees: int = 32, seed: int = 7):
        norm = (x * x).sum(1)
        self.x = x
        lifted = np.hstack([x, np.sqrt(np.maximum(0.0, norm.max(initial=0.0) - norm))[:, None]])
        self.planes = np.random.default_rng(seed).standard_normal((trees, x.shape[1] + 1, BITS))
        self.order, self.keys = [], []
        for p in self.planes:
            h = self._hash(lifted @ p)
            self.order.append(np.argsort(h, kind="stable"))
            self.keys.append(h[self.order[-1]])

    @staticmethod
    def _hash(projected: np.ndarray) -> np.ndarray:
        return ((projected > 0).astype(np.uint64) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).sum(1)

    def candidates(self, queries: np.ndarray, gather: int, least: int):
        """For each query the rows below the longest common prefixes that together hold `gather` entries and `least`
        distinct rows; all rows, where there are fewer."""
        least = min(least, len(self.x))
        hashes = np.stack([self._hash(queries @ p[:-1]) for p in self.planes])
        level = np.zeros(len(queries), np.int64)
        found = np.zeros(len(queries), bool)
        low = np.zeros(hashes.shape, np.int64)
        high = np.full(hashes.shape, len(self.x), np.int64)
        for depth in range(BITS, 0, -1):  # from whole strings upwards, all trees at once
            todo = np.flatnonzero(~found)
            if not len(todo):
                break
            mask = np.uint64(((1 << depth) - 1) << (BITS - depth))
            rest = np.uint64((1 << (BITS - depth)) - 1)
            lo = np.stack([np.searchsorted(k, h[todo] & mask, "left") for k, h in zip(self.keys, hashes)])
            hi = np.stack([np.searchsorted(k, (h[todo] & mask) | rest, "right") for k, h in zip(self.keys, hashes)])
            enough = (hi - lo).sum(0) >= gather
            found[todo[enough]], level[todo[enough]] = True, depth
            low[:, todo[enough]], high[:, todo[enough]] = lo[:, enough], hi[:, enough]
        for q in range(len(queries)):
            seen, depth = self._below(low[:, q], high[:, q]), int(level[q])
            while depth > 0 and np.count_nonzero(seen) < least:  # trees that hold the same rows: all go on up
                depth -= 1
                mask, rest = np.uint64(((1 << depth) - 1) << (BITS - depth)), np.uint64((1 << (BITS - depth)) - 1)
                ends = [(np.searchsorted(k, h & mask, "left"), np.searchsorted(k, (h & mask) | rest, "right")) for k, h in zip(self.keys, hashes[:, q])]
                seen = self._below(*zip(*ends))
            yield np.flatnonzero(seen)

    def _below(self, low, high) -> np.ndarray:
        seen = np.zeros(len(self.x), bool)
        for order, a, b in zip(self.order, low, high):
            seen[order[a:b]] = True
        return seen


def nearest(x, ids, queries, query_ids, k: int, trees: int, gather: float):
    """(query, row id, score) of each query's best k candidates, ties to the smaller id."""
    out = ([], [], [])
    if len(x) and len(queries):
        repeats = int(np.unique(ids, return_counts=True)[1].max())  # rows of a query's own id are no candidates
        for q, qid, rows in zip(queries, query_ids, Forest(x, trees).candidates(queries, max(4 * k, int(gather * len(x))), k + repeats)):
            rows = rows[ids[rows] != qid]
            score = (x[rows] * q).sum(1)
            best = np.lexsort((ids[rows], -score))[:k]
            for o, v in zip(out, (np.full(len(best), qid), ids[rows][best], score[best])):
                o.append(v)
    return [np.concatenate(o) if o else np.zeros(0) for o in out]


def search(
    embeddings: DataFrame, queries: DataFrame, k: int = 20, trees: int = 32, gather: float = 1.2, shard_rows: int = 8192, query_rows: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries(vec_id, embedding) its k nearest of embeddings found.

    A candidate with the query's id is not returned. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows without id; vectors meet only those of their length. Rows that repeat an id
    are each a candidate of other queries; of queries that repeat an id the first by length and content is asked. A query
    with fewer than k candidates gets all of them. Other columns are ignored. Empty tables give none.
    """
    rows = valid_vectors(embeddings).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    asked = valid_vectors(queries).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("dim", "embedding")).alias("_q")).select("vec_id", "_q.embedding", "_q.dim")
    shards = rows.count() // shard_rows + 1
    blocks = asked.count() // query_rows + 1
    deal = lambda df, own, n, other, m: df.withColumn(own, F.expr(f"cast(pmod(xxhash64(vec_id, '{own}'), {n}) as int)")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = deal(rows, "shard", shards, "block", blocks), deal(asked, "block", blocks, "shard", shards)

    def run(own: pa.Table, ask: pa.Table) -> pa.Table:
        none = np.zeros((0, 1))
        x, q = (matrix(t["embedding"]) if len(t) else none for t in (own, ask))
        got = nearest(x, np.asarray(own["vec_id"]), q, np.asarray(ask["vec_id"]), k, trees, gather)
        return pa.table([pa.array(v, t) for v, t in zip(got, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    key = ["dim", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
