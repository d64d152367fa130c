"""Searching all vectors for a stated query set, shard by shard.

Vectors are dealt by hash into shards of bounded size, and every shard is asked every query. A task reads a shard's
vectors once, makes what its kernel needs of them, and then answers the queries in blocks as they stream by, so its
memory is bounded by a shard and a block, whatever the number of queries. Each query's best few in each shard are then
merged. Nothing is collected or broadcast, and a hot vector spreads over the shards by its id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
QUERY_ROWS = 2048
NO_ID = np.iinfo(np.int64).max

#: search(query_ids, queries, k) -> (scores, ids), each of a row for each query and k columns
Search = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]
#: kernel(ids, vectors) -> the search of that shard
Kernel = Callable[[np.ndarray, np.ndarray], Search]


class Best:
    """The k best (score, then smaller id) of each query so far; unfilled places have -inf and NO_ID."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), NO_ID, np.int64)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates for some queries: scores of shape (rows, ids), -inf where one takes no part."""
        some = (scores >= self.worst()[rows, None]) & (scores > -np.inf)
        hit = some.any(axis=1)
        if not hit.any():
            return
        rows, some = rows[hit], some[hit]
        any_row = some.any(axis=0)
        score = np.concatenate([self.score[rows], np.where(some, scores[hit], -np.inf)[:, any_row]], axis=1)
        cand = np.where(some[:, any_row], ids[any_row], NO_ID)
        cand = np.concatenate([self.ids[rows], cand], axis=1)
        if score.shape[1] > 8 * self.k:  # keep what reaches the k-th best, ties included
            kth = np.partition(score, score.shape[1] - self.k, axis=1)[:, -self.k]
            score = np.where(score >= kth[:, None], score, -np.inf)
        order = np.lexsort((cand, -score), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, order, axis=1)
        self.ids[rows] = np.take_along_axis(cand, order, axis=1)


def usable(vector: Column) -> Column:
    """Neither null, nor holding a null or a component that isn't finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def components(table: DataFrame, vector_col: str) -> Column:
    """The vector column as it is if it holds floats or doubles, else cast; floats take half the room in a shuffle."""
    kind = dict(table.dtypes)[vector_col]
    return F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a sorted batch that agree in dim, shard and kind."""
    keys = np.stack([np.asarray(batch[c]) for c in ("dim", "shard", "kind")])
    cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(batch)]
    for a, z in zip(cuts, cuts[1:]):
        if z > a:
            yield batch.slice(a, z - a)


def search(
    vectors: DataFrame,
    is_query: Column,
    kernel: Kernel,
    k: int,
    score_type: str,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score for vectors (vec_id long, v array) that all take part.

    A query's candidates are the rows with another id and as many components; of rows that share a query's id, the
    least vector asks.
    """
    vectors = vectors.where(F.col("vec_id").isNotNull()).withColumn("dim", F.size("v"))
    shards = max(1, -(-vectors.count() // shard_rows))
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = queries.select("vec_id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"))
    rows = vectors.select("vec_id", "v", "dim", shard.alias("shard"), F.lit(0).alias("kind")).unionByName(asked)
    dealt = rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    score = np.float64 if score_type == "double" else np.int64

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, parts, find = None, [], [], None
        for batch in batches:
            for run in _runs(batch):
                dim, key = run["dim"][0].as_py(), (run["dim"][0].as_py(), run["shard"][0].as_py())
                if key != at:
                    at, ids, parts, find = key, [], [], None
                if run["kind"][0].as_py() == 0:
                    ids.append(np.asarray(run["vec_id"]))
                    parts.append(_matrix(run["v"], dim))
                    continue
                if find is None and ids:
                    find = kernel(np.concatenate(ids), np.concatenate(parts))
                    ids, parts = [], []
                for a in range(0, len(run) if find else 0, query_rows):
                    some = run.slice(a, query_rows)
                    q = np.asarray(some["vec_id"])
                    scores, near = find(q, _matrix(some["v"], dim), k)
                    found = near != NO_ID
                    yield pa.RecordBatch.from_pydict({
                        "query_id": pa.array(np.broadcast_to(q[:, None], near.shape)[found], pa.int64()),
                        "vec_id": pa.array(near[found], pa.int64()), "score": pa.array(scores[found].astype(score)),
                    })

    found = dealt.mapInArrow(best, f"query_id long, vec_id long, score {score_type}")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
