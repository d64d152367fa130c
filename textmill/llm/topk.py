"""Exact top-k search by integer inner product, with norm buckets.

Components become floor(256 * x). In a shard the vectors are ordered by length and cut into buckets. For a query q
with k-th best score t so far, a bucket whose longest vector is l has the local cosine threshold t / (|q| l): above
one, the bucket and all after it are skipped; if it is low, vectors too short to reach t are cut off (length
pruning); if it is high, a vector stays only if its component along q's largest one leaves room for the cosine
(coordinate pruning). What stays is verified by its product, which is exact.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null id, take no part; empty
and zero vectors do, with score 0; rows that repeat a vec_id are never candidates of a query of that id, and together
count as one query, the least of their vectors; ties go to the smaller vec_id; an empty table gives an empty result. Components so large that a
sum could pass 2^53 are computed in Python's integers and scores beyond a long become the nearest long. Only the id
and vector columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.vectors import NO_ID, Best, components, search, usable

SCALE = 256
BUCKET = 256
#: Local cosine threshold from which coordinate pruning is used in place of length pruning.
HIGH = 0.5
_SLACK = 1e-9


def integers(v: np.ndarray) -> np.ndarray:
    """floor(256 * x) as whole doubles; they stay exact, a double of over 2^53 being whole already."""
    with np.errstate(over="ignore"):
        return np.floor(v.astype(np.float64) * SCALE)


def _large(ids, x, query_ids, q, k):
    """Scores that doubles can't hold exactly, by Python's integers."""
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    whole = lambda a: [[int(c) if np.isfinite(c) else (1 if c > 0 else -1) << 1100 for c in row] for row in a]
    x, scores, out = whole(x), np.zeros((len(q), k), np.int64), np.full((len(q), k), NO_ID, np.int64)
    for i, row in enumerate(whole(q)):
        found = sorted((-sum(map(int.__mul__, row, other)), int(at)) for at, other in zip(ids, x) if at != query_ids[i])[:k]
        for j, (s, at) in enumerate(found):
            scores[i, j], out[i, j] = min(max(-s, low), high), at
    return scores, out


def kernel(ids: np.ndarray, vectors: np.ndarray):
    """Kernel of a shard: its norm buckets are made once and asked block by block."""
    x = integers(vectors)
    most = np.abs(x).max() if x.size else 0.0
    with np.errstate(over="ignore"):
        length = np.sqrt((x**2).sum(1))
    order = np.argsort(-length, kind="stable")
    ids, x, length = ids[order], x[order], length[order]

    def search(query_ids: np.ndarray, queries: np.ndarray, k: int):
        q = integers(queries)
        if x.size and q.size and not most * np.abs(q).max() * x.shape[1] < 2**53:
            return _large(ids, x, query_ids, q, k)
        return _pruned(ids, x, length, query_ids, q, k)

    return search


def _pruned(ids, x, length, query_ids, q, k):
    """Best of the buckets, whose vectors stand in order of length."""
    size = np.sqrt((q**2).sum(1))
    focus = np.argmax(np.abs(q), axis=1) if q.shape[1] else np.zeros(len(q), int)
    along = np.take_along_axis(q, focus[:, None], axis=1)[:, 0] / np.maximum(size, 1e-300) if q.shape[1] else np.zeros(len(q))
    best, live = Best(len(q), k), np.arange(len(q))
    for at in range(0, len(x), BUCKET):
        rows, long_, own = x[at : at + BUCKET], length[at : at + BUCKET], ids[at : at + BUCKET]
        worst = best.worst()
        room = size[live] * long_[0] * (1 + _SLACK) + _SLACK
        live = live[worst[live] <= room]
        if not len(live):
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(size[live] * long_[0] > 0, worst[live] / (size[live] * long_[0]), 0)
        high = cosine >= HIGH
        for some, coordinate in ((live[~high], False), (live[high], True)):
            for part in range(0, len(some), 512):
                sub = some[part : part + 512]
                # length pruning: sorted by length, so those that can reach the threshold come first
                keep = size[sub][:, None] * long_[None, :] * (1 + _SLACK) + _SLACK >= worst[sub][:, None]
                if coordinate:
                    theirs = rows[:, focus[sub]].T / np.maximum(long_, 1e-300)[None, :]
                    mine = along[sub][:, None]
                    most = theirs * mine + np.sqrt(np.maximum(1 - theirs**2, 0) * np.maximum(1 - mine**2, 0))
                    keep &= most * size[sub][:, None] * long_[None, :] * (1 + _SLACK) + _SLACK >= worst[sub][:, None]
                keep &= query_ids[sub][:, None] != own[None, :]
                scores = np.full(keep.shape, -np.inf)
                if keep.mean() > 0.1:
                    scores = np.where(keep, q[sub] @ rows.T, -np.inf)
                else:
                    a, b = np.nonzero(keep)
                    scores[a, b] = (q[sub[a]] * rows[b]).sum(1)
                best.offer(sub, own, scores)
    return np.where(best.ids == NO_ID, 0, best.score).astype(np.int64), best.ids


def top_k(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long) of each query's k highest; `is_query` is a condition on vec_id."""
    v = components(table, vector_col)
    vectors = table.where(usable(v)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return search(vectors, is_query, kernel, k, "long")
