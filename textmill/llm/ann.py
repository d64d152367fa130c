"""Approximate nearest neighbours by inner product, with a vantage-point tree for each shard.

A coordinate more, sqrt(M^2 - |x|^2) with M the shard's greatest length, makes the nearest by distance the largest
by inner product. A side of a node is skipped when the triangle inequality shows it too far: when the query lies
further than its k-th best distance, divided by `factor`, from the boundary. Factor one is the exact search; larger
ones skip more.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take
no part; rows that repeat a vec_id are never candidates of a query of that id, and together count as one query;
of equal scores the smaller vec_id comes first; an empty table gives an empty result. Only the id and vector columns
are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.vectors import Best, components, search, usable

LEAF = 128
FACTOR = 4.0
_SLACK = 1e-9


class VpTree:
    """Built over the rows of a matrix; points are parted at the median distance from a vantage point."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 7) -> None:
        self.points, self.leaf, self.rng = points, leaf, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        vantage = self.points[self.rng.choice(rows)]
        d = np.sqrt(np.maximum(((self.points[rows] - vantage) ** 2).sum(1), 0))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        return vantage, d[order[half]], self._build(rows[order[:half]]), self._build(rows[order[half:]])

    def search(self, queries: np.ndarray, radius, visit, factor: float) -> None:
        """Calls visit(query rows, point rows) for leaves; radius(query rows) is the distance still of interest."""

        def go(node, some: np.ndarray) -> None:
            if not len(some):
                return
            if isinstance(node, np.ndarray):
                visit(some, node)
                return
            vantage, middle, near, far = node
            off = np.sqrt(np.maximum(((queries[some] - vantage) ** 2).sum(1), 0)) - middle
            inside = off <= 0
            go(near, some[inside])
            go(far, some[~inside])
            for side, to in ((inside, far), (~inside, near)):
                rest, gap = some[side], np.abs(off[side])
                go(to, rest[gap * factor <= radius(rest) * (1 + _SLACK) + _SLACK])

        go(self.root, np.arange(len(queries)))


def kernel(factor: float):
    """Kernel of a shard: its tree is built once and asked block by block."""

    def of(ids: np.ndarray, vectors: np.ndarray):
        x = vectors.astype(np.float64)
        # units keep squares of any finite components finite
        unit = max(np.abs(x).max(), np.finfo(float).tiny)
        small = x / unit
        lengths = (small**2).sum(1)
        top = lengths.max()
        tree = VpTree(np.concatenate([small, np.sqrt(np.maximum(top - lengths, 0))[:, None]], axis=1))

        def search(query_ids: np.ndarray, queries: np.ndarray, k: int):
            q = queries.astype(np.float64)
            q_unit = np.maximum(np.abs(q).max(1), np.finfo(float).tiny)
            # a query's length doesn't change its order: scaled to the points' greatest length
            plain = q / q_unit[:, None]
            scale = np.sqrt(top / (plain**2).sum(1))
            scaled = plain * scale[:, None]
            size = scale / q_unit / unit  # a score times this is a product of the scaled query and a small point
            asked = np.concatenate([scaled, np.zeros((len(q), 1))], axis=1)
            best = Best(len(q), k)

            def least(rows):
                """The product with a small point that is still of interest; any, if the scale is beyond a double."""
                worst, s = best.worst()[rows], size[rows]
                known = np.isfinite(worst) & (s > 1e-290)
                return np.where(known, np.where(known, worst, 0) * s, -np.inf)

            def radius(rows):
                return np.sqrt(np.maximum(2 * top - 2 * least(rows), 0))

            def visit(rows, leaf):
                # a matrix product tells which pairs may matter; those are summed in one order, so equal vectors tie
                maybe = scaled[rows] @ small[leaf].T >= least(rows)[:, None] - _SLACK * (1 + top)
                maybe &= query_ids[rows][:, None] != ids[leaf][None, :]
                a, b = np.nonzero(maybe)
                scores = np.full(maybe.shape, -np.inf)
                for at in range(0, len(a), 65536):
                    i, j = a[at : at + 65536], b[at : at + 65536]
                    scores[i, j] = (q[rows[i]] * x[leaf[j]]).sum(1)
                best.offer(rows, ids[leaf], scores)

            tree.search(asked, radius, visit, factor)
            return best.score, best.ids

        return search

    return of


def nearest(
    table: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score (inner product in double precision) of each query's k nearest found.

    `is_query` is a condition on the column vec_id.
    """
    v = components(table, vector_col)
    vectors = table.where(usable(v) & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return search(vectors, is_query, kernel(factor), k, "double")
