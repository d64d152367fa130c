import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import ann, topk, vectors
from textmill.llm.common import read
from textmill.llm.queries import QUERIES


def brute(rows, step, k, measure):
    """query -> [(vec_id, score)] by comparing every pair."""
    rows = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, q in rows:
        if i % step == 0:
            found = [(-measure(q, v), j) for j, v in rows if j != i and len(v) == len(q)]
            out[i] = [(j, -s) for s, j in sorted(found)[:k]]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


dot = lambda q, v: float((q * v).sum())
whole = lambda q, v: int(np.floor(256 * q) @ np.floor(256 * v)) if len(q) else 0


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    return [(int(i), (centres[i % 8] + rng.normal(size=dim) * 0.4).astype(np.float32).tolist()) for i in rng.permutation(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, score int")


def test_topk_agrees_with_sql(same, sf):
    same("op7_topk", sf)


def test_topk_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 16)
    rng = np.random.default_rng(1)
    rows = [(i, (np.asarray(v) * rng.lognormal(0, 1)).astype(np.float32).tolist()) for i, v in clustered(600, 6)]
    ints = topk.integers(np.array([v for _, v in rows]))
    found = vectors.search(
        table(spark, rows).select("vec_id", F.col("embedding").cast("array<double>").alias("v")), F.col("vec_id") % 50 == 0,
        topk.kernel, 5, "long", shard_rows=90, query_rows=5,
    )
    assert len(ints) == 600 and results(found) == brute(rows, 50, 5, whole)


def test_ann_factor_one_is_exact(spark):
    rows = clustered(700, 8, 3)
    found = vectors.search(
        table(spark, rows).select("vec_id", F.col("embedding").cast("array<double>").alias("v")), F.col("vec_id") % 20 == 0,
        ann.kernel(1.0), 20, "double", shard_rows=250, query_rows=20,
    )
    got, want = results(found), brute(rows, 20, 20, dot)
    assert {q: [j for j, _ in x] for q, x in got.items()} == {q: [j for j, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(got[q], want[q]))


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_ann_recall(spark, folder):
    at = f"/root/testdata/{folder}"
    ids, x = zip(*[(r.vec_id, r.embedding) for r in read(spark, at, "embeddings").collect()])
    ids, x = np.array(ids), np.array(x, float)
    got, hits, total = results(QUERIES["op3_ann"](spark, at)), 0, 0
    for q in ids[ids % 20 == 0]:
        scores = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        hits += len({int(ids[i]) for i in order} & {j for j, _ in got[q]})
        total += len(order)
    assert hits / total >= 0.9


def test_pruning_skips_work():
    """A larger factor visits fewer points; factor one already skips some where clusters are tight."""
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(size=(400, 4)) * 0.05 + c for c in rng.normal(size=(10, 4)) * 5])

    def visited(factor):
        seen = [0]
        tree = ann.VpTree(points, leaf=16)
        tree.search(points[:5], lambda rows: np.full(len(rows), 0.1), lambda rows, leaf: seen.__setitem__(0, seen[0] + len(rows) * len(leaf)), factor)
        return seen[0]

    assert visited(4.0) <= visited(1.0) < 5 * len(points)


HARD = [
    (0, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0, 0.0]), (60, [0.5, 0.5]), (1, [-1.0, 2.0]), (2, [1.0, 0.0]), (3, None), (4, []),
    (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (100, [3.0, 2.0, 1.0]),
    (50, [0.25, -0.25]), (11, [0.001, 0.001]), (150, []), (200, [0.0, 0.0]),
]


def test_hard_rows(spark):
    df = table(spark, [*HARD, (None, [1.0, 1.0])])
    zero = [(i, v) for i, v in HARD if v is not None and None not in v and np.isfinite(v).all()]
    assert results(topk.top_k(df, F.col("vec_id") % 50 == 0)) == {q: x for q, x in brute(zero, 50, 5, whole).items() if x}
    some = [(i, v) for i, v in zero if any(v)]
    assert results(ann.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0)) == {q: x for q, x in brute(some, 20, 20, dot).items() if x}
    for f in (topk.top_k, ann.nearest):
        assert f(df.limit(0), F.col("vec_id") % 2 == 0).collect() == []


def test_ties_of_a_hot_vector(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=16).astype(np.float32).tolist()
    rows = [(i, hot if i % 3 else rng.normal(size=16).astype(np.float32).tolist()) for i in range(500)]
    got = results(ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, factor=1.0))
    assert {q: [j for j, _ in x] for q, x in got.items()} == {q: [j for j, _ in x] for q, x in brute(rows, 20, 20, dot).items()}
    got = results(topk.top_k(table(spark, rows), F.col("vec_id") % 50 == 0))
    assert got == brute(rows, 50, 5, whole)


def test_repeated_rows_and_huge_components(spark):
    df = table(spark, [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [3e38, 1.0]), (3, [-3e38, 0.0])])
    got = results(topk.top_k(df, F.col("vec_id") % 50 == 0))
    assert got == {50: [(2, 2**63 - 1), (1, 256 * 256 * 3), (3, -(2**63))]}
    got = results(ann.nearest(df, F.col("vec_id") % 50 == 0, k=3))
    assert [j for j, _ in got[50]] == [2, 1, 3]


def tight(n, dim, centres, seed=0):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dim))
    x = at[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.05
    return x / np.linalg.norm(x, axis=1)[:, None]


def visited(x, factor, monkeypatch):
    """Share of the pairs that a search by the tree compares, and its recall."""
    seen = [0]
    search = ann.VpTree.search

    def counted(self, queries, radius, visit, factor):
        def seen_too(rows, leaf):
            seen[0] += len(rows) * len(leaf)
            visit(rows, leaf)

        search(self, queries, radius, seen_too, factor)

    monkeypatch.setattr(ann.VpTree, "search", counted)
    ids = np.arange(len(x))
    asked = ids[::20]
    scores, near = ann.kernel(factor)(ids, x)(asked, x[asked], 20)
    monkeypatch.setattr(ann.VpTree, "search", search)
    products = x[asked] @ x.T
    products[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-products, axis=1)[:, :20]
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(near.tolist(), want.tolist())])
    return seen[0] / (len(asked) * len(x)), recall


def test_trees_prune_where_vectors_lie_in_clusters(monkeypatch):
    x = tight(8000, 64, 40)
    share, recall = visited(x, 1.0, monkeypatch)
    assert share < 0.5 and recall > 0.999
    share, recall = visited(x, ann.FACTOR, monkeypatch)
    assert share < 0.4 and recall >= 0.99


def test_buckets_prune_where_lengths_differ(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8000, 64)) * rng.lognormal(0, 1.5, 8000)[:, None]
    ids = np.arange(len(x))
    asked = ids[::50]
    products = [0]
    offer = vectors.Best.offer

    def counted(self, rows, own, scores):
        products[0] += int((scores > -np.inf).sum())
        offer(self, rows, own, scores)

    monkeypatch.setattr(vectors.Best, "offer", counted)
    scores, near = topk.kernel(ids, x)(asked, x[asked], 5)
    whole = np.floor(256 * x[asked]) @ np.floor(256 * x).T
    whole[np.arange(len(asked)), asked] = -np.inf
    assert (-np.sort(-whole, axis=1)[:, :5] == scores).all() and products[0] < 0.2 * whole.size
