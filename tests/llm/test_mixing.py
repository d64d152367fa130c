from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from textmill.llm import mixing


def level(sizes, weights=(3, 1, 2), cap=2):
    """Targets by resharing the excess until none is above its cap; sizes in order."""
    budget = Fraction(3 * sum(sizes), 2)
    w = [Fraction(weights[i % len(weights)]) for i in range(len(sizes))]
    full = set()
    while True:
        rest = budget - sum(cap * sizes[i] for i in full)
        free = sum(w[i] for i in range(len(sizes)) if i not in full)
        goal = [cap * s if i in full else rest * w[i] / free for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if goal[i] > cap * s}
        if not over:
            return goal
        full |= over


def test_agrees_with_sql(same, sf_mid):
    same("op8_mixing", sf_mid)


def test_targets(spark):
    for sizes in ([10, 20, 30], [1, 1000, 5, 7, 900], [0, 5, 5], [100, 1, 1, 1], [8]):
        names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
        df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2), (3, 2), 2).collect()}
        for name, want in zip(names, level(sizes)):
            assert abs(got[name] - float(want)) < 1e-9 * max(1, want)


def documents(spark, n=3000):
    rows = [(i, "w " * (i % 50 + 1), f"s{i * i % 5}" if i % 3 else "s0") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_taken_words_come_near_the_targets(spark):
    out = mixing.mix(documents(spark)).collect()
    taken, goal = Counter(), {}
    source = {r.doc_id: r.source for r in documents(spark).collect()}
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    assert len(out) == 3000
    for s, want in goal.items():
        assert abs(taken[s] - want) <= 25  # half of the longest document


def test_few_bits_a_level_and_shuffled_joins_agree(spark, monkeypatch):
    docs = documents(spark, 600)
    want = sorted(mixing.mix(docs).collect())
    sized, _ = mixing.plan(docs)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = mixing.targets(totals, (3, 1, 2), (3, 2), 2)
    a, _ = mixing.thresholds(sized, goals)
    b, _ = mixing.thresholds(sized, goals, level_bits=5)
    assert sorted(a.collect()) == sorted(b.collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.mix(docs.repartition(7)).collect()) == want


def test_a_larger_budget_keeps_what_a_smaller_one_took(spark):
    docs = documents(spark, 900)
    small = {r.doc_id for r in mixing.mix(docs, share=(1, 4)).collect() if r.times}
    large = {r.doc_id for r in mixing.mix(docs, share=(1, 2)).collect() if r.times}
    assert small < large


def test_mixed_documents(spark):
    docs = documents(spark, 500)
    times = {r.doc_id: r.times for r in mixing.mix(docs).collect()}
    got = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert got == Counter({i: n for i, n in times.items() if n})


def test_edges(edge_docs, no_docs):
    out = mixing.mix(edge_docs).collect()
    assert len(out) == 9 and sum(r.size for r in out) == 3 * 7 + 30_000 + 1 + 8
    assert {r.size for r in out if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []
    assert mixing.mixed_documents(edge_docs).columns == edge_docs.columns


def test_native(edge_docs):
    for df in (mixing.mix(edge_docs), mixing.mixed_documents(edge_docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
