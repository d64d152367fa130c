import random
from itertools import combinations

import corpus_pipeline
import numpy as np

from textmill.llm import similar, simhash
from textmill.llm.common import read

from tests.llm.test_simhash import simhash_words


def plain_set(text):
    words = simhash_words(text)
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_stay(items):
    """items: (doc_id, text) -> least ids of the groups linked by Jaccard 0.8 or more, by all pairs."""
    sets, root = {i: plain_set(t) for i, t in items}, {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if 5 * len(x & y) >= 4 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return sorted({find(i) for i in sets})


def stay(docs):
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(docs.sparkSession, docs, "").collect())


def test_stage_agrees_with_all_pairs(spark, sf_mid):
    docs = read(spark, sf_mid, "documents").where("text is not null")
    assert stay(docs) == plain_stay([(r.doc_id, r.text) for r in docs.collect()])


def test_boundary_of_similarity(spark):
    """36 words, 32 shingles; 8 other words at the end leave 28 of 36 shingles, fewer leave more."""
    base = [f"w{i}" for i in range(36)]
    for other in range(10):
        texts = [" ".join(base), " ".join(base[: 36 - other] + [f"n{i}" for i in range(other)])]
        items = list(enumerate(texts))
        assert stay(spark.createDataFrame(items, "doc_id long, text string")) == plain_stay(items)


def test_crowded_shingles(spark, monkeypatch):
    """Texts that share a common passage, near copies among them: putting crowded shingles last loses no pair."""
    monkeypatch.setattr(similar, "CROWDED", 3)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(30)]
    items = []
    for k in range(40):
        words = common + [f"t{rng.randrange(10**6)}" for _ in range(rng.randint(0, 120))]
        items.append((3 * k, " ".join(words)))
        for j in (1, 2):
            changed = list(words)
            for _ in range(rng.randint(0, 4)):
                changed[rng.randrange(len(changed))] = f"z{rng.randrange(10**6)}"
            items.append((3 * k + j, " ".join(changed)))
    assert stay(spark.createDataFrame(items, "doc_id long, text string")) == plain_stay(items)


def test_sets(spark):
    df = spark.createDataFrame([(None,), ("",), ("a b",), ("a b c d e a b c d e a b c d e",)], "text string")
    sets = [r.s for r in df.select(similar.shingle_sets(df.text).alias("s")).collect()]
    assert sets[0] == sets[1] == [] and len(sets[2]) == 1 and len(sets[3]) == 5 and sets[3] == np.unique(sets[3]).tolist()


def test_simhash_finds_candidates(spark):
    """Texts a word apart get fingerprints within the operator's distance, and the stage takes them from there."""
    base = [f"w{i}" for i in range(3000)]
    texts = [" ".join(base), " ".join(base[:-1] + ["other"]), " ".join(f"x{i}" for i in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    none = spark.sparkContext.broadcast(np.empty(0, np.int64))
    one = df.select(similar._described(df.text, none, similar.WIDTH).alias("d")).select("d.*").cache()
    prints = [r.fp for r in one.collect()]
    assert prints == [simhash.fingerprint(t, similar.WIDTH) for t in texts]
    ids = [r.set_id for r in one.collect()]
    assert [tuple(r) for r in similar.simhash_pairs(one).collect()] == [tuple(sorted(ids[:2]))]


def test_parities_lose_no_pair(spark):
    """Unlike parities are never more than what the sets differ in, and dismiss sets with little in common."""
    rng = np.random.default_rng(5)
    rows, exact = [], []
    for n in (1, 4, 9, 36, 400, 3000):
        for share in (0.0, 0.3, 0.7, 0.8, 0.9, 1.0):
            both, own = rng.integers(-(2**63), 2**63 - 1, (2, n))
            k = round(share * n)
            a, b = np.unique(both), np.unique(np.concatenate([both[:k], own[: (n - k) // 2]]))
            rows.append((len(a), len(b), similar.parities(a).tolist(), similar.parities(b).tolist()))
            exact.append(5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)))
    df = spark.createDataFrame(rows, "un int, vn int, uq array<long>, vq array<long>").coalesce(1)
    passed = [r.x for r in df.select(similar.near_enough("u", "v").alias("x")).collect()]
    assert all(p for p, e in zip(passed, exact) if e) and not all(passed)
