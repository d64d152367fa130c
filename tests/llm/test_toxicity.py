import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textmill.llm import toxicity
from textmill.llm.queries import QUERIES


def spread(text):
    """Words of a text by plain splitting, and its n-grams as words."""
    words = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text).split()
    return words, list(zip(words, words[1:])), list(zip(words, words[2:]))


def per_document(texts):
    a = pa.array(texts, pa.large_string())
    data, offsets = toxicity._buffers(a)
    h, doc = toxicity.word_hashes(data, offsets)
    return h, doc


def test_words_are_hashed_by_content_alone():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é漢.  \n9z") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    h, doc = per_document(texts)
    plain = [(i, w) for i, t in enumerate(texts) for w in spread(t)[0]]
    assert [i for i, _ in plain] == doc.tolist()
    by_word = {}
    for (_, w), x in zip(plain, h.tolist()):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_pieces_do_not_change_words(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["idiot", "été", "a1", "…"]) for _ in range(200)) for _ in range(5)]
    want = per_document(texts)
    monkeypatch.setattr(toxicity, "PIECE", 64)
    got = per_document(texts)
    assert all((a == b).all() for a, b in zip(want, got))


def test_a_long_word_is_one_word_whatever_stands_before_it():
    """Far longer than a piece: the hash goes on from piece to piece, and neighbours in the batch change nothing."""
    long = "a" * (3 * toxicity.PIECE + 5)
    model = toxicity.Model(0.0, np.arange(1 << toxicity.BITS), np.random.default_rng(0).normal(size=1 << toxicity.BITS).astype(np.float32))
    dense = model.dense()
    alone = model.score(pa.array([f"x {long} y"]), dense)[0]
    for before in ("", "b", "b " * 1000, "b" * (toxicity.PIECE - 3), "b" * 2 * toxicity.PIECE + " "):
        got = model.score(pa.array([before, f"x {long} y", "z"]), dense)
        assert got[1] == alone and len(toxicity.distinct_features(pa.array([before, f"x {long} y"]))[1]) == 6


def test_ftrl_agrees_with_one_coordinate_at_a_time():
    """The update of the published algorithm, written out for each coordinate."""
    rng = np.random.default_rng(5)
    data = [(np.unique(rng.integers(0, 50, 8)).astype(np.int32), int(rng.random() < 0.4)) for _ in range(60)]
    alpha, beta, l1, l2, epochs, seed = 0.7, 1.0, 0.3, 0.05, 2, 17
    z, n = {}, {}

    def weight(i, l1, l2):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - (l1 if zi > 0 else -l1)) / ((beta + ni**0.5) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(data)):
            some, label = data[k]
            w = {int(i): weight(int(i), l1, l2) for i in some} | {"bias": weight("bias", 0.0, 0.0)}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in w:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    want = {i: weight(i, l1, l2) for i in z if i != "bias" and weight(i, l1, l2)}
    model = toxicity.fit(data, epochs, alpha, beta, l1, l2, seed)
    assert model.index.tolist() == sorted(want) and 0 < len(want) < 50
    assert np.allclose(model.weight, [want[i] for i in sorted(want)], atol=1e-6) and abs(model.bias - weight("bias", 0.0, 0.0)) < 1e-9


def test_features_count_words_neighbours_and_skips():
    texts = ["one two three four", "", "one one one", "solo", "."]
    a = pa.array(texts)
    want = [len(set(w)) + len(set(p)) + len(set(s)) for w, p, s in map(spread, texts)]
    assert [len(f) for f in toxicity.distinct_features(a)] == want


def test_scores_are_the_sum_of_distinct_weights():
    texts = ["bad bad thing", "good thing", "", None, "bad"]
    rows = toxicity.distinct_features(pa.array([t or "" for t in texts]))
    bad = rows[4][0]
    model = toxicity.Model(-1.0, np.array([bad]), np.array([3.0], np.float32))
    got = model.score(pa.array(texts), model.dense())
    assert np.allclose(got, 1 / (1 + np.exp(-np.array([2.0, -1, -1, -1, 2]))))


def test_sparse_weights():
    rng = random.Random(3)
    noise = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(noise, k=40) + (["vile"] if k % 4 == 0 else [])) for k in range(600)]
    rows = list(zip(toxicity.distinct_features(pa.array(texts)), [int(k % 4 == 0) for k in range(600)]))
    model = toxicity.fit(rows)
    assert 0 < len(model.index) < 200
    score = model.score(pa.array(["a vile b", "plain words"]), model.dense())
    assert score[0] > 0.5 > score[1]


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    out = QUERIES["op4_toxicity"](spark, at)
    labels = spark.read.parquet(f"{at}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    found = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    assert right > 0.95 and found > 0.6 and all(0 <= r.score <= 1 for r in rows)


def test_training_is_bounded_by_rows_and_characters(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} " * 100) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    used = []
    monkeypatch.setattr(toxicity, "fit", lambda rows: used.append([y for _, y in rows]))
    toxicity.train(docs, labels)
    toxicity.train(docs, labels, sample=10)
    monkeypatch.setattr(toxicity, "MOST_CHARACTERS", 3000)
    toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "MOST_CHARACTERS", 1)
    toxicity.train(docs, labels)
    assert all(used[0].count(y) == 30 and 0 < used[1].count(y) <= 10 for y in (0, 1))
    assert all(0 < used[2].count(y) <= 5 for y in (0, 1)) and sorted(used[3]) == [0, 1]


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 0, 1), (7, None, 1), (None, 1, 1), (99, 1, 1), (4, 0, 0)], "doc_id long, toxic int, y int")
    model = toxicity.train(edge_docs, labels)
    out = edge_docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()
    assert len(out) == 9 and all(0 <= r.s <= 1 for r in out)
    blank = {round(r.s, 9) for r in out if r.doc_id in (2, 3, 4)}
    assert len(blank) == 1
    none = toxicity.train(edge_docs, labels.limit(0))
    assert {r.s for r in edge_docs.select(toxicity.score(F.col("text"), none).alias("s")).collect()} == {0.5}
    assert no_docs.select(toxicity.score(F.col("text"), model)).collect() == []
