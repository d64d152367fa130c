import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.llm import lang_id
from textmill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    return lang_id.Model(("a", "b", "c"), lang_id._init(3, 4, rng))


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lang_id._init(3, 4, rng).items()}
    windows, labels = rng.integers(0, 256, (5, 7)), rng.integers(0, 3, 5)
    _, grad = lang_id.loss_and_gradients(p, windows, labels)
    for k in p:
        flat, g = p[k].reshape(-1), grad[k].reshape(-1)
        places = [int(windows[0, 0]) * 12 + 3, int(windows[1, 6]) * 12 + 9] if k[0] == "x" else rng.integers(0, len(flat), 4)
        for i in places:
            old, losses = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = old + step
                losses.append(lang_id.loss_and_gradients(p, windows, labels)[0])
            flat[i] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - g[i]) < 1e-7


def plain(model, text):
    """Mean of position probabilities, one byte at a time over the whole text."""
    p, data, states = model.p, text.encode(), {}
    sig = lambda x: 1 / (1 + np.exp(-x))
    total = np.zeros(len(model.langs))
    for d, order in (("f", range(len(data))), ("b", range(len(data) - 1, -1, -1))):
        h = np.zeros((p["cf"].shape[0], 1))
        m = len(h)
        for i in order:
            x, u = p["x" + d][data[i]][:, None].astype(float), p["u" + d].astype(float) @ h
            z, r = lang_id.KEEP * sig(x[:m] + u[:m]), sig(x[m : 2 * m] + u[m : 2 * m])
            n = np.tanh(x[2 * m :] + r * (u[2 * m :] + p["c" + d]))
            h = (1 - z) * n + z * h
            states[d, i] = h
    for i in range(len(data)):
        q = np.exp(p["of"] @ states["f", i] + p["ob"] @ states["b", i] + p["bias"])
        total += (q / q.sum())[:, 0]
    return total / max(1, len(data))


@pytest.mark.parametrize("sizes", [(256, 512), (64, 3), (16, 2), (5, 1)])
def test_batches_agree_with_one_byte_at_a_time(model, monkeypatch, sizes):
    """Windows and blocks of any size leave no trace: states are carried over their borders, both ways."""
    monkeypatch.setattr(lang_id, "WINDOW", sizes[0])
    monkeypatch.setattr(lang_id, "BLOCK", sizes[1])
    texts = ["", "x", "été 漢字", "a" * 63, "b" * 64, "c" * 65, "hello world " * 40, "", "z", "Straße " * 90]
    a = pa.array(texts, pa.large_string())
    _, offsets, data = a.buffers()
    got = model.probabilities(np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)[: len(texts) + 1])
    for t, q in zip(texts, got):
        assert np.allclose(q, plain(model, t), atol=1e-4)


def test_a_first_byte_is_remembered_over_windows(monkeypatch):
    """A network that holds its state for good: what the first byte says reaches the last window, however slow to settle."""
    p = {k: np.zeros_like(v) for k, v in lang_id._init(2, 1, np.random.default_rng(0)).items()}
    p["xf"][:, 0] = 30.0  # update gate shut: the state stays
    p["xf"][ord("!")] = (-30.0, 0.0, 9.0)
    p["of"][:, 0] = (4.0, -4.0)
    model = lang_id.Model(("marked", "plain"), p)
    monkeypatch.setattr(lang_id, "KEEP", 1.0)
    monkeypatch.setattr(lang_id, "WINDOW", 16)
    monkeypatch.setattr(lang_id, "BLOCK", 4)
    for text in ("!" + "a" * 2000, "a" * 2000):
        data = np.frombuffer(text.encode(), np.uint8)
        (q,) = model.probabilities(data, np.array([0, len(data)]))
        assert np.allclose(q, (1.0, 0.0) if text[0] == "!" else (0.5, 0.5), atol=2e-3)


def test_stretches_hold_whole_texts():
    for n in (1, 63, 64, 65, 128, 1000):
        text = "".join(chr(65 + k % 26) for k in range(n))
        rows = lang_id.stretches(text)
        joined = rows.tobytes().decode()
        assert rows.shape[1] == 64 and len(rows) == max(1, -(-n // 64)) and joined[: n // 64 * 64] == text[: n // 64 * 64]
        assert joined.endswith(text[-64:]) or (n < 64 and joined.startswith(text))


def test_held_out_accuracy(spark, sf_mid):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_mid}/documents.parquet").collect()}
    out = QUERIES["op9_lang_id"](spark, sf_mid).collect()
    assert len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97


def test_edges(spark, edge_docs, no_docs):
    trained = lang_id.train(edge_docs)
    assert trained.langs == ("de", "en", "fr")
    rows = edge_docs.select("doc_id", "text", lang_id.predict(F.col("text"), trained).alias("p")).collect()
    for r in rows:
        if r.doc_id in (2, 3, 4):
            assert tuple(r.p) == ("und", 0.0)
        else:
            assert r.p.lang_pred in trained.langs and 0 < r.p.score <= 1
    assert lang_id.train(no_docs) is None and lang_id.train(edge_docs.where("lang is null")) is None
    assert {r.p.lang_pred for r in edge_docs.select(lang_id.predict(F.col("text"), None).alias("p")).collect()} == {"und"}
    assert no_docs.select(lang_id.predict(F.col("text"), trained)).collect() == []
    digits = spark.createDataFrame([("123 !?",), ("٣٤",), ("ß",)], "text string")
    assert [r.p.lang_pred == "und" for r in digits.select(lang_id.predict(F.col("text"), trained).alias("p")).collect()] == [True, True, False]
