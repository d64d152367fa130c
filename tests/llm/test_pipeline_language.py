import corpus_pipeline
import numpy as np

from textmill.llm import lang_id

LANGS = ("de", "en", "es", "fr")


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect())


def test_letters_stay_without_a_model(spark):
    assert kept(spark, [(1, "some words", None, "a", 10), (2, "12 34", None, "a", 5), (3, None, None, "a", 0), (4, "é", None, "a", 1)]) == [1, 4]


def test_chance_is_not_a_language(spark, monkeypatch):
    flat = lang_id._init(len(LANGS), lang_id.HIDDEN, np.random.default_rng(0))
    model = lang_id.Model(LANGS, {k: np.zeros_like(v) for k, v in flat.items()})
    monkeypatch.setattr(lang_id, "train", lambda *a, **k: model)
    assert kept(spark, [(1, "some words", "en", "a", 10)]) == []


def test_one_language_stays(spark):
    assert kept(spark, [(i, f"some words {i}", "en", "a", 10) for i in range(1, 9)]) == list(range(1, 9))
