from collections import Counter

import corpus_pipeline
import pytest
import tiktoken
from pyspark.sql import functions as F

from textmill.llm import bpe, line_dedup, mixing
from textmill.llm.common import read
from textmill.llm.queries import vocabulary

from tests.llm.test_line_dedup import brute
from tests.llm.test_similar import plain_stay


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents, and the rows of each stage, on the middle tables."""
    folder = "/root/testdata/sf0.01"
    docs, out = read(spark, folder, "documents"), []
    out.append(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append(docs.collect())
    return out


def test_language(stages):
    lettered = [r for r in stages[0] if any(c.isalpha() for c in r.text or "")]
    assert sorted(stages[1]) == sorted(lettered)


def test_lines(stages):
    docs = [(r.doc_id, r.text, r.source) for r in stages[1]]
    assert {r.doc_id: r.text for r in stages[2]} == {i: t for i, t, _ in brute(docs, line_dedup.MIN_SITES)}
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_duplicates(stages):
    """One document of each group of Jaccard 0.8 or more over five-word shingles, by all pairs."""
    assert sorted(r.doc_id for r in stages[3]) == plain_stay([(r.doc_id, r.text) for r in stages[2]])
    assert set(stages[3]) <= set(stages[2])


def test_mixture(spark, stages):
    docs = spark.createDataFrame(stages[3])
    times = {r.doc_id: r.times for r in mixing.mix(docs).collect()}
    assert Counter(r.doc_id for r in stages[4]) == Counter({i: n for i, n in times.items() if n})
    assert set(stages[4]) <= set(stages[3])


def test_tokens(stages):
    path, pattern = vocabulary()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    text = {r.doc_id: r.text for r in stages[4]}
    assert Counter(r.doc_id for r in stages[5]) == Counter(r.doc_id for r in stages[4])
    for r in stages[5]:
        assert r.ids == encoding.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_texts_are_encoded_once(spark, sf):
    plan = corpus_pipeline.tokens(spark, read(spark, sf, "documents"), sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_an_unnamed_language_is_filled_in(spark, sf):
    docs = read(spark, sf, "documents")
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("lang")))
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, some, sf).collect()}
    true = {r.doc_id: r.lang for r in docs.collect()}
    assert all(got[i] == true[i] for i in got if i % 4) and all(got.values())
    unnamed = [i for i in got if i % 4 == 0 and len(true) > 0]
    assert sum(got[i] == true[i] for i in unnamed) / len(unnamed) > 0.9


def test_any_columns_pass(spark, sf):
    """Columns named like what stages use inside keep their values through all stages but the last."""
    names = "d p i t u v s n root set_id text_key gone size removed __removed __lang __stay_id __stay_key __mix_copy times h".split()
    docs = read(spark, sf, "documents").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.where(F.concat_ws("|", *names) != F.concat_ws("|", *(F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names))).isEmpty() and not out.isEmpty()


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"] and out.count() > 0


def test_edges(spark, edge_docs, no_docs, sf):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "byte-level BPE":
                assert out.columns == docs.columns
            rows = out.collect()
            if docs is no_docs:
                assert rows == []
            if name == "SimHash near-dedup" and docs is edge_docs:
                ids = [r.doc_id for r in rows]
                assert sorted(ids) == [1, 2, 5, 6, 7]
            if name == "byte-level BPE" and docs is edge_docs:
                assert len(rows) == 9 and all(r.round_trip for r in rows)
