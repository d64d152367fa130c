import numpy as np

from textmill.config import LSH
from textmill.operators import calibrate
from textmill.operators.neardup import windows
from textmill.plans import neardup


def documents(spark, tmp_path, sizes):
    docs = [(i, " ".join(f"w{k}" for k in range(n)), "en", "src0", n) for i, n in enumerate(sizes)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_long_documents_are_calibrated(spark, tmp_path):
    """Each kind and bin gets a trial of every document of 96 words or more, however long."""
    rows = neardup.QUERIES["perturbation_recall"](spark, documents(spark, tmp_path, [95, 96, 4001, 20_020])).collect()
    assert len(rows) == len(calibrate.KINDS) * len(calibrate.BINS) + 1
    assert {(r.trials + r.failures, r.errors) for r in rows} == {(3, 0)}
    assert sum(r.failures for r in rows) <= 3  # of 96 words a few similarities can't be had
    by_bin = {(r.kind, r.bin): r for r in rows}
    assert by_bin[calibrate.UNRELATED, calibrate.UNRELATED].hits == 0 and by_bin[calibrate.UNRELATED, calibrate.UNRELATED].passed
    assert all(r.hits == r.trials for r in rows if r.bin == "high_similarity")


def test_the_gate_fails_where_bands_find_too_little(spark, tmp_path):
    """Three documents can't prove a recall of 0.98; a few hundred would."""
    rows = neardup.QUERIES["perturbation_recall"](spark, documents(spark, tmp_path, [200, 210, 220])).collect()
    assert all(not r.passed for r in rows if r.bin == "high_similarity") and all(r.passed for r in rows if r.bin.startswith("below"))


def test_overlap_agrees_with_sets():
    rng = np.random.default_rng(3)
    for _ in range(30):
        words = [f"w{k}" for k in rng.integers(0, rng.integers(5, 400), rng.integers(20, 200))]
        texts = windows(words, LSH.width)
        ids = np.unique(texts, return_inverse=True)[1]
        for kind in calibrate.KINDS:
            for amount in {1, 7, len(ids) // 2, len(ids) - 1} - {0}:
                a, b = set(texts), set(windows(calibrate.changed(words, kind, amount), LSH.width))
                assert calibrate.overlap(ids, kind, amount, LSH.width) == (len(a & b), len(a | b)), (kind, amount)
