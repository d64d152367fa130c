import pytest
from pyspark.sql import functions as F

from textmill.operators import admission
from textmill.sources import archives, jsonl
from textmill.streaming import ingest


def test_language_lists(spark):
    df = spark.createDataFrame([("Python",), ("Go",), ("python",), (None,)], "l string")
    got = [r.x for r in df.select(admission.classify_language(F.col("l"), {"python": ["Python"], "other_code": ["Go", "C"]}).alias("x")).collect()]
    assert got == ["python", "other_code", None, None]
    with pytest.raises(ValueError):
        admission.classify_language(F.col("l"), {"a": ["x"], "b": ["x"]})


def test_quarantine_and_names(spark):
    df = spark.createDataFrame([("a/HumanEval", "x.py"), ("a", "tests\\multi-pl-e\\x"), ("a", "b.py"), (None, None)], "r string, p string")
    assert [r.x for r in df.select(admission.quarantined(F.col("r"), F.col("p")).alias("x")).collect()] == [True, True, False, False]
    names = [("a/b.py", ".py", True), (".bashrc", "", True), ("x.tar.gz", ".gz", True), ("a.b c", "", True), ("x." + "y" * 16, "", True), ("/abs", "", False), ("a/../b", "", False), ("a//b", "", False), ("", "", False), ("a\\b.c", ".c", False)]
    rows = spark.createDataFrame(names, "p string, s string, ok boolean").select("s", "ok", admission.safe_suffix(F.col("p")).alias("s2"), admission.safe_member(F.col("p")).alias("ok2")).collect()
    assert all((r.s, r.ok) == (r.s2, r.ok2) for r in rows)


def test_code_skip_order(spark):
    rows = [
        ("Go", False, False, "permissive", "r", "p", "x", False, 1, None), ("Perl", True, True, "gpl", "mbpp", "p", "", True, 0, "language"), ("Go", True, True, "gpl", "mbpp", "p", "", True, 0, "bucket_full"),
        ("Go", False, True, "gpl", "mbpp", "p", "", True, 0, "vendor"), ("Go", False, None, "gpl", "mbpp", "p", "", True, 0, "not_code"), ("Go", False, False, "no_license", "mbpp", "p", "", True, 0, "quarantined"),
        ("Go", False, False, "no_license", "r", "p", "", True, 0, "not_code_content"), ("Go", False, False, "no_license", "r", "p", "x", True, 0, "benchmark"), ("Go", False, False, "no_license", "r", "p", "x", False, 0, "not_code_tokens"),
    ]
    df = spark.createDataFrame(rows, "l string, f boolean, v boolean, c string, r string, p string, t string, b boolean, n int, want string")
    skip = admission.code_skip(*(F.col(x) for x in "lfvcrptbn"), {"other": ["Go"]})
    assert all(r.want == r.got for r in df.withColumn("got", skip).collect())


def test_english_skip_order(spark):
    rows = [("a b", "en", 0.9, "http://x", False, 2, None), (" ", "en", 0.9, "mbpp", True, 0, "empty"), ("a", "fr", 0.9, "mbpp", True, 0, "language"), ("a", "en", None, "mbpp", True, 0, "language"),
            ("a", "en", 0.9, "http://MBPP/", True, 0, "quarantined_url"), ("a", "en", 0.9, None, True, 0, "benchmark"), ("a", "en", 0.9, None, False, 0, "not_english")]
    df = spark.createDataFrame(rows, "t string, l string, s double, u string, b boolean, n int, want string")
    skip = admission.english_skip(*(F.col(x) for x in "tlsubn"), 0.5)
    assert all(r.want == r.got for r in df.withColumn("got", skip).collect())


def test_cutoff(spark):
    rows = spark.createDataFrame([(i, "b", 4) for i in range(6)], "i long, bucket string, tokens long")
    targets = spark.createDataFrame([("b", 10)], "bucket string, target long")
    assert [r.accepted for r in admission.bucket_cutoff(rows, targets, ["i"]).orderBy("i").collect()] == [True, True, True, False, False, False]


def test_ledger(spark):
    schema = "record string, phase string, split string, category string, tokens long"
    ledger = spark.createDataFrame([("a", "p", None, "en", 5), ("b", "p", "train", "en", 7), ("c", "q", None, "fr", 1)], schema)
    same = spark.createDataFrame([("a", "p", None, "en", 5), ("d", "q", None, "fr", 2)], schema)
    merged = admission.ledger_insert(ledger, same, "record")
    assert sorted(r.record for r in merged.collect()) == ["a", "b", "c", "d"]
    other = spark.createDataFrame([("a", "p", None, "en", 6)], schema)
    with pytest.raises(ValueError):
        admission.ledger_insert(ledger, other, "record")
    assert {r.record: r.tokens for r in admission.ledger_insert(ledger, other, "record", replace=True).collect()}["a"] == 6
    quotas = spark.createDataFrame([("all", None, None, None, 10), ("train", "p", "train", None, 8), ("fr", None, None, "fr", 0 + 3)], "name string, phase string, split string, category string, target long")
    got = {r.name: (r.tokens, r.remaining, r.reached) for r in admission.ledger_status(merged, quotas).collect()}
    assert got == {"all": (15, 0, True), "train": (7, 1, False), "fr": (3, 0, True)}


def test_closure(spark):
    ledger = spark.createDataFrame([("a", "s", 3, 10), ("b", "s", 1, 4), ("b", "t", 1, 4), ("c", "s", 1, 2), ("d", "s", 2, 9)], "bucket string, source string, documents long, tokens long")
    markers = spark.createDataFrame([("a", 10), ("b", 8), ("c", 2), ("d", 8)], "bucket string, tokens long")
    targets = spark.createDataFrame([(x, 5) for x in "abcde"], "bucket string, target long")
    got = {r.bucket: r.failure for r in admission.closure(ledger, markers, targets).collect()}
    assert got == {"a": "", "b": "sources", "c": "below_target", "d": "marker", "e": "missing_bucket"}


def test_estimates_round_half_to_even(spark):
    df = spark.createDataFrame([(5,), (15,), (25,)], "b long")
    assert [r.x for r in df.select(admission.estimated_tokens(F.col("b"), F.lit(10.0)).alias("x")).collect()] == [0, 2, 2]


def test_archives(spark, tmp_path):
    data = archives.pack_archive([("a.txt", b"one"), ("d/b.txt", "é\n".encode())])
    (tmp_path / "part-000000.tar.zst").write_bytes(data)
    got = archives.read_archives(spark, str(tmp_path)).orderBy("manifest_index").collect()
    assert [(r.archive, r.manifest_index, r.member_path, r.content, r.size_bytes) for r in got] == [
        ("part-000000.tar.zst", 0, "a.txt", "one", 3), ("part-000000.tar.zst", 1, "d/b.txt", "é\n", 3),
    ]
    assert list(archives.unpack_archive(archives.pack_archive([]))) == []


def test_broken_archives():
    import io
    import tarfile

    import zstandard

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        info = tarfile.TarInfo("a")
        info.size = 1
        tar.addfile(info, io.BytesIO(b"x"))
    with pytest.raises(ValueError):
        list(archives.unpack_archive(zstandard.compress(out.getvalue())))


def test_jsonl(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a": {"b": "x"}}\n{"a": {"b": "y"}}\n')
    assert sorted(r.text for r in jsonl.read_field(spark, str(tmp_path / "good.jsonl"), "a struct<b: string>", "a.b").collect()) == ["x", "y"]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        jsonl.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "t.txt").write_text("a\nb")
    assert [r.text for r in jsonl.read_text(spark, str(tmp_path / "t.txt"), whole=True).collect()] == ["a\nb"]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "doc_id long, text string"
    first = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], schema)
    second = spark.createDataFrame([(0, "a b"), (4, "c")], schema)
    source, place = str(tmp_path / "in"), str(tmp_path / "index")
    first.write.parquet(source)
    for more in (None, second, None):  # the last run finds nothing new
        if more is not None:
            more.write.mode("append").parquet(source)
        ingest.index_duplicates(ingest.document_stream(spark, source, first.schema, files=1), place)
    got = sorted(map(tuple, ingest.duplicate_index(spark, place).collect()))
    assert got == sorted(map(tuple, ingest.partial_counters(first.unionByName(second)).collect()))
    assert [r[1:] for r in got if r[2] == 3] == [(0, 3, 6)]
