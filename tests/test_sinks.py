import pytest
from pyspark.sql import functions as F

from textmill.config import PackConfig
from textmill.operators import pack
from textmill.sources import archives, contracts, jsonl, sinks


def test_token_cache(spark, tmp_path):
    rows = [("a", 1, [2, 3]), ("a", 2, [4, 65535]), ("b", 3, []), ("b", 4, [0, 1, 2, 300])]
    docs = spark.createDataFrame(rows, "archive string, id long, tokens array<int>")
    report = {r.archive: tuple(r)[1:] for r in sinks.write_token_cache(docs, f"{tmp_path}/c", 1 << 16).collect()}
    assert report == {"a": (2, 4, 2, 65535), "b": (2, 4, 0, 300)}
    back = {r.id: (r.start, r.n_tokens, r.tokens) for r in sinks.read_token_cache(spark, f"{tmp_path}/c").collect()}
    assert back == {1: (0, 2, [2, 3]), 2: (2, 2, [4, 65535]), 3: (0, 0, []), 4: (0, 4, [0, 1, 2, 300])}
    part = {r.id: r.tokens for r in sinks.read_token_cache(spark, f"{tmp_path}/c", 1, 2).collect()}
    assert part == {1: [3], 2: [65535], 3: [], 4: [1, 2]}
    with pytest.raises(ValueError, match="outside"):
        sinks.write_token_cache(docs, f"{tmp_path}/d", 65535)
    assert not (tmp_path / "d").exists()
    with pytest.raises(ValueError, match="two bytes"):
        sinks.write_token_cache(docs, f"{tmp_path}/d", 1 << 17)


def test_packed_streams_resume(spark, tmp_path):
    config, at = PackConfig(length=4), f"{tmp_path}/p"
    docs = [(i, s, d, [10 * i + k for k in range(5)]) for i, (s, d) in enumerate([("train", "en"), ("train", "fr"), ("test", "en"), ("train", "en")], 1)]
    index = pack.streams(spark.createDataFrame(docs, "id long, split string, domain string, tokens array<int>").withColumn("n_tokens", F.size("tokens").cast("long")), ["id"]).cache()
    assert sinks.write_packed(index, at, config, only=[("train", "en")]) == [("train", "en")]
    # rows of a stream that was broken off don't count, and are written anew
    (tmp_path / "p/rows/split=test/domain=en").mkdir(parents=True)
    pack.packed(index.where("split = 'test'"), config).drop("split", "domain").limit(0).write.mode("overwrite").parquet(f"{at}/rows/split=test/domain=en")
    before = sorted(p.name for p in (tmp_path / "p/rows/split=train/domain=en").iterdir())
    assert sinks.write_packed(index, at, config) == [("test", "en"), ("train", "fr")]
    assert sorted(p.name for p in (tmp_path / "p/rows/split=train/domain=en").iterdir()) == before
    assert sinks.write_packed(index, at, config) == []
    key = lambda df: sorted((r.split, r.domain, r.row_id, r.tokens, r.starts) for r in df.collect())
    assert key(sinks.read_packed(spark, at)) == key(pack.packed(index, config))


def test_proof_finds_a_lost_and_a_doubled_row(spark):
    rows = spark.range(5)
    assert sinks.proven(rows, rows, "x").count() == 5
    for other in (rows.where("id > 0"), rows.unionByName(spark.range(1)), rows.withColumn("id", F.col("id") + 1)):
        with pytest.raises(ValueError, match="written rows differ"):
            sinks.proven(other, rows, "x")


def test_empty_sft_outputs_are_left_out(spark, tmp_path):
    rows = [(1, "g", "in", "out", "generic", 4, None, "train"), (2, "g", "in", "out", "generic", 4, "quality:x", None)]
    made = spark.createDataFrame(rows, "id int, group_id string, input string, output string, domain string, tokens int, reason string, split string")
    assert sinks.write_sft(made, f"{tmp_path}/s") == ["train", "rejected"]
    assert "input" not in spark.read.parquet(f"{tmp_path}/s/rejected").columns and not (tmp_path / "s/validation").exists()


def test_order_files(spark, tmp_path):
    sinks.write_order(spark.range(100).select(F.col("id").alias("position")), f"{tmp_path}/o")
    files = sorted((r.first, r.last, r.rows) for r in sinks.order_files(spark, f"{tmp_path}/o").collect())
    assert all(b - a + 1 == n for a, b, n in files) and [a for a, _, _ in files[1:]] == [b + 1 for _, b, _ in files[:-1]]


def test_schema_contract(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id long, name string").write.parquet(f"{tmp_path}/t")
    assert contracts.read_checked(spark, f"{tmp_path}/t", "id long, name string", ["name"]).columns == ["name"]
    for schema, word in (("id int, name string", "expected int"), ("id long", "unknown"), ("id long, name string, x int", "missing")):
        with pytest.raises(ValueError, match=word):
            contracts.read_checked(spark, f"{tmp_path}/t", schema)


def test_json_lines_contract(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n{}\n')
    rows = contracts.read_checked_jsonl(spark, f"{tmp_path}/good.jsonl", "a long").collect()
    assert sorted(r.a or 0 for r in rows) == [0, 1]
    (digest,) = sinks.file_digests(spark, str(tmp_path / "good.jsonl")).collect()
    assert contracts.read_checked_jsonl(spark, f"{tmp_path}/good.jsonl", "a long", {"good.jsonl": digest.sha256}).count() == 2
    with pytest.raises(ValueError, match="changed"):
        contracts.read_checked_jsonl(spark, f"{tmp_path}/good.jsonl", "a long", {"good.jsonl": "0" * 64})
    for name, text, problem in (("blank", '{"a": 1}\n\n{"a": 2}\n', "blank"), ("list", "[1]\n", "not_an_object"), ("cut", '{"a"\n', "not_an_object")):
        (tmp_path / f"{name}.jsonl").write_text(text)
        with pytest.raises(ValueError, match=problem):
            contracts.read_checked_jsonl(spark, f"{tmp_path}/{name}.jsonl", "a long")


def test_zstandard_lines(spark, tmp_path):
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    # two frames in one file, as appending writers make them
    (tmp_path / "a.jsonl.zst").write_bytes(pack('{"a": 1, "s": "é\u2028x"}\n{"a": 2}\n'.encode()) + pack(b'{"a": 3}\n'))
    (tmp_path / "b.jsonl.zst").write_bytes(pack(b""))
    assert sorted((r.a, r.s) for r in jsonl.read_zst(spark, f"{tmp_path}/*.zst", "a long, s string").collect()) == [(1, "é\u2028x"), (2, None), (3, None)]
    (tmp_path / "c.jsonl.zst").write_bytes(pack(b'{"a": 1}\n\n'))
    with pytest.raises(Exception, match="blank line"):
        jsonl.read_zst(spark, f"{tmp_path}/c.jsonl.zst", "a long").collect()


def test_repo_files_go_on_from_a_row(spark, tmp_path):
    rows = [("r0", [("a.py", "x"), ("b.py", "y")]), ("r1", []), ("r2", [("c.py", "z")]), ("r3", None)]
    schema = "repo string, files array<struct<path: string, content: string>>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/r")
    scan = lambda n: sorted((r.row, r.repo, r.nth, r.file.path) for r in contracts.repo_files(spark, f"{tmp_path}/r", schema, skip=n).collect())
    assert scan(0) == [(0, "r0", 0, "a.py"), (0, "r0", 1, "b.py"), (2, "r2", 0, "c.py")] and scan(1) == [(2, "r2", 0, "c.py")]


def test_parquet_contract(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/t")
    good = contracts.parquet_contract(spark, f"{tmp_path}/t", 10, files=2).first()
    assert good.agrees and good.files == 2 and good.rows == 10
    assert not contracts.parquet_contract(spark, f"{tmp_path}/t", 11).first().agrees and not contracts.parquet_contract(spark, f"{tmp_path}/t", 10, files=3).first().agrees


def test_manifest_problems_are_errors(spark):
    m = [("a", 0, "x", 5, 1), ("a", 1, "y", 6, 1)]
    manifest = spark.createDataFrame(m, "archive string, manifest_index long, member_path string, size_bytes long, tokens long")
    measured = manifest.drop("tokens").withColumn("sha", F.lit("s"))
    assert sorted(map(tuple, archives.assert_merged(archives.merged_manifest(manifest, measured)).collect())) == [("a", 0, "x", 5, 1, "s"), ("a", 1, "y", 6, 1, "s")]
    swapped = measured.withColumn("member_path", F.when(F.col("manifest_index") == 0, "y").otherwise("x"))
    with pytest.raises(ValueError, match="member_order"):
        archives.assert_merged(archives.merged_manifest(manifest, swapped))
    with pytest.raises(ValueError, match="no_member"):
        archives.assert_merged(archives.merged_manifest(manifest, measured.limit(1)))


def test_parts_are_bounded_by_bytes(spark):
    rows = [("a", i, n) for i, n in enumerate([40, 70, 10, 300, 1, 1])] + [("b", 0, 5)]
    parts = archives.parts(spark.createDataFrame(rows, "archive string, manifest_index long, size_bytes long"), 100)
    assert sorted((r.archive, r.manifest_index, r.part) for r in parts.collect()) == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 4), ("a", 5, 4), ("b", 0, 0)]
