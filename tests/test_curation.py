import pytest
from pyspark.sql import functions as F

from textmill.config import QUALITY
from textmill.operators import curate, dq, publish, quality

FP = "id long, key string, bucket string, archive string, words long, content_hash string, final_cluster string, penalty long, flags array<string>, selection_rank string"


@pytest.fixture(scope="module")
def fp(spark):
    rows = [
        (1, "k1", "en", "a", 10, "c1", "f1", 4, ["very_long_line"], "r3"),
        (2, "k2", "en", "a", 10, "c1", "f1", 0, [], "r1"),
        (3, "k0", "py", "b", 20, "c2", "f1", 0, [], "r2"),
        (4, "k4", "en", "b", 5, "c3", "f2", 0, ["too_short"], "r4"),
        (5, "k5", "en", "b", 5, "c3", "f2", 8, [], "r5"),
        (6, "k6", "en", "c", 7, "c4", "f3", 0, [], "r6"),
        (7, "k7", "en", "c", 7, "c5", "f3", 0, [], "r7"),
        (8, "k8", "en", "c", 9, "c6", "f4", 0, [], "r0"),
    ]
    return spark.createDataFrame(rows, FP).cache()


@pytest.fixture(scope="module")
def steps(spark, fp):
    guard = spark.createDataFrame([(6, "mbpp-marker")], "id long, reason string")
    first = curate.first_reasons(fp, guard, QUALITY)
    reasons = first.unionByName(curate.propagated(fp, first))
    clean = curate.reason_free(fp, reasons)
    exact = curate.exact_choice(clean)
    final = curate.final_choice(exact)
    all_ = reasons.unionByName(curate.residual(clean, exact, final, ("py",)))
    return reasons, clean, exact, final, all_


def listed(df):
    return sorted(tuple(r) for r in df.collect())


def test_contamination_reaches_the_whole_cluster(steps):
    assert listed(steps[0]) == [(4, "quality:too_short"), (6, "benchmark:mbpp-marker"), (6, curate.PROPAGATED), (7, curate.PROPAGATED)]


def test_choices(steps):
    _, clean, exact, final, _ = steps
    assert {r.content_hash: r.canonical_id for r in exact.collect()} == {"c1": 2, "c2": 3, "c3": 5, "c6": 8}
    assert {r.final_cluster: r.canonical_id for r in final.collect()} == {"f1": 3, "f2": 5, "f4": 8}
    assert listed(curate.canonical_map(clean, exact, final)) == [(1, 3), (2, 3), (3, 3), (5, 5), (8, 8)]


def test_residual_reasons_and_self_check(fp, steps):
    _, clean, exact, final, reasons = steps
    assert listed(curate.residual(clean, exact, final, ("py",))) == [(1, curate.EXACT), (2, curate.NEAR)]
    assert {r.violations for r in curate.self_check(fp, reasons, curate.canonical_map(clean, exact, final)).collect()} == {0}
    broken = {r.check: r.violations for r in curate.self_check(fp, reasons.where("id <> 2"), curate.canonical_map(clean, exact, final)).collect()}
    assert broken["eligible_share_cluster"] == 1 and broken["eligible_not_canonical"] == 1


def candidates(spark):
    rows = [(i, "train" if i % 3 else "test", "en", f"r{i:02d}", f"k{i}", 3) for i in range(12)]
    return spark.createDataFrame(rows, "id long, split string, category string, selection_rank string, key string, words long")


def test_quota_prefix_cuts_the_last_document(spark):
    quotas = spark.createDataFrame([("train", "en", 8), ("test", "en", 6)], "split string, category string, target long")
    got = listed(curate.quota_prefix(candidates(spark), quotas).select("split", "id", "selected_tokens"))
    assert got == [("test", 0, 3), ("test", 3, 3), ("train", 1, 3), ("train", 2, 3), ("train", 4, 2)]


def test_short_supply_is_an_error(spark):
    for split, target in (("train", 25), ("nowhere", 1)):
        with pytest.raises(ValueError):
            curate.quota_prefix(candidates(spark), spark.createDataFrame([(split, "en", target)], "split string, category string, target long"))


def test_decisions(spark, fp, steps):
    _, clean, exact, final, reasons = steps
    eligible = curate.reason_free(fp, reasons).withColumn("split", F.lit("train"))
    selected = spark.createDataFrame([(3, 20)], "id long, selected_tokens long")
    got = {r.id: (r.decision, r.reasons) for r in curate.decisions(fp, reasons, curate.canonical_map(clean, exact, final), eligible, selected).collect()}
    assert got[3] == ("keep", "") and got[8] == ("reject", curate.OVERFLOW) and got[4] == ("reject", "quality:too_short")
    assert got[6] == ("reject", f"benchmark:mbpp-marker,{curate.PROPAGATED}")


def test_audits(spark, fp, steps):
    reasons = steps[-1]
    eligible = curate.reason_free(fp, reasons)
    rows = publish.reconciliation(publish.raw_totals(fp), publish.raw_totals(eligible), publish.rejected_totals(fp, reasons)).collect()
    assert all(r.reconciled for r in rows)
    short = publish.reconciliation(publish.raw_totals(fp), publish.raw_totals(eligible), publish.rejected_totals(fp, reasons.where("id <> 4"))).collect()
    assert not all(r.reconciled for r in short)
    orphan = publish.reason_totals(fp, reasons.unionByName(spark.createDataFrame([(99, "x")], "id long, reason string")))
    assert {r.reason: r.orphans for r in orphan.collect()}["x"] == 1
    leaky = spark.createDataFrame([("g", "train"), ("g", "test"), ("h", "train")], "source_group string, split string")
    assert listed(publish.leakage(leaky, ("source_group",)).select("values", "leaking", "repeated")) == [(2, 1, 1)]
    assert listed(publish.split_masks(leaky, "source_group")) == [("g", 5, True), ("h", 1, False)]


def test_keep_bits(spark):
    rows = spark.createDataFrame([("a", i, i) for i in range(40_000)] + [("b", 0, 50_000)], "archive string, manifest_index long, id long")
    keep = [0, 9, 32_767, 32_768, 39_999]
    got = {r.archive: r for r in publish.keep_bits(rows, spark.createDataFrame([(i,) for i in keep], "id long")).collect()}
    bits = bytearray(5000)
    for i in keep:
        bits[i // 8] |= 1 << i % 8
    assert got["a"].bits == bits.hex() and (got["a"].documents, got["a"].kept) == (40_000, 5)
    assert got["b"].bits == "00" and got["b"].kept == 0


def test_assertions(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert {r.side: r.rows for r in dq.differences(a, a.distinct()).collect()} == {"only_left": 1, "only_right": 0}
    with pytest.raises(ValueError):
        dq.assert_empty(a, "rows")
    dq.assert_empty(a.limit(0), "rows")


def test_broken_inventory(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2), ("c", 1)], "archive string, manifest_index long")
    assert {r.archive: r.contiguous for r in quality.contiguity(rows).collect()} == {"a": True, "b": False, "c": False}
