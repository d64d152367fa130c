import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from textmill.config import PackConfig
from textmill.operators import pack

T4 = PackConfig(length=4)


def index(spark, docs, domain="d"):
    rows = [(i, "train", domain, list(d), len(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id long, split string, domain string, tokens array<int>, n_tokens long")
    return pack.streams(df.drop("tokens"), ["id"]).join(df.select("id", "tokens"), "id")


def plain(docs, t, eos=0):
    stream, first = [], set()
    for d in docs:
        first.add(len(stream))
        stream += [*d, eos]
    rows = max(0, (len(stream) - 1) // t)
    return [(stream[r * t : r * t + t + 1], [i == 0 or r * t + i in first for i in range(t + 1)]) for r in range(rows)]


def packed(spark, docs, config=T4):
    rows = pack.packed(index(spark, docs), config).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(len(rows)))
    return [(r.tokens, r.starts) for r in rows]


def test_three_documents(spark):
    docs = [[10, 11], [20, 21, 22], [30, 31, 32, 33]]
    rows = pack.packed(index(spark, docs), T4)
    out = pack.collated(rows, T4).orderBy("row_id").collect()
    assert len(out) == 2
    assert (out[0].input_ids, out[0].labels, out[0].position_ids, out[0].document_ids) == ([10, 11, 0, 20], [11, 0, pack.IGNORED, 21], [0, 1, 2, 0], [0, 0, 0, 1])
    assert out[0].num_loss_tokens == 3
    assert pack.supervised(rows, T4).first().supervised_tokens == sum(r.num_loss_tokens for r in out)
    assert {r.violations for r in pack.violations(rows, T4).collect()} == {0}


@pytest.mark.parametrize("lengths", [[7], [3, 4], [8], [8, 8], [1, 1, 1, 1], [0, 0, 9, 0], [40], [2]])
def test_rows_agree_with_the_formula_and_a_plain_packer(spark, lengths):
    docs = [[100 + i] * n for i, n in enumerate(lengths)]
    got = packed(spark, docs)
    assert got == plain(docs, 4)
    row = pack.available(index(spark, docs), T4).first()
    assert row.rows == len(got) and row.unstored_tokens == sum(lengths) + len(lengths) - (4 * len(got) + 1 if got else 0)


def test_random_documents(spark):
    rng = random.Random(3)
    docs = [[rng.randint(0, 50) for _ in range(rng.choice([0, 1, 3, 30]))] for _ in range(60)]
    assert packed(spark, docs, PackConfig(length=7)) == plain(docs, 7)
    gaps = pack.index_gaps(index(spark, docs)).first()
    assert gaps.gaps == 0 and pack.index_gaps(index(spark, docs).where("id <> 5")).first().gaps == 1


def test_end_tokens_in_documents_are_no_boundaries(spark):
    assert packed(spark, [[5, 0, 6, 0, 7]])[0] == ([5, 0, 6, 0, 7], [True, False, False, False, False])


def test_broken_rows_are_counted(spark):
    rows = spark.createDataFrame([("train", "d", 0, [1, 2, 3, 4, 99_999], [False, False, True, False, False])], "split string, domain string, row_id long, tokens array<int>, starts array<boolean>")
    assert {r.rule: r.violations for r in pack.violations(rows, T4).collect()} == {"row_length": 0, "first_start": 1, "vocabulary": 1, "start_after_end_token": 1, "starts_length": 0}


def test_largest_remainder():
    weights = {"a": 0.4, "b": 0.4, "c": 0.2}
    assert pack.largest_remainder(8, weights) == {"a": 3, "b": 3, "c": 2}
    big = pack.largest_remainder(12_836_914, weights)
    assert list(big.values()) == [5_134_766, 5_134_765, 2_567_383] and sum(big.values()) == 12_836_914
    assert pack.largest_remainder(0, weights) == {"a": 0, "b": 0, "c": 0}
    for total in range(60):
        rows = pack.largest_remainder(total, {"a": Fraction(1, 3), "b": 0.25, "c": 1})
        exact = pack.exact_weights({"a": Fraction(1, 3), "b": 0.25, "c": 1})
        assert sum(rows.values()) == total and all(abs(rows[d] - total * exact[d]) < 1 for d in rows)
    for bad in ({"a": -1, "b": 2}, {"a": 0}):
        with pytest.raises(ValueError):
            pack.largest_remainder(3, bad)


def test_feasible_rows():
    weights = {"a": 0.5, "b": 0.5}
    assert pack.feasible_rows({"a": 10, "b": 4}, weights) == 9 and pack.feasible_rows({"a": 10, "b": 4}, weights, quantum=4) == 8
    assert pack.feasible_rows({"a": 10, "b": 40}, weights, cap=6) == 6 and pack.feasible_rows({"a": 10}, weights) in (0, 1)


def test_order(spark):
    rows = spark.createDataFrame([(d, i) for d in "ab" for i in range(50)], "domain string, row_id long")
    counts = {"a": 30, "b": 7}
    order = pack.training_order(rows, counts, "s").cache()
    assert [r.position for r in order.orderBy("position").collect()] == list(range(37))
    assert all(r.valid for r in pack.order_report(order, counts).collect())
    assert not all(r.valid for r in pack.order_report(order.where("position > 0"), counts).collect())
    assert sorted(order.collect()) == sorted(pack.training_order(rows.repartition(5), counts, "s").collect())
    batches = pack.microbatches(order, 2, 4).collect()
    assert len(batches) == 32 and {(r.batch, r.rank, r.slot) for r in batches} == {(b, k, s) for b in range(4) for k in range(2) for s in range(4)}


def test_references(spark):
    refs = spark.createDataFrame([(0, 5), (2, (1 << 56) - 1)], "d int, r long").select("d", "r", pack.reference(F.col("d"), F.col("r")).alias("x"))
    d, r = pack.unreferenced(F.col("x"))
    assert all((x.d, x.r) == (x.d2, x.r2) for x in refs.select("d", "r", d.alias("d2"), r.alias("r2")).collect())
