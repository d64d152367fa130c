import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textmill.config import SPLIT, SplitPolicy
from textmill.functions import identity
from textmill.functions.graph import components
from textmill.functions.prefix import ordinal, running


def test_digests(spark):
    row = spark.createDataFrame([("src", 7, "ab" * 32)], "s string, i long, h string").select(
        identity.document_key(F.col("s"), F.col("i")).alias("key"), identity.named_digest("ns", F.col("s")).alias("d"), identity.named_hash("ns", F.col("h")).alias("h")
    ).first()
    assert row.key == hashlib.sha256(b"src\x007").hexdigest()
    assert row.d == hashlib.sha256(b"ns\0src").hexdigest()
    assert row.h == hashlib.sha256(b"ns\0" + bytes.fromhex("ab" * 32)).hexdigest()


def test_splits(spark):
    policy = SplitPolicy(shares=(("test", 1), ("validation", 1), ("train", 2)))
    groups = [hashlib.sha256(bytes([i])).hexdigest() for i in range(200)]
    rows = spark.createDataFrame([(g,) for g in groups], "g string").select("g", identity.split_of(F.col("g"), policy).alias("s")).collect()
    for r in rows:
        value = int.from_bytes(hashlib.sha256(f"split:{policy.seed}\0".encode() + bytes.fromhex(r.g)).digest()[:8], "big")
        assert r.s == next(name for name, end in policy.thresholds() if value < end)
    assert {r.s for r in rows} == {"test", "validation", "train"} and SPLIT.thresholds()[-1] == ("train", 1 << 64)


@pytest.mark.parametrize("partitions", ["1", "3", "13"])
def test_running_sums(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = random.Random(2)
        rows = [(i, rng.choice(["hot"] * 6 + ["b", None]), rng.randint(0, 9)) for i in range(500)]
        df = spark.createDataFrame(rows, "i long, g string, v long")
        got = {r.i: r.s for r in running(df, ["g"], ["i"], {"s": F.col("v")}).collect()}
        sums = {}
        for i, g, v in rows:
            assert got[i] == sums.get(g, 0)
            sums[g] = sums.get(g, 0) + v
        assert sorted(r.n for r in ordinal(df, ["i"], "n").collect()) == list(range(500))
        assert running(df.limit(0), ["g"], ["i"], {"s": F.col("v")}).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
