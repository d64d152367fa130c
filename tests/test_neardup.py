import re
import struct
import unicodedata
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textmill.config import LSH, LshConfig, LshTable
from textmill.functions import text as tx
from textmill.operators import neardup
from textmill.plans import neardup as plans
from textmill.sources import tables

BASE = [f"word{i}" for i in range(160)]


def corpus(spark):
    changed = list(BASE)
    changed[50] = changed[90] = "other"
    texts = [" ".join(BASE), " ".join(BASE).upper() + "  ", " ".join(changed), " ".join(f"x{i}" for i in range(80)), " ".join(f"y{i}" for i in range(80)), "tiny", ""]
    rows = [(i, f"a{i % 2}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "ordinal long, archive string, text string").withColumn("normalized_hash", F.sha2(tx.normalized(F.col("text")), 256))


def test_signature_fills_empty_bins():
    table = LshTable(1, 2, bins=8, bands=2)
    got = neardup.signature(np.array([8 * 5 + 3, 8 * 4 + 3, 8 * 9 + 6], np.uint64), table)
    fill = lambda i, donor, value: xxhash.xxh3_64_intdigest(struct.pack(">HHQ", i, donor, value), seed=2)
    first = fill(0, 3, 4)
    assert got.tolist() == [first, fill(1, 3, 4), fill(2, 3, 4), 4, fill(4, 6, 9), fill(5, 6, 9), 9, fill(7, 0, first)]
    assert neardup.signature(np.empty(0, np.uint64), table).tolist() == [xxhash.xxh3_64_intdigest(struct.pack(">H", i), seed=2) for i in range(8)]


def test_bands_cover_all_tables():
    keys = neardup.band_keys([b"a b c d e"], LSH)
    assert len(keys) == 24 and len(set(keys)) == 24 and keys == neardup.band_keys([b"a b c d e"] * 3, LSH)


def test_clusters(spark):
    docs = corpus(spark).cache()
    reps = docs.join(neardup.star_edges(docs).where("ordinal = root").select("ordinal"), "ordinal", "left_semi")
    found = reps.select("ordinal", neardup.shingled(tx.words(tx.normalized(F.col("text"))), LSH).alias("s"))
    found = found.select("ordinal", F.size("s.set").alias("n"), "s.set", "s.bands").cache()
    sets, keyed = found.select("ordinal", "n", "set"), found.select("ordinal", "n", "bands")
    refined = neardup.refine(neardup.candidates(keyed, LSH), sets, LSH)
    by_prefix = neardup.shared_shingle_pairs(sets, LSH).where("accepted")
    accepted = refined.where("accepted")
    assert sorted(map(tuple, accepted.collect())) == sorted(map(tuple, by_prefix.collect())) == [(0, 2, 146, 166, True)]
    rows = neardup.clusters(docs, accepted)
    assert sorted((r.ordinal, r.root) for r in rows.collect()) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 5), (6, 6)]
    audit = neardup.audit(rows, docs).first()
    assert (audit.clusters, audit.singletons, audit.cross_archive, audit.invalid_roots, audit.split_texts) == (5, 4, 1, 0, 0)


def test_bounds_are_errors(spark):
    keyed = spark.createDataFrame([(i, 10, ["k"]) for i in range(4)], "ordinal long, n int, bands array<string>")
    assert neardup.candidates(keyed, LSH).count() == 6
    with pytest.raises(ValueError):
        neardup.candidates(keyed, LshConfig(max_posting=3))
    # six unique pairs, met in two bands each
    keyed = spark.createDataFrame([(i, 10, ["k", "l"]) for i in range(4)], "ordinal long, n int, bands array<string>")
    assert neardup.candidates(keyed, LshConfig(max_pairs=6)).count() == 6
    with pytest.raises(ValueError):
        neardup.candidates(keyed, LshConfig(max_pairs=5))


def test_queries_without_sql_agree_with_brute_force(spark, sf):
    """Bands, sketches and candidate pairs against plain loops over every document."""
    docs = {r.id: r.text for r in tables.documents(spark, sf).collect()}
    words = {i: re.findall(r"[\w']+", " ".join(unicodedata.normalize("NFKC", t).casefold().split())) for i, t in docs.items()}
    cut = lambda w: [" ".join(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else w
    sketches = {}
    for i, w in words.items():
        found = cut(w)
        found = [found[k * len(found) // 2048] for k in range(2048)] if len(found) > 2048 else found
        sketches[i] = ",".join(sorted({f"{xxhash.xxh3_64_intdigest(s):016x}" for s in found})[:16])
    assert {r.id: r.sketch for r in plans.QUERIES["bottom_k_sketch"](spark, sf).collect()} == sketches

    order = {r.id: r.ordinal for r in plans.numbered(spark, sf).select("id", "ordinal").collect()}
    first = {}
    for i in sorted(words, key=order.get):
        first.setdefault(" ".join(unicodedata.normalize("NFKC", docs[i]).casefold().split()), order[i])
    kept = {order[i]: cut(w) for i, w in words.items() if order[i] in first.values()}
    bands = {o: neardup.band_keys([s.encode() for s in w], LSH) for o, w in kept.items()}
    got = {}
    for r in plans.QUERIES["near_bands"](spark, sf).collect():
        got.setdefault(r.ordinal, {})[r.band] = r.key
    assert got == {o: dict(enumerate(keys)) for o, keys in bands.items()}

    pairs = {}
    for a, b in combinations(sorted(kept), 2):
        x, y = set(kept[a]), set(kept[b])
        if set(bands[a]) & set(bands[b]) and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
            pairs[a, b] = (len(x & y), len(x | y), not (x | y) or 5 * len(x & y) >= 4 * len(x | y))
    assert {(r.a, r.b) for r in plans.QUERIES["length_ratio_candidates"](spark, sf).collect()} == set(pairs)
    assert {(r.a, r.b): (r.inter, r.union, r.accepted) for r in plans.QUERIES["near_candidates_lsh"](spark, sf).collect()} == pairs
    assert pairs and any(p[2] for p in pairs.values())


def test_sizes_that_fit(spark):
    row = spark.range(1).select(*(neardup.fits(F.lit(a), F.lit(b), LSH).alias(f"c{i}") for i, (a, b) in enumerate([(4, 5), (5, 4), (3, 4), (0, 0)]))).first()
    assert tuple(row) == (True, True, False, True)


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (10, 10), (5, 10), (500, 1000)], "h long, n long")
    rows = df.select(*(c.alias(k) for k, c in neardup.wilson(F.col("h"), F.col("n"), 1.6448536269514722).items())).collect()
    assert tuple(rows[0]) == (0.0, 1.0) and rows[1].upper == 1.0 and 0.78 < rows[1].lower < 0.8
    assert rows[2].lower < rows[3].lower < 0.5 < rows[3].upper < rows[2].upper


def test_windows_of_words_joined_once():
    for n in range(12):
        words = [f"é{i}" * (i % 3) for i in range(n)]
        assert neardup.encoded_windows(words, 5) == [w.encode() for w in neardup.windows(words, 5)]
