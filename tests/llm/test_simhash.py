import random
from collections import Counter
from itertools import combinations

import xxhash

from textmill.llm import simhash
from textmill.llm.common import read


def plain_fingerprint(text):
    words = simhash_words(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    bits = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def simhash_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w]


def plain_classes(items):
    """items: (doc_id, fingerprint) -> component by union of all linked pairs."""
    root = {f: f for _, f in items}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(root, 2):
        if bin(a ^ b).count("1") <= 2:
            root[find(a)] = find(b)
    least = {}
    for i, f in items:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted(((i if i is not None else -1), f, least.get(find(f))) for i, f in items)


def test_query_agrees_with_brute_force(spark, sf_mid):
    from textmill.llm.queries import QUERIES

    docs = [(r.doc_id, plain_fingerprint(r.text)) for r in read(spark, sf_mid, "documents").collect()]
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in QUERIES["op5_simhash"](spark, sf_mid).collect())
    assert got == plain_classes(docs)


def near(rng, n, around, spread):
    out = set(around)
    while len(out) < n:
        f = rng.choice(list(around))
        for _ in range(rng.randint(0, spread)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return out


def test_edges_of_crowded_blocks(spark):
    """Hundreds of fingerprints that share most bits are dealt again until the last level; no pair is lost."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    crowd = near(rng, 700, base, 5)
    crowd |= {base[0] ^ (x << 3) for x in range(256)}  # one bucket at every level
    signed = [f - (1 << 64) if f >> 63 else f for f in crowd]
    fps = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {(r.u, r.v) for r in simhash.near_edges(fps).collect()}
    want = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(8)
    nodes = rng.sample(range(-(10**6), 10**6), 400)
    pairs = list(zip(nodes[:150], nodes[1:150])) + [(nodes[200], x) for x in nodes[201:300]] + [(nodes[350], nodes[351])]
    edges = spark.createDataFrame([(min(p), max(p)) for p in pairs], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = {x: min(nodes[:150]) for x in nodes[:150]} | {x: min(nodes[200:300]) for x in nodes[200:300]}
    assert got == want | {x: min(nodes[350:352]) for x in nodes[350:352]}


def test_edges(edge_docs, no_docs):
    got = sorted((r.doc_id if r.doc_id is not None else -1, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(edge_docs).collect())
    assert got == plain_classes([(r.doc_id, plain_fingerprint(r.text)) for r in edge_docs.collect()])
    assert [c for i, f, c in got if f == 0] == [2, 2, 2]
    assert simhash.near_duplicates(no_docs).collect() == []


def test_only_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(df).collect()] == [None]


def test_long_text_fingerprint():
    rng = random.Random(1)
    for n in (1, 2, 3, 4, 255, 257, 258, 2000):
        text = "\x0b".join(rng.choice(["Abc", "dé", "ÉF", "\u00a0x", "y\x1cz"]) for _ in range(n))
        assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)
