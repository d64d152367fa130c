"""Near duplicates by SimHash, then by exact Jaccard similarity of word shingles, `WIDTH` words and `JACCARD` or more.

First SimHash: the operator's fingerprints of the shingles, its blocks, Hamming distance and components make classes of
texts, and each is held against one of its class. A fingerprint of 64 bits can't bound the similarity, though: at 0.8
about ten bits differ, with a wide spread, so any Hamming bound short of nearly all pairs loses some. What lies beyond
the operator's bound is found by prefixes: in any fixed order of all shingles, two
sets at similarity t share one among the first n - ceil(t n) + 1 of either, and the first that they share leaves enough
behind it. The order is by hash with the shingles of crowded prefixes last, so chance meetings are few.

Sets that meet at a shingle are not all paired up. First each is held against the one of them with the fewest rare
shingles, which joins a group of near copies whatever its size by about as many pairs as it has members; then pairs are made only of sets that those links
leave in different components. Every pair at the threshold is so found or joined already: components are exact.

Candidates are dismissed where they meet if the parities of their shingles in `PARITIES` classes differ too often: that
Hamming distance is at most what the sets differ in, so it loses none. Of the rest, a
candidate passes if two sketches of counts allow the similarity, and then its whole sets are compared, which are made
anew from the texts of those that need it; neither texts nor sets of all documents travel. Equal sets stand for all
their documents, so copies cost nothing.

Defined cases: texts without words are equal, and so are texts of one set of shingles; fewer words than a shingle make
one shingle of them all. Sets are told apart by a hash of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import cut, release, small_batches
from textmill.llm.simhash import components, fingerprint_of, near_edges, shingle_hashes

WIDTH = 5
#: Numerator and denominator of the least similarity.
JACCARD = (4, 5)
#: A shingle in more prefixes than this comes last in the order; so many at most do, which only costs time.
CROWDED = 32
MOST_CROWDED = 1_000_000
#: Ids of sets that candidates need: so many are broadcast, more are joined by shuffle.
BROADCAST_SETS = 1_000_000
#: Counts of a sketch, each of a byte; a set with more in one of them has no sketch and passes.
COUNTS = 128
#: Parities of a set, eight longs.
PARITIES = 512


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes as signed integers, ascending."""
    return np.unique(shingle_hashes(text, width).view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))


def shingle_sets(text: Column, width: int = WIDTH) -> Column:
    """Distinct shingle hashes (array<long>) of a text column, ascending."""

    @F.arrow_udf("array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield _lists([shingle_set(t.as_py(), width) for t in texts])
        finally:
            release()

    return of(text)


def prefix(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first of a set's shingles that a similar one must share one of; those of `last` (ascending) come after all others."""
    t, d = JACCARD
    if len(last) and len(s):
        late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
        s = np.concatenate([s[~late], s[late]])
    return s[: len(s) - -(-t * len(s) // d) + 1]


def sketch(s: np.ndarray) -> bytes:
    """How many shingles fall into each of `COUNTS` classes; empty if a byte doesn't hold a count."""
    counts = np.bincount((s % COUNTS).astype(np.int64), minlength=COUNTS)
    return counts.astype(np.uint8).tobytes() if len(s) and counts.max() < 256 else b""


def parities(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls into each of `PARITIES` classes, as longs; other classes than a sketch's."""
    odd = np.bincount(((s >> 7) % PARITIES).astype(np.int64), minlength=PARITIES) % 2 == 1
    return np.packbits(odd).view(np.int64)


def near_enough(a: str, b: str) -> Column:
    """Whether the parities allow the similarity: a class of unlike parity holds a shingle of one set alone."""
    t, d = JACCARD
    unlike = sum(F.bit_count(F.get(f"{a}q", F.lit(i)).bitwiseXOR(F.get(f"{b}q", F.lit(i)))) for i in range(PARITIES // 64))
    return unlike.cast("long") * (t + d) <= (F.col(f"{a}n") + F.col(f"{b}n")).cast("long") * (d - t)


def _described(text: Column, last, width: int) -> Column:
    """Struct set_id, n, p (prefix), sketch, q (parities) and fp (fingerprint) of a text column; `last` is a broadcast array."""

    @F.arrow_udf("set_id long, n int, p array<long>, sketch binary, q array<long>, fp long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                ids, sizes, heads, sketches, odd, prints = [], [], [], [], [], []
                for t in texts:
                    hashes = shingle_hashes(t.as_py(), width)
                    s = np.unique(hashes.view(np.int64))
                    ids.append(xxhash.xxh64_intdigest(s.tobytes(), 42))
                    sizes.append(len(s))
                    heads.append(prefix(s, last.value))
                    sketches.append(sketch(s))
                    odd.append(parities(s))
                    prints.append(fingerprint_of(hashes))
                columns = [pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), _lists(heads), pa.array(sketches, pa.binary())]
                columns += [_lists(odd), pa.array(prints, pa.int64())]
                yield pa.StructArray.from_arrays(columns, names=["set_id", "n", "p", "sketch", "q", "fp"])
        finally:
            release()

    return of(text)


def _heads(text: Column, width: int) -> Column:
    """Prefixes (array<long>) in the order of hashes alone."""

    @F.arrow_udf("array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        none = np.empty(0, np.int64)
        try:
            for texts in batches:
                yield _lists([prefix(shingle_set(t.as_py(), width), none) for t in texts])
        finally:
            release()

    return of(text)


def most_shared(u: Column, v: Column, un: Column, vn: Column) -> Column:
    """A bound (long) for the size of the intersection of two sets, from their sketches, or else from their sizes."""

    @F.arrow_udf("long")
    def of(a: pa.Array, b: pa.Array, m: pa.Array, n: pa.Array) -> pa.Array:
        bound = np.minimum(np.asarray(m), np.asarray(n)).astype(np.int64)
        known = np.flatnonzero([len(x.as_buffer()) == COUNTS and len(y.as_buffer()) == COUNTS for x, y in zip(a, b)])
        if len(known):
            some = pa.array(known)
            x, y = (np.frombuffer(b"".join(c.take(some).to_pylist()), np.uint8).reshape(-1, COUNTS) for c in (a, b))
            bound[known] = np.minimum(x, y).sum(1, dtype=np.int64)
        return pa.array(bound)

    return of(u, v, un, vn)


def _enough(shared: Column, un: Column, vn: Column) -> Column:
    """Whether an intersection of this size is enough for sets of these sizes."""
    t, d = JACCARD
    return shared.cast("long") * (t + d) >= (un + vn).cast("long") * t


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (u, v) at the threshold; `sets` has set_id, text_key, n, sketch, `texts` text_key and text; both may repeat."""
    small = sets.groupBy("set_id").agg(F.first(F.struct("n", "sketch")).alias("f"))
    side = lambda x: small.select(F.col("set_id").alias(x), F.col("f.n").alias(f"{x}n"), F.col("f.sketch").alias(f"{x}s"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    able = both.withColumn("most", most_shared(F.col("us"), F.col("vs"), F.col("un"), F.col("vn"))).where(_enough(F.col("most"), F.col("un"), F.col("vn")))
    able = cut(able.select("u", "v"))
    needed = able.select(F.col("u").alias("set_id")).unionByName(able.select(F.col("v").alias("set_id"))).distinct()
    # one text of each set, whichever: the set made of it is the same
    keys = cut(sets.join(needed, "set_id", "left_semi").groupBy("set_id").agg(F.min("text_key").alias("text_key")))
    if keys.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS:
        keys = F.broadcast(keys)
    some = texts.join(keys, "text_key").select("set_id", shingle_sets(F.col("text"), width).alias("set"))
    whole = cut(some.dropDuplicates(["set_id"]))
    side = lambda x: whole.select(F.col("set_id").alias(x), F.col("set").alias(f"{x}s"))
    both = able.join(side("u"), "u").join(side("v"), "v")
    return both.where(_enough(F.size(F.array_intersect("us", "vs")), F.size("us"), F.size("vs"))).select("u", "v")


def _able(a: str, b: str) -> Column:
    """Whether what the first shared shingle leaves of either set is enough."""
    left = F.least(F.col(f"{a}n") - F.col(f"{a}i"), F.col(f"{b}n") - F.col(f"{b}i"))
    return _enough(left, F.col(f"{a}n"), F.col(f"{b}n"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def simhash_pairs(one: DataFrame) -> DataFrame:
    """Candidates (u, v) of SimHash: each set with one of its class, the least; `one` has set_id, n, q, fp.

    Classes are the components of the fingerprints within the operator's Hamming distance.
    """
    linked = components(near_edges(one.select("fp").distinct()))
    rooted = one.join(linked, F.col("fp") == F.col("node"), "left").select("set_id", "n", "q", F.coalesce("root", "fp").alias("root"))
    least = F.min(F.struct("set_id", "n", "q")).alias("c")
    hubs = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("m"), least).where("m > 1")
    hubs = hubs.select("root", F.col("c.set_id").alias("u"), F.col("c.n").alias("un"), F.col("c.q").alias("uq"))
    rest = rooted.select("root", *(F.col(c).alias(x) for c, x in (("set_id", "v"), ("n", "vn"), ("q", "vq"))))
    return hubs.join(rest, "root").where((F.col("u") != F.col("v")) & near_enough("u", "v")).select(*_ordered("u", "v"))


def similar_components(sets: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, root) of the sets that a chain of pairs at the threshold links; `sets` has set_id, text_key, n, p, sketch, q, fp."""
    sets = sets.where("n > 0")
    one = sets.groupBy("set_id").agg(F.first(F.struct("n", "p", "q", "fp")).alias("f")).select("set_id", "f.*")
    points = cut(one.select("set_id", "n", "q", "fp"))
    # dealt once by shingle, for the counts and for the join with them
    rows = one.select("set_id", "n", F.posexplode("p").alias("i", "s")).repartition("s")
    # the one with the fewest rare shingles before it: of near copies the text that the others were changed from, if it is there
    met = rows.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("i", "set_id", "n")).alias("first")).where("m > 1")
    # only shingles where sets meet are kept, a small part
    meeting = cut(rows.join(met.select("s", "first"), "s"))
    stars = meeting.where("set_id != first.set_id").select(
        *(F.col(f"first.{c}").alias(x) for c, x in (("set_id", "u"), ("n", "un"), ("i", "ui"))), F.col("set_id").alias("v"), F.col("n").alias("vn"), F.col("i").alias("vi")
    )
    pairs = simhash_pairs(points).unionByName(stars.where(_able("u", "v")).select(*_ordered("u", "v"))).distinct()
    edges = cut(_verified(pairs, sets, texts, width))
    rooted = components(edges).withColumnRenamed("node", "set_id")

    placed = meeting.drop("first").join(rooted, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    mixed = placed.groupBy("s").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("s")
    rest = cut(placed.join(mixed, "s", "left_semi").join(points.select("set_id", "q"), "set_id"))
    a, b = (rest.select("s", F.col("set_id").alias(x), F.col("n").alias(f"{x}n"), F.col("i").alias(f"{x}i"), F.col("q").alias(f"{x}q"), F.col("root").alias(f"{x}r")) for x in "uv")
    apart = (F.col("u") < F.col("v")) & (F.col("ur") != F.col("vr"))
    pairs = a.join(b, "s").where(apart & _able("u", "v") & near_enough("u", "v")).select("u", "v").distinct()
    return components(edges.unionByName(_verified(pairs, sets, texts, width)))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, text_key and root of every document; documents of one root are linked by near duplicates."""
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    crowded = docs.select(F.explode(_heads(text, width)).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CROWDED)
    # stored first, so that the counts' shuffle files, of every prefix, go before the next step
    last = cut(crowded.orderBy(F.desc("m"), "s").limit(MOST_CROWDED).select("s")).toArrow()["s"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(last))
    made = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), _described(text, shared, width).alias("d"))
    marked = cut(made.select("doc_id", "text_key", "d.*"))
    texts = docs.select(F.xxhash64(text).alias("text_key"), text.alias("text"))
    rooted = similar_components(marked.drop("doc_id"), texts, width)
    ids = marked.select("doc_id", "text_key", "set_id")
    return ids.join(rooted, F.col("set_id") == F.col("node"), "left").select("doc_id", "text_key", F.coalesce("root", "set_id").alias("root"))
