"""SimHash near-duplicates: pigeonhole blocks find the pairs, Hamming distance verifies them.

A fingerprint has 64 bits; two documents link when theirs differ in at most two. Split into four blocks of 16 bits,
such a pair agrees in two blocks at least, so fingerprints are joined on each of the six pairs of blocks and the
pairs so found are verified. Distinct fingerprints stand for all their documents, so copies cost nothing. A bucket
that holds more than `SMALL` distinct fingerprints isn't paired up: by the same argument its members are dealt again
on the 32 bits they do not yet share, in blocks of eight, and then on the last 16 in blocks of four, after which a
bucket has 256 distinct fingerprints at most. No pair is lost and no bucket gives more than 256 * 256 / 2 pairs.

Defined cases: a null or wordless text has fingerprint zero and links like any other; fewer words than a shingle
make one shingle of them all; rows that repeat a doc_id each stay; null ids take the class of their fingerprint and
never name one unless it has no other; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import cut, small_batches

WIDTH = 3
DISTANCE = 2
BLOCKS = 4
SMALL = 64
SEED = 42
#: Documents that go are rows of 16 bytes; so many are broadcast, and no text is shuffled; more are joined by shuffle.
BROADCAST_GONE = 1_000_000


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of every word shingle of a text, A-Z lower-cased, words being runs without ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - width or None].tolist()
    found = (digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist()))
    return np.fromiter(found, np.uint64, len(starts))


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 bits, each set if it is set in over half of the shingle hashes; as a signed integer."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of a text by its shingle hashes, repeats included."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 255):  # so many fit the sums of 8 bits
        part = hashes[start : start + 255].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(text: Column, width: int = WIDTH) -> Column:
    """Fingerprint column (long) of a text column."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint(t.as_py(), width) for t in texts), pa.int64())

    return of(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _pairs_of_blocks(bits: list[int]) -> list[list[int]]:
    """The bits cut into BLOCKS runs, and those of each choice of BLOCKS - DISTANCE runs."""
    n = len(bits) // BLOCKS
    runs = [bits[i * n : (i + 1) * n] for i in range(BLOCKS)]
    return [sum(some, []) for some in combinations(runs, BLOCKS - DISTANCE)]


def block_masks(levels: int = 3) -> list[list[list[int]]]:
    """For each level, the masks that the members of a parent mask are dealt on; the index of a mask is its id."""
    parents, out = [list(range(64))], []
    fixed = [[]]
    for _ in range(levels):
        children = [[have + more for more in _pairs_of_blocks(rest)] for have, rest in zip(fixed, parents)]
        out.append([[_signed(sum(1 << b for b in bits)) for bits in group] for group in children])
        fixed = [bits for group in children for bits in group]
        parents = [[b for b in range(64) if b not in set(bits)] for bits in fixed]
    return out


def _dealt(members: DataFrame, masks: list[list[int]]) -> DataFrame:
    """(mask, key, fp) on each child mask of the members (mask, fp)."""
    table = F.array(*(F.array(*(F.lit(m) for m in group)) for group in masks))
    child = F.posexplode(F.element_at(table, (F.col("mask") + 1).cast("int")))
    n = len(masks[0])
    return members.select("mask", "fp", child.alias("i", "m")).select(
        (F.col("mask") * n + F.col("i")).cast("int").alias("mask"), F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp"
    )


def near_edges(fps: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints (column fp) that differ in at most DISTANCE bits."""
    found = None
    members, masks = fps.select(F.lit(0).alias("mask"), "fp"), block_masks()
    for level, of_level in enumerate(masks):
        dealt = _dealt(members, of_level)
        sizes = dealt.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        last = level == len(masks) - 1
        if not last:
            sizes = cut(sizes)
        kept = dealt.join(sizes if last else sizes.where(F.col("n") <= SMALL), ["mask", "key"]).select("mask", "key", "fp")
        a, b = kept.withColumnRenamed("fp", "u"), kept.withColumnRenamed("fp", "v")
        near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)
        pairs = a.join(b, ["mask", "key"]).where(near).select("u", "v")
        found = pairs if found is None else found.unionByName(pairs)
        if last or sizes.where(F.col("n") > SMALL).isEmpty():
            break
        members = cut(dealt.join(sizes.where(F.col("n") > SMALL), ["mask", "key"]).select("mask", "fp"))
    return found.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (u, v); the root is the least node of its component.

    Alternating large-star and small-star steps: each node's neighbours are hung under the least of them, till
    nothing changes. Rows never outnumber the edges and the nodes; each round is written to the shared folder.
    """
    edges = cut(edges)
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # small star: each node with its smaller neighbours
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        hung = small.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(least.select(F.col("m").alias("u"), "v"))
        edges = cut(hung.where("u < v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, fp (long), fingerprint (16 hex digits) and component_id (least doc_id reachable) of every document.

    text_key is a hash of the text, which with the id names a row unless the row is repeated.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    marked = cut(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), fingerprints(text, width).alias("fp")))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = fps.join(components(near_edges(fps)), F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = cut(rooted)
    classes = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id", "text_key", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "root", "component_id"
    )


def one_of_each(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with one row left of each class of near duplicates: the one of least id."""
    return least_of_each(docs, near_duplicates(docs, width, id_col, text_col), id_col, text_col)


def least_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with the row of least id left of each class in `found` (doc_id, text_key, root)."""
    # a null id comes after all others
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_key").alias("t"))).alias("f")
    stay = found.groupBy("root").agg(first).select("root", F.col("f.i").alias("i"), F.col("f.t").alias("t"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("t")))
    gone = cut(found.join(stay, "root").where(other).select(F.col("doc_id").alias("i"), F.col("text_key").alias("t")).distinct())
    if gone.limit(BROADCAST_GONE + 1).count() <= BROADCAST_GONE:
        gone = F.broadcast(gone)
    # the documents travel in a struct, so their columns may have any name
    rows = docs.select(F.struct("*").alias("d"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("key"))
    kept = rows.join(gone, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("t")), "left_anti")
    unique = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return (kept if unique else kept.dropDuplicates(["id", "key"])).select("d.*")
