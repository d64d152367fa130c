"""Near duplicates: one-permutation MinHash bands find candidates, whole shingle sets verify them.

Only one document of each normalized text enters; copies hang on it by star edges. Candidates are pairs that share a
band and whose set sizes allow the threshold; each is verified by exact Jaccard over all shingles.
"""

from __future__ import annotations

import struct
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.config import LshConfig, LshTable
from textmill.functions.graph import components
from textmill.storage import cut

PREFIX = "english-near-v1-"


def signature(hashes: np.ndarray, table: LshTable) -> np.ndarray:
    """Least rank in each bin; an empty bin takes a digest of itself, the next filled bin and that one's value."""
    bins, digest = table.bins, xxhash.xxh3_64_intdigest
    if not len(hashes):
        return np.array([digest(struct.pack(">H", i), seed=table.densify_seed) for i in range(bins)], np.uint64)
    out, full = np.full(bins, np.iinfo(np.uint64).max, np.uint64), np.zeros(bins, bool)
    rank, at = np.divmod(hashes, np.uint64(bins))
    np.minimum.at(out, at := at.astype(np.int64), rank)
    full[at] = True
    filled, values = np.flatnonzero(full), out.copy()
    for i in np.flatnonzero(~full):
        # filling goes upwards, so a bin that wraps around may take one that was filled just before
        later = filled[filled > i]
        donor = int(later[0]) if len(later) else 0
        value = int(values[donor])
        values[i] = digest(struct.pack(">HHQ", int(i), donor, value), seed=table.densify_seed)
    return values


def band_keys(shingles: list[bytes], config: LshConfig) -> list[str]:
    """Hex key of each band of all tables."""
    out = []
    for t, table in enumerate(config.tables):
        hashes = np.array([xxhash.xxh3_64_intdigest(s, table.hash_seed) for s in shingles], np.uint64)
        rows = signature(hashes, table).astype(">u8").reshape(table.bands, table.rows)
        for band, values in enumerate(rows):
            seed = (config.key_seed + len(out)) % (1 << 64)
            out.append(xxhash.xxh3_64_hexdigest(struct.pack(">HH", t, band) + values.tobytes(), seed=seed))
    return out


def windows(words: list[str], width: int) -> list[str]:
    """Runs of `width` words; the words themselves if there are fewer."""
    return [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else words


def encoded_windows(words: list[str], width: int) -> list[bytes]:
    """`windows` in UTF-8, cut out of the words joined once."""
    if len(words) < width:
        return [w.encode() for w in words]
    parts = [w.encode() for w in words]
    ends = list(accumulate(len(p) + 1 for p in parts))
    joined = b" ".join(parts)
    return [joined[a : b - 1] for a, b in zip([0, *ends], ends[width - 1 :])]


def bands(words: Column, config: LshConfig) -> Column:
    """Band keys (array<string>) of a column of the words of normal forms, by Arrow batches."""

    @F.arrow_udf("array<string>")
    def of(rows: pa.Array) -> pa.Array:
        keys = (band_keys(encoded_windows(r.as_py(), config.width), config) for r in rows)
        return pa.array(keys, pa.list_(pa.string()))

    return of(words)


def shingled(words: Column, config: LshConfig) -> Column:
    """Struct set (distinct shingle digests, array<long>, ascending) and bands of a column of words, in one pass."""

    @F.arrow_udf("set array<long>, bands array<string>")
    def of(rows: pa.Array) -> pa.Array:
        sets, keys = [], []
        for r in rows:
            found = encoded_windows(r.as_py(), config.width)
            digests = np.array([xxhash.xxh64_intdigest(s, config.shingle_seed) for s in found], np.uint64)
            sets.append(np.unique(digests.view(np.int64)))
            keys.append(band_keys(found, config))
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(keys, pa.list_(pa.string()))], names=["set", "bands"])

    return of(words)


def sketch(words: Column, width: int, most: int = 2048, k: int = 16) -> Column:
    """The k least distinct XXH3 digests, as hex, of up to `most` evenly chosen windows of words."""

    @F.arrow_udf("array<string>")
    def of(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows:
            found = windows(r.as_py(), width)
            if len(found) > most:
                found = [found[i * len(found) // most] for i in range(most)]
            out.append(sorted({xxhash.xxh3_64_hexdigest(s.encode()) for s in found})[:k])
        return pa.array(out, pa.list_(pa.string()))

    return of(words)


def star_edges(docs: DataFrame) -> DataFrame:
    """(ordinal, root, members): the least ordinal of each normalized hash, and how many share it.

    `docs` has ordinal and normalized_hash. An aggregate and a join, so a hash of very many copies is no single window.
    """
    least = docs.groupBy("normalized_hash").agg(F.min("ordinal").alias("root"), F.count(F.lit(1)).alias("members"))
    return docs.select("ordinal", "normalized_hash").join(least, "normalized_hash").select("ordinal", "root", "members")


def fits(a: Column, b: Column, config: LshConfig) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return F.least(a, b).cast("long") * config.jaccard.denominator >= F.greatest(a, b).cast("long") * config.jaccard.numerator


def candidates(keyed: DataFrame, config: LshConfig) -> DataFrame:
    """Distinct pairs (a, b), a < b, that share a band and fit by size; `keyed` has ordinal, n and bands.

    Postings or pairs beyond the bounds are an error: nothing is cut short.
    """
    postings = keyed.select("ordinal", "n", F.posexplode("bands").alias("band", "key"))
    sizes = postings.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    top = sizes.agg(F.max("m").alias("m"), F.sum(F.expr("m * (m - 1) / 2")).alias("pairs")).first()
    # every unique pair is met once at least, and in every band at most: only beyond that has it to be counted
    most = len(config.tables) * config.tables[0].bands
    if top.m and (top.m > config.max_posting or top.pairs > config.max_pairs * most):
        raise ValueError(f"a posting of {top.m} documents, or over {(top.pairs or 0) // most} pairs, is beyond the bounds")
    shared = postings.join(sizes.select("band", "key"), ["band", "key"], "left_semi")
    a = shared.select("band", "key", F.col("ordinal").alias("a"), F.col("n").alias("an"))
    b = shared.select("band", "key", F.col("ordinal").alias("b"), F.col("n").alias("bn"))
    pairs = a.join(b, ["band", "key"]).where((F.col("a") < F.col("b")) & fits(F.col("an"), F.col("bn"), config)).select("a", "b").distinct()
    if not top.pairs or top.pairs <= config.max_pairs:
        return pairs
    pairs = cut(pairs)
    if (unique := pairs.count()) > config.max_pairs:
        raise ValueError(f"{unique} pairs are beyond the bound of {config.max_pairs}")
    return pairs


def refine(pairs: DataFrame, sets: DataFrame, config: LshConfig) -> DataFrame:
    """Pairs with intersection, union and whether they reach the threshold, in whole numbers; no sets at all do."""
    used = sets.join(pairs.select(F.col("a").alias("ordinal")).unionByName(pairs.select(F.col("b").alias("ordinal"))).distinct(), "ordinal", "left_semi")
    side = lambda x: used.select(F.col("ordinal").alias(x), F.col("set").alias(f"{x}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    inter = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    counted = both.select("a", "b", inter.alias("inter"), (F.size("a_set") + F.size("b_set")).cast("long").alias("sum"))
    rows = counted.select("a", "b", "inter", (F.col("sum") - F.col("inter")).alias("union"))
    accepted = (F.col("union") == 0) | (F.col("inter") * config.jaccard.denominator >= F.col("union") * config.jaccard.numerator)
    return rows.withColumn("accepted", accepted)


def shared_shingle_pairs(sets: DataFrame, config: LshConfig) -> DataFrame:
    """All pairs at the threshold, without sketches, by prefixes.

    A pair at Jaccard t shares a shingle among the first n - ceil(t n) + 1 of either set in any fixed order. The order
    is by rarity, so the prefixes meet seldom.
    """
    each = sets.select("ordinal", "n", F.explode("set").alias("s"))
    rarity = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(rarity, "s").groupBy("ordinal", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    t = config.jaccard
    head = F.col("n") - F.floor((F.col("n") * t.numerator + t.denominator - 1) / t.denominator).cast("int") + 1
    prefix = ranked.select("ordinal", "n", F.explode(F.slice("o", F.lit(1), head)).alias("p")).where("p.df > 1").select("ordinal", "n", "p.s")
    a = prefix.select("s", F.col("ordinal").alias("a"), F.col("n").alias("an"))
    b = prefix.select("s", F.col("ordinal").alias("b"), F.col("n").alias("bn"))
    pairs = a.join(b, "s").where((F.col("a") < F.col("b")) & fits(F.col("an"), F.col("bn"), config)).select("a", "b").distinct()
    return refine(pairs, sets, config)


def clusters(docs: DataFrame, accepted: DataFrame) -> DataFrame:
    """(ordinal, root) of every document: near edges of representatives and star edges of their copies."""
    stars = star_edges(docs)
    edges = accepted.select(F.col("a").alias("u"), F.col("b").alias("v"))
    # copies follow their representative, so only representatives need the components
    rooted = stars.join(components(edges).select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return rooted.select("ordinal", F.coalesce("top", "root").alias("root"))


def audit(clustered: DataFrame, docs: DataFrame) -> DataFrame:
    """Clusters, singletons, clusters over several archives, split normalized texts and invalid roots."""
    rows = clustered.join(docs.select("ordinal", "archive", "normalized_hash"), "ordinal")
    by_root = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("archive").alias("s"), F.min("ordinal").alias("low"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    totals = by_root.agg(
        F.count(F.lit(1)).alias("clusters"), count(F.col("n") == 1).alias("singletons"), count(F.col("s") > 1).alias("cross_archive"),
        count(F.col("low") != F.col("root")).alias("invalid_roots"),
    )
    leaks = rows.groupBy("normalized_hash").agg(F.count_distinct("root").alias("r")).agg(count(F.col("r") > 1).alias("split_texts"))
    return totals.join(F.broadcast(leaks))  # one row each


def wilson(hits: Column, trials: Column, z: float) -> dict[str, Column]:
    """One-sided Wilson bounds; (0, 1) without trials."""
    n = trials.cast("double")
    p = hits / n
    scale = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / scale
    radius = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / scale
    return {
        "lower": F.when(trials == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - radius)),
        "upper": F.when(trials == 0, 1.0).otherwise(F.least(F.lit(1.0), centre + radius)),
    }


def stratified_sample(pairs: DataFrame, strata: int, per: int) -> DataFrame:
    """Of each stratum of pairs, by a digest, the first `per` by the same digest."""
    digest = F.sha2(F.concat_ws(":", "a", "b"), 256)
    rows = pairs.withColumn("digest", digest).withColumn("stratum", (F.conv(F.substring("digest", 1, 4), 16, 10).cast("long") % strata).cast("int"))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("digest"))
    return rows.withColumn("place", place).where(F.col("place") <= per)


def paired_documents(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(archive, id) of the documents that stand on either side of a pair (a, b), each once."""
    sides = pairs.select(F.col("a").alias("ordinal")).unionByName(pairs.select(F.col("b").alias("ordinal"))).distinct()
    return docs.select("ordinal", "archive", "id").join(sides, "ordinal").select("archive", "id")
