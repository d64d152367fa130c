"""Queries: shingles, candidates, exact refinement, clusters and calibration."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.config import LSH
from textmill.functions import text as tx
from textmill.functions.identity import sha
from textmill.operators import calibrate, neardup
from textmill.plans.registry import Registry
from textmill.sources import tables
from textmill.storage import cut

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
Z = NormalDist().inv_cdf(0.95)


def numbered(spark, sf) -> DataFrame:
    """ordinal, id, key, archive, normalized_hash, n, set and bands of every document, in archive order; no texts."""
    docs = tables.documents(spark, sf).withColumn("normal", tx.normalized(F.col("text")))
    found = neardup.shingled(tx.words(F.col("normal")), LSH)
    rows = cut(docs.select("id", "key", "archive", sha(F.col("normal")).alias("normalized_hash"), found.alias("s")))
    places = tables.ordinal(rows.select("id", "archive"), ["archive", "id"]).select("id", "ordinal")
    return rows.join(places, "id").select("ordinal", "id", "key", "archive", "normalized_hash", F.size("s.set").alias("n"), "s.set", "s.bands")


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each normalized text."""
    return docs.join(neardup.star_edges(docs).where("ordinal = root").select("ordinal"), "ordinal", "left_semi")


def sets_of(docs: DataFrame) -> DataFrame:
    return representatives(docs).select("ordinal", "n", "set")


def keyed(docs: DataFrame) -> DataFrame:
    """ordinal, n and band keys of the representatives."""
    return representatives(docs).select("ordinal", "n", "bands")


def accepted(docs: DataFrame) -> DataFrame:
    pairs = cut(neardup.candidates(keyed(docs), LSH))
    return neardup.refine(pairs, sets_of(docs), LSH).where("accepted")


def near_map(spark, sf) -> DataFrame:
    """(id, cluster_id) of every document."""
    docs = cut(numbered(spark, sf))
    clustered = neardup.clusters(docs, accepted(docs))
    roots = docs.select(F.col("ordinal").alias("root"), F.concat(F.lit(neardup.PREFIX), "key").alias("cluster_id"))
    return clustered.join(docs.select("ordinal", "id"), "ordinal").join(roots, "root").select("id", "cluster_id")


@query("SELECT ordinal, n FROM sizes")
def shingle_counts(spark, sf):
    return sets_of(numbered(spark, sf)).select("ordinal", F.col("n").cast("long").alias("n"))


@query("SELECT ordinal, root, members FROM stars")
def normalized_star_edges(spark, sf):
    return neardup.star_edges(numbered(spark, sf))


@query('SELECT a, b, inter, "union" FROM near')
def exact_jaccard_pairs(spark, sf):
    """Every pair at the threshold, found by prefixes of rare shingles."""
    return neardup.shared_shingle_pairs(sets_of(numbered(spark, sf)), LSH).where("accepted").select("a", "b", "inter", "union")


@query("SELECT archive, id FROM numbered WHERE ordinal IN (SELECT a FROM near UNION SELECT b FROM near)")
def paired_documents(spark, sf):
    """Documents of each archive that a pair at the threshold needs."""
    docs = numbered(spark, sf)
    return neardup.paired_documents(neardup.shared_shingle_pairs(sets_of(docs), LSH).where("accepted"), docs)


@query()
def length_ratio_candidates(spark, sf):
    """Pairs over the whole table that share a band and that their sizes allow; the bands have no SQL form."""
    return neardup.candidates(keyed(numbered(spark, sf)), LSH)


@query("SELECT ordinal, root FROM clustered")
def near_components(spark, sf):
    docs = numbered(spark, sf)
    return neardup.clusters(docs, accepted(docs))


@query("SELECT c.id, 'english-near-v1-' || r.key AS cluster_id FROM clustered c JOIN numbered r ON r.ordinal = c.root")
def cluster_map(spark, sf):
    """Each document and its cluster's name, that of the root document."""
    return near_map(spark, sf)


@query("""SELECT count(*) AS clusters, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS singletons, sum(CASE WHEN s > 1 THEN 1 ELSE 0 END)::BIGINT AS cross_archive,
    0::BIGINT AS invalid_roots, 0::BIGINT AS split_texts FROM (SELECT root, count(*) AS n, count(DISTINCT archive) AS s FROM clustered GROUP BY root)""")
def cluster_audit(spark, sf):
    docs = numbered(spark, sf)
    return neardup.audit(cut(neardup.clusters(docs, accepted(docs))), docs)


@query()
def near_bands(spark, sf):
    """Band keys of every representative; the digest has no SQL form."""
    return keyed(numbered(spark, sf)).select("ordinal", F.posexplode("bands").alias("band", "key"))


@query()
def near_candidates_lsh(spark, sf):
    """Candidate pairs of the bands, with their exact Jaccard counts."""
    docs = numbered(spark, sf)
    return neardup.refine(cut(neardup.candidates(keyed(docs), LSH)), sets_of(docs), LSH)


@query()
def bottom_k_sketch(spark, sf):
    """Sixteen least digests of up to 2,048 evenly chosen shingles of each document."""
    words = tx.words(tx.normalized(F.col("text")))
    return tables.documents(spark, sf).select("id", neardup.sketch(words, LSH.width).alias("sketch")).withColumn("sketch", F.array_join("sketch", ","))


@query("""SELECT a, b, stratum, place FROM (SELECT a, b, (('0x' || substr(sha256(a || ':' || b), 1, 4))::BIGINT % 16)::INTEGER AS stratum,
    row_number() OVER (PARTITION BY ('0x' || substr(sha256(a || ':' || b), 1, 4))::BIGINT % 16 ORDER BY sha256(a || ':' || b)) AS place FROM near) WHERE place <= 2""")
def stratified_pair_sample(spark, sf):
    pairs = neardup.shared_shingle_pairs(sets_of(numbered(spark, sf)), LSH).where("accepted")
    return neardup.stratified_sample(pairs.select("a", "b"), 16, 2).select("a", "b", "stratum", F.col("place").cast("long").alias("place"))


@query(f"""SELECT bucket, hits, trials, greatest(0.0::DOUBLE, centre - radius) AS lower, least(1.0::DOUBLE, centre + radius) AS upper FROM (
    SELECT bucket, hits, trials, (p + {Z * Z}::DOUBLE / (2 * n)) / (1 + {Z * Z}::DOUBLE / n) AS centre,
        {Z}::DOUBLE * sqrt(p * (1 - p) / n + {Z * Z}::DOUBLE / (4 * n * n)) / (1 + {Z * Z}::DOUBLE / n) AS radius FROM (
        SELECT bucket, count(*) FILTER (WHERE len(flags) = 0) AS hits, count(*) AS trials, count(*)::DOUBLE AS n,
            count(*) FILTER (WHERE len(flags) = 0) / count(*)::DOUBLE AS p FROM flagged GROUP BY bucket))""")
def wilson_bounds(spark, sf):
    """One-sided 95 % bounds for the share of documents without a flag."""
    counted = tables.fingerprints(spark, sf).groupBy("bucket").agg(F.sum(F.when(F.size("flags") == 0, 1).otherwise(0)).alias("hits"), F.count(F.lit(1)).alias("trials"))
    bounds = neardup.wilson(F.col("hits"), F.col("trials"), Z)
    return counted.select("bucket", "hits", "trials", *(c.alias(k) for k, c in bounds.items()))


@query()
def perturbation_recall(spark, sf):
    """By kind of change and bin of similarity, over all documents of 96 words or more, whole: how many changed copies share
    a band with their original, with bounds and the verdict; controls that share nothing."""
    return calibrate.report(tables.documents(spark, sf).select(tx.words(tx.normalized(F.col("text"))).alias("w")), LSH, Z)
