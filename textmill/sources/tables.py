"""The driver tables as the engine's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.config import QUALITY, SPLIT
from textmill.functions import identity, text as tx
from textmill.functions.prefix import ordinal
from textmill.storage import cut, read, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, key, bucket, archive, text and size of every document; a null text counts as an empty one."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return spread(docs, "doc_id").select(
        F.col("doc_id").alias("id"),
        identity.document_key(F.col("source"), F.col("doc_id")).alias("key"),
        F.col("lang").alias("bucket"),
        F.col("source").alias("archive"),
        F.octet_length(text).cast("long").alias("size_bytes"),
        text.alias("text"),
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, without its text: hashes, measures, flags, penalty, identity, group and rank."""
    docs = tx.with_lines(documents(spark, sf_dir))
    text = F.col("text")
    m = tx.measures(text)
    rows = docs.select("id", "key", "bucket", "archive", "size_bytes", "text", *(c.alias(k) for k, c in m.items()))
    rows = rows.withColumn("flags", tx.flags(text, {k: F.col(k) for k in m}, QUALITY))
    origin = F.concat("archive", F.lit("/"), F.floor(F.col("id") / 10).cast("string"))
    normalized_hash = identity.sha(tx.normalized(text))
    soft = F.create_map(*(F.lit(x) for kv in QUALITY.soft.items() for x in kv))
    penalty = F.aggregate("flags", F.lit(0).cast("long"), lambda s, f: s + F.coalesce(F.element_at(soft, f), F.lit(0)))
    rows = rows.withColumns({"content_hash": identity.sha(text), "normalized_hash": normalized_hash, "penalty": penalty})
    return rows.drop("text").withColumns({
        "final_cluster": identity.named_hash("english-normalized-provisional", F.col("normalized_hash")),
        "source_group": identity.named_digest("english-source", origin),
        "selection_rank": identity.selection_rank(F.col("key"), SPLIT),
    })


def inventory(fp: DataFrame) -> DataFrame:
    """Fingerprints with manifest_index, each document's place in its archive."""
    return ordinal(fp, ["id"], "manifest_index", ["archive"])


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints computed once, for plans that use them several times."""
    return cut(fingerprints(spark, sf_dir))
