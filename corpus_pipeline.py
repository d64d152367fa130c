"""A corpus from raw documents to token ids, stage by stage; each stage is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import bpe, lang_id, line_dedup, mixing, similar, simhash
from textmill.llm.common import discard, read, shared_dir
from textmill.llm.queries import remainder, vocabulary

#: Of the way from chance to certainty, how far the best language's probability has to go. At sf0.1 the least of any
#: document with letters is 0.36 of four languages, here 0.325 are asked for.
TELLS = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; those without text or letters go, and those it can't tell from chance.

    Where no row has a language to learn from, all documents with letters stay. Null, empty and letterless texts go;
    repeated rows are judged alike; texts are read whole; an empty table stays empty; columns may have any name.
    """
    model = lang_id.train(docs, usable=lambda i: remainder(4, i) != 2)
    if model is None:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    chance = 1 / len(model.langs)
    least = chance + TELLS * (1 - chance) if chance < 1 else 0.0
    # the input travels in a struct, so its names can't clash
    told = docs.select(F.struct("*").alias("d"), lang_id.predict(F.col("text"), model).alias("p"))
    kept = told.where((F.col("p.lang_pred") != lang_id.UNKNOWN) & (F.col("p.score") >= least))
    # a document that names no language gets the predicted one
    return kept.select(*(F.coalesce("d.lang", "p.lang_pred").alias(c) if c == "lang" else F.col("d")[c].alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated boilerplate lines, n_chars following.

    Null and empty texts stay as they are; equal rows are treated alike; columns may have any name.
    """
    count = "_" * max(map(len, docs.columns)) + "removed"  # no column's name
    kept, changed = line_dedup.dedup_lines(docs, removed_col=count), F.col(count) > 0
    sized = {c: F.when(changed, F.length("text").cast(kind)).otherwise(F.col(c)) for c, kind in docs.dtypes if c == "n_chars"}
    return kept.select(*(sized.get(c, F.col(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8 or more), the one of least id.

    Null and wordless texts are one group; of rows that repeat an id and text one stays; a null id comes after all
    others; texts are compared whole; an empty table stays empty; columns may have any name.
    """
    return simhash.least_of_each(docs, similar.classes(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in rows of their own.

    Null and empty texts have no words and go with the budget of their source; a null source is one of its own; rows that
    repeat an id are taken alike, as the hash of the id decides; an empty table stays empty; columns may have any name.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text.

    A null or empty text has no ids and decodes to itself; repeated rows get equal rows.
    """
    made = bpe.encoded(spark, docs, ["doc_id", "lang", "source"], *vocabulary())
    return made.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing", mixture),
    ("byte-level BPE", tokens),
]

#: The language network and the tokenizer can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory; a stage's rows go once the next stage has written its own."""
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            discard(spark, f"{folder}/{k - 1}")
    return docs
