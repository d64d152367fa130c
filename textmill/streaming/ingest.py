"""Incremental ingestion: documents arrive as files, and duplicate counters follow them.

Counters merge by min and sum, so any order and cutting of the batches gives what one batch over all files gives. A
batch's partial counters are written under its own id, so a batch that runs again after a failure replaces itself.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.functions.identity import sha


def document_stream(spark: SparkSession, path: str, schema, files: int | None = 10, most_bytes: int | None = None) -> DataFrame:
    """Documents of files as they arrive; a batch has at most so many files or, if that is given, so many bytes."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if most_bytes is None else reader.option("maxBytesPerTrigger", most_bytes)
    return reader.parquet(path)


def partial_counters(docs: DataFrame) -> DataFrame:
    """(content_hash, first_id, documents, tokens) of a batch of doc_id and text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), sha(text).alias("content_hash"), tx.word_count(text).alias("tokens"))
    return rows.groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))


def merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("content_hash").agg(F.min("first_id").alias("first_id"), F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


def index_duplicates(stream: DataFrame, folder: str, every: str | None = None, idle: float = 0.0):
    """Keeps its place in `folder`/place, so a later call goes on where this one ends; partial counters lie in
    `folder`/batches. Takes all files there are and ends or, with `every`, looks for new ones that often until none has
    come for `idle` seconds."""

    def write(batch: DataFrame, batch_id: int) -> None:
        partial_counters(batch).write.mode("overwrite").parquet(f"{folder}/batches/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/place")
    if every is None:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    query, seen, since = writer.trigger(processingTime=every).start(), -1, time.monotonic()
    while query.isActive and time.monotonic() - since < idle:
        query.awaitTermination(1)
        last = query.lastProgress
        if last and last["numInputRows"] and last["batchId"] != seen:
            seen, since = last["batchId"], time.monotonic()
    query.processAllAvailable()
    query.stop()
    return query


def duplicate_index(spark: SparkSession, folder: str) -> DataFrame:
    return merged(spark.read.parquet(f"{folder}/batches").drop("batch"))


def live_counters(stream: DataFrame) -> DataFrame:
    """The same counters as a running aggregate, for complete or update mode."""
    return partial_counters(stream)
