"""Sinks in a store that all executors share, with readers, digests and proofs that the files hold what was meant.

A sink deals its rows by what names a file's folder and lets adaptive execution split folders that are large and merge
small ones, so a hot archive is many files and no single task. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.config import PackConfig
from textmill.operators import dq, pack

#: Rows of a file at most; a larger folder has several.
FILE_ROWS = 1_000_000
SFT_OUTPUTS = ("train", "validation", "rejected")


def write_by(df: DataFrame, path: str, by: Sequence[str], form: str = "parquet", mode: str = "errorifexists", **options) -> None:
    """Rows in folders named by the columns `by`."""
    dealt = df.hint("rebalance", *by)
    dealt.write.format(form).mode(mode).partitionBy(*by).option("maxRecordsPerFile", FILE_ROWS).options(**options).save(path)


def proven(written: DataFrame, meant: DataFrame, what: str) -> DataFrame:
    """`written`, if it holds the rows of `meant` and no others, repeats included; else an error."""
    wrong = {r.side: r.rows for r in dq.differences(meant, written).collect() if r.rows}
    if wrong:
        raise ValueError(f"{what}: written rows differ from those meant: {wrong}")
    return written


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, bytes, sha256) of the files under a path, each read by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_fingerprints(fp: DataFrame, path: str) -> DataFrame:
    """Fingerprints as compressed JSON lines, in folders by archive; returns the digests of the files."""
    write_by(fp, path, ["archive"], "json", compression="gzip")
    return file_digests(fp.sparkSession, path, "*.json.gz")


def read_fingerprints(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _packed_u16(tokens: pa.Array) -> pa.Array:
    """Each list of ids as little-endian pairs of bytes, without a Python number."""
    flat = np.asarray(tokens.flatten()).astype("<u2")
    sizes = np.diff(np.asarray(tokens.offsets)).astype(np.int32) * 2
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(tokens), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])


def u16(tokens: Column) -> Column:
    """Ids below 65,536 (array<int>) as bytes, two each."""

    @F.arrow_udf("binary")
    def of(rows: pa.Array) -> pa.Array:
        return _packed_u16(rows)

    return of(F.coalesce(tokens, F.array().cast("array<int>")))


def from_u16(data: Column) -> Column:
    """The ids (array<int>) of such bytes."""

    @F.arrow_udf("array<int>")
    def of(rows: pa.Array) -> pa.Array:
        parts = [np.frombuffer(r.as_buffer(), "<u2").astype(np.int32) for r in rows]
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))

    return of(data)


def write_token_cache(docs: DataFrame, path: str, vocabulary: int) -> DataFrame:
    """Token ids of documents (archive, id, tokens) as bytes, with each one's offset in its archive, in folders by archive.

    Ids outside of the vocabulary are an error and nothing is written. Returns each archive's documents and tokens and
    its least and greatest id.
    """
    if not 0 < vocabulary <= 1 << 16:
        raise ValueError(f"a vocabulary of {vocabulary} ids doesn't fit two bytes")
    sized = docs.select("archive", "id", "tokens", F.size("tokens").cast("long").alias("n_tokens"))
    low, high = F.array_min("tokens"), F.array_max("tokens")
    seen = sized.groupBy("archive").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.min(low).alias("least"), F.max(high).alias("greatest"))
    bad = seen.where((F.col("least") < 0) | (F.col("greatest") >= vocabulary)).limit(3).collect()
    if bad:
        raise ValueError(f"ids outside of 0 to {vocabulary - 1}: {bad}")
    placed = pack.offsets(sized.select("archive", "id", "n_tokens"), ["archive"], ["id"], "n_tokens").select("archive", "id", "start", "n_tokens")
    data = sized.select("archive", "id", u16(F.col("tokens")).alias("data"))
    write_by(placed.join(data, ["archive", "id"]), path, ["archive"])
    return seen


def read_token_cache(spark: SparkSession, path: str, first: int = 0, count: int | None = None) -> DataFrame:
    """(archive, id, start, n_tokens, tokens): all ids of each document, or `count` of them from `first` on.

    Only the bytes asked for are decoded.
    """
    rows = spark.read.parquet(path)
    data = F.col("data") if count is None and not first else F.substring("data", 2 * first + 1, 2 * (count if count is not None else 1 << 29))
    return rows.select("archive", "id", "start", "n_tokens", from_u16(data).alias("tokens"))


def _written(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_packed(index: DataFrame, path: str, config: PackConfig, only: Sequence[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """Packed rows in folders by split and domain, stream by stream; returns the streams written.

    A stream is marked once its rows are whole. Called again, marked streams are left alone and others begin anew, so
    a run that was broken off goes on where it was. `only` names streams to write now.
    """
    spark, done = index.sparkSession, f"{path}/done"
    streams = {(r.split, r.domain) for r in index.select(*pack.STREAM).distinct().collect()}  # a few
    marked = {(r.split, r.domain) for r in spark.read.parquet(done).collect()} if _written(spark, done) else set()
    due = sorted(s for s in streams - marked if only is None or s in only)
    for split, domain in due:
        rows = pack.packed(index.where((F.col("split") == split) & (F.col("domain") == domain)), config)
        folder = f"{path}/rows/split={split}/domain={domain}"
        rows.drop(*pack.STREAM).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(folder)
        spark.createDataFrame([(split, domain)], "split string, domain string").coalesce(1).write.mode("append").parquet(done)
    return due


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the streams that are whole."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.join(F.broadcast(spark.read.parquet(f"{path}/done").distinct()), list(pack.STREAM), "left_semi")


def write_order(order: DataFrame, path: str) -> None:
    """The training order in files of rising positions, each sorted, so that a reader can stream it."""
    n = int(order.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order.repartitionByRange(n, "position").sortWithinPartitions("position").write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def order_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, last, rows) of an order's files; positions of one file are consecutive and files don't overlap."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), "position")
    return rows.groupBy("file").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.count(F.lit(1)).alias("rows"))


def write_sft(decided: DataFrame, path: str) -> list[str]:
    """Accepted rows by split, rejected ones with their reason and without text; outputs without rows are left out."""
    kept = ["id", "group_id", "input", "output", "domain", "tokens"]
    parts = {s: decided.where((F.col("reason").isNull()) & (F.col("split") == s)).select(*kept) for s in SFT_OUTPUTS[:2]}
    parts["rejected"] = decided.where("reason is not null").select("id", "group_id", "domain", "reason")
    there = [name for name, rows in parts.items() if not rows.isEmpty()]
    for name in there:
        parts[name].write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/{name}")
    return there


def append_once(rows: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key the table at the path doesn't hold yet, each key once; the same rows again add nothing."""
    fresh = rows.dropDuplicates([key])
    if _written(rows.sparkSession, path):
        fresh = fresh.join(rows.sparkSession.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)
