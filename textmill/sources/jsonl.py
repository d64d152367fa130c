"""JSON lines and text, plain or compressed; a line that isn't an object is an error."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Plain bytes that go into one compressed blob, and lines that a reader sends back at once.
BLOB_BYTES = 64 << 20
LINES = 10_000


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of .jsonl and .jsonl.gz files."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_field(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """(text): one field, by its dotted name."""
    return read_jsonl(spark, path, schema).select(F.col(field).alias("text"))


def read_text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=whole).withColumnRenamed("value", "text")


def write_jsonl(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.mode("errorifexists").option("compression", compression).json(path)


def zst_lines(blobs: DataFrame) -> DataFrame:
    """(line) of every line of Zstandard blobs (data), streamed; a blank line or broken text is an error."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["data"]:
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data.as_buffer()), read_across_frames=True) as plain:
                    some = []
                    for line in io.TextIOWrapper(plain, "utf-8", newline="\n"):
                        if not line.strip():
                            raise ValueError("a blank line among JSON lines")
                        some.append(line.rstrip("\n"))
                        if len(some) == LINES:
                            yield pa.RecordBatch.from_pydict({"line": pa.array(some, pa.string())})
                            some = []
                    yield pa.RecordBatch.from_pydict({"line": pa.array(some, pa.string())})

    return blobs.select("data").mapInArrow(lines, "line string")


def read_zst(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of .jsonl.zst files, wherever Spark's readers find them; a file is one task's work."""
    blobs = spark.read.format("binaryFile").load(path).select(F.col("content").alias("data"))
    return zst_lines(blobs).select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def zst_blobs(lines: DataFrame) -> DataFrame:
    """(data): the lines (line) as Zstandard blobs of some `BLOB_BYTES` plain bytes, at least one for a task with lines."""

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def blob() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"data": pa.array([zstandard.ZstdCompressor(level=3).compress("".join(out).encode())], pa.binary())})

        for batch in batches:
            for line in batch["line"].to_pylist():
                out.append(line + "\n")
                size += len(line)
                if size >= BLOB_BYTES:
                    yield blob()
                    out, size = [], 0
        if out:
            yield blob()

    return lines.select("line").mapInArrow(blobs, "data binary")
