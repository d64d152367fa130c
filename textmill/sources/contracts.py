"""Scans that hold their files against a contract: schemas, line rules, digests, nested files, a place to go on from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.sources.sinks import file_digests


def schema_problems(found: T.StructType, expected: T.StructType) -> list[str]:
    """How a schema differs from the expected one: columns missing, of another type, or unknown."""
    types, wanted = {f.name: f.dataType for f in found}, {f.name: f.dataType for f in expected}
    out = [f"{n}: missing" for n in wanted if n not in types]
    out += [f"{n}: {types[n].simpleString()}, expected {t.simpleString()}" for n, t in wanted.items() if n in types and types[n] != t]
    return out + [f"{n}: unknown" for n in types if n not in wanted]


def read_checked(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet files whose schema is the one given, and of them the columns asked for; another schema is an error."""
    rows = spark.read.parquet(path)
    if problems := schema_problems(rows.schema, T._parse_datatype_string(schema)):
        raise ValueError(f"{path}: {'; '.join(problems)}")
    return rows.select(*(columns or rows.columns))


def line_problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem, lines) of JSON lines: blank ones, and ones that aren't an object."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    # an object gives its keys, also none; an array, a number or broken text gives null
    problem = F.when(F.trim(F.regexp_replace("value", r"\s", "")) == "", "blank").when(F.json_object_keys("value").isNull(), "not_an_object")
    return lines.withColumn("problem", problem).where("problem is not null").groupBy("file", "problem").agg(F.count(F.lit(1)).alias("lines"))


def read_checked_jsonl(spark: SparkSession, path: str, schema: str, sha256: dict[str, str] | None = None) -> DataFrame:
    """Rows of JSON lines, plain or compressed; a blank line, a line that is no object, or a file whose digest isn't the
    one expected (by its name) is an error."""
    if sha256 is not None:
        found = {r.file: r.sha256 for r in file_digests(spark, path).where(F.col("file").isin(*sha256)).collect()}
        if wrong := {f for f, digest in sha256.items() if found.get(f) != digest}:
            raise ValueError(f"files that are missing or changed: {sorted(wrong)}")
    if bad := line_problems(spark, path).limit(3).collect():
        raise ValueError(f"{path}: {bad}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def repo_files(spark: SparkSession, path: str, schema: str, files: str = "files", skip: int = 0) -> DataFrame:
    """One row for each nested file of repository rows, in the order of shards and rows, from row `skip` of each shard on.

    A repository without files gives none. Rows have shard, row (place in the shard), the repository's columns and file.
    """
    rows = spark.read.schema(schema).parquet(path)
    rest = [c for c in rows.columns if c != files]
    placed = rows.select(F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row"), *rest, files)
    return placed.where(F.col("row") >= skip).select("shard", "row", *rest, F.posexplode(files).alias("nth", "file"))


def parquet_contract(spark: SparkSession, path: str, rows: int, files: int | None = None) -> DataFrame:
    """(files, rows, bytes, digest, agrees) of the Parquet files under a path against the rows and files expected."""
    parts = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    whole = file_digests(spark, path, "*.parquet").join(parts, "file", "left").na.fill(0, ["rows"])
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256)  # a row a file
    sums = whole.agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), digest.alias("digest"))
    agrees = (F.col("rows") == rows) & (F.lit(True) if files is None else F.col("files") == files)
    return sums.withColumn("agrees", agrees)
