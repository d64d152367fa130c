"""Archives: tar files under Zstandard, members in order and a manifest of them as the last member.

The reader takes the archives as binary files, so whatever store Spark reads will do, and streams each one's members;
an archive that breaks a rule is an error. The writer packs groups of rows into archive bytes.
"""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.prefix import running
from textmill.operators.admission import first_failing

MANIFEST = "_manifest.jsonl"
MEMBERS = "archive string, manifest_index long, member_path string, content string, sha256 string, size_bytes long"


def pack_archive(members: list[tuple[str, bytes]]) -> bytes:
    """Archive bytes of (path, content) members; the manifest is added."""
    out = io.BytesIO()
    with zstandard.ZstdCompressor(level=3).stream_writer(out, closefd=False) as zipped, tarfile.open(fileobj=zipped, mode="w|") as tar:

        def add(path: str, content: bytes) -> None:
            info = tarfile.TarInfo(path)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))

        rows = []
        for path, content in members:
            add(path, content)
            rows.append(json.dumps({"member_path": path, "size_bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}))
        add(MANIFEST, "\n".join([*rows, ""]).encode())
    return out.getvalue()


def unpack_archive(data: bytes) -> Iterator[tuple[int, str, str, str, int]]:
    """(manifest_index, member_path, content, sha256, size) of each member, held against the manifest."""
    found, manifest = [], None
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:
        for info in tar:
            if manifest is not None or not info.isfile():
                raise ValueError(f"{info.name}: members must be files, and the manifest the last")
            content = tar.extractfile(info).read()
            if info.name == MANIFEST:
                manifest = [json.loads(line) for line in content.decode().splitlines()]
                continue
            sha = hashlib.sha256(content).hexdigest()
            found.append((info.name, sha, len(content)))
            yield len(found) - 1, info.name, content.decode("utf-8"), sha, len(content)
    if manifest is None or found != [(r["member_path"], r["sha256"], r["size_bytes"]) for r in manifest]:
        raise ValueError("the manifest doesn't agree with the members")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of MEMBERS for every archive at a path; an archive is one task's work."""
    files = spark.read.format("binaryFile").load(path)
    return unpacked(files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias("data")))


def unpacked(packed: DataFrame) -> DataFrame:
    """Rows of MEMBERS for (archive, data) rows."""
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = ["archive", "manifest_index", "member_path", "content", "sha256", "size_bytes"]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["archive"].to_pylist(), batch["data"]):
                rows, size = [], 0
                for row in unpack_archive(data.as_py()):
                    rows.append((name, *row))
                    size += row[-1]
                    if size > 16 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return packed.select("archive", "data").mapInArrow(members, MEMBERS)


def parts(docs: DataFrame, most_bytes: int) -> DataFrame:
    """Documents (archive, manifest_index, size_bytes and more) with part, which of their archive's parts they go to.

    A part begins once `most_bytes` have gone to those before, so it holds at most that and one document more.
    """
    placed = running(docs, ["archive"], ["manifest_index"], {"before": F.col("size_bytes")})
    return placed.withColumn("part", F.floor(F.col("before") / most_bytes).cast("long")).drop("before")


def archived(docs: DataFrame) -> DataFrame:
    """(archive, data): archive bytes of documents with archive, part, manifest_index, member_path and text.

    A part is one task's work; `parts` bounds its size. A group without documents gives no archive.
    """
    name = F.format_string("%s-part-%06d.tar.zst", "archive", "part")
    rows = docs.select(name.alias("archive"), "manifest_index", "member_path", F.col("text"))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("manifest_index")
        members = [(p, t.encode()) for p, t in zip(table["member_path"].to_pylist(), table["text"].to_pylist())]
        return pa.table({"archive": [table["archive"][0].as_py()], "data": pa.array([pack_archive(members)], pa.binary())})

    return rows.groupBy("archive").applyInArrow(packed, "archive string, data binary")


def merged_manifest(manifest: DataFrame, measured: DataFrame) -> DataFrame:
    """Rows of a manifest and of what was measured, joined by their place in the archive, with `problem`, null if they agree.

    `manifest` has archive, manifest_index, member_path, size_bytes, tokens; `measured` archive, manifest_index,
    member_path, size_bytes and more. Rows that only one side has, other members and other sizes are problems.
    """
    m = manifest.select("archive", "manifest_index", "member_path", "size_bytes", "tokens")
    rest = [c for c in measured.columns if c not in m.columns]
    found = measured.select("archive", "manifest_index", F.col("member_path").alias("found_path"), F.col("size_bytes").alias("found_bytes"), *rest)
    problem = first_failing({
        "no_member": F.col("found_path").isNull(), "no_manifest_row": F.col("member_path").isNull(), "member_order": F.col("member_path") != F.col("found_path"),
        "size": F.col("size_bytes") != F.col("found_bytes"), "not_positive": (F.col("size_bytes") <= 0) | (F.col("tokens") <= 0),
    })
    return m.join(found, ["archive", "manifest_index"], "full").withColumn("problem", problem).drop("found_bytes")


def assert_merged(rows: DataFrame) -> DataFrame:
    """The merged rows, if none has a problem; else an error that names the first few."""
    bad = rows.where("problem is not null").orderBy("archive", "manifest_index").select("archive", "manifest_index", "problem").limit(3).collect()
    if bad:
        raise ValueError(f"the manifest doesn't agree with the members: {bad}")
    return rows.drop("problem", "found_path")
