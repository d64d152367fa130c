"""Archive reports, duplicate counters and record checks over fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.identity import document_key
from textmill.functions.prefix import ordinal


def flag_histogram(fp: DataFrame) -> DataFrame:
    """Documents by bucket and flag."""
    return fp.select("bucket", F.explode("flags").alias("flag")).groupBy("bucket", "flag").agg(F.count(F.lit(1)).alias("documents"))


def archive_report(fp: DataFrame) -> DataFrame:
    """Totals of each archive, with its languages and flags counted."""
    totals = fp.groupBy("archive").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("size_bytes").alias("bytes"), F.sum("words").alias("tokens"),
        F.sum(F.size("flags").cast("long")).alias("flag_total"), F.sum(F.when(F.size("flags") > 0, 1).otherwise(0)).alias("flagged"),
    )

    def listed(key: str, rows: DataFrame, name: str) -> DataFrame:
        counted = rows.groupBy("archive", key).agg(F.count(F.lit(1)).alias("n"))
        pairs = F.array_sort(F.collect_list(F.concat_ws("=", key, F.col("n").cast("string"))))
        return counted.groupBy("archive").agg(F.array_join(pairs, ",").alias(name))

    flags = listed("flag", fp.select("archive", F.explode("flags").alias("flag")), "flags")
    return totals.join(listed("bucket", fp, "buckets"), "archive").join(flags, "archive", "left").withColumn("flags", F.coalesce("flags", F.lit("")))


def clusters(fp: DataFrame, key: str) -> DataFrame:
    """Counters of each distinct hash: they merge by min and sum, so partial and incremental results agree."""
    return fp.groupBy(key).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("documents"), F.sum("words").alias("tokens"))


def duplicate_accounting(fp: DataFrame) -> DataFrame:
    """Documents, clusters first seen and duplicates of each archive; a cluster belongs to its first archive."""
    first = fp.groupBy("content_hash").agg(F.min("archive").alias("archive"))
    new = first.groupBy("archive").agg(F.count(F.lit(1)).alias("new_clusters"))
    all_ = fp.groupBy("archive").agg(F.count(F.lit(1)).alias("documents"))
    joined = all_.join(new, "archive", "left").withColumn("new_clusters", F.coalesce("new_clusters", F.lit(0)))
    return joined.withColumn("duplicates", F.col("documents") - F.col("new_clusters"))


def contiguity(fp: DataFrame) -> DataFrame:
    """Archives with the proof that manifest indexes run from 0 without gap or repeat."""
    n = F.col("documents")
    return (
        fp.groupBy("archive")
        .agg(F.count(F.lit(1)).alias("documents"), F.min("manifest_index").alias("low"), F.max("manifest_index").alias("high"), F.sum("manifest_index").alias("total"))
        .withColumn("contiguous", (F.col("low") == 0) & (F.col("high") == n - 1) & (F.col("total") * 2 == n * (n - 1)))
    )


def record_violations(fp: DataFrame) -> DataFrame:
    """How many fingerprints break each rule of the record format."""
    hexa = lambda c: ~F.col(c).rlike("^[0-9a-f]{64}$")
    rules = {
        "key": hexa("key"), "content_hash": hexa("content_hash"), "normalized_hash": hexa("normalized_hash"),
        "size": F.col("size_bytes") <= 0, "tokens": F.col("words") <= 0,
        "flags": F.col("flags") != F.array_sort(F.array_distinct("flags")),
        "lines": F.col("nonempty_lines") > F.col("lines"),
        "fractions": (F.col("repeated_line_fraction") < 0) | (F.col("repeated_line_fraction") > 1),
    }
    sums = fp.agg(*(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(k) for k, c in rules.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules))).alias("r")).select("r.*")


def record_audit(rows: DataFrame, version: int) -> DataFrame:
    """How many records break each rule: (archive, version, manifest_index, key, words, flags, benchmark_reason).

    Places run from 0 in each archive, a key is that of its archive and id, and the contamination flag stands if and
    only if there is a reason for it; whether places have gaps is told by `contiguity`.
    """
    flagged, reason = F.array_contains("flags", "benchmark_contamination"), F.col("benchmark_reason").isNotNull()
    rules = {
        "version": F.col("version") != version, "manifest_index": F.col("manifest_index") < 0, "key": F.col("key") != document_key(F.col("archive"), F.col("id")),
        "flag_without_reason": flagged & ~reason, "reason_without_flag": reason & ~flagged, "tokens": F.col("words") <= 0,
    }
    sums = rows.agg(*(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(k) for k, c in rules.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules))).alias("r")).select("r.*")


def ordered_digest(df: DataFrame, columns: list[str], order: list[str], batch: int) -> DataFrame:
    """(digest, batches, rows): rows are digested, then batches of them in order, then the batches' digests in order.

    A task holds the digests of a batch, and the last one those of all batches.
    """
    row = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256)
    placed = ordinal(df.select(*dict.fromkeys([*columns, *order])), order, "place").select("place", row.alias("row"))
    joined = lambda at, of: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, of))), lambda x: x[of]), "\n" if of == "row" else "")
    parts = placed.groupBy(F.floor(F.col("place") / batch).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sha2(joined("place", "row"), 256).alias("part"))
    return parts.agg(F.sha2(joined("batch", "part"), 256).alias("digest"), F.count(F.lit(1)).alias("batches"), F.sum("n").alias("rows"))


def lowest_priority(df: DataFrame, by: str, k: int, priority) -> DataFrame:
    """The k rows of least priority of each group; ranks are limited before they are shuffled."""
    ranked = df.withColumn("priority", priority)
    place = F.row_number().over(Window.partitionBy(by).orderBy("priority"))
    return ranked.withColumn("place", place).where(F.col("place") <= k)


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and a sum of 48-bit row digests that doesn't depend on their order."""
    row = F.concat_ws("|", *(F.col(c).cast("string") for c in columns))
    part = F.conv(F.substring(F.sha2(row, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))
