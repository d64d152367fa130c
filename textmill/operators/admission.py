"""Admission of source rows: language lists, quarantine, ordered skip reasons, cut-offs and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.prefix import ordinal, running

# Benchmark names that quarantine a path or url.
QUARANTINE = ("mbpp", "evalplus", "eval_plus", "multi-pl-e", "multipl-e", "multiple-e", "mbxp", "mxeval", "human_eval", "humaneval")
LICENSES = ("permissive", "no_license")


def classify_language(language: Column, lists: dict[str, Sequence[str]]) -> Column:
    """The list that names a language exactly; null if none does. Lists that overlap are an error."""
    named = [x for names in lists.values() for x in names]
    if len(named) != len(set(named)):
        raise ValueError("language lists overlap")
    out = F.lit(None).cast("string")
    for name, languages in lists.items():
        out = F.when(language.isin(*languages), name).otherwise(out)
    return out


def quarantined(*parts: Column) -> Column:
    """Whether a path or url, in lower case and with forward slashes, names a benchmark."""
    joined = F.replace(F.lower(F.concat_ws("/", *parts)), F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for marker in QUARANTINE:
        out |= F.contains(joined, F.lit(marker))
    return F.coalesce(out, F.lit(False))


def first_failing(tests: dict[str, Column]) -> Column:
    """Name of the first condition that holds; null if none does. A null condition doesn't hold."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in tests.items()))


def english_skip(text: Column, language: Column, score: Column, url: Column, contaminated: Column, tokens: Column, least: float | None) -> Column:
    """Why an English row is skipped, or null."""
    tests = {"empty": text.isNull() | (F.trim(F.regexp_replace(text, r"\s", "")) == "")}
    if least is not None:
        tests["language"] = ~language.eqNullSafe(F.lit("en")) | score.isNull() | (score < least)
    return first_failing(tests | {"quarantined_url": quarantined(url), "benchmark": contaminated, "not_english": tokens <= 0})


def code_skip(language: Column, full: Column, vendor: Column, license_: Column, repo: Column, path: Column, content: Column, contaminated: Column, tokens: Column, lists) -> Column:
    """Why a code file is skipped, or null; licence, content and token failures all count as not_code."""
    return first_failing({
        "language": classify_language(language, lists).isNull(), "bucket_full": full, "vendor": vendor, "not_code": license_.isNull() | ~license_.isin(*LICENSES),
        "quarantined": quarantined(repo, path), "not_code_content": content.isNull() | (content == ""), "benchmark": contaminated, "not_code_tokens": tokens <= 0,
    })


def bucket_cutoff(rows: DataFrame, targets: DataFrame, order: Sequence[str], committed: Column | None = None) -> DataFrame:
    """Rows accepted in ingest order while a bucket's tokens so far stay under its target. `rows` has bucket, tokens."""
    before = running(rows, ["bucket"], order, {"before": F.col("tokens")})
    have = F.col("before") + (F.lit(0) if committed is None else committed)
    return before.join(F.broadcast(targets), "bucket").withColumn("accepted", have < F.col("target"))


def safe_suffix(path: Column) -> Column:
    """File suffix of at most 16 safe characters, or nothing."""
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.when(suffix.rlike(r"^\.[A-Za-z0-9_+.-]+$") & (F.length(suffix) <= 16), suffix).otherwise(F.lit(""))


def safe_member(path: Column) -> Column:
    """Relative, without empty, . or .. parts, backslashes or control characters."""
    parts = F.split(path, "/")
    return (path != "") & ~path.rlike(r"^/|\\|[\x00-\x1f]") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def discover(archives: DataFrame, ledger: DataFrame, reports: DataFrame, errors: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Archives (archive, bucket, bytes) with a ledger record, without a report, and without an error unless those are
    tried again; `place` counts them from 1, the smallest first."""
    due = archives.join(ledger.select("archive").distinct(), "archive", "left_semi").join(reports.select("archive").distinct(), "archive", "left_anti")
    if not retry_errors:
        due = due.join(errors.select("archive").distinct(), "archive", "left_anti")
    return ordinal(due, ["bytes", "bucket", "archive"], "place").withColumn("place", F.col("place") + 1)


def ledger_status(ledger: DataFrame, quotas: DataFrame) -> DataFrame:
    """Tokens committed towards each quota; a null key of a quota matches any value. Quotas are a handful of rows."""
    on = F.lit(True)
    for key in ("phase", "split", "category"):
        on &= F.col(f"q.{key}").isNull() | (F.col(f"q.{key}") == F.col(f"r.{key}"))
    # summed first: the theta join meets one row a key, not one a record
    sums = ledger.groupBy("phase", "split", "category").agg(F.sum("tokens").alias("tokens"))
    joined = F.broadcast(quotas).alias("q").join(sums.alias("r"), on, "left").groupBy("q.name", "q.target").agg(F.coalesce(F.sum("r.tokens"), F.lit(0)).alias("tokens"))
    gap = F.greatest(F.col("target") - F.col("tokens"), F.lit(0))
    return joined.select("name", "target", "tokens", gap.alias("remaining"), (F.col("tokens") / F.col("target")).alias("fraction"), (F.col("tokens") >= F.col("target")).alias("reached"))


def ledger_insert(ledger: DataFrame, fresh: DataFrame, key: str, replace: bool = False) -> DataFrame:
    """The ledger with new records; the same record again changes nothing, another under a known key is an error."""
    fresh = fresh.select(*ledger.columns).distinct()
    if replace:
        return ledger.join(fresh.select(key).distinct(), key, "left_anti").select(*ledger.columns).unionByName(fresh)
    clash = fresh.join(ledger.select(key).distinct(), key, "left_semi").select(*ledger.columns).exceptAll(ledger).limit(3).collect()
    if clash or fresh.groupBy(key).count().where("count > 1").limit(1).collect():
        raise ValueError(f"records differ from those in the ledger: {clash}")
    return ledger.unionByName(fresh.join(ledger.select(key).distinct(), key, "left_anti").select(*ledger.columns))


def estimated_tokens(size: Column, ratio: Column) -> Column:
    """Bytes over bytes per token, rounded half to even."""
    return F.bround(size / ratio).cast("long")


def closure(ledger: DataFrame, markers: DataFrame, targets: DataFrame) -> DataFrame:
    """For each bucket, whether its collection is complete: one source, documents, tokens at target and as marked."""
    sums = ledger.groupBy("bucket").agg(F.count_distinct("source").alias("sources"), F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    rows = targets.join(sums, "bucket", "left").join(markers.select("bucket", F.col("tokens").alias("marked")), "bucket", "left")
    failure = first_failing({
        "missing_bucket": F.col("documents").isNull(), "sources": F.col("sources") != 1, "empty": F.col("documents") <= 0,
        "below_target": F.col("tokens") < F.col("target"), "marker": ~F.col("marked").eqNullSafe(F.col("tokens")),
    })
    return rows.select("bucket", "target", "tokens", F.coalesce(failure, F.lit("")).alias("failure"))


def file_closure(files: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """(key, state): files that no ledger record names, and records whose file isn't there; a closed collection has none."""
    f, r = files.select(key).distinct(), ledger.select(key).distinct()
    return f.join(r, key, "left_anti").withColumn("state", F.lit("without_record")).unionByName(r.join(f, key, "left_anti").withColumn("state", F.lit("without_file")))
