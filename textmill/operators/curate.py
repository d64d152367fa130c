"""Curation: reject reasons, canonical choices, splits, quotas and decisions.

Reasons are (id, reason) rows; a document without any is eligible. The tables here carry ids and hashes, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.config import QualityPolicy, SplitPolicy
from textmill.functions.identity import named_digest, split_of
from textmill.functions.prefix import running

# Reasons.
PROPAGATED = "benchmark_cluster_contamination"
EXACT = "residual_exact_duplicate"
NEAR = "english_near_duplicate"
NORMALIZED = "residual_normalized_duplicate"
OVERFLOW = "quota_overflow"
MISSING_REPO = "missing_code_repo_id"
MISSING_ENGLISH = "missing_english_source_identity"
# Fixed value: namespace of the clusters that the near-duplicate map names.
NEAR_CLUSTER = "english-near-cluster"


def quality_reasons(fp: DataFrame, policy: QualityPolicy) -> DataFrame:
    hard = F.array(*map(F.lit, policy.hard))
    return fp.select("id", F.explode(F.array_intersect("flags", hard)).alias("flag")).select("id", F.concat(F.lit("quality:"), "flag").alias("reason"))


def first_named(*parts: Column) -> Column:
    """The first of the parts that isn't blank, without white space at its ends; null if all are."""
    bare = (F.regexp_replace(p.cast("string"), r"^\s+|\s+$", "") for p in parts)
    return F.coalesce(*(F.when(b != "", b) for b in bare))


def missing_identity(rows: DataFrame) -> DataFrame:
    """Reasons of documents without a source identity; `rows` has id, code and identity."""
    word = F.when(F.col("code"), MISSING_REPO).otherwise(MISSING_ENGLISH)
    return rows.where("identity is null").select("id", word.alias("reason"))


def source_groups(rows: DataFrame) -> DataFrame:
    """`rows` (id, code, identity) with source_group, the digest of the identity in its namespace; null without one."""
    group = F.when(F.col("code"), named_digest("code-repository", F.col("identity"))).otherwise(named_digest("english-source", F.col("identity")))
    return rows.withColumn("source_group", group)


def first_reasons(fp: DataFrame, guard: DataFrame, policy: QualityPolicy) -> DataFrame:
    """Quality and benchmark reasons."""
    benchmark = guard.select("id", F.concat(F.lit("benchmark:"), "reason").alias("reason"))
    return quality_reasons(fp, policy).unionByName(benchmark)


def propagated(fp: DataFrame, reasons: DataFrame) -> DataFrame:
    """A reason for every document that shares a content hash or final cluster with a contaminated one."""
    hit = fp.join(reasons.where(F.col("reason").startswith("benchmark:")).select("id").distinct(), "id", "left_semi")
    shared = [fp.join(hit.select(key).distinct(), key, "left_semi").select("id") for key in ("content_hash", "final_cluster")]
    return shared[0].unionByName(shared[1]).distinct().withColumn("reason", F.lit(PROPAGATED))


def reason_free(fp: DataFrame, reasons: DataFrame) -> DataFrame:
    return fp.join(reasons.select("id").distinct(), "id", "left_anti")


def near_mapped(fp: DataFrame, near_map: DataFrame) -> DataFrame:
    """Fingerprints with their near-duplicate cluster as final_cluster; `near_map` has id and cluster_id.

    A document that the map doesn't know keeps its provisional cluster; `dq.coverage` tells whether there are any.
    """
    named = near_map.select("id", named_digest(NEAR_CLUSTER, F.col("cluster_id")).alias("near"))
    rest = [c for c in fp.columns if c != "final_cluster"]
    return fp.join(named, "id", "left").select(*rest, F.coalesce("near", "final_cluster").alias("final_cluster"))


def exact_choice(clean: DataFrame) -> DataFrame:
    """Of each content hash, the document of least (penalty, key)."""
    least = F.min(F.struct("penalty", "key", "id", "final_cluster")).alias("c")
    return clean.groupBy("content_hash").agg(least).select("content_hash", "c.penalty", "c.key", F.col("c.id").alias("canonical_id"), "c.final_cluster")


def final_choice(exact: DataFrame) -> DataFrame:
    """Of each final cluster, the exact canonical document of least (penalty, key)."""
    least = F.min(F.struct("penalty", "key", "canonical_id")).alias("c")
    return exact.groupBy("final_cluster").agg(least).select("final_cluster", F.col("c.canonical_id").alias("canonical_id"))


def canonical_map(clean: DataFrame, exact: DataFrame, final: DataFrame) -> DataFrame:
    """(id, canonical_id): each reason-free document and its final canonical document, by way of its exact one."""
    through = exact.select("content_hash", F.col("final_cluster").alias("cluster"))
    ends = final.select(F.col("final_cluster").alias("cluster"), "canonical_id")
    return clean.select("id", "content_hash").join(through, "content_hash").join(ends, "cluster").select("id", "canonical_id")


def residual(clean: DataFrame, exact: DataFrame, final: DataFrame, code_buckets: tuple[str, ...] = ()) -> DataFrame:
    """Reasons of the documents that another stands for; each gets exactly one."""
    chosen = exact.select("content_hash", F.col("canonical_id").alias("exact_id"))
    copies = clean.select("id", "bucket", "content_hash", "final_cluster").join(chosen, "content_hash")
    a = copies.where("id != exact_id").select("id", F.lit(EXACT).alias("reason"))
    word = F.when(F.col("bucket").isin(*code_buckets), NORMALIZED).otherwise(NEAR) if code_buckets else F.lit(NEAR)
    b = copies.where("id = exact_id").join(final, "final_cluster").where("id != canonical_id").select("id", word.alias("reason"))
    return a.unionByName(b)


def self_check(fp: DataFrame, reasons: DataFrame, mapped: DataFrame) -> DataFrame:
    """Violations of what canonicalization promises; every count must be 0."""
    eligible = reason_free(fp, reasons).select("id", "content_hash", "final_cluster")
    repeated = lambda key: eligible.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
    own = mapped.where("id = canonical_id").select("id")
    checks = {
        "eligible_share_content": repeated("content_hash"),
        "eligible_share_cluster": repeated("final_cluster"),
        "eligible_not_canonical": eligible.join(own, "id", "left_anti").count(),
        "canonical_not_eligible": own.join(eligible, "id", "left_anti").count(),
        "mapped_to_rejected": mapped.select(F.col("canonical_id").alias("id")).distinct().join(eligible, "id", "left_anti").count(),
    }
    return fp.sparkSession.createDataFrame(list(checks.items()), "check string, violations long")


def assign_splits(eligible: DataFrame, policy: SplitPolicy) -> DataFrame:
    """Eligible documents with their split, a function of the group alone, so groups never straddle splits."""
    return eligible.withColumn("split", split_of(F.col("source_group"), policy))


def quota_prefix(candidates: DataFrame, quotas: DataFrame, fail_short: bool = True) -> DataFrame:
    """(id, split, category, selected_tokens): of each split and category the first documents by (selection_rank, key)
    that fill the target, the last one cut to what is left. A target that can't be filled is an error.

    `candidates` has id, split, category, selection_rank, key, words; `quotas` has split, category, target.
    """
    if fail_short:
        supply = candidates.groupBy("split", "category").agg(F.sum("words").alias("have"))
        short = quotas.join(supply, ["split", "category"], "left").where(F.coalesce("have", F.lit(0)) < F.col("target")).limit(5).collect()
        if short:
            raise ValueError(f"quotas exceed the supply: {short}")
    columns = candidates.select("id", "split", "category", "selection_rank", "key", "words")
    before = running(columns, ["split", "category"], ["selection_rank", "key"], {"before": F.col("words")})
    kept = before.join(F.broadcast(quotas), ["split", "category"]).where("before < target")
    return kept.select("id", "split", "category", F.least(F.col("words"), F.col("target") - F.col("before")).alias("selected_tokens"))


def quota_proof(candidates: DataFrame, quotas: DataFrame, selected: DataFrame) -> DataFrame:
    """For each cell: target, selected tokens and documents, documents cut short, whether the selected ones come before
    all others by (selection_rank, key), and whether only the last is cut. Aggregates alone, so no cell is one task."""
    place = F.struct("selection_rank", "key")
    taken = selected.select("id", "selected_tokens")
    rows = candidates.select("id", "split", "category", "selection_rank", "key", "words").join(taken, "id", "left")
    in_, short = F.col("selected_tokens").isNotNull(), F.col("selected_tokens") < F.col("words")
    cells = rows.groupBy("split", "category").agg(
        F.coalesce(F.sum("selected_tokens"), F.lit(0)).alias("tokens"), F.count("selected_tokens").alias("documents"), F.count(F.when(short, 1)).alias("cut_documents"),
        F.max(F.when(in_, place)).alias("last"), F.min(F.when(~in_, place)).alias("next"), F.max(F.when(short, place)).alias("cut"),
    )
    true = F.lit(True)
    return quotas.join(cells, ["split", "category"]).select(
        "split", "category", "target", "tokens", "documents", "cut_documents",
        F.coalesce(F.col("last") < F.col("next"), true).alias("prefix"), F.coalesce(F.col("last") == F.col("cut"), true).alias("cut_last"),
    )


def decisions(fp: DataFrame, reasons: DataFrame, mapped: DataFrame, splits: DataFrame, selected: DataFrame) -> DataFrame:
    """keep or reject for every document, with its canonical document, split, tokens and sorted reasons."""
    listed = reasons.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    rows = (
        fp.select("id", "bucket", "archive").join(mapped, "id", "left").join(splits.select("id", "split"), "id", "left")
        .join(selected.select("id", "selected_tokens"), "id", "left").join(listed, "id", "left")
    )
    over = F.col("reasons").isNull() & F.col("selected_tokens").isNull()
    return rows.select(
        "id", "bucket", "archive", F.when(F.col("selected_tokens").isNotNull(), "keep").otherwise("reject").alias("decision"),
        "canonical_id", "split", F.coalesce("selected_tokens", F.lit(0)).alias("selected_tokens"),
        F.when(over, OVERFLOW).otherwise(F.coalesce("reasons", F.lit(""))).alias("reasons"),
    )
