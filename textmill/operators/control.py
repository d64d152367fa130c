"""What runs the stages: configuration checks, preflight, progress, plans for new generations, the order of stages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.config import SPLITS, LshConfig
from textmill.operators import neardup
from textmill.operators.admission import first_failing

#: Phase and token field that a final quota has to name, and the phase of a collection target.
FINAL, COLLECTION, EXACT = "final", "collection", "exact_tokens"


def quota_problems(rows: DataFrame, categories: Sequence[str], sources: Mapping[str, Sequence[str]]) -> DataFrame:
    """(name, problem) of quota rows (phase, split, category, source, token_field, target) and of cells that lack one.

    Final quotas: one for every split and category, of exact tokens, positive. Collection targets: one for each category
    without sources and for each source of the others, whose own total, if given, is the sum of its sources. `sources`
    has the sources of a category, none for one that is a bucket itself. The table is a handful of rows.
    """
    spark = rows.sparkSession
    split, category, source = F.col("split"), F.col("category"), F.col("source")
    name = F.concat_ws("/", "phase", F.coalesce("split", F.lit("-")), "category", F.coalesce("source", F.lit("-")))
    final = F.col("phase") == FINAL
    valid = first_failing({
        "phase": ~F.col("phase").isin(FINAL, COLLECTION), "split": final & ~F.coalesce(split.isin(*SPLITS), F.lit(False)), "category": ~category.isin(*categories),
        "source": ~final & source.isNotNull() & ~F.array_contains(F.array(*(F.lit(f"{c}/{s}") for c, some in sources.items() for s in some)), F.concat_ws("/", category, source)),
        "token_field": ~F.col("token_field").eqNullSafe(F.lit(EXACT)), "target": F.col("target").isNull() | (F.col("target") <= 0),
    })
    named = rows.select(name.alias("name"), valid.alias("problem"), "phase", "category", "source", "target")
    repeated = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.lit("repeated").alias("problem"))
    cells = [f"{FINAL}/{s}/{c}/-" for s in SPLITS for c in categories]
    cells += [f"{COLLECTION}/-/{c}/{s}" for c in categories for s in (sources.get(c) or ["-"])]
    wanted = spark.createDataFrame([(c,) for c in cells], "name string")
    missing = wanted.join(named.select("name"), "name", "left_anti").select("name", F.lit("missing").alias("problem"))
    parts = named.where((F.col("phase") == COLLECTION) & category.isin(*(c for c, s in sources.items() if s)))
    sums = parts.groupBy("category").agg(F.sum(F.when(source.isNull(), F.col("target"))).alias("all"), F.sum(F.when(source.isNotNull(), F.col("target"))).alias("parts"))
    unequal = sums.where("all != parts").select(F.concat(F.lit(f"{COLLECTION}/-/"), "category", F.lit("/-")).alias("name"), F.lit("sum_of_sources").alias("problem"))
    return named.where("problem is not null").select("name", "problem").unionByName(repeated).unionByName(missing).unionByName(unequal)


def refinement_preflight(pairs: DataFrame, sets: DataFrame, config: LshConfig, least_rate: float, most_seconds: float, strata: int = 256, per: int = 40) -> DataFrame:
    """Refines a stratified sample of pairs and tells whether the whole will be done in time.

    One row: pairs, sampled, rate (pairs a second), seconds (projected) and whether both bounds hold.
    """
    total = pairs.count()
    sample = neardup.stratified_sample(pairs.select("a", "b"), strata, per).select("a", "b")
    began = time.monotonic()
    sampled = neardup.refine(sample, sets, config).count()
    rate = sampled / max(time.monotonic() - began, 1e-9)
    seconds = total / rate if rate else 0.0
    within = total == 0 or (rate >= least_rate and seconds <= most_seconds)
    return pairs.sparkSession.createDataFrame([(total, sampled, rate, seconds, within)], "pairs long, sampled long, rate double, seconds double, within boolean")


def progress(finalized: DataFrame, audited: DataFrame, failed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each bucket: archives finalized, audited and failed, documents, tokens, target, what remains, and health.

    `finalized` has archive, bucket, documents, tokens; `audited` and `failed` have archive; `targets` bucket and target.
    """
    marked = finalized.join(audited.select("archive").distinct().withColumn("a", F.lit(1)), "archive", "left").join(failed.select("archive").distinct().withColumn("f", F.lit(1)), "archive", "left")
    sums = marked.groupBy("bucket").agg(F.count(F.lit(1)).alias("finalized"), F.count("a").alias("audited"), F.count("f").alias("failed"), F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    rows = targets.join(sums, "bucket", "left").na.fill(0)
    done, left = F.col("audited"), F.greatest(F.col("target") - F.col("tokens"), F.lit(0))
    health = first_failing({"missing": F.col("finalized") == 0, "failed": F.col("failed") > 0, "collecting": left > 0, "auditing": done < F.col("finalized")})
    share = F.when(F.col("finalized") > 0, done / F.col("finalized")).otherwise(F.lit(0.0))
    return rows.select("bucket", "finalized", "audited", "failed", "documents", "tokens", "target", left.alias("remaining"), share.alias("coverage"), F.coalesce(health, F.lit("complete")).alias("health"))


def generation_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(archive, action, recanonicalize): what a new generation of archives (archive, digest) asks for.

    Outputs of an archive that is as it was are reused, others are fingerprinted or dropped; any change at all means
    that canonical choices, which look at all documents, are made anew.
    """
    a, b = old.select("archive", F.col("digest").alias("was")), new.select("archive", F.col("digest").alias("now"))
    same = F.col("was").eqNullSafe(F.col("now"))
    action = F.when(F.col("now").isNull(), "drop").when(same, "reuse").otherwise("fingerprint")
    rows = a.join(b, "archive", "full").select("archive", action.alias("action"))
    changed = rows.agg(F.coalesce(F.max(F.col("action") != "reuse"), F.lit(False)).alias("recanonicalize"))
    return rows.join(F.broadcast(changed))  # one row


def stage_states(needs: Mapping[str, Iterable[str]], done: Iterable[str], failed: Iterable[str] = ()) -> dict[str, str]:
    """State of each stage: complete, failed, blocked (behind a failure), ready or waiting. A circle is an error."""
    done, failed, out = set(done), set(failed), {}

    def state(stage: str, above: tuple[str, ...] = ()) -> str:
        if stage in above or stage not in needs:
            raise ValueError(f"{stage} is unknown or needs itself")
        if stage not in out:
            before = [state(n, (*above, stage)) for n in needs[stage]]
            if stage in failed:
                out[stage] = "failed"
            elif any(s in ("failed", "blocked") for s in before):
                out[stage] = "blocked"
            elif any(s != "complete" for s in before):
                out[stage] = "waiting"
            else:
                out[stage] = "complete" if stage in done else "ready"
        return out[stage]

    for stage in needs:
        state(stage)
    return {stage: out[stage] for stage in needs}


def run_stages(needs: Mapping[str, Iterable[str]], work: Mapping[str, Callable[[], object]], done: Iterable[str] = (), dry: bool = False) -> tuple[dict[str, str], dict[str, str]]:
    """Runs what is ready, one stage after another, until nothing is; a dry run stops before the first ready stage.

    Returns the states and, by stage, the errors: a stage that fails blocks those behind it and no others.
    """
    done, errors = set(done), {}
    while True:
        states = stage_states(needs, done, errors)
        due = next((s for s, state in states.items() if state == "ready"), None)
        if due is None or dry:
            return states, errors
        try:
            work[due]()
            done.add(due)
        except Exception as error:
            errors[due] = str(error)
