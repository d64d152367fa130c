"""Queries: configuration, preflight, progress, new generations and the smoke build."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.config import LSH, PACK, SPLITS
from textmill.functions import text as tx
from textmill.operators import control, pack
from textmill.plans import neardup, packing
from textmill.plans.curation import curated
from textmill.plans.registry import Registry
from textmill.sources import tables
from textmill.storage import cut

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

CATEGORIES, SOURCES = ("python", "other_code", "english"), {"english": ("fineweb_edu", "wikipedia")}
#: phase, split, category, source, token field, target: right ones, and below them a fault of every kind.
QUOTAS = [("final", s, c, None, "exact_tokens", 1000) for s in SPLITS for c in CATEGORIES]
QUOTAS += [("collection", None, c, None, "exact_tokens", n) for c, n in (("python", 40), ("other_code", 40), ("english", 20))]
QUOTAS += [("collection", None, "english", s, "exact_tokens", 10) for s in SOURCES["english"]]
FAULTY = [
    *QUOTAS[1:-1], QUOTAS[2], ("final", "dev", "python", None, "exact_tokens", 5), ("final", "train", "poetry", None, "exact_tokens", 5), ("later", None, "python", None, "exact_tokens", 5),
    ("collection", None, "english", "books", "exact_tokens", 5), ("collection", None, "python", None, "bytes", 5), ("final", "test", "english", None, "exact_tokens", 0),
]
_COLUMNS = "phase string, split string, category string, source string, token_field string, target long"
_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in FAULTY)
_CELLS = ", ".join(f"('final/{s}/{c}/-')" for s in SPLITS for c in CATEGORIES) + ", " + ", ".join(f"('collection/-/{c}/{s}')" for c in CATEGORIES for s in (SOURCES.get(c) or ["-"]))


@query(f"""SELECT * FROM (WITH q(phase, split, category, source, token_field, target) AS (VALUES {_VALUES}),
    named AS (SELECT phase || '/' || coalesce(split, '-') || '/' || category || '/' || coalesce(source, '-') AS name, * FROM q),
    judged AS (SELECT name, CASE WHEN phase NOT IN ('final', 'collection') THEN 'phase' WHEN phase = 'final' AND (split IS NULL OR split NOT IN ('test', 'validation', 'train')) THEN 'split'
        WHEN category NOT IN ('python', 'other_code', 'english') THEN 'category' WHEN phase <> 'final' AND source IS NOT NULL AND category || '/' || source NOT IN ('english/fineweb_edu', 'english/wikipedia') THEN 'source'
        WHEN token_field IS DISTINCT FROM 'exact_tokens' THEN 'token_field' WHEN target IS NULL OR target <= 0 THEN 'target' END AS problem FROM named)
    SELECT * FROM judged WHERE problem IS NOT NULL
    UNION ALL SELECT name, 'repeated' FROM named GROUP BY name HAVING count(*) > 1
    UNION ALL SELECT c.name, 'missing' FROM (VALUES {_CELLS}) c(name) WHERE c.name NOT IN (SELECT name FROM named)
    UNION ALL SELECT 'collection/-/' || category || '/-', 'sum_of_sources' FROM named WHERE phase = 'collection' AND category = 'english' GROUP BY category
        HAVING sum(CASE WHEN source IS NULL THEN target END) <> sum(CASE WHEN source IS NOT NULL THEN target END))""")
def quota_problems(spark, sf):
    """Faults of a quota table; that without any is `QUOTAS`."""
    return control.quota_problems(spark.createDataFrame(FAULTY, _COLUMNS), CATEGORIES, SOURCES)


@query()
def refinement_preflight(spark, sf):
    """Whether a sample of the candidate pairs is refined fast enough for all of them; the rate is the machine's."""
    docs = cut(neardup.numbered(spark, sf))
    pairs = cut(neardup.neardup.candidates(neardup.keyed(docs), LSH))
    return control.refinement_preflight(pairs, neardup.sets_of(docs), LSH, least_rate=1.0, most_seconds=259_200)


@query("""SELECT t.bucket, coalesce(finalized, 0) AS finalized, coalesce(audited, 0) AS audited, coalesce(failed, 0) AS failed, coalesce(documents, 0)::BIGINT AS documents, coalesce(tokens, 0)::BIGINT AS tokens,
    t.target::BIGINT AS target, greatest(t.target - coalesce(tokens, 0), 0)::BIGINT AS remaining, CASE WHEN coalesce(finalized, 0) > 0 THEN audited / finalized ELSE 0.0::DOUBLE END AS coverage,
    CASE WHEN coalesce(finalized, 0) = 0 THEN 'missing' WHEN failed > 0 THEN 'failed' WHEN tokens < t.target THEN 'collecting' WHEN audited < finalized THEN 'auditing' ELSE 'complete' END AS health
    FROM (VALUES ('en', 1000), ('de', 100000000), ('fr', 1000), ('it', 10)) t(bucket, target) LEFT JOIN (
        SELECT bucket, count(*) AS finalized, count(*) FILTER (WHERE a <> 'src1') AS audited, count(*) FILTER (WHERE bucket = 'fr' AND a = 'src2') AS failed, sum(n) AS documents, sum(words) AS tokens
        FROM (SELECT bucket, archive AS a, count(*) AS n, sum(words) AS words FROM measured GROUP BY 1, 2) GROUP BY bucket) s ON s.bucket = t.bucket""")
def collection_progress(spark, sf):
    """Progress and health of each bucket."""
    docs = tables.documents(spark, sf).select("bucket", "archive", tx.word_count(F.col("text")).alias("words"))
    name = F.concat_ws("/", "bucket", "archive").alias("archive")
    archives = cut(docs.groupBy("bucket", name).agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("tokens")))
    targets = spark.createDataFrame([("en", 1000), ("de", 100_000_000), ("fr", 1000), ("it", 10)], "bucket string, target long")
    return control.progress(archives, archives.where("archive not like '%/src1'"), archives.where("archive = 'fr/src2'"), targets)


@query("""SELECT * FROM (WITH old AS (SELECT source AS archive, sum(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT)::BIGINT AS digest FROM documents WHERE source <> 'src4' GROUP BY 1),
    new AS (SELECT source AS archive, sum(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT)::BIGINT AS digest FROM documents WHERE source <> 'src5' AND doc_id % 100 <> 7 GROUP BY 1),
    acts AS (SELECT coalesce(o.archive, n.archive) AS archive, CASE WHEN n.digest IS NULL THEN 'drop' WHEN o.digest = n.digest THEN 'reuse' ELSE 'fingerprint' END AS action FROM old o FULL JOIN new n ON n.archive = o.archive)
    SELECT archive, action, (SELECT bool_or(action <> 'reuse') FROM acts) AS recanonicalize FROM acts)""")
def generation_plan(spark, sf):
    """What a generation asks for that has an archive more, one less, and others with fewer documents."""
    docs = tables.documents(spark, sf).select("id", "archive")
    digest = F.sum(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long")).alias("digest")
    old = docs.where("archive != 'src4'").groupBy("archive").agg(digest)
    new = docs.where("archive != 'src5' and id % 100 != 7").groupBy("archive").agg(digest)
    return control.generation_plan(old, new)


@query(f"""SELECT domain, count(*) AS documents, sum(n_tokens)::BIGINT AS tokens, ((sum(n_tokens) + count(*) - 1) // {PACK.length})::BIGINT AS rows FROM (
    SELECT domain, n_tokens FROM (SELECT domain, len(tokens) AS n_tokens, row_number() OVER (PARTITION BY domain ORDER BY id) AS place FROM tokened t
        WHERE archive = (SELECT min(archive) FROM tokened u WHERE u.domain = t.domain)) WHERE place <= 20) GROUP BY domain""")
def smoke_build(spark, sf):
    """The first documents of one archive of each domain, packed: a small run of the whole way to training rows."""
    index = packing.index(spark, sf)
    first = index.groupBy("domain").agg(F.min("archive").alias("archive"))
    docs = pack.smoke_documents(index.join(F.broadcast(first), ["domain", "archive"]), 20)
    placed = cut(pack.streams(docs.withColumn("split", F.lit("smoke")).drop("start", "end", "eos_at"), ["id"]))
    made = pack.packed(placed, PACK).groupBy("domain").agg(F.count(F.lit(1)).alias("rows"))
    sums = placed.groupBy("domain").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
    return sums.join(made, "domain", "left").na.fill(0, ["rows"]).select("domain", "documents", "tokens", "rows")


@query("""SELECT * FROM (VALUES ('fingerprints', 'complete'), ('near_map', 'complete'), ('choices', 'ready'), ('splits', 'waiting'), ('packing', 'waiting')) v(stage, state)
    WHERE (SELECT count(*) FROM documents) > 0""")
def stage_states(spark, sf):
    """Where a curation stands whose fingerprints and near-duplicate map are made."""
    c = curated(spark, sf)
    needs = {"fingerprints": [], "near_map": ["fingerprints"], "choices": ["near_map"], "splits": ["choices"], "packing": ["splits"]}
    done = [name for name, rows in (("fingerprints", c.provisional), ("near_map", c.near_map)) if not rows.isEmpty()]
    return spark.createDataFrame(list(control.stage_states(needs, done).items()), "stage string, state string")
