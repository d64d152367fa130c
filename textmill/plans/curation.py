"""Queries: fingerprints, benchmark guard, canonical choices, splits, quotas, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.config import QUALITY, SPLIT
from textmill.functions import text as tx
from textmill.functions.identity import split_of
from textmill.operators import benchmark, curate, dq, publish, quality
from textmill.plans import neardup, oracle
from textmill.plans.registry import Registry
from textmill.sources import tables
from textmill.storage import cut, read, stamp

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


class Curation:
    """The curation of a directory's documents; each step is computed when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def provisional(self) -> DataFrame:
        """Fingerprints whose final_cluster is that of the normalized text."""
        return self._once("provisional", lambda: tables.fingerprints(self.spark, self.sf_dir))

    @property
    def near_map(self) -> DataFrame:
        return self._once("near_map", lambda: cut(neardup.near_map(self.spark, self.sf_dir)))

    def step(self, name: str, make) -> DataFrame:
        """A step that a later stage adds, made once."""
        return self._once(name, make)

    @property
    def fp(self) -> DataFrame:
        """Fingerprints with near duplicates in one final cluster, on which all choices, splits and audits rest."""
        return self._once("fp", lambda: cut(curate.near_mapped(self.provisional, self.near_map)))

    @property
    def deny(self) -> DataFrame:
        return self._once("deny", lambda: cut(benchmark.denylist(read(self.spark, self.sf_dir, "benchmark"))))

    @property
    def guard(self) -> DataFrame:
        return self._once("guard", lambda: cut(benchmark.guard(tables.documents(self.spark, self.sf_dir), self.deny)))

    @property
    def reasons0(self) -> DataFrame:
        return self._once("reasons0", lambda: curate.first_reasons(self.fp, self.guard, QUALITY))

    @property
    def propagated(self) -> DataFrame:
        return self._once("propagated", lambda: curate.propagated(self.fp, self.reasons0))

    @property
    def reasons1(self) -> DataFrame:
        return self._once("reasons1", lambda: cut(self.reasons0.unionByName(self.propagated)))

    @property
    def clean(self) -> DataFrame:
        return self._once("clean", lambda: cut(curate.reason_free(self.fp, self.reasons1)))

    @property
    def exact(self) -> DataFrame:
        return self._once("exact", lambda: cut(curate.exact_choice(self.clean)))

    @property
    def final(self) -> DataFrame:
        return self._once("final", lambda: cut(curate.final_choice(self.exact)))

    @property
    def mapped(self) -> DataFrame:
        return self._once("mapped", lambda: curate.canonical_map(self.clean, self.exact, self.final))

    @property
    def reasons(self) -> DataFrame:
        return self._once("reasons", lambda: cut(self.reasons1.unionByName(curate.residual(self.clean, self.exact, self.final))))

    @property
    def eligible(self) -> DataFrame:
        made = lambda: cut(curate.assign_splits(curate.reason_free(self.fp, self.reasons), SPLIT).withColumn("category", F.col("bucket")))
        return self._once("eligible", made)

    @property
    def quotas(self) -> DataFrame:
        """Three fifths of each cell's supply, so that every cell ends in a cut document."""
        return self.eligible.groupBy("split", "category").agg(F.floor(F.sum("words") * 3 / 5).cast("long").alias("target"))

    @property
    def selected(self) -> DataFrame:
        return self._once("selected", lambda: cut(curate.quota_prefix(self.eligible, self.quotas)))


#: Curations kept in a session: the one at work, and the one before.
KEPT = 2
_KEPT: dict[tuple, Curation] = {}


def curated(spark: SparkSession, sf_dir: str) -> Curation:
    """The curation of a directory, whose stored steps all queries of the session share as long as the files it is made
    of are as they were."""
    key = (spark.sparkContext.applicationId, sf_dir, *(stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
    if key not in _KEPT:
        _KEPT[key] = Curation(spark, sf_dir)
        for old in list(_KEPT)[:-KEPT]:
            del _KEPT[old]
    return _KEPT[key]


_METRICS = "characters, lines, nonempty_lines, words, max_line_chars, mean_line_chars, repeated_line_fraction, whitespace_fraction, alphanumeric_fraction, url_count, code_line_fraction"


@query(f"SELECT id, {_METRICS} FROM measured")
def doc_quality_metrics(spark, sf):
    return tables.fingerprints(spark, sf).select("id", *_METRICS.split(", "))


@query("SELECT id, array_to_string(flags, ',') AS flags FROM flagged")
def doc_quality_flags(spark, sf):
    return tables.fingerprints(spark, sf).select("id", F.array_join("flags", ",").alias("flags"))


@query("SELECT id, key, content_hash, normalized_hash, final_cluster, source_group, selection_rank, penalty::BIGINT AS penalty, manifest_index FROM fp")
def fingerprints(spark, sf):
    cols = ["id", "key", "content_hash", "normalized_hash", "final_cluster", "source_group", "selection_rank", "penalty", "manifest_index"]
    return tables.inventory(tables.fingerprints(spark, sf)).select(*cols)


@query("SELECT bucket, flag, count(*) AS documents FROM (SELECT bucket, unnest(flags) AS flag FROM flagged) GROUP BY bucket, flag")
def flag_histogram(spark, sf):
    return quality.flag_histogram(tables.fingerprints(spark, sf))


@query("""SELECT f.archive, count(*) AS documents, sum(size_bytes)::BIGINT AS bytes, sum(words)::BIGINT AS tokens, sum(len(flags))::BIGINT AS flag_total,
    sum(CASE WHEN len(flags) > 0 THEN 1 ELSE 0 END)::BIGINT AS flagged, any_value(b.list) AS buckets, coalesce(any_value(g.list), '') AS flags
    FROM flagged f LEFT JOIN (SELECT archive, string_agg(bucket || '=' || n, ',' ORDER BY bucket || '=' || n) AS list
        FROM (SELECT archive, bucket, count(*) AS n FROM flagged GROUP BY 1, 2) GROUP BY 1) b ON b.archive = f.archive
    LEFT JOIN (SELECT archive, string_agg(flag || '=' || n, ',' ORDER BY flag || '=' || n) AS list
        FROM (SELECT archive, flag, count(*) AS n FROM (SELECT archive, unnest(flags) AS flag FROM flagged) GROUP BY 1, 2) GROUP BY 1) g ON g.archive = f.archive
    GROUP BY f.archive""")
def archive_report(spark, sf):
    return quality.archive_report(tables.stored(spark, sf))


@query("SELECT content_hash, min(id) AS first_id, count(*) AS documents, sum(words)::BIGINT AS tokens FROM fp GROUP BY content_hash")
def exact_clusters(spark, sf):
    return quality.clusters(tables.fingerprints(spark, sf), "content_hash")


@query("SELECT normalized_hash, min(id) AS first_id, count(*) AS documents, sum(words)::BIGINT AS tokens FROM fp GROUP BY normalized_hash")
def normalized_clusters(spark, sf):
    return quality.clusters(tables.fingerprints(spark, sf), "normalized_hash")


@query("""SELECT a.archive, documents, coalesce(n, 0) AS new_clusters, documents - coalesce(n, 0) AS duplicates
    FROM (SELECT archive, count(*) AS documents FROM fp GROUP BY 1) a LEFT JOIN
    (SELECT archive, count(*) AS n FROM (SELECT min(archive) AS archive FROM fp GROUP BY content_hash) GROUP BY 1) c ON a.archive = c.archive""")
def dup_accounting(spark, sf):
    return quality.duplicate_accounting(tables.stored(spark, sf))


@query("SELECT archive, count(*) AS documents, 0::BIGINT AS low, count(*) - 1 AS high, (count(*) * (count(*) - 1) // 2)::BIGINT AS total, true AS contiguous FROM documents d JOIN (SELECT doc_id AS i, source AS archive FROM documents) s ON s.i = d.doc_id GROUP BY archive")
def archive_contiguity(spark, sf):
    return quality.contiguity(tables.inventory(tables.documents(spark, sf).select("id", "archive")))


@query("SELECT unnest(['key', 'content_hash', 'normalized_hash', 'size', 'tokens', 'flags', 'lines', 'fractions']) AS rule, unnest([0, 0, 0, (SELECT count(*) FROM raw WHERE size_bytes <= 0), (SELECT count(*) FROM measured WHERE words <= 0), 0, 0, 0])::BIGINT AS violations")
def record_violations(spark, sf):
    return quality.record_violations(tables.fingerprints(spark, sf))


@query("SELECT id, archive, ordinal FROM numbered")
def dense_ordinal(spark, sf):
    docs = tables.documents(spark, sf).select("id", "archive")
    return tables.ordinal(docs, ["archive", "id"]).select("id", "archive", "ordinal")


@query("""SELECT id, archive, place FROM (SELECT id, archive, row_number() OVER (PARTITION BY archive ORDER BY sha256('sample' || chr(0) || key)) AS place FROM raw) WHERE place <= 5""")
def lowest_priority_sample(spark, sf):
    docs = tables.documents(spark, sf).select("id", "archive", "key")
    picked = quality.lowest_priority(docs, "archive", 5, F.sha2(F.concat(F.lit("sample\0"), "key"), 256))
    return picked.select("id", "archive", F.col("place").cast("long").alias("place"))


@query("""SELECT id, array_to_string(CASE WHEN len(w) <= 16 THEN w ELSE list_transform(range(0, 16), lambda i: w[i * len(w) // 16 + 1]) END, ' ') AS words
    FROM (SELECT id, regexp_extract_all(text, '[\\p{L}\\p{N}_'']+') AS w FROM raw)""")
def even_sample(spark, sf):
    return tables.documents(spark, sf).select("id", F.array_join(tx.evenly(tx.words(F.col("text")), 16), " ").alias("words"))


@query("SELECT count(*) AS rows, sum(('0x' || substr(sha256(id::VARCHAR || '|' || bucket || '|' || archive || '|' || size_bytes::VARCHAR), 1, 12))::BIGINT)::VARCHAR AS digest FROM raw")
def table_digest(spark, sf):
    return quality.table_digest(tables.documents(spark, sf), ["id", "bucket", "archive", "size_bytes"])


@query("SELECT id, reason FROM quality_reasons")
def hard_reject_reasons(spark, sf):
    return curate.quality_reasons(tables.fingerprints(spark, sf), QUALITY)


@query("SELECT id, penalty::BIGINT AS penalty FROM fp")
def soft_penalty(spark, sf):
    return tables.fingerprints(spark, sf).select("id", "penalty")


@query("SELECT 'strong' AS kind, digest FROM strong")
def benchmark_strong_lines(spark, sf):
    return benchmark.denylist(read(spark, sf, "benchmark")).where("kind = 'strong'")


@query("SELECT 'pair' AS kind, digest FROM deny_pairs")
def benchmark_line_pairs(spark, sf):
    return benchmark.denylist(read(spark, sf, "benchmark")).where("kind = 'pair'")


@query("SELECT id, kind, hits::BIGINT AS hits FROM hits")
def denylist_hits(spark, sf):
    return benchmark.hits(tables.documents(spark, sf), curated(spark, sf).deny)


@query("SELECT id, reason FROM guard WHERE reason IS NOT NULL")
def guard_reason(spark, sf):
    return curated(spark, sf).guard


@query("SELECT id, reason FROM propagated")
def contamination_propagation(spark, sf):
    return curated(spark, sf).propagated


@query("SELECT content_hash, penalty::BIGINT AS penalty, canonical_id FROM exact")
def exact_choice(spark, sf):
    return curated(spark, sf).exact.select("content_hash", "penalty", "canonical_id")


@query("SELECT final_cluster, canonical_id FROM final")
def final_choice(spark, sf):
    return curated(spark, sf).final


@query("SELECT id, canonical_id FROM mapped")
def canonical_map(spark, sf):
    return curated(spark, sf).mapped


@query("SELECT id, reason FROM residual")
def residual_reasons(spark, sf):
    c = curated(spark, sf)
    return curate.residual(c.clean, c.exact, c.final)


@query("""SELECT 'eligible_share_content' AS "check", count(*) AS violations FROM (SELECT content_hash FROM eligible GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'eligible_share_cluster', count(*) FROM (SELECT final_cluster FROM eligible GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'eligible_not_canonical', count(*) FROM eligible WHERE id NOT IN (SELECT id FROM mapped WHERE id = canonical_id)
    UNION ALL SELECT 'canonical_not_eligible', count(*) FROM mapped WHERE id = canonical_id AND id NOT IN (SELECT id FROM eligible)
    UNION ALL SELECT 'mapped_to_rejected', count(DISTINCT canonical_id) FROM mapped WHERE canonical_id NOT IN (SELECT id FROM eligible)""")
def canonical_self_check(spark, sf):
    c = curated(spark, sf)
    return curate.self_check(c.fp, c.reasons, cut(c.mapped))


@query("SELECT source_group, count(*) AS documents, sum(words)::BIGINT AS tokens FROM eligible GROUP BY source_group")
def source_groups(spark, sf):
    return curated(spark, sf).eligible.groupBy("source_group").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("tokens"))


@query("SELECT DISTINCT source_group, split FROM eligible")
def split_assignment(spark, sf):
    return curated(spark, sf).eligible.select("source_group", "split").distinct()


@query("SELECT id, selection_rank FROM fp")
def selection_rank(spark, sf):
    return tables.fingerprints(spark, sf).select("id", "selection_rank")


@query("SELECT id, split, category, selected_tokens FROM selected")
def quota_prefix(spark, sf):
    return curated(spark, sf).selected


@query("""SELECT r.split, r.category, any_value(q.target)::BIGINT AS target, coalesce(sum(s.selected_tokens), 0)::BIGINT AS tokens, count(s.id) AS documents,
    count(*) FILTER (WHERE s.selected_tokens < r.words) AS cut_documents,
    coalesce(max(CASE WHEN s.id IS NOT NULL THEN r.selection_rank || r.key END) < min(CASE WHEN s.id IS NULL THEN r.selection_rank || r.key END), true) AS prefix,
    coalesce(max(CASE WHEN s.id IS NOT NULL THEN r.selection_rank || r.key END) = max(CASE WHEN s.selected_tokens < r.words THEN r.selection_rank || r.key END), true) AS cut_last
    FROM ranked r JOIN quotas q ON q.split = r.split AND q.category = r.category LEFT JOIN selected s ON s.id = r.id GROUP BY r.split, r.category""")
def quota_proof(spark, sf):
    """What makes a selection right, cell by cell: it fills the target, is a prefix by rank, and cuts its last document alone."""
    c = curated(spark, sf)
    return curate.quota_proof(c.eligible, c.quotas, c.selected)


_DECISIONS = """SELECT f.id, f.bucket, f.archive, CASE WHEN s.id IS NOT NULL THEN 'keep' ELSE 'reject' END AS decision, m.canonical_id, e.split,
    coalesce(s.selected_tokens, 0) AS selected_tokens, CASE WHEN r.list IS NULL AND s.id IS NULL THEN 'quota_overflow' ELSE coalesce(r.list, '') END AS reasons
    FROM fp f LEFT JOIN mapped m ON m.id = f.id LEFT JOIN eligible e ON e.id = f.id LEFT JOIN selected s ON s.id = f.id
    LEFT JOIN (SELECT id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS list FROM reasons GROUP BY id) r ON r.id = f.id"""


@query(_DECISIONS)
def decisions(spark, sf):
    c = curated(spark, sf)
    return curate.decisions(c.fp, c.reasons, c.mapped, c.eligible, c.selected)


@query(f"""SELECT unnest(['keep_has_reason', 'keep_without_split', 'reject_has_tokens', 'reject_without_reason']) AS rule, unnest([
    count(*) FILTER (WHERE decision = 'keep' AND reasons <> ''), count(*) FILTER (WHERE decision = 'keep' AND (split IS NULL OR selected_tokens <= 0)),
    count(*) FILTER (WHERE decision <> 'keep' AND selected_tokens <> 0), count(*) FILTER (WHERE decision <> 'keep' AND reasons = '')]) AS violations FROM ({_DECISIONS})""")
def decision_violations(spark, sf):
    d = decisions(spark, sf)
    keep = F.col("decision") == "keep"
    rules = {
        "keep_has_reason": keep & (F.col("reasons") != ""), "keep_without_split": keep & (F.col("split").isNull() | (F.col("selected_tokens") <= 0)),
        "reject_has_tokens": ~keep & (F.col("selected_tokens") != 0), "reject_without_reason": ~keep & (F.col("reasons") == ""),
    }
    sums = d.agg(*(F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in rules.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules))).alias("r")).select("r.*")


@query("SELECT bucket, split, count(*) AS documents, sum(words)::BIGINT AS tokens, 0::BIGINT AS invalid_tokens FROM eligible GROUP BY bucket, split")
def eligible_supply(spark, sf):
    return publish.supply(curated(spark, sf).eligible)


@query("""SELECT split, category, bucket, count(*) AS documents, sum(words)::BIGINT AS tokens, grouping(split, category, bucket)::INTEGER AS level
    FROM eligible GROUP BY GROUPING SETS ((split), (category), (bucket), (split, category), (split, bucket), ())""")
def supply_grouping_sets(spark, sf):
    return publish.grouping_sets(curated(spark, sf).eligible)


@query("SELECT bucket, count(*) AS documents, sum(words)::BIGINT AS tokens FROM fp GROUP BY bucket")
def raw_totals(spark, sf):
    return publish.raw_totals(tables.fingerprints(spark, sf))


@query("SELECT bucket, count(*) AS documents, sum(words)::BIGINT AS tokens FROM fp WHERE id IN (SELECT id FROM reasons) GROUP BY bucket")
def rejected_totals(spark, sf):
    c = curated(spark, sf)
    return publish.rejected_totals(c.fp, c.reasons)


@query("SELECT reason, count(*) AS associations, sum(words)::BIGINT AS tokens, 0::BIGINT AS orphans FROM (SELECT DISTINCT * FROM reasons) r JOIN fp ON fp.id = r.id GROUP BY reason")
def reason_totals(spark, sf):
    c = curated(spark, sf)
    return publish.reason_totals(c.fp, c.reasons)


@query("""SELECT bucket, count(*) AS raw_documents, sum(words)::BIGINT AS raw_tokens,
    count(*) FILTER (WHERE ok) AS eligible_documents, coalesce(sum(words) FILTER (WHERE ok), 0)::BIGINT AS eligible_tokens,
    count(*) FILTER (WHERE NOT ok) AS rejected_documents, coalesce(sum(words) FILTER (WHERE NOT ok), 0)::BIGINT AS rejected_tokens,
    0::BIGINT AS documents_delta, 0::BIGINT AS tokens_delta, true AS reconciled
    FROM (SELECT bucket, words, id NOT IN (SELECT id FROM reasons) AS ok FROM fp) GROUP BY bucket""")
def raw_reconciliation(spark, sf):
    c = curated(spark, sf)
    return publish.reconciliation(publish.raw_totals(c.fp), publish.raw_totals(c.eligible), publish.rejected_totals(c.fp, c.reasons))


@query("""SELECT 'content_hash' AS identity, count(DISTINCT content_hash) AS "values", 0::BIGINT AS leaking, 0::BIGINT AS repeated FROM eligible
    UNION ALL SELECT 'normalized_hash', count(DISTINCT normalized_hash), 0, 0 FROM eligible
    UNION ALL SELECT 'final_cluster', count(DISTINCT final_cluster), 0, 0 FROM eligible
    UNION ALL SELECT 'source_group', count(*), sum(CASE WHEN s > 1 THEN 1 ELSE 0 END)::BIGINT, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT
        FROM (SELECT count(DISTINCT split) AS s, count(*) AS n FROM eligible GROUP BY source_group)""")
def leakage_audit(spark, sf):
    return publish.leakage(curated(spark, sf).eligible)


@query("""SELECT archive, bit_or(CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 4 END)::INTEGER AS mask,
    count(DISTINCT split) > 1 AS collision FROM eligible GROUP BY archive""")
def split_mask_collisions(spark, sf):
    return publish.split_masks(curated(spark, sf).eligible, "archive")


@query("""SELECT t.archive, t.documents, t.kept, b.bits FROM
    (SELECT f.archive, count(*) AS documents, count(e.id) AS kept FROM fp f LEFT JOIN eligible e ON e.id = f.id GROUP BY f.archive) t JOIN
    (SELECT archive, string_agg(lower(printf('%02x', v)), '' ORDER BY byte) AS bits FROM (
        SELECT f.archive, f.manifest_index // 8 AS byte, sum(CASE WHEN e.id IS NULL THEN 0 ELSE (1 << (f.manifest_index % 8)::INTEGER) END)::INTEGER AS v
        FROM fp f LEFT JOIN eligible e ON e.id = f.id GROUP BY 1, 2) GROUP BY archive) b ON b.archive = t.archive""")
def keep_bits(spark, sf):
    c = curated(spark, sf)
    return publish.keep_bits(tables.inventory(c.fp.select("id", "archive")), c.eligible)


@query("SELECT f.archive, f.manifest_index, f.id, e.id IS NOT NULL AS keep FROM fp f LEFT JOIN eligible e ON e.id = f.id")
def kept_by_bits(spark, sf):
    """Documents joined by place with the bitmap that says whether they stay."""
    c = curated(spark, sf)
    indexed = cut(tables.inventory(c.fp.select("id", "archive")))
    return publish.kept_by_bits(indexed, publish.keep_pieces(indexed, c.eligible))


@query(f"""SELECT (row_number() OVER (ORDER BY CASE i.split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, i.category))::INTEGER AS cell, i.split, i.category,
    input_documents, coalesce(documents, 0) AS documents, coalesce(tokens, 0)::BIGINT AS tokens, 5000::BIGINT AS target,
    greatest(5000 - coalesce(tokens, 0), 0)::BIGINT AS shortfall, greatest(coalesce(tokens, 0) - 5000, 0)::BIGINT AS surplus, true AS consistent
    FROM (SELECT {oracle.split_of('source_group')} AS split, bucket AS category, count(*) AS input_documents FROM fp GROUP BY 1, 2) i
    LEFT JOIN (SELECT split, category, count(*) AS documents, sum(words) AS tokens FROM eligible GROUP BY 1, 2) e ON e.split = i.split AND e.category = i.category""")
def selected_totals(spark, sf):
    """Every cell that documents fall into, against 5,000 tokens each."""
    c = curated(spark, sf)
    inputs = cut(c.fp.select(split_of(F.col("source_group"), SPLIT).alias("split"), F.col("bucket").alias("category"), "words"))
    quotas = inputs.select("split", "category").distinct().withColumn("target", F.lit(5000).cast("long"))
    return publish.selected_totals(inputs, c.eligible, quotas)


@query("""SELECT q.split, q.category, 5000::BIGINT AS target, sum(e.words)::BIGINT AS tokens, greatest(5000 - sum(e.words), 0)::BIGINT AS shortfall,
    greatest(sum(e.words) - 5000, 0)::BIGINT AS surplus FROM quotas q JOIN eligible e ON e.split = q.split AND e.category = q.category GROUP BY q.split, q.category""")
def reference_quota_gap(spark, sf):
    c = curated(spark, sf)
    seen = c.eligible.groupBy("split", "category").agg(F.sum("words").alias("tokens"))
    return publish.quota_gap(seen, c.quotas.select("split", "category", F.lit(5000).cast("long").alias("target")))


@query("SELECT id, reason FROM reasons WHERE id NOT IN (SELECT id FROM fp WHERE bucket <> 'en')")
def orphan_reasons(spark, sf):
    """Reasons whose document isn't in a table of the other languages."""
    c = curated(spark, sf)
    return dq.orphans(c.reasons, c.fp.where("bucket <> 'en'"), "id")


@query("SELECT l.doc_id AS key, 'missing' AS state FROM (SELECT DISTINCT doc_id FROM documents) l WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def coverage_diff(spark, sf):
    key = F.col("doc_id").alias("key")
    return dq.coverage(read(spark, sf, "documents").select(key), read(spark, sf, "labels").select(key), "key")


@query("""SELECT coalesce(a.bucket, b.bucket) AS bucket, coalesce(a.n, 0) AS finalized, coalesce(b.n, 0) AS audited, coalesce(b.n, 0) / coalesce(a.n, 0) AS coverage
    FROM (SELECT bucket, count(*) AS n FROM raw GROUP BY 1) a FULL JOIN (SELECT bucket, count(*) AS n FROM raw WHERE id IN (SELECT doc_id FROM labels) GROUP BY 1) b ON a.bucket = b.bucket""")
def coverage_full_outer(spark, sf):
    docs = tables.documents(spark, sf).select("id", "bucket")
    seen = docs.join(read(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    a, b = (x.groupBy("bucket").agg(F.count(F.lit(1)).alias(n)) for x, n in ((docs, "finalized"), (seen, "audited")))
    return a.join(b, "bucket", "full").na.fill(0).withColumn("coverage", F.col("audited") / F.col("finalized"))


@query("""SELECT * FROM (WITH once AS (SELECT content_hash, min(id) AS first_id, count(*) AS documents, sum(words)::BIGINT AS tokens FROM fp GROUP BY 1),
    merged AS (SELECT content_hash, min(first_id) AS first_id, sum(documents)::BIGINT AS documents, sum(tokens)::BIGINT AS tokens FROM (
        SELECT archive, content_hash, min(id) AS first_id, count(*) AS documents, sum(words) AS tokens FROM fp GROUP BY 1, 2)
        WHERE archive <> 'src3' GROUP BY 1)
    SELECT 'only_left' AS side, count(*) AS rows FROM (SELECT * FROM once EXCEPT ALL SELECT * FROM merged)
    UNION ALL SELECT 'only_right', count(*) FROM (SELECT * FROM merged EXCEPT ALL SELECT * FROM once))""")
def table_equality(spark, sf):
    """Counters merged from partial ones by archive, of which that of src3 is missing, against those computed at once."""
    fp = tables.stored(spark, sf)
    parts = fp.groupBy("archive", "content_hash").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("documents"), F.sum("words").alias("tokens"))
    merged = parts.where("archive != 'src3'").groupBy("content_hash").agg(F.min("first_id").alias("first_id"), F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return dq.differences(quality.clusters(fp, "content_hash"), merged)


@query("SELECT id, archive FROM raw WHERE id > 100 ORDER BY id LIMIT 50")
def keyset_page(spark, sf):
    return dq.keyset_page(tables.documents(spark, sf).select("id", "archive"), "id", 100, 50)


@query("SELECT id, final_cluster FROM mappedfp")
def near_map_applied(spark, sf):
    """The near-duplicate map laid over the provisional clusters."""
    return curated(spark, sf).fp.select("id", "final_cluster")


@query("""SELECT 'missing' AS state, count(*) AS documents FROM fp WHERE bucket = 'fr'
    UNION ALL SELECT 'unexpected', count(*) FROM fp WHERE bucket = 'de'
    UNION ALL SELECT 'orphan_reason', count(*) FROM reasons WHERE id IN (SELECT id FROM fp WHERE bucket = 'es')
    UNION ALL SELECT 'empty_group', count(DISTINCT source_group) FROM fp WHERE source_group NOT IN (SELECT source_group FROM eligible)""")
def referential_audit(spark, sf):
    """What hangs loose between tables, here with planted faults: a map without French documents and with unknown German
    ones, reasons against a table without Spanish documents, and groups of which no document is eligible."""
    c = curated(spark, sf)
    ids = c.fp.select(F.when(F.col("bucket") == "de", -1 - F.col("id")).otherwise(F.col("id")).alias("id"), "bucket").where("bucket != 'fr'")
    covered = dq.coverage(c.fp.where("bucket != 'de'"), ids, "id").groupBy("state").agg(F.count(F.lit(1)).alias("documents"))
    loose = dq.orphans(c.reasons, c.fp.where("bucket != 'es'"), "id").agg(F.lit("orphan_reason").alias("state"), F.count(F.lit(1)).alias("documents"))
    empty = dq.orphans(c.fp.select("source_group").distinct(), c.eligible, "source_group").agg(F.lit("empty_group").alias("state"), F.count(F.lit(1)).alias("documents"))
    return covered.unionByName(loose).unionByName(empty)


_IDENTITY = """SELECT page_id AS id, page_id % 3 = 0 AS code, CASE WHEN page_id % 3 = 0 THEN nullif(trim(CASE WHEN page_id % 5 = 0 THEN '  ' ELSE host END), '')
    ELSE coalesce(nullif(trim(CASE WHEN page_id % 2 = 0 THEN url ELSE ' ' END), ''), nullif(trim(CASE WHEN page_id % 7 = 0 THEN '' ELSE page_id::VARCHAR END), '')) END AS identity
    FROM (SELECT page_id, url, regexp_extract(url, '://([^/]*)', 1) AS host FROM pages)"""


def identities(spark, sf) -> DataFrame:
    """Pages as code files, known by their host, and as articles, known by url or else id; some lack what names them."""
    i, host = F.col("page_id"), F.regexp_extract("url", "://([^/]*)", 1)
    code = curate.first_named(F.when(i % 5 == 0, "  ").otherwise(host))
    article = curate.first_named(F.when(i % 2 == 0, F.col("url")).otherwise(" "), F.when(i % 7 == 0, "").otherwise(i.cast("string")))
    return read(spark, sf, "pages").select(i.alias("id"), (i % 3 == 0).alias("code"), F.when(i % 3 == 0, code).otherwise(article).alias("identity"))


@query(f"""SELECT id, code, identity, sha256(CASE WHEN code THEN 'code-repository' ELSE 'english-source' END || chr(0) || identity) AS source_group FROM ({_IDENTITY})""")
def source_identity(spark, sf):
    return curate.source_groups(identities(spark, sf))


@query(f"SELECT id, CASE WHEN code THEN '{curate.MISSING_REPO}' ELSE '{curate.MISSING_ENGLISH}' END AS reason FROM ({_IDENTITY}) WHERE identity IS NULL")
def missing_identity(spark, sf):
    return curate.missing_identity(identities(spark, sf))


@query(f"""SELECT count(*) AS documents, count(*) FILTER (WHERE g <> source_group) AS group_mismatches, count(*) FILTER (WHERE {oracle.split_of('g')} <> split) AS split_mismatches
    FROM (SELECT e.source_group, e.split, sha256('english-source' || chr(0) || d.source || '/' || ((d.doc_id + CASE WHEN d.doc_id % 50 = 0 THEN 10 ELSE 0 END) // 10)::VARCHAR) AS g
        FROM eligible e JOIN documents d ON d.doc_id = e.id)""")
def provenance_rederived(spark, sf):
    """Groups and splits derived again from the source rows, some of which have moved on, against those that curation stored."""
    c = curated(spark, sf)
    moved = F.expr("(doc_id + if(doc_id % 50 = 0, 10, 0)) div 10").cast("string")
    again = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.concat(F.lit("english-source\0"), "source", F.lit("/"), moved), 256).alias("g"))
    rows = c.eligible.join(again, "id")
    wrong = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return rows.agg(F.count(F.lit(1)).alias("documents"), wrong(F.col("g") != F.col("source_group")).alias("group_mismatches"), wrong(split_of(F.col("g"), SPLIT) != F.col("split")).alias("split_mismatches"))
