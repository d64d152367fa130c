"""Queries: the branches that the main path over prose doesn't take, with part of the languages standing in for code."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from textmill.config import QUALITY, SFT
from textmill.functions import text as tx
from textmill.operators import admission, benchmark, curate, publish, quality, sft
from textmill.plans.curation import curated
from textmill.plans.oracle import _HARD, quoted
from textmill.plans.registry import Registry
from textmill.sources import sinks, tables
from textmill.storage import cut, read, shared_dir

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
#: Languages whose documents count as code here.
CODE = ("fr",)


@query(f"""SELECT id, array_to_string(list_sort(list_filter(list_concat(list_filter(flags, lambda f: f <> 'too_short'), [CASE WHEN size_bytes < {QUALITY.short_bytes} THEN 'too_short' END,
    CASE WHEN lines <= {QUALITY.minified_lines} AND max_line_chars > {QUALITY.minified_line} THEN 'likely_minified' END]), lambda f: f IS NOT NULL)), ',') AS flags FROM flagged WHERE bucket = 'fr'""")
def code_quality_flags(spark, sf):
    """Flags by the rules for code: short by bytes, and minified lines."""
    docs = tx.with_lines(tables.documents(spark, sf).where(F.col("bucket").isin(*CODE)))
    m = tx.measures(F.col("text"))
    rows = docs.select("id", "text", *(c.alias(k) for k, c in m.items()))
    return rows.select("id", F.array_join(tx.flags(F.col("text"), {k: F.col(k) for k in m}, QUALITY, code=True), ",").alias("flags"))


@query(f"""SELECT id, 'quality:' || flag AS reason FROM (SELECT id, unnest(list_concat(list_filter(flags, lambda f: f <> 'too_short'), [CASE WHEN size_bytes < {QUALITY.short_bytes} THEN 'too_short' END,
    CASE WHEN lines <= {QUALITY.minified_lines} AND max_line_chars > {QUALITY.minified_line} THEN 'likely_minified' END])) AS flag FROM flagged WHERE bucket = 'fr')
    WHERE flag IN ({_HARD}, {', '.join(map(quoted, QUALITY.hard_code))})""")
def code_reject_reasons(spark, sf):
    docs = code_quality_flags(spark, sf).withColumn("flags", F.split("flags", ","))
    return curate.quality_reasons(docs, replace(QUALITY, hard=QUALITY.hard + QUALITY.hard_code))


@query(f"""SELECT r.id, CASE WHEN r.reason = '{curate.NEAR}' AND f.bucket = 'fr' THEN '{curate.NORMALIZED}' ELSE r.reason END AS reason FROM residual r JOIN fp f ON f.id = r.id""")
def code_residual_reasons(spark, sf):
    """Code that another document stands for is a normalized duplicate, prose a near one."""
    c = curated(spark, sf)
    return curate.residual(c.clean, c.exact, c.final, CODE)


_ITEM = """SELECT item_id, text, 'def item_' || item_id || '(x):' || chr(10) || '    return ' || repeat('x + ', 12) || item_id AS code,
    ['assert item_' || item_id || '(1) == ' || repeat('1', 20), 'short'] AS tests FROM benchmark"""
_BARE = "list_filter(list_transform(string_split({}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"


@query(f"""SELECT DISTINCT kind, digest FROM (
    SELECT 'strong' AS kind, sha256(x) AS digest FROM (SELECT unnest({_BARE.format('text')}) AS x FROM ({_ITEM}) UNION ALL SELECT unnest(tests) FROM ({_ITEM})) WHERE length(x) >= {benchmark.STRONG}
    UNION ALL SELECT 'exact', sha256(array_to_string({_BARE.format('code')}, chr(10))) FROM ({_ITEM})
    UNION ALL SELECT 'pair', sha256(b[i] || chr(10) || b[i + 1]) FROM (SELECT {_BARE.format('code')} AS b FROM ({_ITEM})), unnest(range(1, len(b))) AS t(i) WHERE length(b[i]) + length(b[i + 1]) >= {benchmark.PAIR}
    UNION ALL SELECT 'function', 'item_' || item_id FROM benchmark)""")
def benchmark_code_denylist(spark, sf):
    """Denylist of items that have code and tests beside their text."""
    i = F.col("item_id").cast("string")
    code = F.concat(F.lit("def item_"), i, F.lit("(x):\n    return "), F.repeat(F.lit("x + "), F.lit(12)), i)
    tests = F.array(F.concat(F.lit("assert item_"), i, F.lit("(1) == "), F.repeat(F.lit("1"), F.lit(20))), F.lit("short"))
    return benchmark.denylist(read(spark, sf, "benchmark").select("text", code.alias("code"), tests.alias("tests")), code="code", tests=("tests",))


_META = """SELECT r.*, CASE WHEN t % 9 = 1 THEN NULL ELSE '{"a": 1}' END AS llm_judgement, CASE WHEN t % 9 = 2 THEN '{' WHEN t % 9 = 3 THEN '[1]' ELSE '[1, 2]' END AS unit_tests,
    CASE WHEN t % 9 = 4 THEN 'x' ELSE '["pass", "fail"]' END AS tests_execution_status, t FROM (SELECT *, ('0x' || substr(id, 1, 6))::BIGINT AS t FROM sft_split) r"""


@query(f"""SELECT id, CASE WHEN reason IS NOT NULL AND (reason LIKE 'schema:%' OR reason LIKE 'quality:%') AND reason <> 'quality:rendering' THEN reason
    WHEN llm_judgement IS NULL THEN 'schema:metadata' WHEN unit_tests = '{{' THEN 'schema:unit-tests-json' WHEN tests_execution_status = 'x' THEN 'schema:test-status-json'
    WHEN unit_tests = '[1]' THEN 'schema:test-count-mismatch' ELSE reason END AS reason FROM ({_META})""")
def sft_metadata_decisions(spark, sf):
    """Rows whose judgement, tests and statuses are checked as well; some are missing, broken or don't fit."""
    from textmill.plans import sft as plans

    rows = plans.source(spark, sf)
    t = F.conv(F.substring("id", 1, 6), 16, 10).cast("long") % 9
    rows = rows.withColumns({
        "llm_judgement": F.when(t == 1, F.lit(None)).otherwise('{"a": 1}'), "unit_tests": F.when(t == 2, "{").when(t == 3, "[1]").otherwise("[1, 2]"),
        "tests_execution_status": F.when(t == 4, "x").otherwise('["pass", "fail"]'),
    })
    return sft.decide(rows, SFT, cut(plans.bad_groups(spark, sf, rows)), metadata=True).select("id", "reason")


@query("""SELECT sha256(string_agg(part, '' ORDER BY batch)) AS digest, count(*) AS batches, sum(n)::BIGINT AS rows FROM (
    SELECT batch, count(*) AS n, sha256(string_agg(row, chr(10) ORDER BY place)) AS part FROM (
        SELECT place, place // 64 AS batch, sha256(id::VARCHAR || '|' || bucket || '|' || archive || '|' || size_bytes::VARCHAR) AS row FROM (
            SELECT *, row_number() OVER (ORDER BY id) - 1 AS place FROM raw)) GROUP BY batch)""")
def ordered_digest(spark, sf):
    """Digest of a table that tells its order: rows into batches, batches into one."""
    return quality.ordered_digest(tables.documents(spark, sf), ["id", "bucket", "archive", "size_bytes"], ["id"], 64)


@query("""SELECT count(*) AS groups, count(*) FILTER (WHERE buckets > 1) AS in_several_buckets, max(buckets) AS most_buckets FROM (
    SELECT source_group, count(DISTINCT bucket) AS buckets FROM eligible GROUP BY source_group)""")
def cross_bucket_groups(spark, sf):
    """Source groups whose documents lie in several buckets."""
    return publish.cross_buckets(curated(spark, sf).eligible)


@query("""SELECT key, CASE WHEN l IS NULL THEN 'without_record' ELSE 'without_file' END AS state FROM (
    SELECT coalesce(f.key, l.key) AS key, f.key AS f, l.key AS l FROM (SELECT DISTINCT lang || '/' || source AS key FROM documents WHERE source <> 'src2') f
    FULL JOIN (SELECT DISTINCT lang || '/' || source AS key FROM documents WHERE lang <> 'es') l ON l.key = f.key) WHERE f IS NULL OR l IS NULL""")
def raw_file_closure(spark, sf):
    """Raw files without a ledger record and records without a file, here with one archive and one language lost."""
    docs = tables.documents(spark, sf).select("bucket", "archive", F.concat_ws("/", "bucket", "archive").alias("key"))
    return admission.file_closure(docs.where("archive != 'src2'"), docs.where("bucket != 'es'"), "key")


@query("""SELECT unnest(['version', 'manifest_index', 'key', 'flag_without_reason', 'reason_without_flag', 'tokens']) AS rule, unnest([
    count(*) FILTER (WHERE id % 20 = 1), sum(CASE WHEN id % 20 = 2 THEN 1 ELSE 0 END), count(*) FILTER (WHERE id % 20 = 3),
    count(*) FILTER (WHERE id % 20 = 4), count(*) FILTER (WHERE id % 20 = 5), count(*) FILTER (WHERE id % 20 = 6 OR words <= 0)])::BIGINT AS violations FROM fp""")
def fingerprint_record_audit(spark, sf):
    """Rules of fingerprint records, each broken by one document in twenty."""
    i, contaminated = F.col("id") % 20, F.lit("benchmark_contamination")
    fp = tables.inventory(tables.fingerprints(spark, sf))
    rows = fp.select(
        "id", "archive", F.when(i == 1, 0).otherwise(1).alias("version"), F.when(i == 2, -1).otherwise(F.col("manifest_index")).alias("manifest_index"),
        F.when(i == 3, F.reverse("key")).otherwise(F.col("key")).alias("key"), F.when(i == 6, 0).otherwise(F.col("words")).alias("words"),
        F.when(i == 4, F.array_append("flags", contaminated)).otherwise(F.col("flags")).alias("flags"), F.when(i == 5, "mbpp-marker").alias("benchmark_reason"),
    )
    return quality.record_audit(rows, version=1)


_TOKENS = "list_concat(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_'']+'), lambda w: ('0x' || substr(md5(w), 1, 6))::INTEGER % 65535 + 1), CASE WHEN role = 'assistant' THEN [0] ELSE []::INTEGER[] END)"


@query(f"""SELECT conv_id, message::INTEGER AS message, (i - 1)::INTEGER AS nth, t[i]::INTEGER AS token, role = 'assistant' AS sampled, t[i] <> 0 AS content FROM (
    SELECT conv_id, role, {_TOKENS} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS message FROM conversations), unnest(range(1, len(t) + 1)) AS u(i)""")
def chat_token_masks(spark, sf):
    """Ids of every message with what training needs of them: the message, whether the model writes it, whether it is content."""
    return sft.token_masks(sft.messages(read(spark, sf, "conversations")), 65_536)


@query("SELECT conv_id, count(*) AS spans, max(stop)::BIGINT AS tokens, bool_and(start = coalesce(before, 0)) AS joined FROM (SELECT *, lag(stop) OVER (PARTITION BY conv_id ORDER BY message) AS before FROM ("
       f"SELECT conv_id, message, sum(n) OVER w - n AS start, sum(n) OVER w AS stop FROM (SELECT conv_id, len({_TOKENS}) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS message FROM conversations)"
       " WINDOW w AS (PARTITION BY conv_id ORDER BY message))) GROUP BY conv_id")
def chat_message_spans(spark, sf):
    """Where each message's ids begin and end in its conversation, and that the spans meet."""
    spans = sft.message_spans(sft.messages(read(spark, sf, "conversations")), 65_536)
    before = F.coalesce(F.get(F.col("spans"), F.col("i") - 1)["stop"], F.lit(0))
    each = spans.select("conv_id", "spans", F.posexplode("spans").alias("i", "s")).select("conv_id", "s", (F.when(F.col("i") == 0, 0).otherwise(before) == F.col("s.start")).alias("ok"))
    return each.groupBy("conv_id").agg(F.count(F.lit(1)).alias("spans"), F.max("s.stop").cast("long").alias("tokens"), F.bool_and("ok").alias("joined"))


@query("SELECT DISTINCT sha256('short' || ':' || text) AS rejection_id, 'short' AS reason FROM documents WHERE length(text) < 800")
def rejection_sink(spark, sf):
    """Rejections appended in two runs, the second with all of the first once more."""
    at, docs = f"{shared_dir(spark)}/{uuid.uuid4().hex}", read(spark, sf, "documents")
    for most in (400, 800):
        rows = docs.where(F.length("text") < most).select(F.sha2(F.concat_ws(":", F.lit("short"), "text"), 256).alias("rejection_id"), F.lit("short").alias("reason"))
        sinks.append_once(rows, at, "rejection_id")
    return spark.read.parquet(at)
