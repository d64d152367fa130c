"""Queries: admission, quarantine, ledgers, closure, archives and incremental ingestion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.functions.prefix import ordinal
from textmill.operators import admission
from textmill.plans.oracle import QUARANTINE, quoted
from textmill.plans.registry import Registry
from textmill.sources import archives, contracts, jsonl, tables
from textmill.sources.sinks import file_digests
from textmill.storage import cut, read, shared_dir
from textmill.streaming import ingest

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
LISTS = {"prose": ("en", "fr"), "other_prose": ("de", "es")}
_LIST = "CASE WHEN lang IN ('en', 'fr') THEN 'prose' WHEN lang IN ('de', 'es') THEN 'other_prose' END"
SUFFIX = "^.+(\\.[^./]+)$"


def scratch(spark) -> str:
    """A folder of its own in the shared one; what a query returns reads it, so it goes with the shared folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query(f"SELECT page_id, coalesce({QUARANTINE}, false) AS quarantined FROM (SELECT page_id, replace(lower(url), '\\', '/') AS s FROM pages)")
def url_quarantine(spark, sf):
    return read(spark, sf, "pages").select("page_id", admission.quarantined(F.col("url")).alias("quarantined"))


@query(f"SELECT id, {QUARANTINE} AS quarantined FROM (SELECT doc_id AS id, replace(lower(source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'tests\\Human_Eval' ELSE 'src' END), '\\', '/') AS s FROM documents)")
def path_quarantine(spark, sf):
    path = F.when(F.col("doc_id") % 7 == 0, "tests\\Human_Eval").otherwise("src")
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), admission.quarantined(F.col("source"), path).alias("quarantined"))


@query(f"SELECT doc_id AS id, {_LIST} AS list FROM documents")
def language_policy(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), admission.classify_language(F.col("lang"), LISTS).alias("list"))


_SCORE = "(doc_id * 37 % 100) / 100.0::DOUBLE"


@query(f"""SELECT id, CASE WHEN trim(regexp_replace(text, '\\s', '', 'g')) = '' THEN 'empty' WHEN lang <> 'en' OR score < 0.3 THEN 'language'
    WHEN id % 17 = 0 THEN 'quarantined_url' WHEN id IN (SELECT id FROM guard WHERE reason IS NOT NULL) THEN 'benchmark'
    WHEN len(regexp_extract_all(text, {quoted(tx.WORD)})) = 0 THEN 'not_english' END AS skip
    FROM (SELECT doc_id AS id, coalesce(text, '') AS text, lang, {_SCORE} AS score FROM documents)""")
def english_admission(spark, sf):
    from textmill.plans.curation import curated

    hit = curated(spark, sf).guard.select("id", F.lit(True).alias("hit"))
    docs = tables.documents(spark, sf).join(hit, "id", "left")
    url = F.when(F.col("id") % 17 == 0, "https://x.example/HumanEval/1").otherwise("https://x.example/1")
    score = (F.col("id") * 37 % 100) / F.lit(100.0)
    skip = admission.english_skip(F.col("text"), F.col("bucket"), score, url, F.coalesce("hit", F.lit(False)), tx.word_count(F.col("text")), 0.3)
    return docs.select("id", skip.alias("skip"))


@query(f"""SELECT id, CASE WHEN list IS NULL THEN 'language' WHEN id % 23 = 0 THEN 'vendor' WHEN id % 19 = 0 THEN 'not_code' WHEN id % 7 = 0 THEN 'quarantined'
    WHEN text = '' THEN 'not_code_content' WHEN len(regexp_extract_all(text, {quoted(tx.WORD)})) = 0 THEN 'not_code_tokens' END AS skip
    FROM (SELECT doc_id AS id, coalesce(text, '') AS text, {_LIST} AS list FROM documents)""")
def code_admission(spark, sf):
    docs, i = tables.documents(spark, sf), F.col("id")
    licence = F.when(i % 19 == 0, "copyleft").otherwise("permissive")
    path = F.when(i % 7 == 0, "eval/MBPP.py").otherwise("src/a.py")
    skip = admission.code_skip(F.col("bucket"), F.lit(False), i % 23 == 0, licence, F.col("archive"), path, F.col("text"), F.lit(False), tx.word_count(F.col("text")), LISTS)
    return docs.select("id", skip.alias("skip"))


@query("""SELECT id, bucket, before::BIGINT AS before, before < 20000 AS accepted FROM (SELECT id, bucket,
    coalesce(sum(words) OVER (PARTITION BY bucket ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM measured)""")
def bucket_cutoff(spark, sf):
    docs = tables.documents(spark, sf).select("id", "bucket", tx.word_count(F.col("text")).alias("tokens"))
    targets = docs.select("bucket").distinct().withColumn("target", F.lit(20_000))
    return admission.bucket_cutoff(docs, targets, ["id"]).select("id", "bucket", "before", "accepted")


@query(f"""SELECT page_id, CASE WHEN regexp_matches(s, '^\\.[A-Za-z0-9_+.-]+$') AND length(s) <= 16 THEN s ELSE '' END AS suffix
    FROM (SELECT page_id, regexp_extract(regexp_extract(replace(url, '\\', '/'), '[^/]*$', 0), '^.+(\\.[^.]+)$', 1) AS s FROM pages)""")
def safe_suffixes(spark, sf):
    return read(spark, sf, "pages").select("page_id", admission.safe_suffix(F.col("url")).alias("suffix"))


@query("""SELECT page_id, path <> '' AND NOT regexp_matches(path, '^/|\\\\|[\\x00-\\x1f]') AND len(list_filter(string_split(path, '/'), lambda p: p IN ('', '.', '..'))) = 0 AS safe
    FROM (SELECT page_id, regexp_extract(url, '://[^/]*/?(.*)', 1) AS path FROM pages)""")
def safe_members(spark, sf):
    return read(spark, sf, "pages").select("page_id", admission.safe_member(F.regexp_extract("url", "://[^/]*/?(.*)", 1)).alias("safe"))


@query("""SELECT filename AS name, (row_number() OVER (ORDER BY sha256('seed' || chr(0) || filename)) - 1)::BIGINT AS place FROM (SELECT DISTINCT source AS filename FROM documents)""")
def seeded_order(spark, sf):
    names = read(spark, sf, "documents").select(F.col("source").alias("name")).distinct()
    return ordinal(names.withColumn("h", F.sha2(F.concat(F.lit("seed\0"), "name"), 256)), ["h"], "place").select("name", "place")


@query("""SELECT name, place % 3 AS worker, place // 3 AS turn, (100 + place)::BIGINT AS archive FROM (SELECT name, (row_number() OVER (ORDER BY name) - 1)::BIGINT AS place FROM (SELECT DISTINCT source AS name FROM documents))""")
def shard_assignment(spark, sf):
    """Shards dealt to three workers in turn; archive numbers 100 + worker + 3 * turn never clash."""
    names = ordinal(read(spark, sf, "documents").select(F.col("source").alias("name")).distinct(), ["name"], "place")
    worker, turn = F.col("place") % 3, F.floor(F.col("place") / 3)
    return names.select("name", worker.alias("worker"), turn.alias("turn"), (F.lit(100) + worker + 3 * turn).alias("archive"))


_ARCHIVES = "SELECT archive, min(bucket) AS bucket, sum(size_bytes)::BIGINT AS bytes FROM raw GROUP BY archive"


def _discovered(spark, sf, retry: bool) -> DataFrame:
    """Archives that hold Spanish documents have a ledger record, those with a document numbered 3 modulo 40 a report,
    those with one numbered 5 modulo 50 an error."""
    docs = tables.documents(spark, sf)
    found = docs.groupBy("archive").agg(F.min("bucket").alias("bucket"), F.sum("size_bytes").alias("bytes"))
    of = lambda condition: docs.where(condition).select("archive")
    return admission.discover(found, of("bucket = 'es'"), of("id % 40 = 3"), of("id % 50 = 5"), retry).select("archive", "bucket", "bytes", "place")


def _discovery(retry: bool) -> str:
    less = "" if retry else "AND archive NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 5)"
    return f"""SELECT archive, bucket, bytes, row_number() OVER (ORDER BY bytes, bucket, archive) AS place FROM ({_ARCHIVES})
    WHERE archive IN (SELECT source FROM documents WHERE lang = 'es') AND archive NOT IN (SELECT source FROM documents WHERE doc_id % 40 = 3) {less}"""


@query(_discovery(False))
def archive_discovery(spark, sf):
    """Archives with a ledger record and neither report nor error, smallest first."""
    return _discovered(spark, sf, False)


@query(_discovery(True))
def archive_retry(spark, sf):
    """The same with those whose run failed."""
    return _discovered(spark, sf, True)


def ledger(spark, sf) -> DataFrame:
    """One record for each archive and language."""
    docs = tables.documents(spark, sf).select("archive", "bucket", "size_bytes", tx.word_count(F.col("text")).alias("words"))
    rows = docs.groupBy("archive", "bucket").agg(F.count(F.lit(1)).alias("documents"), F.sum("size_bytes").alias("bytes"), F.sum("words").alias("tokens"))
    return rows.select(F.sha2(F.concat_ws(":", F.lit("pretrain"), "bucket", "archive"), 256).alias("record"), F.lit("pretrain").alias("phase"), F.lit(None).cast("string").alias("split"), F.col("bucket").alias("category"), "archive", "documents", "bytes", "tokens")


@query("""SELECT q.name, q.target, coalesce(sum(r.words), 0)::BIGINT AS tokens, greatest(q.target - coalesce(sum(r.words), 0), 0)::BIGINT AS remaining,
    coalesce(sum(r.words), 0) / q.target AS fraction, coalesce(sum(r.words), 0) >= q.target AS reached
    FROM (SELECT unnest(['all', 'english', 'none']) AS name, unnest([NULL, 'en', 'xx']) AS category, unnest([100000, 10000000, 5])::BIGINT AS target) q
    LEFT JOIN measured r ON q.category IS NULL OR q.category = r.bucket GROUP BY q.name, q.target""")
def ledger_status(spark, sf):
    quotas = spark.createDataFrame([("all", "pretrain", None, None, 100_000), ("english", None, None, "en", 10_000_000), ("none", None, None, "xx", 5)], "name string, phase string, split string, category string, target long")
    return admission.ledger_status(ledger(spark, sf), quotas)


@query("SELECT count(DISTINCT archive || ':' || bucket) AS records, count(*) AS documents FROM raw")
def ledger_insert(spark, sf):
    """Records put in twice, which changes nothing."""
    rows = ledger(spark, sf)
    again = admission.ledger_insert(rows.where("category = 'en'"), rows, "record")
    return again.agg(F.count_distinct("record").alias("records"), F.sum("documents").alias("documents"))


@query("""SELECT bucket, 50000::BIGINT AS target, sum(words)::BIGINT AS tokens, CASE WHEN count(DISTINCT archive) <> 1 THEN 'sources' ELSE '' END AS failure FROM measured GROUP BY bucket
    UNION ALL SELECT 'it', 50000, NULL, 'missing_bucket'""")
def collection_closure(spark, sf):
    rows = ledger(spark, sf).select(F.col("category").alias("bucket"), F.col("archive").alias("source"), "documents", "tokens")
    markers = rows.groupBy("bucket").agg(F.sum("tokens").alias("tokens"))
    targets = rows.select("bucket").distinct().unionByName(spark.createDataFrame([("it",)], "bucket string")).withColumn("target", F.lit(50_000).cast("long"))
    return admission.closure(rows, markers, targets)


@query("SELECT archive, sum(size_bytes)::BIGINT AS bytes, round_even(sum(size_bytes) / 4.5::DOUBLE, 0)::BIGINT AS tokens FROM raw GROUP BY archive")
def token_estimate(spark, sf):
    sums = tables.documents(spark, sf).groupBy("archive").agg(F.sum("size_bytes").alias("bytes"))
    return sums.select("archive", "bytes", admission.estimated_tokens(F.col("bytes"), F.lit(4.5)).alias("tokens"))


@query("SELECT DISTINCT sha256('short' || ':' || text) AS rejection_id, 'short' AS reason FROM documents WHERE length(text) < 400")
def rejection_ledger(spark, sf):
    """Rejections by id, without text; the same rejection again adds nothing."""
    rows = read(spark, sf, "documents").where("length(text) < 400").select(F.sha2(F.concat_ws(":", F.lit("short"), "text"), 256).alias("rejection_id"), F.lit("short").alias("reason"))
    return rows.unionByName(rows).dropDuplicates(["rejection_id"])


@query("SELECT doc_id AS id, lang, sha256(text) AS text_sha256 FROM documents")
def jsonl_round_trip(spark, sf):
    """Documents written as compressed JSON lines and read again, with a nested field."""
    at = scratch(spark)
    jsonl.write_jsonl(read(spark, sf, "documents").select("doc_id", F.struct("text", "lang").alias("body")), at)
    rows = jsonl.read_jsonl(spark, at, "doc_id long, body struct<text: string, lang: string>")
    return rows.select(F.col("doc_id").alias("id"), F.col("body.lang").alias("lang"), F.sha2("body.text", 256).alias("text_sha256"))


@query("SELECT doc_id AS id, length(text) AS characters FROM documents WHERE text IS NOT NULL")
def jsonl_field(spark, sf):
    """A field by its dotted name, of compressed JSON lines with known digests whose lines are held to be objects."""
    at = scratch(spark)
    jsonl.write_jsonl(read(spark, sf, "documents").select("doc_id", F.struct(F.struct("text").alias("inner")).alias("body")), at)
    schema = "doc_id long, body struct<inner: struct<text: string>>"
    digests = {r.file: r.sha256 for r in file_digests(spark, at, "*.json.gz").collect()}  # a row a file
    rows = contracts.read_checked_jsonl(spark, f"{at}/*.json.gz", schema, digests)
    return rows.where("body.inner.text is not null").select(F.col("doc_id").alias("id"), F.length("body.inner.text").alias("characters"))


@query("SELECT doc_id AS id, lang, sha256(text) AS text_sha256 FROM documents")
def jsonl_zst_scan(spark, sf):
    """JSON lines under Zstandard, as the bytes of such files."""
    made = read(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "lang", "text"), {"ignoreNullFields": "false"}).alias("line"))
    at = scratch(spark)
    jsonl.zst_blobs(made).write.parquet(at)
    lines = jsonl.zst_lines(spark.read.parquet(at))
    rows = lines.select(F.from_json("line", "doc_id long, lang string, text string", {"mode": "FAILFAST"}).alias("r"))
    return rows.select(F.col("r.doc_id").alias("id"), "r.lang", F.sha2("r.text", 256).alias("text_sha256"))


@query("SELECT count(*) AS lines, sum(length(line))::BIGINT AS characters FROM (SELECT unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM documents)")
def text_lines(spark, sf):
    """Lines of compressed text files."""
    at = scratch(spark)
    read(spark, sf, "documents").where("text is not null").select(F.regexp_replace("text", r"\n\z", "")).write.option("compression", "gzip").text(at)
    return jsonl.read_text(spark, at).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("characters"))


@query("""SELECT CASE WHEN doc_id % 20 = 1 THEN 'blank' ELSE 'not_an_object' END AS problem, count(*) AS lines FROM documents WHERE doc_id % 20 IN (1, 2, 3, 4) GROUP BY 1""")
def jsonl_line_problems(spark, sf):
    """Lines that a strict reader refuses: here blank ones, arrays, broken text and numbers among objects."""
    at, i = scratch(spark), F.col("doc_id") % 20
    odd = F.when(i == 1, "  ").when(i == 2, "[1, 2]").when(i == 3, '{"a": ').when(i == 4, "17")
    read(spark, sf, "documents").select(F.coalesce(odd, F.to_json(F.struct("doc_id", "lang")))).write.option("compression", "gzip").text(at)
    return contracts.line_problems(spark, at).groupBy("problem").agg(F.sum("lines").alias("lines"))


@query("SELECT conv_id, min(turn) AS first, count(*) AS files, sum(length(text))::BIGINT AS characters FROM conversations WHERE conv_id >= 3 GROUP BY conv_id")
def repo_file_scan(spark, sf):
    """Nested files of repositories, here turns of conversations, from a saved place in the shard on."""
    at, t = scratch(spark), read(spark, sf, "conversations")
    nested = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("files"))
    nested.orderBy("conv_id").coalesce(1).write.parquet(at)
    skipped = t.where("conv_id < 3").select("conv_id").distinct().count()
    files = contracts.repo_files(spark, at, "conv_id long, files array<struct<turn: long, role: string, text: string>>", skip=skipped)
    return files.groupBy("conv_id").agg(F.min("file.turn").alias("first"), F.count(F.lit(1)).alias("files"), F.sum(F.length("file.text")).alias("characters"))


@query("SELECT conv_id, turn, role FROM conversations")
def sft_schema_scan(spark, sf):
    """Columns of files whose schema is the one expected; any other is an error."""
    return contracts.read_checked(spark, f"{sf}/conversations.parquet", "conv_id long, turn long, role string, text string", ["conv_id", "turn", "role"])


@query("SELECT count(*) AS rows, true AS agrees, true AS stable FROM documents")
def parquet_inventory(spark, sf):
    """Rows of a table's files against a contract, and a digest of the files that is the same when taken again."""
    n = read(spark, sf, "documents").count()
    first, again = (contracts.parquet_contract(spark, f"{sf}/documents.parquet", n) for _ in range(2))
    same = first.join(again.select("digest").distinct(), "digest", "left_semi").agg((F.count(F.lit(1)) == 1).alias("stable"))
    return first.select("rows", "agrees").join(F.broadcast(same))  # one row


_MANIFEST = """SELECT source AS archive, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS manifest_index, doc_id, octet_length(encode(coalesce(text, ''))) AS size_bytes FROM documents"""


@query(f"""SELECT archive, manifest_index, CASE WHEN doc_id % 30 = 1 THEN 'no_member' WHEN doc_id % 30 = 2 THEN 'no_manifest_row' WHEN doc_id % 30 = 3 THEN 'member_order' WHEN doc_id % 30 = 4 THEN 'size'
    WHEN size_bytes <= 0 OR doc_id % 30 = 5 THEN 'not_positive' END AS problem FROM ({_MANIFEST})""")
def manifest_merge(spark, sf):
    """A manifest and its members by place, with rows missing on either side, members swapped and sizes changed."""
    docs = cut(tables.inventory(tables.documents(spark, sf).select("id", "archive", "size_bytes")))
    i, path = F.col("id") % 30, F.format_string("doc-%012d.txt", "id")
    base = docs.select("id", "archive", "manifest_index", path.alias("member_path"), "size_bytes")
    manifest = base.where(i != 2).withColumn("tokens", F.when(i == 5, 0).otherwise(1))
    changed = {"member_path": F.when(i == 3, "other.txt").otherwise(F.col("member_path")), "size_bytes": F.col("size_bytes") + (i == 4).cast("long")}
    return archives.merged_manifest(manifest, base.where(i != 1).withColumns(changed).drop("id")).select("archive", "manifest_index", "problem")


_PARTS = """SELECT id, archive, content_hash, size_bytes, manifest_index, (coalesce(sum(size_bytes) OVER (PARTITION BY archive ORDER BY manifest_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 100000)::BIGINT AS part FROM fp"""


@query(f"""SELECT printf('%s-part-%06d.tar.zst', archive, part) AS archive, row_number() OVER (PARTITION BY archive, part ORDER BY manifest_index) - 1 AS manifest_index,
    printf('doc-%012d.txt', id) AS member_path, content_hash AS sha256, size_bytes FROM ({_PARTS})""")
def archive_round_trip(spark, sf):
    """Documents packed into tar.zst archives of bounded bytes and read again by member."""
    rows = tables.inventory(tables.documents(spark, sf)).select("archive", "manifest_index", F.format_string("doc-%012d.txt", "id").alias("member_path"), "text", "size_bytes")
    at = scratch(spark)
    archives.archived(archives.parts(rows, 100_000)).write.parquet(f"{at}/packed")
    stored = spark.read.parquet(f"{at}/packed")
    return archives.unpacked(stored).select("archive", "manifest_index", "member_path", "sha256", "size_bytes")


@query(f"SELECT archive, part, count(*) AS documents, sum(size_bytes)::BIGINT AS bytes FROM ({_PARTS}) GROUP BY archive, part")
def archive_parts(spark, sf):
    """Parts of an archive, bounded by bytes."""
    docs = tables.inventory(tables.documents(spark, sf).select("id", "archive", "size_bytes"))
    return archives.parts(docs, 100_000).groupBy("archive", "part").agg(F.count(F.lit(1)).alias("documents"), F.sum("size_bytes").alias("bytes"))


@query("SELECT content_hash, min(id) AS first_id, count(*) AS documents, sum(words)::BIGINT AS tokens FROM fp GROUP BY content_hash")
def stream_dedup_index(spark, sf):
    """Duplicate counters of documents that arrive as a stream of files."""
    at = scratch(spark)
    docs = read(spark, sf, "documents").select("doc_id", "text", "source")
    docs.repartition(4, "source").write.parquet(f"{at}/in")
    stream = ingest.document_stream(spark, f"{at}/in", docs.schema, files=1)
    ingest.index_duplicates(stream, f"{at}/index")
    return ingest.duplicate_index(spark, f"{at}/index")


_COUNTERS = "SELECT content_hash, min(id) AS first_id, count(*) AS documents, sum(words)::BIGINT AS tokens FROM fp GROUP BY content_hash"


@query(_COUNTERS)
def stream_resumed(spark, sf):
    """The stream ends after half of the files; begun again it takes the others and no file twice."""
    at, docs = scratch(spark), read(spark, sf, "documents").select("doc_id", "text", "source")
    for late in (False, True):
        docs.where((F.pmod(F.xxhash64("source"), F.lit(2)) == 1) == late).repartition(2, "source").write.mode("append").parquet(f"{at}/in")
        ingest.index_duplicates(ingest.document_stream(spark, f"{at}/in", docs.schema, files=1), f"{at}/index")
    return ingest.duplicate_index(spark, f"{at}/index")


@query(_COUNTERS)
def stream_by_bytes(spark, sf):
    """Batches bounded by bytes, polled until no file has come for a while."""
    at, docs = scratch(spark), read(spark, sf, "documents").select("doc_id", "text", "source")
    docs.repartition(4, "source").write.parquet(f"{at}/in")
    stream = ingest.document_stream(spark, f"{at}/in", docs.schema, most_bytes=100_000)
    ingest.index_duplicates(stream, f"{at}/index", every="200 milliseconds", idle=2.0)
    return ingest.duplicate_index(spark, f"{at}/index")
