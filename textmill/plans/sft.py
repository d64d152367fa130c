"""Queries: instruction conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.config import SFT
from textmill.operators import benchmark, sft
from textmill.plans.oracle import first_failing, prompt_split, quoted
from textmill.plans.registry import Registry
from textmill.storage import cut, read

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def source(spark, sf) -> DataFrame:
    """Prompt and completion pairs of the conversations as source rows; some are made faulty, or hold a benchmark item."""
    p = sft.pairs(read(spark, sf, "conversations"))
    item = read(spark, sf, "benchmark").orderBy("item_id").select("text").first()
    prompt = F.when(F.col("conv_id") % 17 == 4, F.concat("prompt", F.lit("\n"), F.lit(item.text if item else ""))).otherwise(F.col("prompt"))
    return p.select(
        F.md5(F.concat_ws(":", "conv_id", "turn")).alias("id"), prompt.alias("input"), F.col("completion").alias("output"),
        F.when(F.col("conv_id") % 11 == 3, "other").otherwise("generic").alias("domain"), F.lit("self-instruct").alias("generation_algorithm"),
        F.when(F.col("conv_id") % 13 == 5, 1.5).otherwise(0.5).alias("average_test_score"),
    )


def bad_groups(spark, sf, rows: DataFrame) -> DataFrame:
    deny = benchmark.denylist(read(spark, sf, "benchmark")).where("kind = 'strong'")
    hits = benchmark.hits(rows.select("id", F.concat_ws("\n", "input", "output").alias("text")), deny)
    return sft.contaminated_groups(rows, hits)


def decided(spark, sf) -> DataFrame:
    rows = source(spark, sf)
    return sft.decide(rows, SFT, cut(bad_groups(spark, sf, rows)))


@query("SELECT id, reason, split, tokens::INTEGER AS tokens FROM sft_split")
def sft_decisions(spark, sf):
    return decided(spark, sf).select("id", "reason", "split", F.col("tokens").cast("int").alias("tokens"))


@query("SELECT id, group_id FROM sft_marked")
def sft_prompt_groups(spark, sf):
    return source(spark, sf).select("id", sft.prompt_group(F.col("input")).alias("group_id"))


@query(f"SELECT DISTINCT group_id, {prompt_split('group_id')} AS split FROM sft_marked")
def sft_group_split(spark, sf):
    groups = source(spark, sf).select(sft.prompt_group(F.col("input")).alias("group_id")).distinct()
    return groups.select("group_id", sft.group_split(F.col("group_id"), SFT).alias("split"))


@query("SELECT group_id FROM sft_bad")
def sft_contaminated_groups(spark, sf):
    return bad_groups(spark, sf, source(spark, sf))


@query("SELECT coalesce(reason, 'accepted:' || split) AS outcome, domain, count(*) AS rows, sum(tokens - 1)::BIGINT AS tokens FROM sft_split GROUP BY 1, 2")
def sft_counters(spark, sf):
    return sft.counters(decided(spark, sf))


_PLANTED = """SELECT doc_id AS id, text || CASE WHEN doc_id % 25 = 7 THEN ' AKIA' || upper(substr(md5(doc_id::VARCHAR), 1, 16)) || ' ' WHEN doc_id % 25 = 8 THEN chr(10) || '-----BEGIN EC PRIVATE KEY-----'
    WHEN doc_id % 25 = 9 THEN ' ghp_' || md5(doc_id::VARCHAR) || 'abcd' WHEN doc_id % 25 = 10 THEN ' xoxb-' || md5(doc_id::VARCHAR) WHEN doc_id % 25 = 11 THEN ' AKIA' || md5(doc_id::VARCHAR) ELSE '' END AS text FROM documents"""


@query("SELECT id, kind FROM (SELECT id, " + first_failing({k: f"regexp_matches(text, {quoted(p)})" for k, p in sft.SECRETS.items()}) + f" AS kind FROM ({_PLANTED})) WHERE kind IS NOT NULL")
def secret_kinds(spark, sf):
    """Kinds of secrets in documents into which some are planted, and some that only look alike."""
    digest, turn = F.md5(F.col("doc_id").cast("string")), F.col("doc_id") % 25
    planted = {
        7: F.concat(F.lit(" AKIA"), F.upper(F.substring(digest, 1, 16)), F.lit(" ")), 8: F.lit("\n-----BEGIN EC PRIVATE KEY-----"),
        9: F.concat(F.lit(" ghp_"), digest, F.lit("abcd")), 10: F.concat(F.lit(" xoxb-"), digest), 11: F.concat(F.lit(" AKIA"), digest),
    }
    added = F.coalesce(*(F.when(turn == k, v) for k, v in planted.items()), F.lit(""))
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), sft.secret_kind(F.concat("text", added)).alias("kind"))
    return docs.where("kind is not null")


_ROLES = """SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
    first_value(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS first_role FROM conversations"""


@query(f"""SELECT conv_id, """ + first_failing({
    "unknown_role": "bool_or(role IS NULL OR role NOT IN ('system', 'user', 'assistant'))",
    "empty_content": "bool_or(text IS NULL OR trim(regexp_replace(text, '\\s', '', 'g')) = '')",
    "no_user": "NOT bool_or(role = 'user')",
    "alternation": "bool_or((first_role <> 'system' OR n > 1) AND role <> CASE WHEN (n - CASE WHEN first_role = 'system' THEN 2 ELSE 1 END) % 2 = 0 THEN 'user' ELSE 'assistant' END)",
}) + f" AS problem FROM ({_ROLES}) GROUP BY conv_id")
def chat_validity(spark, sf):
    return sft.messages(read(spark, sf, "conversations")).select("conv_id", sft.chat_problem(F.col("messages")).alias("problem"))


@query(f"""SELECT conv_id, sha256(string_agg('<|' || role || '|>' || chr(10) || text || CASE WHEN role = 'assistant' THEN '{sft.END}' ELSE '' END, chr(10) ORDER BY n)) AS rendered
    FROM ({_ROLES}) GROUP BY conv_id""")
def chat_rendered_text(spark, sf):
    return sft.messages(read(spark, sf, "conversations")).select("conv_id", F.sha2(sft.rendered(F.col("messages")), 256).alias("rendered"))


@query(f"SELECT conv_id, (n - 1)::INTEGER AS place, role, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_'']+')) AS words, role = 'assistant' AS sampled FROM ({_ROLES})")
def chat_turn_counts(spark, sf):
    rows = sft.messages(read(spark, sf, "conversations")).select("conv_id", F.explode(sft.turn_counts(F.col("messages"))).alias("t"))
    return rows.select("conv_id", "t.*")


@query(f"SELECT id, split_part(output || '{sft.END}' || input, '{sft.END}', 1) = output AS kept FROM sft_rows")
def chat_responses(spark, sf):
    """A reply read back up to its first end."""
    reply = sft.response(F.concat("output", F.lit(sft.END), "input"))
    return source(spark, sf).select("id", (reply == F.col("output")).alias("kept"))
