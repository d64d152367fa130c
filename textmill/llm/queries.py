"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.llm import ann, bpe, lang_id, line_dedup, mixing, secrets, simhash, topk, toxicity, url_filter
from textmill.llm.common import read, spread

URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def documents(spark, sf_dir):
    """The documents, over all cores where their files give fewer tasks than that: texts cost the most here."""
    return spread(read(spark, sf_dir, "documents"), "doc_id")


def op1_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    kept = line_dedup.dedup_lines(docs.withColumn("n_lines", F.size(F.split("text", "\n"))))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines"))
    return kept.select(
        "doc_id", n.cast("long").alias("n_lines"), F.col("__removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5")
    )


def op2_url_filter(spark, sf_dir):
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op3_ann(spark, sf_dir):
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def remainder(modulus: int, doc_id=None):
    """crc32 of the doc_id's text, modulo; null for a null id."""
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string")) % modulus


def op4_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), usable=remainder(5) != 0)
    held = F.coalesce(remainder(5) == 0, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "fingerprint", "component_id")


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op6_bpe(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", bpe.digests(spark, F.col("text"), *vocabulary()).alias("d")).select("doc_id", "d.*")


def op7_topk(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_mixing(spark, sf_dir):
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_lang_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = lang_id.train(docs, usable=lambda i: remainder(4, i) != 2)
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), lang_id.predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.*")


def op10_secrets(spark, sf_dir):
    forest = secrets.train(secrets.labelled_findings(spark))
    found = secrets.scan(documents(spark, sf_dir), forest)
    return found.select("doc_id", "nth", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_url_filter, op3_ann, op4_toxicity, op5_simhash, op6_bpe, op7_topk, op8_mixing, op9_lang_id, op10_secrets,
        pipeline,
    )
}

ORACLES = {
    "op1_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, source, md5(text) AS doc, i - 1 AS pos, string_split(text, chr(10))[i] AS line,
                   trim(string_split(text, chr(10))[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare
            FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)
        ), spread AS (
            SELECT bare, min(coalesce(doc_id, 9223372036854775807)) AS first_id FROM lines WHERE bare <> ''
            GROUP BY bare HAVING count(DISTINCT coalesce(source, chr(0))) >=
                CASE WHEN len(regexp_extract_all(bare, '[^\\x20\\x09-\\x0D]+')) >= {line_dedup.LONG_WORDS} THEN {line_dedup.LONG_SITES} ELSE {line_dedup.MIN_SITES} END
        ), firsts AS (
            SELECT l.bare, any_value(s.first_id) AS first_id, min(l.pos) AS first_pos
            FROM lines l JOIN spread s ON l.bare = s.bare AND coalesce(l.doc_id, 9223372036854775807) = s.first_id GROUP BY l.bare
        ), marked AS (
            SELECT l.*, f.bare IS NOT NULL AND NOT (l.doc_id = f.first_id AND l.pos = f.first_pos) AS repeated
            FROM lines l LEFT JOIN firsts f ON l.bare = f.bare
        ), judged AS (
            SELECT *, repeated AND sum(CASE WHEN repeated THEN length(bare) ELSE 0 END) OVER (PARTITION BY doc_id) * {line_dedup.MOST[1]}
                   <= sum(length(bare)) OVER (PARTITION BY doc_id) * {line_dedup.MOST[0]} AS gone
            FROM marked
        ), kept AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
                   coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
            FROM judged GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
               length(k.text) AS n_chars, md5(k.text) AS text_md5
        FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op2_url_filter": """
        WITH rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
            ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ), parts AS (
            SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), fits AS (
            SELECT p.page_id, r.rule_host || r.rule_path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host) DESC, length(rule_path) DESC, verdict DESC) AS n
            FROM parts p JOIN rules r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
        )
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.n = 1""",
    "op7_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op8_mixing": """
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                   ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, 2 * source_size AS top, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
                   sum(source_size) OVER () AS total FROM sources
        ), rising AS (
            SELECT *, sum(w) OVER () AS weights,
                   coalesce(sum(top) OVER (ORDER BY top * 6 // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top_before,
                   coalesce(sum(w) OVER (ORDER BY top * 6 // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
            FROM weighed
        ), capped AS (
            SELECT *, (total * 3 - top_before * 2) * w > top * 2 * (weights - w_before) AS capped FROM rising
        ), goals AS (
            SELECT source, source_size, CASE WHEN capped THEN top::DOUBLE ELSE
                   (w * (total * 3 - sum(CASE WHEN capped THEN top ELSE 0 END) OVER () * 2))::DOUBLE
                   / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER () * 2)::DOUBLE END AS target FROM capped
        ), budgets AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goals
        ), hashes AS (
            SELECT source, h, sum(size) AS here, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM sized GROUP BY source, h
        ), taken AS (
            SELECT x.source, x.h, upto - here < target - whole * source_size
                   AND (upto <= target - whole * source_size OR (target - whole * source_size - (upto - here)) * 2 >= here) AS more
            FROM hashes x JOIN budgets b ON x.source IS NOT DISTINCT FROM b.source
        )
        SELECT d.doc_id, d.size::BIGINT AS size, b.source_size, b.target, (d.size * (b.whole + CASE WHEN t.more THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
        JOIN taken t ON d.source IS NOT DISTINCT FROM t.source AND d.h = t.h""",
}
