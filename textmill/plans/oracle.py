"""DuckDB SQL that the registered queries are held against, built from named common tables."""

from __future__ import annotations

import re

from textmill.config import LSH, PACK, QUALITY, SFT, SPLIT
from textmill.functions import text as tx
from textmill.operators import admission, benchmark, curate, sft


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def normalized(x: str) -> str:
    return collapsed(f"replace(lower({x}), 'ß', 'ss')")


def split_of(group: str) -> str:
    value = f"substr(sha256({quoted('split:' + SPLIT.seed)}::BLOB || '\\x00'::BLOB || unhex({group})), 1, 16)"
    *held, (rest, _) = SPLIT.thresholds()
    return "CASE " + " ".join(f"WHEN {value} < '{end:016x}' THEN '{name}'" for name, end in held) + f" ELSE '{rest}' END"


def prompt_split(group: str) -> str:
    digest = f"sha256({quoted(SFT.seed)} || chr(0) || {group})"
    return f"CASE WHEN ('0x' || substr({digest}, 1, 16))::UBIGINT % 1000000 < {SFT.validation_per_million} THEN 'validation' ELSE 'train' END"


def rounded(n: str, of: str, digits: int) -> str:
    """n / of to some digits, half to even."""
    scaled, of = f"(({n})::BIGINT * {10**digits})", f"greatest(({of})::BIGINT, 1)"
    rest = f"({scaled} % {of})"
    return f"({scaled} // {of} + CASE WHEN 2 * {rest} > {of} OR (2 * {rest} = {of} AND ({scaled} // {of}) % 2 = 1) THEN 1 ELSE 0 END) / {10**digits}.0::DOUBLE"


def first_failing(tests: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {quoted(name)}" for name, c in tests.items()) + " END"


ALNUM = r"[\p{L}\p{N}]"
_WORD = quoted(tx.WORD)
_HARD = ", ".join(map(quoted, QUALITY.hard))
_SOFT = " + ".join(f"CASE WHEN list_contains(flags, '{f}') THEN {w} ELSE 0 END" for f, w in sorted(QUALITY.soft.items()))
_FLAGS = {
    "empty": "text = ''",
    "high_line_repetition": f"repeated_lines > {QUALITY.repeated_lines} * nonempty_lines AND nonempty_lines >= {QUALITY.repeated_lines_from}",
    "high_url_density": f"words > 0 AND url_count / words > {QUALITY.url_density}",
    "null_character": "contains(text, chr(0))",
    "possible_generated": f"regexp_matches(lower(left(text, {QUALITY.generated_head})), {quoted('|'.join(tx.GENERATED))})",
    "possible_secret": f"regexp_matches(left(text, {QUALITY.secret_head}), {quoted('|'.join(tx.SECRETS))})",
    "replacement_character": "contains(text, '�')",
    "too_short": f"words < {QUALITY.short_words}",
    "very_long_line": f"max_line_chars > {QUALITY.long_line}",
}

CTES = {
    "raw": """SELECT doc_id AS id, sha256(source || chr(0) || doc_id::VARCHAR) AS key, lang AS bucket, source AS archive,
        coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS size_bytes,
        string_split(coalesce(text, ''), chr(10)) AS parts FROM documents""",
    "lined": f"""SELECT *, CASE WHEN len(parts) > 1 AND parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS line_list,
        list_filter(list_transform(parts, lambda x: {collapsed('x')}), lambda x: x <> '') AS bare FROM raw""",
    "measured": f"""SELECT *, length(text) AS characters, len(line_list) AS lines, len(bare) AS nonempty_lines,
        len(regexp_extract_all(text, {_WORD})) AS words, list_max(list_transform(line_list, lambda x: length(x))) AS max_line_chars,
        {rounded('length(text)', 'len(line_list)', 3)} AS mean_line_chars, len(bare) - len(list_distinct(bare)) AS repeated_lines,
        {rounded('len(bare) - len(list_distinct(bare))', 'len(bare)', 6)} AS repeated_line_fraction,
        {rounded("len(regexp_extract_all(text, '[ ' || chr(9) || '-' || chr(13) || ']'))", 'length(text)', 6)} AS whitespace_fraction,
        {rounded(f"len(regexp_extract_all(text, {quoted(ALNUM)}))", 'length(text)', 6)} AS alphanumeric_fraction,
        len(regexp_extract_all(text, {quoted(tx.URL)})) AS url_count,
        {rounded(f"len(list_filter(line_list, lambda x: regexp_matches(x, {quoted(tx.CODE_LINE)})))", 'len(line_list)', 6)} AS code_line_fraction FROM lined""",
    "flagged": "SELECT *, list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in _FLAGS.items()) + "], lambda x: x IS NOT NULL) AS flags FROM measured",
    "fp": f"""SELECT *, {_SOFT} AS penalty, sha256(text) AS content_hash, sha256({normalized('text')}) AS normalized_hash,
        sha256('english-normalized-provisional'::BLOB || '\\x00'::BLOB || unhex(sha256({normalized('text')}))) AS final_cluster,
        sha256('english-source' || chr(0) || archive || '/' || (id // 10)::VARCHAR) AS source_group,
        sha256({quoted('selection:' + SPLIT.seed)}::BLOB || '\\x00'::BLOB || unhex(key)) AS selection_rank,
        row_number() OVER (PARTITION BY archive ORDER BY id) - 1 AS manifest_index FROM flagged""",
    "deny_lines": f"SELECT list_filter(list_transform(string_split(text, chr(10)), lambda x: {collapsed('x')}), lambda x: x <> '') AS bare FROM benchmark",
    "strong": f"SELECT DISTINCT sha256(x) AS digest FROM (SELECT unnest(bare) AS x FROM deny_lines) WHERE length(x) >= {benchmark.STRONG}",
    "deny_pairs": f"""SELECT DISTINCT sha256(bare[i] || chr(10) || bare[i + 1]) AS digest FROM deny_lines, unnest(range(1, len(bare))) AS t(i)
        WHERE length(bare[i]) + length(bare[i + 1]) >= {benchmark.PAIR}""",
    "deny_exact": "SELECT DISTINCT sha256(array_to_string(bare, chr(10))) AS digest FROM deny_lines WHERE len(bare) > 0",
    "hits": f"""SELECT id, 'strong' AS kind, count(DISTINCT sha256(x)) AS hits FROM (SELECT id, unnest(bare) AS x FROM fp)
            WHERE length(x) >= {benchmark.STRONG} AND sha256(x) IN (SELECT digest FROM strong) GROUP BY id
        UNION ALL SELECT id, 'pair', count(DISTINCT sha256(bare[i] || chr(10) || bare[i + 1])) FROM fp, unnest(range(1, len(bare))) AS t(i)
            WHERE length(bare[i]) + length(bare[i + 1]) >= {benchmark.PAIR} AND sha256(bare[i] || chr(10) || bare[i + 1]) IN (SELECT digest FROM deny_pairs) GROUP BY id
        UNION ALL SELECT id, 'exact', 1 FROM fp WHERE sha256(array_to_string(bare, chr(10))) IN (SELECT digest FROM deny_exact)""",
    "guard": f"""SELECT id, {first_failing({
        'mbpp-marker': f"regexp_matches(lower(text), {quoted(benchmark.MARKER)})",
        'mbpp-json-shape': ' AND '.join(f"contains(lower(text), {quoted(k)})" for k in benchmark.JSON_KEYS),
        'mbpp-exact-code': "id IN (SELECT id FROM hits WHERE kind = 'exact')",
        'mbpp-problem-or-test': "id IN (SELECT id FROM hits WHERE kind = 'strong')",
        'mbpp-embedded-code': "id IN (SELECT id FROM hits WHERE kind = 'pair' AND hits >= 2)",
    })} AS reason FROM fp""",
    "quality_reasons": f"SELECT id, 'quality:' || flag AS reason FROM (SELECT id, unnest(flags) AS flag FROM fp) WHERE flag IN ({_HARD})",
    "reasons0": "SELECT * FROM quality_reasons UNION ALL SELECT id, 'benchmark:' || reason FROM guard WHERE reason IS NOT NULL",
    "mappedfp": """SELECT f.* EXCLUDE (final_cluster), sha256('english-near-cluster' || chr(0) || 'english-near-v1-' || r.key) AS final_cluster
        FROM fp f JOIN clustered c ON c.id = f.id JOIN numbered r ON r.ordinal = c.root""",
    "bad": "SELECT DISTINCT content_hash, final_cluster FROM mappedfp WHERE id IN (SELECT id FROM reasons0 WHERE reason LIKE 'benchmark:%')",
    "propagated": f"""SELECT id, '{curate.PROPAGATED}' AS reason FROM mappedfp WHERE content_hash IN (SELECT content_hash FROM bad)
        OR final_cluster IN (SELECT final_cluster FROM bad)""",
    "reasons1": "SELECT * FROM reasons0 UNION ALL SELECT * FROM propagated",
    "clean": "SELECT * FROM mappedfp WHERE id NOT IN (SELECT id FROM reasons1)",
    "exact": "SELECT content_hash, penalty, key, id AS canonical_id, final_cluster FROM clean QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY penalty, key) = 1",
    "final": "SELECT final_cluster, canonical_id FROM exact QUALIFY row_number() OVER (PARTITION BY final_cluster ORDER BY penalty, key) = 1",
    "mapped": "SELECT c.id, f.canonical_id FROM clean c JOIN exact e ON e.content_hash = c.content_hash JOIN final f ON f.final_cluster = e.final_cluster",
    "residual": f"""SELECT c.id, CASE WHEN c.id <> e.canonical_id THEN '{curate.EXACT}' ELSE '{curate.NEAR}' END AS reason
        FROM clean c JOIN exact e ON e.content_hash = c.content_hash JOIN final f ON f.final_cluster = c.final_cluster
        WHERE c.id <> e.canonical_id OR c.id <> f.canonical_id""",
    "reasons": "SELECT * FROM reasons1 UNION ALL SELECT * FROM residual",
    "eligible": f"SELECT *, bucket AS category, {split_of('source_group')} AS split FROM mappedfp WHERE id NOT IN (SELECT id FROM reasons)",
    "quotas": "SELECT split, category, (sum(words) * 3 // 5)::BIGINT AS target FROM eligible GROUP BY split, category",
    "ranked": "SELECT *, coalesce(sum(words) OVER (PARTITION BY split, category ORDER BY selection_rank, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM eligible",
    "selected": "SELECT r.id, r.split, r.category, least(r.words, q.target - r.before)::BIGINT AS selected_tokens FROM ranked r JOIN quotas q ON r.split = q.split AND r.category = q.category WHERE r.before < q.target",
    "numbered": "SELECT *, row_number() OVER (ORDER BY archive, manifest_index) - 1 AS ordinal FROM fp",
    "stars": "SELECT ordinal, id, archive, normalized_hash, text, min(ordinal) OVER (PARTITION BY normalized_hash) AS root, count(*) OVER (PARTITION BY normalized_hash) AS members FROM numbered",
    "worded": f"SELECT ordinal, regexp_extract_all({normalized('text')}, {_WORD}) AS w FROM stars WHERE ordinal = root",
    "shingled": f"""SELECT DISTINCT ordinal, unnest(CASE WHEN len(w) < {LSH.width} THEN w ELSE
        list_transform(range(1, len(w) - {LSH.width} + 2), lambda i: array_to_string(w[i:i + {LSH.width - 1}], ' ')) END) AS s FROM worded""",
    "sizes": "SELECT w.ordinal, count(s.s) AS n FROM worded w LEFT JOIN shingled s ON s.ordinal = w.ordinal GROUP BY w.ordinal",
    "near": f"""SELECT x.a, x.b, x.inter, sa.n + sb.n - x.inter AS "union" FROM (
            SELECT a.ordinal AS a, b.ordinal AS b, count(*) AS inter FROM shingled a JOIN shingled b ON a.s = b.s AND a.ordinal < b.ordinal GROUP BY 1, 2) x
        JOIN sizes sa ON sa.ordinal = x.a JOIN sizes sb ON sb.ordinal = x.b
        WHERE x.inter * {LSH.jaccard.denominator} >= (sa.n + sb.n - x.inter) * {LSH.jaccard.numerator}""",
    "reach": "SELECT ordinal AS node, ordinal AS peer FROM worded UNION SELECT r.node, e.v FROM reach r JOIN (SELECT a AS u, b AS v FROM near UNION ALL SELECT b, a FROM near) e ON r.peer = e.u",
    "tops": "SELECT node, min(peer) AS top FROM reach GROUP BY node",
    "clustered": "SELECT s.ordinal, s.id, s.archive, s.normalized_hash, t.top AS root FROM stars s JOIN tops t ON t.node = s.root",
    "tokened": f"""SELECT id, split, category AS domain, selection_rank, archive, manifest_index,
        list_transform(regexp_extract_all(text, {_WORD}), lambda w: ('0x' || substr(md5(w), 1, 6))::INTEGER % {PACK.vocabulary - 1} + 1) AS tokens FROM eligible""",
    "indexed": """SELECT *, len(tokens) AS n_tokens, coalesce(sum(len(tokens) + 1) OVER (PARTITION BY split, domain ORDER BY archive, manifest_index
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM tokened""",
    "stream": f"SELECT split, domain, start + i - 1 AS pos, coalesce(tokens[i], {PACK.eos}) AS tok, i = 1 AS fresh FROM indexed, unnest(range(1, n_tokens + 2)) AS t(i)",
    "cells": f"""SELECT split, domain, pos // {PACK.length} AS row_id, pos % {PACK.length} AS spot, tok, fresh OR pos % {PACK.length} = 0 AS fresh FROM stream
        UNION ALL SELECT split, domain, pos // {PACK.length} - 1, {PACK.length}, tok, fresh FROM stream WHERE pos % {PACK.length} = 0 AND pos > 0""",
    "packed": f"""SELECT split, domain, row_id, list(tok ORDER BY spot) AS tokens, list(fresh ORDER BY spot) AS starts FROM cells
        GROUP BY split, domain, row_id HAVING count(*) = {PACK.length + 1}""",
    "turns": "SELECT *, lead(role) OVER w AS next, lead(text) OVER w AS completion FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)",
    "sft_rows": """SELECT md5(conv_id::VARCHAR || ':' || turn::VARCHAR) AS id,
        text || CASE WHEN conv_id % 17 = 4 THEN chr(10) || (SELECT text FROM benchmark ORDER BY item_id LIMIT 1) ELSE '' END AS input, completion AS output,
        CASE WHEN conv_id % 11 = 3 THEN 'other' ELSE 'generic' END AS domain, 'self-instruct' AS generation_algorithm,
        CASE WHEN conv_id % 13 = 5 THEN 1.5 ELSE 0.5 END AS average_test_score FROM turns WHERE role = 'user' AND next = 'assistant'""",
    "sft_marked": f"SELECT *, 'prompt-sha256:' || sha256({normalized('input')}) AS group_id, len(regexp_extract_all(input, {_WORD})) + len(regexp_extract_all(output, {_WORD})) + 4 AS tokens FROM sft_rows",
    "sft_bad": f"""SELECT DISTINCT group_id FROM (SELECT group_id, {collapsed('line')} AS bare FROM (
            SELECT group_id, unnest(string_split(input || chr(10) || output, chr(10))) AS line FROM sft_marked))
        WHERE length(bare) >= {benchmark.STRONG} AND sha256(bare) IN (SELECT digest FROM strong)""",
    "sft_decided": f"""SELECT *, coalesce({first_failing({
        'schema:input': 'input IS NULL', 'schema:output': 'output IS NULL',
        'quality:empty-prompt': "trim(regexp_replace(input, '\\s', '', 'g')) = ''", 'quality:empty-completion': "trim(regexp_replace(output, '\\s', '', 'g')) = ''",
        'quality:prompt-bytes': f"octet_length(encode(input)) > {SFT.max_prompt_bytes}", 'quality:completion-bytes': f"octet_length(encode(output)) > {SFT.max_completion_bytes}",
        'schema:domain': f"domain NOT IN ({', '.join(map(quoted, SFT.domains))})",
        'schema:average-test-score': 'average_test_score < 0 OR average_test_score > 1', 'quality:test-score': f'average_test_score < {SFT.min_score}',
        'benchmark:group-propagated': 'group_id IN (SELECT group_id FROM sft_bad)',
    })}, {first_failing({f'secret:{k}': f"regexp_matches(input || chr(10) || output, {quoted(p)})" for k, p in sft.SECRETS.items()})},
        {first_failing({'quality:rendering': f"contains(input, '{sft.END}') OR contains(output, '{sft.END}')", 'length:over-context': f'tokens - 1 > {SFT.max_tokens}'})}) AS reason FROM sft_marked""",
    "sft_split": f"SELECT *, CASE WHEN reason IS NULL THEN {prompt_split('group_id')} END AS split FROM sft_decided",
}
RECURSIVE = {"reach"}


def sql(select: str) -> str:
    """The select with the common tables that it needs, in the order of their use."""
    needed: list[str] = []

    def need(text: str, own: str = "") -> None:
        for name in CTES:
            if name != own and name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(CTES[name], name)
                if name not in needed:
                    needed.append(name)

    need(select)
    if not needed:
        return select
    recursive = "RECURSIVE " if RECURSIVE & set(needed) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({CTES[n]})" for n in needed) + "\n" + select


QUARANTINE = " OR ".join("contains(s, " + quoted(m) + ")" for m in admission.QUARANTINE)
