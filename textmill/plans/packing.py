"""Queries: tokens, streams, packed rows, their order and what training needs of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.config import PACK
from textmill.functions import text as tx
from textmill.operators import pack
from textmill.plans.curation import curated
from textmill.plans.registry import Registry
from textmill.sources import tables
from textmill.storage import cut

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
T = PACK.length
WEIGHTS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}
SEED = "textmill-order"


def index(spark, sf) -> DataFrame:
    """Document index with tokens: every eligible document's place in its split and language's stream."""
    c = curated(spark, sf)
    return c.step("index", lambda: _index(c, spark, sf))


def _index(c, spark, sf) -> DataFrame:
    # only eligible texts are cut into tokens
    kept = c.eligible.select("id", "split", F.col("category").alias("domain"), "archive")
    texts = tables.documents(spark, sf).select("id", "text").join(kept, "id")
    docs = cut(texts.select("id", "split", "domain", "archive", pack.token_ids(F.col("text"), PACK.vocabulary).alias("tokens")).withColumn("n_tokens", F.size("tokens").cast("long")))
    placed = pack.streams(docs.select("id", "split", "domain", "archive", "n_tokens"), ["archive", "id"])
    return cut(placed.join(docs.select("id", "tokens"), "id"))


def rows_of(spark, sf) -> DataFrame:
    return pack.packed(index(spark, sf), PACK)


def joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), " ").alias(column)


def counts(spark, sf, rows: DataFrame) -> dict[str, int]:
    """Rows of each domain that the weights and the supply of training rows allow; a few domains."""
    have = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    return pack.largest_remainder(pack.feasible_rows(have, WEIGHTS), WEIGHTS)


def train_rows(spark, sf) -> DataFrame:
    """(domain, row_id) of the training rows there are."""
    have = pack.available(index(spark, sf), PACK).where("split = 'train' and rows > 0")
    return have.select("domain", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row_id"))


@query("SELECT id, split, domain, n_tokens, start, start + n_tokens AS eos_at FROM indexed")
def document_index(spark, sf):
    return index(spark, sf).select("id", "split", "domain", "n_tokens", "start", "eos_at")


@query("""SELECT id, archive, coalesce(sum(words) OVER (PARTITION BY archive ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    sum(words) OVER (PARTITION BY archive ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS "end" FROM measured""")
def token_offsets(spark, sf):
    docs = tables.documents(spark, sf).select("id", "archive", tx.word_count(F.col("text")).alias("words"))
    return pack.offsets(docs, ["archive"], ["id"], "words").select("id", "archive", "start", "end")


@query("SELECT archive, sum(words)::BIGINT AS tokens FROM measured GROUP BY archive")
def token_counts(spark, sf):
    return tables.documents(spark, sf).select("archive", tx.word_count(F.col("text")).alias("n")).groupBy("archive").agg(F.sum("n").alias("tokens"))


@query("SELECT id, array_to_string(tokens[17:24], ' ') AS tokens FROM tokened WHERE len(tokens) >= 24")
def token_slices(spark, sf):
    """Random access: tokens 16 to 23 of each document."""
    rows = index(spark, sf).where("n_tokens >= 24").select("id", F.slice("tokens", 17, 8).alias("tokens"))
    return rows.select("id", joined("tokens"))


@query("SELECT split, domain, row_id, array_to_string(tokens, ' ') AS tokens, array_to_string(list_transform(starts, lambda s: CASE WHEN s THEN '1' ELSE '0' END), '') AS starts FROM packed")
def packed_rows(spark, sf):
    bits = F.array_join(F.transform("starts", lambda s: s.cast("int").cast("string")), "")
    return rows_of(spark, sf).select("split", "domain", "row_id", joined("tokens"), bits.alias("starts"))


_LABELS = f"list_transform(range(1, {T + 1}), lambda i: CASE WHEN starts[i + 1] THEN {pack.IGNORED} ELSE tokens[i + 1] END)"


@query(f"SELECT split, domain, row_id, array_to_string({_LABELS}, ' ') AS labels, len(list_filter({_LABELS}, lambda x: x <> {pack.IGNORED}))::INTEGER AS num_loss_tokens FROM packed")
def packed_labels(spark, sf):
    return pack.collated(rows_of(spark, sf), PACK).select("split", "domain", "row_id", joined("labels"), "num_loss_tokens")


@query(f"""SELECT split, domain, row_id, string_agg(spot - since, ' ' ORDER BY spot) AS position_ids, string_agg(doc, ' ' ORDER BY spot) AS document_ids FROM (
    SELECT split, domain, row_id, spot, max(CASE WHEN fresh THEN spot END) OVER w AS since, sum(fresh::INTEGER) OVER w - 1 AS doc FROM cells
    WHERE spot < {T} AND (split, domain, row_id) IN (SELECT (split, domain, row_id) FROM packed) WINDOW w AS (PARTITION BY split, domain, row_id ORDER BY spot ROWS UNBOUNDED PRECEDING)) GROUP BY split, domain, row_id""")
def packed_segments(spark, sf):
    rows = pack.collated(rows_of(spark, sf), PACK)
    return rows.select("split", "domain", "row_id", joined("position_ids"), joined("document_ids"))


@query(f"SELECT split, domain, count(*) AS rows, sum({T} - (len(list_filter(starts, lambda s: s)) - 1))::BIGINT AS supervised_tokens FROM packed GROUP BY split, domain")
def supervised_counts(spark, sf):
    return pack.supervised(rows_of(spark, sf), PACK)


_AVAILABLE = f"""SELECT split, domain, count(*) AS documents, sum(n_tokens)::BIGINT AS content_tokens, ((sum(n_tokens) + count(*) - 1) // {T})::BIGINT AS rows,
    (sum(n_tokens) + count(*) - CASE WHEN (sum(n_tokens) + count(*) - 1) // {T} > 0 THEN (sum(n_tokens) + count(*) - 1) // {T} * {T} + 1 ELSE 0 END)::BIGINT AS unstored_tokens
    FROM indexed GROUP BY split, domain"""


@query(_AVAILABLE)
def available_rows(spark, sf):
    return pack.available(index(spark, sf), PACK)


@query(f"""SELECT unnest(['row_length', 'first_start', 'vocabulary', 'start_after_end_token', 'starts_length']) AS rule, unnest([
    count(*) FILTER (WHERE len(tokens) <> {T + 1}), count(*) FILTER (WHERE NOT starts[1]), count(*) FILTER (WHERE len(list_filter(tokens, lambda x: x < 0 OR x >= {PACK.vocabulary})) > 0),
    count(*) FILTER (WHERE len(list_filter(range(1, {T + 1}), lambda i: starts[i + 1] AND tokens[i] <> {PACK.eos})) > 0),
    count(*) FILTER (WHERE len(starts) <> {T + 1})]) AS violations FROM (SELECT split, domain, row_id, CASE WHEN row_id % 7 = 3 THEN list_transform(tokens, lambda x: x + 60000) ELSE tokens END AS tokens,
        CASE WHEN row_id % 5 = 2 THEN list_concat([false], starts[2:]) ELSE starts END AS starts FROM packed)""")
def packed_violations(spark, sf):
    """Rows that break each rule, among them some whose ids or starts are spoilt."""
    rows = rows_of(spark, sf)
    tokens = F.when(F.col("row_id") % 7 == 3, F.transform("tokens", lambda x: x + 60_000)).otherwise(F.col("tokens"))
    starts = F.when(F.col("row_id") % 5 == 2, F.concat(F.array(F.lit(False)), F.slice("starts", 2, T))).otherwise(F.col("starts"))
    return pack.violations(rows.withColumns({"tokens": tokens, "starts": starts}), PACK)


@query("""SELECT split, domain, count(*) AS documents, count(*) FILTER (WHERE start <> coalesce(before, 0) AND NOT (before IS NULL AND start = 0)) AS gaps FROM (
    SELECT split, domain, start, lag(start + n_tokens + 1) OVER (PARTITION BY split, domain ORDER BY archive, manifest_index) AS before FROM indexed WHERE id % 10 <> 4) GROUP BY split, domain""")
def document_index_gaps(spark, sf):
    """Where streams break off, with the documents whose id ends in 4 taken out of the index."""
    return pack.index_gaps(index(spark, sf).where("id % 10 != 4"))


@query("""SELECT domain, n, rows::BIGINT AS allotted FROM (SELECT domain, n, (1001 * n) // t + CASE WHEN row_number() OVER (ORDER BY (1001 * n) % t DESC, domain) <= 1001 - sum((1001 * n) // t) OVER () THEN 1 ELSE 0 END AS rows
    FROM (SELECT domain, n, (sum(n) OVER ())::BIGINT AS t FROM (SELECT domain, count(*) AS n FROM indexed GROUP BY domain)))""")
def largest_remainder(spark, sf):
    """1,001 rows shared by the domains' numbers of documents."""
    n = {r.domain: r.n for r in curated(spark, sf).eligible.groupBy(F.col("category").alias("domain")).agg(F.count(F.lit(1)).alias("n")).orderBy("domain").collect()}
    shares = pack.largest_remainder(1001, n)
    return spark.createDataFrame([(d, n[d], shares[d]) for d in n], "domain string, n long, allotted long")


_FEASIBLE = f"""SELECT * FROM (WITH have AS (SELECT domain, rows FROM ({_AVAILABLE}) WHERE split = 'train'), parts(domain, k) AS (VALUES ('de', 1), ('en', 2), ('es', 1), ('fr', 1)),
    totals AS (SELECT unnest(range(0, (SELECT coalesce(sum(rows), 0) FROM have)::BIGINT + 1)) AS n),
    allotted AS (SELECT n, domain, (n * k) // 5 + CASE WHEN row_number() OVER (PARTITION BY n ORDER BY (n * k) % 5 DESC, domain) <= n - sum((n * k) // 5) OVER (PARTITION BY n) THEN 1 ELSE 0 END AS rows
        FROM totals, parts),
    best AS (SELECT max(n) AS n FROM (SELECT n FROM allotted a LEFT JOIN have h ON h.domain = a.domain GROUP BY n HAVING bool_and(a.rows <= coalesce(h.rows, 0))))
    SELECT a.domain, coalesce(h.rows, 0)::BIGINT AS have, a.rows::BIGINT AS allotted FROM allotted a JOIN best USING (n) LEFT JOIN have h ON h.domain = a.domain)"""


@query(_FEASIBLE)
def feasible_rows(spark, sf):
    """The longest order that the weights allow: rows there are and rows allotted of each domain."""
    there = pack.available(index(spark, sf), PACK).where("split = 'train'").select("domain", "rows").collect()  # a row a domain
    have = {r.domain: r.rows for r in there}
    shares = pack.largest_remainder(pack.feasible_rows(have, WEIGHTS), WEIGHTS)
    return spark.createDataFrame([(d, have.get(d, 0), n) for d, n in shares.items()], "domain string, have long, allotted long")


@query(f"""SELECT domain, row_id FROM (SELECT domain, unnest(range(0, rows)) AS row_id FROM ({_AVAILABLE}) WHERE split = 'train')
    ORDER BY sha256('{SEED}:sample:' || domain || ':' || row_id) LIMIT 25""")
def row_sample(spark, sf):
    """Twenty-five training rows, drawn without replacement."""
    return pack.row_sample(train_rows(spark, sf), 25, SEED)


_ORDER_CTE = f"""SELECT (row_number() OVER (ORDER BY sha256('{SEED}:mix:' || domain || ':' || row_id)) - 1)::BIGINT AS position, domain, row_id FROM (
    SELECT domain, row_id, row_number() OVER (PARTITION BY domain ORDER BY sha256('{SEED}:pick:' || domain || ':' || row_id)) - 1 AS place
    FROM (SELECT domain, unnest(range(0, rows)) AS row_id FROM ({_AVAILABLE}) WHERE split = 'train')) x JOIN ({_FEASIBLE}) f USING (domain) WHERE place < f.allotted"""


def planned(spark, sf) -> tuple[DataFrame, dict[str, int]]:
    """The longest order that the weights and the supply of training rows allow, and its rows of each domain."""
    c, rows = curated(spark, sf), cut(train_rows(spark, sf))
    shares = counts(spark, sf, rows)
    return c.step("order", lambda: cut(pack.training_order(rows, shares, SEED))), shares


def order(spark, sf) -> DataFrame:
    return planned(spark, sf)[0]


@query(_ORDER_CTE)
def training_order(spark, sf):
    return order(spark, sf)


@query(f"""SELECT o.domain, count(*) AS rows, count(*) * {T}::BIGINT AS tokens, count(*) / sum(count(*)) OVER () AS share, any_value(f.have) - count(*) AS dropped_rows
    FROM ({_ORDER_CTE}) o JOIN ({_FEASIBLE}) f ON f.domain = o.domain GROUP BY o.domain""")
def mixture_order(spark, sf):
    """What the order holds of each domain, its share of all, and the rows that the weights leave out."""
    made = order(spark, sf)
    there = pack.available(index(spark, sf), PACK).where("split = 'train'").select("domain", "rows")
    return pack.order_accounts(made, there, PACK)


@query(f"""SELECT f.domain, f.allotted AS planned, coalesce(o.rows, 0) AS rows, coalesce(o.distinct_rows, 0) AS distinct_rows,
    coalesce(o.rows, 0) = f.allotted AND coalesce(o.distinct_rows, 0) = f.allotted AS valid FROM ({_FEASIBLE}) f
    LEFT JOIN (SELECT domain, count(*) AS rows, count(DISTINCT row_id) AS distinct_rows FROM ({_ORDER_CTE}) GROUP BY domain) o ON o.domain = f.domain""")
def order_validation(spark, sf):
    made, shares = planned(spark, sf)
    return pack.order_report(made, shares)


@query(f"""SELECT count(*) AS rows, count(DISTINCT position) AS positions, min(position) AS first, max(position) AS last, count(*) * {T}::BIGINT AS tokens,
    (count(*) // 12 * 12)::BIGINT AS batched_rows, (count(*) % 12)::BIGINT AS surplus_rows, count(*) = count(DISTINCT position) AND max(position) = count(*) - 1 AS contiguous FROM ({_ORDER_CTE})""")
def order_budget(spark, sf):
    """Rows, positions and tokens of the order against updates of twelve rows."""
    return pack.order_budget(order(spark, sf), PACK, 12)


@query(f"""SELECT position, domain, row_id, position // 12 AS batch FROM ({_ORDER_CTE}) WHERE position >= 36 AND position < (SELECT count(*) FROM ({_ORDER_CTE})) // 12 * 12 AND position % 12 // 3 = 2""")
def resumed_batches(spark, sf):
    """What rank 2 of 4 still reads after three updates."""
    return pack.resumed(order(spark, sf), 4, 3, 36, 2)


@query(f"""SELECT position, domain, row_id, position // 12 AS batch, (position % 12 // 3)::INTEGER AS rank, (position % 3)::INTEGER AS slot
    FROM ({_ORDER_CTE}) WHERE position < (SELECT count(*) FROM ({_ORDER_CTE})) // 12 * 12""")
def microbatch_ranks(spark, sf):
    return pack.microbatches(order(spark, sf), 4, 3)


@query(f"SELECT position, domain, row_id FROM ({_ORDER_CTE}) WHERE position < 10")
def order_prefix(spark, sf):
    return pack.first_rows(order(spark, sf), 10)


@query(f"SELECT o.position, o.domain, o.row_id, array_to_string(p.tokens, ' ') AS tokens FROM ({_ORDER_CTE}) o JOIN packed p ON p.split = 'train' AND p.domain = o.domain AND p.row_id = o.row_id")
def order_lookup(spark, sf):
    """The packed row behind each reference."""
    rows = rows_of(spark, sf).where("split = 'train'").select("domain", "row_id", joined("tokens"))
    return order(spark, sf).join(rows, ["domain", "row_id"]).select("position", "domain", "row_id", "tokens")


@query(f"SELECT position, ((CASE domain WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END)::BIGINT << 56) | row_id AS ref, domain, row_id FROM ({_ORDER_CTE})")
def order_references(spark, sf):
    """References in one long each, and what they decode to."""
    ids = F.create_map(*(F.lit(x) for i, d in enumerate(sorted(WEIGHTS)) for x in (d, i)))
    refs = order(spark, sf).select("position", pack.reference(F.element_at(ids, F.col("domain")), F.col("row_id")).alias("ref"))
    domain, row = pack.unreferenced(F.col("ref"))
    return refs.select("position", "ref", F.element_at(F.array(*map(F.lit, sorted(WEIGHTS))), domain + 1).alias("domain"), row.alias("row_id"))


@query(f"""SELECT r.split, r.domain, r.required::BIGINT AS required, coalesce(a.rows, 0) AS rows, coalesce(a.rows, 0) >= r.required AS sufficient
    FROM (SELECT unnest(['train', 'train', 'validation', 'test']) AS split, unnest(['en', 'fr', 'en', 'es']) AS domain, unnest([100, 100000, 5, 1]) AS required) r
    LEFT JOIN ({_AVAILABLE}) a ON a.split = r.split AND a.domain = r.domain""")
def selection_supply(spark, sf):
    need = {("train", "en"): 100, ("train", "fr"): 100_000, ("validation", "en"): 5, ("test", "es"): 1}
    return pack.supply_report(pack.available(index(spark, sf), PACK), need)


@query("""SELECT bucket AS domain, sum(size_bytes)::BIGINT AS loss, sum(words)::BIGINT AS tokens, sum(size_bytes) / sum(words) AS mean_loss FROM measured GROUP BY bucket""")
def domain_metrics(spark, sf):
    """Token-weighted means by domain, of bytes in place of a loss."""
    rows = tables.documents(spark, sf).select(F.col("bucket").alias("domain"), F.col("size_bytes").alias("loss"), tx.word_count(F.col("text")).alias("tokens"))
    return pack.domain_metrics(rows)
