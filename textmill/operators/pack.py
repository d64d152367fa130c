"""Packing token streams into fixed rows, and the order in which rows are trained on.

A stream is one split and domain: each document's tokens and an end token, in archive order. Row r holds positions
r T to r T + T, so neighbours share a token; incomplete rows at the end are dropped and accounted for. Documents are cut
into one piece a row, never into single tokens, before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.config import PackConfig
from textmill.functions import text as tx
from textmill.functions.prefix import running

IGNORED = -100
STREAM = ("split", "domain")


def token_ids(text: Column, vocabulary: int) -> Column:
    """Ids of the words of a text, by digest, from 1; a stand-in for a tokenizer where none is given."""
    one = lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int") % (vocabulary - 1) + 1)
    return F.transform(tx.words(text), one)


def offsets(docs: DataFrame, group: Sequence[str], order: Sequence[str], size: str) -> DataFrame:
    """Each document's first and end offset in its group's concatenation."""
    return running(docs, group, order, {"start": F.col(size)}).withColumn("end", F.col("start") + F.col(size))


def streams(docs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Document index: each document's interval in its stream, and where its end token stands. `docs` has n_tokens."""
    placed = running(docs, STREAM, order, {"start": F.col("n_tokens") + 1})
    return placed.withColumn("eos_at", F.col("start") + F.col("n_tokens")).withColumn("end", F.col("start") + F.col("n_tokens") + 1)


def packed(index: DataFrame, config: PackConfig) -> DataFrame:
    """(split, domain, row_id, tokens, starts): complete rows of length + 1 tokens and where segments start in them.

    `index` has split, domain, start, end, tokens. A position starts a segment if it is a document's first token or
    the first of the row.
    """
    t = config.length
    low = F.when(F.col("start") == 0, F.lit(0)).otherwise(F.floor((F.col("start") - 1) / t))
    rows = index.select(
        *STREAM, "start", "end", F.concat("tokens", F.array(F.lit(config.eos))).alias("ids"),
        F.explode(F.sequence(low.cast("long"), F.floor((F.col("end") - 1) / t).cast("long"))).alias("row_id"),
    )
    first = F.greatest(F.col("row_id") * t, F.col("start"))
    last = F.least(F.col("row_id") * t + t, F.col("end") - 1)
    ids = F.slice("ids", (first - F.col("start") + 1).cast("int"), (last - first + 1).cast("int"))
    fresh = F.transform(ids, lambda _, i: (i == 0) & (first == F.col("start")))
    pieces = rows.select(*STREAM, "row_id", F.struct((first - F.col("row_id") * t).alias("at"), ids.alias("ids"), fresh.alias("fresh")).alias("p"))
    # at most length + 1 pieces a row
    whole = pieces.groupBy(*STREAM, "row_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    flat = whole.select(*STREAM, "row_id", F.flatten("p.ids").alias("tokens"), F.flatten("p.fresh").alias("fresh"))
    starts = F.transform("fresh", lambda x, i: x | (i == 0))
    return flat.where(F.size("tokens") == t + 1).select(*STREAM, "row_id", "tokens", starts.alias("starts"))


def collated(rows: DataFrame, config: PackConfig) -> DataFrame:
    """input_ids, labels (ignored where the next token starts a segment), position_ids and document_ids of rows."""
    t = config.length
    head = F.slice("starts", 1, t)
    labels = F.zip_with(F.slice("tokens", 2, t), F.slice("starts", 2, t), lambda x, s: F.when(s, F.lit(IGNORED)).otherwise(x))
    places = F.transform(head, lambda s, i: F.when(s, i))
    none = F.array().cast("array<int>")
    # running maximum of the starts, running count of the starts
    since = F.aggregate(places, none, lambda a, p: F.concat(a, F.array(F.coalesce(p, F.element_at(a, -1)))))
    docs = F.aggregate(head, none, lambda a, s: F.concat(a, F.array(F.when(F.size(a) == 0, 0).otherwise(F.element_at(a, -1) + s.cast("int")))))
    out = rows.select(*STREAM, "row_id", F.slice("tokens", 1, t).alias("input_ids"), labels.alias("labels"), since.alias("since"), docs.alias("document_ids"))
    places = F.transform("since", lambda s, i: i - s)
    return out.select(*STREAM, "row_id", "input_ids", "labels", places.alias("position_ids"), "document_ids", F.size(F.filter("labels", lambda x: x != IGNORED)).alias("num_loss_tokens"))


def supervised(rows: DataFrame, config: PackConfig) -> DataFrame:
    """Tokens that count for the loss by stream: a row's length less its starts after the first."""
    inner = F.size(F.filter("starts", lambda s: s)) - 1
    return rows.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("rows"), F.sum((F.lit(config.length) - inner).cast("long")).alias("supervised_tokens"))


def available(index: DataFrame, config: PackConfig) -> DataFrame:
    """Rows each stream gives, from its totals alone, and the tokens left over."""
    n = index.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("content_tokens"))
    stream = F.col("content_tokens") + F.col("documents")
    rows = n.withColumn("rows", F.floor((stream - 1) / config.length).cast("long"))
    stored = F.when(F.col("rows") > 0, F.col("rows") * config.length + 1).otherwise(F.lit(0))
    return rows.withColumn("unstored_tokens", stream - stored)


def violations(rows: DataFrame, config: PackConfig) -> DataFrame:
    """Rows that break each rule of the format."""
    pairs = F.zip_with(F.slice("tokens", 1, config.length), F.slice("starts", 2, config.length), lambda x, s: s & (x != config.eos))
    rules = {
        "row_length": F.size("tokens") != config.length + 1,
        "first_start": ~F.col("starts")[0],
        "vocabulary": F.exists("tokens", lambda x: (x < 0) | (x >= config.vocabulary)),
        "start_after_end_token": F.exists(pairs, lambda x: x),
        "starts_length": F.size("starts") != config.length + 1,
    }
    sums = rows.agg(*(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(k) for k, c in rules.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules))).alias("r")).select("r.*")


def index_gaps(index: DataFrame) -> DataFrame:
    """Documents of a stream that don't begin where one ends; a stream's first begins at 0.

    A join on the offset, which spreads a long stream, where a window would hold it in one task.
    """
    ends = index.select(*STREAM, F.col("end").alias("start"), F.lit(1).alias("met"))
    starts = index.select(*STREAM, "id", "start")
    met = starts.join(ends, [*STREAM, "start"], "left")
    return met.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.when(F.col("met").isNull() & (F.col("start") > 0), 1).otherwise(0)).alias("gaps"))


def exact_weights(weights: dict[str, float | Fraction]) -> dict[str, Fraction]:
    """Weights as fractions of one; negative, infinite or all-zero weights are an error."""
    exact = {d: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for d, w in weights.items()}
    if any(w < 0 for w in exact.values()) or not (total := sum(exact.values())):
        raise ValueError(f"weights must not be negative, and not all zero: {weights}")
    return {d: w / total for d, w in exact.items()}


def largest_remainder(total: int, weights: dict[str, float | Fraction]) -> dict[str, int]:
    """Rows of each domain: whole parts, and what is left to the largest fractions, earlier domains first."""
    exact = {d: total * w for d, w in exact_weights(weights).items()}
    rows = {d: int(x) for d, x in exact.items()}
    order = sorted(exact, key=lambda d: (rows[d] - exact[d], list(exact).index(d)))
    for d in order[: total - sum(rows.values())]:
        rows[d] += 1
    return rows


def feasible_rows(have: dict[str, int], weights: dict[str, float | Fraction], quantum: int = 1, cap: int | None = None) -> int:
    """The most rows, a multiple of the quantum, that the domains can fill by weight."""
    low, high = 0, (sum(have.values()) if cap is None else min(cap, sum(have.values()))) // quantum
    while low < high:
        middle = (low + high + 1) // 2
        need = largest_remainder(middle * quantum, weights)
        low, high = (middle, high) if all(need[d] <= have.get(d, 0) for d in need) else (low, middle - 1)
    return low * quantum


def training_order(rows: DataFrame, counts: dict[str, int], seed: str) -> DataFrame:
    """(position, domain, row_id): of each domain the first rows by a seeded digest, all ordered by another.

    Rows are ranked without a window over a whole domain. `rows` has domain and row_id.
    """
    digest = lambda name: F.sha2(F.concat_ws(":", F.lit(seed), F.lit(name), "domain", F.col("row_id").cast("string")), 256)
    placed = running(rows.select("domain", "row_id", digest("pick").alias("pick")), ["domain"], ["pick"], {"place": F.lit(1).cast("long")})
    most = F.create_map(*(F.lit(x) for kv in counts.items() for x in kv))
    taken = placed.where(F.col("place") < F.element_at(most, F.col("domain"))).select("domain", "row_id")
    return running(taken.withColumn("mix", digest("mix")), [], ["mix"], {"position": F.lit(1).cast("long")}).select("position", "domain", "row_id")


def smoke_documents(docs: DataFrame, n: int) -> DataFrame:
    """The first n documents of each domain by id: a small build. Top n, so a task keeps n of a domain."""
    place = F.row_number().over(Window.partitionBy("domain").orderBy("id"))
    return docs.withColumn("place", place).where(F.col("place") <= n).drop("place")


def reference(domain_id: Column, row_id: Column) -> Column:
    """A domain and row in one long: eight bits and 56."""
    return F.shiftleft(domain_id.cast("long"), 56).bitwiseOR(row_id.cast("long"))


def unreferenced(ref: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(ref, 56).cast("int"), ref.bitwiseAND(F.lit((1 << 56) - 1))


def order_report(order: DataFrame, counts: dict[str, int]) -> DataFrame:
    """For each domain, rows ordered, distinct rows, and whether both are as planned."""
    plan = order.sparkSession.createDataFrame([(d, int(n)) for d, n in counts.items()], "domain string, planned long")
    got = order.groupBy("domain").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("row_id").alias("distinct_rows"))
    joined = F.broadcast(plan).join(got, "domain", "left").na.fill(0)
    return joined.withColumn("valid", (F.col("rows") == F.col("planned")) & (F.col("distinct_rows") == F.col("planned")))


def order_accounts(order: DataFrame, there: DataFrame, config: PackConfig) -> DataFrame:
    """Rows and tokens of each domain in the order, their share of all, and rows there are that it leaves out."""
    got = order.groupBy("domain").agg(F.count(F.lit(1)).alias("rows"))
    total = got.agg(F.sum("rows").alias("all"))  # one row
    rows = got.join(there.select("domain", F.col("rows").alias("have")), "domain").join(F.broadcast(total))
    return rows.select("domain", "rows", (F.col("rows") * config.length).alias("tokens"), (F.col("rows") / F.col("all")).alias("share"), (F.col("have") - F.col("rows")).alias("dropped_rows"))


def order_budget(order: DataFrame, config: PackConfig, quantum: int) -> DataFrame:
    """Whether positions run from 0 without a gap, and how rows and tokens fill updates of `quantum` rows."""
    n = F.col("rows")
    totals = order.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("position").alias("positions"), F.min("position").alias("first"), F.max("position").alias("last"))
    return totals.select(
        "rows", "positions", "first", "last", (n * config.length).alias("tokens"), (n - n % quantum).alias("batched_rows"), (n % quantum).alias("surplus_rows"),
        ((n == F.col("positions")) & (F.col("last") == n - 1)).alias("contiguous"),
    )


def resumed(order: DataFrame, ranks: int, per_rank: int, done: int, rank: int) -> DataFrame:
    """A rank's rows of the complete global batches after `done` rows, which must be whole batches."""
    if done % (ranks * per_rank):
        raise ValueError(f"{done} rows are not whole batches of {ranks * per_rank}")
    mine = microbatches(order, ranks, per_rank).where((F.col("position") >= done) & (F.col("rank") == rank))
    return mine.select("position", "domain", "row_id", "batch")


def microbatches(order: DataFrame, ranks: int, per_rank: int) -> DataFrame:
    """Complete global batches, each rank with a run of its own; the rest of the order is left out."""
    size = ranks * per_rank
    n = order.count() // size * size
    p = F.col("position")
    return order.where(p < n).select("position", "domain", "row_id", F.floor(p / size).cast("long").alias("batch"), F.floor(p % size / per_rank).cast("int").alias("rank"), (p % per_rank).cast("int").alias("slot"))


def supply_report(have: DataFrame, need: dict[tuple[str, str], int]) -> DataFrame:
    """Rows wanted and there by split and domain."""
    wanted = have.sparkSession.createDataFrame([(s, d, int(n)) for (s, d), n in need.items()], "split string, domain string, required long")
    rows = F.broadcast(wanted).join(have.select("split", "domain", "rows"), ["split", "domain"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return rows.withColumn("sufficient", F.col("rows") >= F.col("required"))


def domain_metrics(losses: DataFrame) -> DataFrame:
    """Token-weighted mean loss by domain; `losses` has domain, loss and tokens."""
    return losses.groupBy("domain").agg(F.sum("loss").alias("loss"), F.sum("tokens").alias("tokens")).withColumn("mean_loss", F.col("loss") / F.col("tokens"))


def first_rows(order: DataFrame, n: int) -> DataFrame:
    return order.where(F.col("position") < n)


def row_sample(rows: DataFrame, n: int, seed: str) -> DataFrame:
    """n rows (domain, row_id) without replacement, those of least seeded digest; each task keeps n rows at most."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.lit("sample"), "domain", F.col("row_id").cast("string")), 256)
    return rows.select("domain", "row_id").orderBy(digest, "domain", "row_id").limit(n)
