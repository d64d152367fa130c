"""Mixing sources to target weights by hash thresholds, with DataFrame operations only.

Each document has a fixed hash of its id. For every source the words are summed by hash bucket, the bucket in which
the running sum meets the source's budget is split by the next bits, and so on until one hash value is left: its
threshold. A document is taken when its hash is under the threshold, so nothing is sorted, reruns agree, and a larger
budget keeps all that a smaller one took.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; rows that repeat a
doc_id share its hash and are taken alike; documents of size 0 take part but add nothing; an empty table gives an
empty result. Only the id, text and source columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 12
#: A source's threshold is a row of about 100 bytes; up to so many rows are broadcast, more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def words_in(text: Column) -> Column:
    """Number of words in a text, 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, seed: str = "mix") -> Column:
    """60 bits of MD5, which other engines have too; rows of one id share it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int) -> DataFrame:
    """Target words of each source (columns source, source_size, one row a source).

    Sources in code point order, null last, take the weights in turn. They share `share[0] / share[1]` of all words
    by weight; no target exceeds `cap` times its source's size, what is over goes to the others by weight. The sums
    are exact decimals, and each target one division.
    """
    num, den = share
    everything, lcm = Window.partitionBy(), 1
    for w in weights:
        lcm *= w
    big = "decimal(38,0)"
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", weight.cast(big)).withColumn("top", (F.col("source_size") * cap).cast(big))
    # In the order in which sources reach their caps as the level rises.
    rising = Window.orderBy((F.col("top") * F.lit(lcm) / F.col("w")).cast(big), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(big)
    rows = (
        rows.withColumn("total", F.sum(F.col("source_size").cast(big)).over(everything).cast(big))
        .withColumn("weights", F.sum("w").over(everything).cast(big))
        .withColumn("top_before", F.coalesce(F.sum("top").over(rising), zero).cast(big))
        .withColumn("w_before", F.coalesce(F.sum("w").over(rising), zero).cast(big))
        .withColumn("capped", (F.col("total") * num - F.col("top_before") * den) * F.col("w") > F.col("top") * den * (F.col("weights") - F.col("w_before")))
        .withColumn("top_capped", F.sum(F.when(F.col("capped"), F.col("top")).otherwise(zero)).over(everything).cast(big))
        .withColumn("w_free", F.sum(F.when(F.col("capped"), zero).otherwise(F.col("w"))).over(everything).cast(big))
    )
    level = (F.col("w") * (F.col("total") * num - F.col("top_capped") * den)).cast("double") / (F.col("w_free") * den).cast("double")
    return rows.select(
        "source", "source_size", F.when(F.col("capped"), F.col("top").cast("double")).otherwise(level).alias("target")
    )


def thresholds(sized: DataFrame, goals: DataFrame, level_bits: int = LEVEL_BITS) -> tuple[DataFrame, int]:
    """Rounds and hash threshold of each source, and the number of sources.

    `sized` has source, size, h; `goals` has source, source_size, target. A document of a source is taken `whole`
    times, and once more if h < `limit`.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = (
        goals.withColumn("whole", whole)
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumns({"bucket": F.lit(0).cast("long"), "under": F.lit(0).cast("long")})
    )
    state = cut(state)
    count = state.count()
    shift = HASH_BITS
    while True:
        known, shift = shift, max(0, shift - level_bits)
        part = state.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "left", "under")
        if count <= BROADCAST_SOURCES:
            part = F.broadcast(part)
        hits = (
            sized.join(part, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", known) == F.col("b")))
            .groupBy("source", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("here"), F.min("h").alias("low"), F.max("h").alias("high"), F.first("left").alias("left"), F.first("under").alias("base"))
        )
        by_source = Window.partitionBy("source").orderBy("bucket")
        hits = hits.withColumn("upto", F.col("base") + F.sum("here").over(by_source))
        met = hits.where(F.col("upto") >= F.col("left"))
        # min of a struct is the first bucket that meets the budget
        edge = met.groupBy("source").agg(F.min(F.struct("bucket", "upto", "here", "low", "high")).alias("e"))
        keep = state.select("source", "source_size", "target", "whole", "left")
        state = keep.join(edge.withColumnRenamed("source", "es"), F.col("source").eqNullSafe(F.col("es")), "left").select(
            *keep.columns,
            # without documents left to split, everything is under the limit
            F.coalesce("e.bucket", F.lit(1 << (HASH_BITS - shift))).alias("bucket"),
            (F.coalesce("e.upto", F.lit(0)) - F.coalesce("e.here", F.lit(0))).alias("under"),
            F.coalesce("e.here", F.lit(0)).alias("here"),
            F.coalesce("e.low", F.lit(1 << HASH_BITS)).alias("low"),
            F.coalesce("e.high", F.lit(1 << HASH_BITS)).alias("high"),
        )
        state = cut(state)
        if shift == 0 or state.where("low < high").isEmpty():
            break
    # The one hash value at the boundary is taken if that comes nearer to the budget.
    limit = F.when((F.col("left") - F.col("under")) * 2 >= F.col("here"), F.col("low") + 1).otherwise(F.col("low"))
    return state.select("source", "source_size", "target", "whole", limit.alias("limit")), count


def plan(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    cap: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The sized documents (doc_id, source, size, h), and each source's threshold row, as `thresholds` has it."""
    sized = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            words_in(F.col(text_col)).alias("size"),
            document_hash(F.col(id_col), seed).alias("h"),
        )
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    limits, count = thresholds(sized, targets(totals, weights, share, cap))
    return sized, F.broadcast(limits) if count <= BROADCAST_SOURCES else limits


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, times and taken (size * times) of every document; options as for `plan`."""
    sized, limits = plan(docs, **options)
    times = F.col("whole") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0)
    return sized.join(limits.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The documents as the mix takes them: all columns, a row for each time that a document is taken."""
    _, limits = plan(docs, seed=seed, **options)
    limits = limits.select(F.col("source").alias("of"), "whole", "limit")
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    # the documents travel in a struct, so their columns may have any name
    rows = docs.select(F.struct("*").alias("d"), docs[source_col].alias("from"), document_hash(docs[id_col], seed).alias("h"))
    times = (F.col("whole") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0)).cast("int")
    taken = rows.join(limits, F.col("from").eqNullSafe(F.col("of"))).select("d", times.alias("times")).where("times > 0")
    return taken.select("d", F.explode(F.sequence(F.lit(1), "times"))).select("d.*")
