"""Benchmark contamination: a denylist of lines and line pairs, and the guard that looks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.functions.identity import sha

STRONG = 32
PAIR = 40
#: Digests of a denylist are rows of 80 bytes; up to so many are broadcast, more are joined by shuffle.
BROADCAST_DIGESTS = 500_000
# What names a function, what a document must hold, and the reasons given.
FUNCTION = r"(?m)^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("
MARKER = r"mostly basic python problems|\bmbpp\b"
JSON_KEYS = ('"task_id"', '"test_list"', '"challenge_test_list"')
REASONS = ("mbpp-marker", "mbpp-json-shape", "mbpp-exact-code", "mbpp-problem-or-test", "mbpp-embedded-code")


def strong_lines(lines: Column) -> Column:
    """Distinct digests of the collapsed lines long enough to tell."""
    return F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(x) >= STRONG), sha))


def line_pairs(lines: Column) -> Column:
    """Distinct digests of neighbouring collapsed lines that are long enough together."""
    after = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    before = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))
    both = F.zip_with(before, after, lambda a, b: F.when(F.length(a) + F.length(b) >= PAIR, sha(F.concat(a, F.lit("\n"), b))))
    return F.array_distinct(F.array_compact(both))


def exact_digest(lines: Column) -> Column:
    return sha(F.array_join(lines, "\n"))


def denylist(items: DataFrame, text: str = "text", code: str | None = None, tests: tuple[str, ...] = (), least_items: int = 1) -> DataFrame:
    """(kind, digest) of benchmark items: kinds strong, pair, exact and function. Too few items are an error."""
    if (n := items.limit(least_items).count()) < least_items:
        raise ValueError(f"the benchmark has {n} items, expected {least_items} at least")
    code = code or text
    lines = strong_lines(tx.bare_lines(F.col(text)))
    for column in tests:
        lines = F.concat(lines, F.flatten(F.transform(F.coalesce(F.col(column), F.array()), lambda x: strong_lines(tx.bare_lines(x)))))
    bare = tx.bare_lines(F.col(code))
    kinds = {
        "strong": lines, "pair": line_pairs(bare),
        "exact": F.when(F.size(bare) > 0, F.array(exact_digest(bare))).otherwise(F.array().cast("array<string>")),
        "function": F.regexp_extract_all(F.col(code), F.lit(FUNCTION), F.lit(1)),
    }
    each = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("digests")) for k, c in kinds.items()))
    return items.select(F.explode(each).alias("k")).select("k.kind", F.explode("k.digests").alias("digest")).distinct()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS else df


def hits(docs: DataFrame, deny: DataFrame) -> DataFrame:
    """(id, kind, hits): how many distinct denied digests of a kind a document holds; only documents with any."""
    # lines are computed once; only their digests are exploded
    lines = docs.select("id", "text", tx.bare_lines(F.col("text")).alias("__bare"))
    each = F.array(
        F.struct(F.lit("strong").alias("kind"), strong_lines(F.col("__bare")).alias("d")),
        F.struct(F.lit("pair").alias("kind"), line_pairs(F.col("__bare")).alias("d")),
        F.struct(F.lit("exact").alias("kind"), F.array(exact_digest(F.col("__bare"))).alias("d")),
        F.struct(F.lit("function").alias("kind"), F.array_distinct(F.regexp_extract_all("text", F.lit(FUNCTION), F.lit(1))).alias("d")),
    )
    held = lines.select("id", F.explode(each).alias("k")).select("id", "k.kind", F.explode("k.d").alias("digest"))
    return held.join(_small(deny), ["kind", "digest"], "left_semi").groupBy("id", "kind").agg(F.count(F.lit(1)).alias("hits"))


def guard(docs: DataFrame, deny: DataFrame) -> DataFrame:
    """(id, reason) of contaminated documents; the first reason that holds is given."""
    lowered = F.lower("text")
    shaped = F.lit(True)
    for key in JSON_KEYS:
        shaped &= F.contains(lowered, F.lit(key))
    marked = docs.select("id", F.when(lowered.rlike(MARKER), 1).when(shaped, 2).alias("rank")).where("rank is not null")
    n = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("hits"))), F.lit(0))
    counted = hits(docs, deny).groupBy("id").agg(n("exact").alias("e"), n("strong").alias("s"), n("pair").alias("p"), n("function").alias("f"))
    embedded = (F.col("p") >= 2) | (F.col("p") >= 1) & (F.col("f") >= 1)
    found = counted.select("id", F.when(F.col("e") > 0, 3).when(F.col("s") > 0, 4).when(embedded, 5).alias("rank")).where("rank is not null")
    first = marked.unionByName(found).groupBy("id").agg(F.min("rank").alias("rank"))
    return first.select("id", F.element_at(F.array(*map(F.lit, REASONS)), F.col("rank")).alias("reason"))
