"""Line dedup across sites, with DataFrame operations only.

A line's spread is the number of distinct sites whose documents hold it. HyperLogLog sketches of the sites, one for
each line hash, merge by aggregation; lines whose estimate is near the threshold get an exact distinct count. Lines
of `long_words` words or more are boilerplate from `long_sites` sites on, shorter ones from `min_sites`. Of boilerplate
only the first occurrence (least doc_id, then position) stays, so no content leaves the corpus, and every other document
keeps the rest of its lines. A document that would lose more than `MOST` of its characters isn't a page with
boilerplate but a copy: it stays whole, for document dedup to judge, which a remnant would escape.

A line is what stands between line feeds, compared without white space at its ends and hashed to 96 bits. Blank lines
are never boilerplate. Words are runs without white space.

Defined cases: a null text stays null and has no lines; a null site counts as one site; rows that repeat a doc_id are
separate documents unless their texts agree, and equal rows are treated alike; documents with a null id come after
all others; an empty table gives an empty result. Input columns keep their names and values, whatever they are called,
but for the text; they travel in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import cut

MIN_SITES = 5
LONG_WORDS = 40
LONG_SITES = 3
#: Numerator and denominator of the share of its characters that a document may lose.
MOST = (2, 3)
LG_K = 10
#: Estimates from NEAR[0] to NEAR[1] times the threshold are checked exactly; the sketch's error is under 4 %.
NEAR = (0.5, 2.0)
#: A boilerplate line is a row of about 40 bytes; up to so many are broadcast, more are joined by shuffle.
BROADCAST_LINES = 100_000
EDGE = " \t\r\x0b\x0c"
_NO_ID = 2**63 - 1


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(EDGE))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """What names a document: its id, and a hash of its text that tells rows of one id apart."""
    return F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)), F.xxhash64(docs[text_col])


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str, long_words: int = LONG_WORDS) -> DataFrame:
    """(id, doc, site, pos, size, long, h1, h2) of each line that isn't blank; doc tells rows of one id apart."""
    i, doc = _keys(docs, id_col, text_col)
    rows = docs.select(
        i.alias("id"),
        doc.alias("doc"),
        F.coalesce(docs[site_col].cast("string"), F.lit("\0")).alias("site"),
        F.posexplode(F.transform(F.split(docs[text_col], "\n"), stripped)).alias("pos", "line"),
    )
    # at least as many characters as so many words need; the pattern reads few lines then
    long_ = (F.length("line") >= 2 * long_words - 1) & (F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")) >= long_words)
    return rows.where("line != ''").select(
        "id", "doc", "site", "pos", F.length("line").alias("size"), long_.alias("long"), F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, long_sites: int = LONG_SITES) -> DataFrame:
    """(h1, h2, first) of the lines on as many sites as their length asks; first is the place of the first occurrence."""
    need = F.when(F.col("long"), long_sites).otherwise(min_sites)
    # the least and the greatest site tell a spread of one exactly, which nearly all lines have
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"),
        (F.min("site") != F.max("site")).alias("some"),
        F.first("long").alias("long"),
        F.min(F.struct("id", "pos", "doc")).alias("first"),
    )
    several = F.col("some") if min(min_sites, long_sites) > 1 else F.lit(True)
    spread = cut(spread.where(several & (F.col("sites") >= need * NEAR[0])).withColumn("need", need))
    sure = F.col("sites") > F.col("need") * NEAR[1]
    near = spread.where(~sure).select("h1", "h2", "need")
    if near.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        near = F.broadcast(near)
    # distinct (line, site) pairs first, so a hot line is a row for each site and task
    exact = (
        lines.select("h1", "h2", "site").join(near, ["h1", "h2"]).groupBy("h1", "h2", "need", "site").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2", "need").agg(F.count("one").alias("exact")).where(F.col("exact") >= F.col("need")).select("h1", "h2")
    )
    return spread.where(sure).select("h1", "h2", "first").unionByName(
        spread.join(exact, ["h1", "h2"]).select("h1", "h2", "first")
    )


def dedup_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    removed_col: str = "__removed",
    long_sites: int = LONG_SITES,
    long_words: int = LONG_WORDS,
) -> DataFrame:
    """The documents with their text less repeated boilerplate, and the number of lines removed in `removed_col`."""
    if removed_col in docs.columns:
        raise ValueError(f"the documents have a column {removed_col} already; name another in removed_col")
    lines = lines_of(docs, id_col, text_col, site_col, long_words)
    found = cut(boilerplate(lines, min_sites, long_sites))
    if found.count() <= BROADCAST_LINES:
        found = F.broadcast(found)
    # a document's repeated places, their characters once for each place though equal rows count them anew
    hits = lines.join(found, ["h1", "h2"]).where(F.struct("id", "pos", "doc") != F.col("first"))
    removed = hits.groupBy("id", "doc").agg(F.collect_set(F.struct("pos", "size")).alias("gone"))
    i, doc = _keys(docs, id_col, text_col)
    whole = docs.select(F.struct("*").alias("d"), i.alias("id"), doc.alias("doc"))
    split = F.split(F.col("d")[text_col], "\n")
    size = F.aggregate(split, F.lit(0), lambda n, line: n + F.length(stripped(line)))
    lost = F.aggregate("gone", F.lit(0), lambda n, g: n + g["size"])
    page = F.col("gone").isNotNull() & (lost * MOST[1] <= size * MOST[0])
    joined = whole.join(removed, ["id", "doc"], "left").select("d", F.when(page, F.col("gone.pos")).alias("gone"))
    # a difference of sets, as a search of `gone` for each line would be quadratic; the lines are bound, so split once
    places = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.get(F.transform(F.array(split), lambda lines: F.transform(places(lines), lambda i: F.get(lines, i))), F.lit(0))
    new = F.when(F.col("gone").isNull(), F.col("d")[text_col]).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *(new.alias(c) if c == text_col else F.col("d")[c].alias(c) for c in docs.columns),
        F.coalesce(F.size("gone"), F.lit(0)).alias(removed_col),
    )
