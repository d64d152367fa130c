"""Text as column expressions: normal forms, words, lines, shingles, quality measures and flags.

Everything is a built-in expression, so it stays in generated code. The one Python function is the normal form of texts
with characters whose compatibility forms, composition or case folding the built-in functions don't cover; other texts
never reach it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.config import QualityPolicy

# Fixed values.
WORD = r"[\p{L}\p{N}_']+"
URL = r"(?i)https?://|www\."
CODE_LINE = (
    r"(?i)^\s*(?:def |class |import |from |function |const |let |var |#include|public |private |"
    r"if\s*\(|for\s*\(|while\s*\(|return\b|[{}]|</?[a-z])"
)
SECRETS = (
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{30,}\b",
)
#: White space of str.split and str.strip, the insides of a character class; and what ends a line in str.splitlines.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same white space to Java, which tests two conditions a character, not ten.
BLANK = r"(?U)[\s\x1c-\x1f]"
BREAK = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"
GENERATED = ("generated file", "auto-generated", "autogenerated", "do not edit", "machine generated")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, where it stands in a lambda that runs many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Characters beyond these need the whole normal form: of these, NFKC and NFC change none, and folding only the sharp s.
PLAIN = r"\x00-\x7f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\xff\u2013\u2014\u2018-\u201f\u20ac"
PLAIN_CODE = r"\x00-\u02ff"


def unix(text: Column) -> Column:
    """Line ends as line feeds."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def plain(text: Column, code: bool = False) -> Column:
    """Whether the built-in functions give the normal form, as no character is beyond the plain ones.

    ASCII texts show by their sizes; others are read in runs of ASCII and of the other plain characters, as a class of
    all of them, sought from every place, took most of the time of a normal form.
    """
    others = (PLAIN_CODE if code else PLAIN).replace(r"\x00-\x7f", "").replace(r"\x00-\u02ff", r"\x80-\u02ff")
    return (F.octet_length(text) == F.length(text)) | F.rlike(text, F.lit(rf"\A(?:[\x00-\x7f]++|[{others}]++)*+\z"))


def _normalized(text: str, code: bool) -> str:
    text = unicodedata.normalize("NFC" if code else "NFKC", text.replace("\r\n", "\n").replace("\r", "\n"))
    if code:
        return "\n".join(line.rstrip() for line in text.split("\n")).strip("\n")
    return " ".join(text.casefold().split())


def normalize_exact(text: Column, code: bool = False) -> Column:
    """The normal form with Unicode composition and case folding, by Arrow batches."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((None if t is None else _normalized(t, code) for t in texts.to_pylist()), pa.string())

    return of(text)


def normalized(text: Column, code: bool = False) -> Column:
    """Code: line ends unified, NFC, lines right-trimmed, no blank lines at the ends. Prose: NFKC, folded, collapsed."""
    if code:
        blank = WHITE.replace(r"\t-\r", r"\t\x0b-\r")
        trimmed = F.regexp_replace(unix(text), rf"[{blank}]+(?=\n|\z)", "")
        native = F.regexp_replace(F.regexp_replace(trimmed, r"^\n+", ""), r"\n+\z", "")
    else:
        native = collapsed(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))
    odd = ~plain(text, code)
    return F.when(odd, normalize_exact(F.when(odd, text), code)).otherwise(native)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_lines(text: Column) -> Column:
    """Lines, without the empty one after a final line break."""

    def open_(lines: Column) -> Column:
        closed = (F.size(lines) > 1) & (F.element_at(lines, -1) == "")
        return F.when(closed, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)

    return bind(F.split(text, BREAK), open_)


def bare_lines(text: Column) -> Column:
    """Collapsed lines that aren't blank."""
    return F.filter(F.transform(F.split(text, BREAK), collapsed), lambda line: line != "")


def shingles(text: Column, width: int) -> Column:
    """Windows of `width` words of the normal form; the words themselves if there are fewer."""

    def windows(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.when(F.size(w) < width, w).otherwise(each)

    return bind(words(normalized(text)), windows)


def evenly(values: Column, most: int) -> Column:
    """At most `most` values, at even steps."""

    def sampled(v: Column) -> Column:
        n = F.size(v).cast("long")
        places = F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))
        taken = F.transform(places, lambda i: F.element_at(v, (F.floor(i * n / F.lit(most)) + 1).cast("int")))
        return F.when(n <= most, v).otherwise(taken)

    return bind(values, sampled)


def with_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with the text's lines and its collapsed lines, which `measures` reads; computed once for all of them."""
    df = df.withColumn("__lines", split_lines(F.col(text)))
    return df.withColumn("__bare", F.filter(F.transform("__lines", collapsed), lambda line: line != ""))


def rounded(n: Column, of: Column, digits: int) -> Column:
    """n / of to some digits, half to even, computed in whole numbers."""
    of, scaled = of.cast("long"), n.cast("long") * 10**digits
    rest = scaled % of
    low = F.floor((scaled - rest) / of)
    up = (2 * rest > of) | ((2 * rest == of) & (low % 2 == 1))
    return (low + up.cast("long")) / F.lit(10.0**digits)


def measures(text: Column) -> dict[str, Column]:
    """The quality measures of rows that `with_lines` made."""
    lines, bare = F.col("__lines"), F.col("__bare")
    n, filled, chars = F.size(lines).cast("long"), F.size(bare).cast("long"), F.length(text).cast("long")
    one = F.lit(1)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    code = F.size(F.filter(lines, lambda line: line.rlike(CODE_LINE)))
    repeated = filled - F.size(F.array_distinct(bare))
    return {
        "characters": chars,
        "lines": n,
        "nonempty_lines": filled,
        "repeated_lines": repeated,
        "words": word_count(text),
        "max_line_chars": F.array_max(F.transform(lines, F.length)).cast("long"),
        "mean_line_chars": rounded(chars, F.greatest(n, one), 3),
        "repeated_line_fraction": rounded(repeated, F.greatest(filled, one), 6),
        "whitespace_fraction": rounded(count(BLANK), F.greatest(chars, one), 6),
        "alphanumeric_fraction": rounded(count(r"[\p{L}\p{N}]"), F.greatest(chars, one), 6),
        "url_count": count(URL),
        "code_line_fraction": rounded(code, F.greatest(n, one), 6),
    }


def flags(text: Column, m: dict[str, Column], policy: QualityPolicy, code: bool = False) -> Column:
    """Sorted quality flags, from the text and its measures."""
    head = F.lower(F.left(text, F.lit(policy.generated_head)))
    secret = F.left(text, F.lit(policy.secret_head))
    conditions = {
        "empty": text == "",
        "too_short": F.octet_length(text) < policy.short_bytes if code else m["words"] < policy.short_words,
        "null_character": F.contains(text, F.lit("\0")),
        "replacement_character": F.contains(text, F.lit("�")),
        "very_long_line": m["max_line_chars"] > policy.long_line,
        "high_line_repetition": (m["repeated_lines"] / F.greatest(m["nonempty_lines"], F.lit(1)) > policy.repeated_lines) & (m["nonempty_lines"] >= policy.repeated_lines_from),
        "high_url_density": (m["words"] > 0) & (m["url_count"] / F.greatest(m["words"], F.lit(1)) > policy.url_density),
        "possible_generated": F.rlike(head, F.lit("|".join(GENERATED))),
        "possible_secret": F.rlike(secret, F.lit("|".join(SECRETS))),
    }
    if code:
        conditions["likely_minified"] = (m["lines"] <= policy.minified_lines) & (m["max_line_chars"] > policy.minified_line)
    return F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in conditions.items()))))
