import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from textmill.config import QUALITY
from textmill.functions import text as tx


def column(spark, texts, make):
    return [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", make(F.col("text")).alias("x")).orderBy("i").collect()]


TEXTS = ["", "one", "Straße  ÉCOLE\n\n x ", "a\nb\na\n", "\n", "l1\r\nl2\rl3", "don't stop_it 42", "  \t "]


ODD = [
    "ﬁne ＡＢＣ İ", "e\u0301 x", "a\u00a0b\u2003c\u3000d\x1ce\x85f", "Ὀδυσσεύς Σ", "№ ½ ² ª µ ſ", "Ⅷ ㎏ ｶﾞ", "ẞ ŉ ǰ ΐ", "I\u0307 i\u0307", "\u212b\u2126", "“quotes” – — ’ €",
    "x\u2028y\u2029z\x0bw\x0cv\x1dU\x1eT", "한국어 각", "𝔘𝔫𝔦", "ÀÉÎÕÜßÿ¿¡§©®°±¶·»«×÷",
]


def test_normal_forms(spark):
    prose = lambda t: " ".join(unicodedata.normalize("NFKC", t.replace("\r\n", "\n").replace("\r", "\n")).casefold().split())
    texts = [*TEXTS, *ODD]
    assert column(spark, texts, tx.normalized) == [prose(t) for t in texts]
    assert column(spark, texts, tx.normalize_exact) == [prose(t) for t in texts]
    code = ["\n\n  a  \n\tb\t\n\n", "x\r\ny \r", "", "  \n  "]
    assert column(spark, code, lambda c: tx.normalized(c, code=True)) == ["  a\n\tb", "x\ny", "", ""]
    plain = lambda t: "\n".join(x.rstrip() for x in unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n")).split("\n")).strip("\n")
    code = [*code, *ODD, "a\u00a0\n\u3000\nb\x1c\x85", "e\u0301  \n"]
    assert column(spark, code, lambda c: tx.normalized(c, code=True)) == column(spark, code, lambda c: tx.normalize_exact(c, code=True)) == [plain(t) for t in code]


def test_every_character_that_stays_native_is_plain():
    """The built-in form agrees with the whole one on each character that it is used for."""
    native = lambda t: t.lower().replace("ß", "ss")
    for c in map(chr, range(0x2100)):
        if re.fullmatch(f"[{tx.PLAIN}]", c) and not c.isspace():
            assert unicodedata.normalize("NFKC", c).casefold() == native(c), hex(ord(c))
        if re.fullmatch(f"[{tx.PLAIN_CODE}]", c):
            assert unicodedata.normalize("NFC", c) == c, hex(ord(c))
        assert bool(re.fullmatch(f"[{tx.WHITE}]", c)) == c.isspace(), hex(ord(c))
        assert (len(("a" + c + "b").splitlines()) == 2) == bool(re.fullmatch(tx.BREAK, c)), hex(ord(c))


def test_lines_and_words(spark):
    assert column(spark, ["", "a\n", "a\n\nb", "\n"], tx.split_lines) == [[""], ["a"], ["a", "", "b"], [""]]
    assert column(spark, ODD, tx.split_lines) == [t.splitlines() for t in ODD]
    assert column(spark, ["a\r\n\r\nb\r", "\x1e\x85"], tx.split_lines) == [["a", "", "b"], ["", ""]]
    assert column(spark, ["don't stop_it, été 42!"], tx.words) == [["don't", "stop_it", "été", "42"]]


def test_shingles_and_even_samples(spark):
    words = [f"w{i}" for i in range(9)]
    assert column(spark, [" ".join(words), "a b", ""], lambda c: tx.shingles(c, 5)) == [[" ".join(words[i : i + 5]) for i in range(5)], ["a", "b"], []]
    assert column(spark, [" ".join(words)], lambda c: tx.evenly(tx.words(c), 4)) == [[words[i * 9 // 4] for i in range(4)]]


def flagged(spark, text, code=False):
    df = tx.with_lines(spark.createDataFrame([(text,)], "text string"))
    m = tx.measures(F.col("text"))
    row = df.select("text", *(c.alias(k) for k, c in m.items()))
    return row.select(tx.flags(F.col("text"), {k: F.col(k) for k in m}, QUALITY, code).alias("f")).first().f


LONG = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize(
    ("text", "flag"),
    [
        ("", "empty"), ("few words", "too_short"), (LONG + "\0", "null_character"), (LONG + "�", "replacement_character"),
        (LONG + "\n" + "x" * 2001, "very_long_line"), (LONG + "\nsame" * 40, "high_line_repetition"),
        (LONG + " http://a www.b" * 4, "high_url_density"), (LONG + " Do Not Edit", "possible_generated"),
        (LONG + " AKIA" + "A1" * 8, "possible_secret"), (LONG + "-----BEGIN RSA PRIVATE KEY-----", "possible_secret"),
    ],
)
def test_each_flag(spark, text, flag):
    assert flag in flagged(spark, text) and flag not in flagged(spark, LONG + "\nplain")


def test_code_flags(spark):
    assert flagged(spark, "x" * 1500, code=True) == ["likely_minified"] and flagged(spark, "x = 1", code=True) == ["too_short"]


def test_measures_agree_with_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab É1 \n{'.\r\x0b\u2028\u00a0") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    df = tx.with_lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    rows = df.select("i", *(c.alias(k) for k, c in tx.measures(F.col("text")).items())).orderBy("i").collect()
    for t, r in zip(texts, rows):
        lines = t.splitlines() or [t]
        bare = [" ".join(x.split()) for x in lines if x.strip()]
        assert (r.characters, r.lines, r.nonempty_lines) == (len(t), len(lines), len(bare))
        assert r.words == len(re.findall(r"[\w']+", t)) and r.max_line_chars == max(map(len, lines))
        near = lambda got, want, digits: abs(got - want) <= 0.5000001 * 10**-digits and got == round(got, digits)
        assert near(r.alphanumeric_fraction, sum(c.isalnum() for c in t) / len(t), 6)
        assert near(r.whitespace_fraction, sum(c.isspace() for c in t) / len(t), 6)
        assert near(r.repeated_line_fraction, 1 - len(set(bare)) / len(bare) if bare else 0, 6)
        assert near(r.mean_line_chars, len(t) / len(lines), 3)


def test_fractions_are_rounded_half_to_even(spark):
    cases = [(1, 128, 6), (3, 128, 6), (5, 2, 0), (7, 2, 0), (2, 3, 6), (10**9, 7, 3), (0, 5, 6)]
    row = spark.range(1).select(*(tx.rounded(F.lit(n), F.lit(d), k).alias(f"c{i}") for i, (n, d, k) in enumerate(cases))).first()
    assert list(row) == [0.007812, 0.023438, 2.0, 4.0, 0.666667, 142857142.857, 0.0]


def test_quick_classes_say_the_same(spark):
    """Every character of the first plane: the quick tests for plain and for white space agree with the classes."""
    chars = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    for code, name in ((False, tx.PLAIN), (True, tx.PLAIN_CODE)):
        known = re.compile(f"[{name}]*")
        texts = [*chars, *("aé" + c + "ü b" for c in chars[:0x2200]), "", "a" * 50_000, "aé" * 50_000, "aé" * 50_000 + " "]
        assert column(spark, texts, lambda t: tx.plain(t, code)) == [known.fullmatch(t) is not None for t in texts]
    texts = [f"a{c}b" for c in chars]
    folded = column(spark, texts, tx.collapsed)
    assert [t == "a b" for t in folded] == [c.isspace() for c in chars]


def test_normal_form_is_no_dearer_than_a_few_scans(spark):
    """The normal form of plain texts against counting their words; it took eight times as long."""
    text = "Größe und Maß, déjà vu: the quick brown fox jumps over the lazy dog. "
    df = spark.range(64, numPartitions=4).select(F.repeat(F.lit(text), F.lit(4000) + (F.col("id") % 2).cast("int")).alias("text")).cache()
    df.count()

    def took(make):
        best = 1e9
        for _ in range(3):
            began = time.time()
            df.select(make(F.col("text")).alias("x")).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        return best

    assert took(lambda t: F.octet_length(tx.normalized(t))) < 4 * took(tx.word_count)
    df.unpersist()
