"""Calibration of the candidate search: copies changed to a known similarity, and how many of them the bands find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.config import LshConfig
from textmill.operators.neardup import band_keys, wilson, windows

# Names of the bins with their least and greatest similarity, in thousandths, and the kinds of change.
BINS = {"below_wide": (700, 760), "below_boundary": (770, 795), "above_boundary": (800, 830), "above_target": (840, 880), "high_similarity": (900, 950)}
KINDS = ("append_donor_fragment", "truncate_tail", "replace_contiguous_with_donor")
EVALUATIONS = 24
#: Control pairs that share no word, which no band may join.
UNRELATED = "unrelated"


def changed(words: list[str], kind: str, amount: int) -> list[str]:
    """The words with so many others appended, so many cut off, or a run of so many in the middle replaced."""
    if kind == "truncate_tail":
        return words[: len(words) - amount]
    others = [f"donor{i}" for i in range(amount)]
    if kind == "append_donor_fragment":
        return words + others
    start = (len(words) - amount) // 2
    return words[:start] + others + words[start + amount :]


def overlap(ids: np.ndarray, kind: str, amount: int, width: int) -> tuple[int, int]:
    """Intersection and union of the shingle sets before and after a change; `ids` number the shingles of the words.

    Every shingle that holds another word is new, so only what is left of the old ones has to be counted.
    """
    n, whole = len(ids), len(np.unique(ids))
    if kind == "append_donor_fragment":
        return whole, whole + amount
    if kind == "truncate_tail":
        return len(np.unique(ids[: n - amount])), whole
    start = (n + width - 1 - amount) // 2
    left = np.concatenate([ids[: max(0, start - width + 1)], ids[start + amount :]])
    return len(np.unique(left)), whole + n - len(left)


def amount_for(ids: np.ndarray, kind: str, low: int, high: int, width: int) -> int | None:
    """A change that leaves low to high thousandths of similarity, by halving; None if none of so many tries does."""
    least, most = 1, len(ids) - 1
    for _ in range(EVALUATIONS):
        if least > most:
            return None
        amount = (least + most) // 2
        inter, union = overlap(ids, kind, amount, width)
        if inter * 1000 < low * union:
            most = amount - 1
        elif inter * 1000 > high * union:
            least = amount + 1
        else:
            return amount
    return None


def trials(words: Column, config: LshConfig) -> Column:
    """array<struct<kind, bin, found, hit, exact>> of a document's words, one for each kind and bin and one control.

    found tells whether a change of that similarity exists, hit whether a band is shared, exact whether the sets of the
    changed text have the similarity that was computed.
    """

    def of_document(w: list[str]) -> list[dict]:
        texts = windows(w, config.width)
        numbers: dict[str, int] = {}
        ids = np.array([numbers.setdefault(t, len(numbers)) for t in texts])
        own, out = set(band_keys([t.encode() for t in texts], config)), []
        for kind in KINDS:
            for name, (low, high) in BINS.items():
                amount = amount_for(ids, kind, low, high, config.width)
                if amount is None:
                    out.append({"kind": kind, "bin": name, "found": False, "hit": False, "exact": True})
                    continue
                other = windows(changed(w, kind, amount), config.width)
                both = (len(numbers.keys() & set(other)), len(numbers.keys() | set(other)))
                hit = not own.isdisjoint(band_keys([t.encode() for t in other], config))
                out.append({"kind": kind, "bin": name, "found": True, "hit": hit, "exact": both == overlap(ids, kind, amount, config.width)})
        control = band_keys([t.encode() for t in windows([f"other{i}" for i in range(len(w))], config.width)], config)
        out.append({"kind": UNRELATED, "bin": UNRELATED, "found": True, "hit": not own.isdisjoint(control), "exact": True})
        return out

    kind = pa.list_(pa.struct([("kind", pa.string()), ("bin", pa.string()), ("found", pa.bool_()), ("hit", pa.bool_()), ("exact", pa.bool_())]))

    @F.arrow_udf("array<struct<kind: string, bin: string, found: boolean, hit: boolean, exact: boolean>>")
    def of(rows: pa.Array) -> pa.Array:
        return pa.array([of_document(r.as_py()) for r in rows], kind)

    return of(words)


def report(docs: DataFrame, config: LshConfig, z: float, least_words: int = 96, least_recall: float = 0.98) -> DataFrame:
    """(kind, bin, trials, hits, failures, errors, lower, upper, passed) over all documents (w) of enough words.

    A bin at or above the threshold passes if the lower bound of its recall reaches `least_recall`, one below it and the
    control whatever is found; changes that couldn't be made are failures, wrong similarities are errors.
    """
    each = docs.where(F.size("w") >= least_words).select(F.explode(trials(F.col("w"), config)).alias("t")).select("t.*")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = each.groupBy("kind", "bin").agg(count(F.col("found")).alias("trials"), count(F.col("hit")).alias("hits"), count(~F.col("found")).alias("failures"), count(~F.col("exact")).alias("errors"))
    bounds = wilson(F.col("hits"), F.col("trials"), z)
    rows = sums.select("*", *(c.alias(k) for k, c in bounds.items()))
    threshold = 1000 * config.jaccard
    above = F.col("bin").isin(*(b for b, (low, _) in BINS.items() if low >= threshold))
    passed = F.when(above, F.col("lower") >= least_recall).when(F.col("bin") == UNRELATED, F.col("hits") == 0).otherwise(F.lit(True))
    return rows.withColumn("passed", passed & (F.col("errors") == 0))
