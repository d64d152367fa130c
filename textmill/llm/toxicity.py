"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and bytes beyond ASCII in the lower-cased text. Features are its distinct words,
pairs of neighbours and pairs with one word between, hashed to `BITS` bits. Every coordinate has its own learning
rate and an L1 threshold, so most weights are exactly zero and the model is a short list that travels with the task.
Whole texts are scored, in NumPy over the bytes of a batch.

Training uses at most `SAMPLE` labelled documents of either class, chosen by a hash of their id, whole texts, and no more
of them than hold `MOST_CHARACTERS`; that bound is the only thing here that doesn't grow with the data.

Defined cases: null and wordless texts score by the bias alone; a document labelled more than once counts as 1 if any
label is 1; null labels and null ids teach nothing; without labels every score is 0.5; repeated rows score alike; an
empty table gives an empty result. A word may have any length; a document's score doesn't depend on its neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import small_batches

BITS = 20
SAMPLE = 4000
#: Characters of either class that are learnt from; it bounds what the driver holds, and at least one document is.
MOST_CHARACTERS = 100_000_000
#: Bytes hashed at once; words go on from one piece to the next.
PIECE = 1 << 16
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_PAIR, _SKIP = np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(PIECE, _RADIX))])
_INVERSE = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(PIECE, np.uint64(pow(int(_RADIX), -1, 1 << 64))))])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document index of each word of the texts data[offsets[i]:offsets[i + 1]], in order."""
    hashes, places = [], []
    at, end = int(offsets[0]), int(offsets[-1])
    borders = np.unique(offsets)
    open_, open_at = None, 0  # sum and place of the word that the last piece ended in
    while at < end:
        stop = min(at + PIECE, end)
        part = data[at:stop]
        word = _IS_WORD[part]
        fresh = np.zeros(len(part) + 1, bool)
        fresh[borders[np.searchsorted(borders, at) : np.searchsorted(borders, stop, "right")] - at] = True
        before = np.concatenate([[False], word])
        after = np.concatenate([word, [False]])
        starts = np.flatnonzero(after & (~before | fresh))
        ends = np.flatnonzero(before & (~after | fresh))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(part)])])
        found, where = (sums[ends] - sums[starts]) * _INVERSE[starts], starts + at
        goes_on = stop < end and bool(word[-1]) and not fresh[-1]
        if open_ is not None:
            if word[0] and not fresh[0]:
                power = np.uint64(pow(int(_RADIX), at - open_at, 1 << 64))
                found[:1] = found[:1] * power + open_
                where[0] = open_at
            else:
                found, where = np.concatenate([[open_], found]), np.concatenate([[open_at], where])
            open_ = None
        if goes_on:
            open_, open_at = found[-1], int(where[-1])
            found, where = found[:-1], where[:-1]
        hashes.append(_mixed(found))
        places.append(where)
        at = stop
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.searchsorted(offsets, np.concatenate(places), "right") - 1


def features(data: np.ndarray, offsets: np.ndarray):
    """Yields (document index, feature) arrays for words, neighbours and skip-grams; a feature may repeat."""
    h, doc = word_hashes(data, offsets)
    shift = np.uint64(64 - BITS)
    yield doc, (_mixed(h) >> shift).astype(np.int64)
    for gap, odd in ((1, _PAIR), (2, _SKIP)):
        same = np.flatnonzero(doc[gap:] == doc[:-gap])
        yield doc[same], (_mixed(h[same] * odd + h[same + gap]) >> shift).astype(np.int64)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def _slices(texts: pa.Array, size: int = 4 << 20):
    """Slices of a batch of about so many bytes, at a row each at least."""
    data, offsets = _buffers(texts)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield data, offsets[at : stop + 1]
        at = stop


@dataclass(frozen=True)
class Model:
    """Bias, and the weights that aren't zero."""

    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out

    def score(self, texts: pa.Array, dense: np.ndarray) -> np.ndarray:
        out = []
        for data, offsets in _slices(texts):
            docs, found = [], []
            for doc, feature in features(data, offsets):
                hit = np.flatnonzero(dense[feature])
                docs.append(doc[hit])
                found.append(feature[hit])
            key = np.unique(np.concatenate(docs) << BITS | np.concatenate(found))
            total = np.bincount(key >> BITS, weights=dense[key & ((1 << BITS) - 1)], minlength=len(offsets) - 1)
            out.append(1 / (1 + np.exp(-np.clip(total + self.bias, -60, 60))))
        return np.concatenate(out) if out else np.empty(0)


def distinct_features(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct features of each text."""
    out = []
    for data, offsets in _slices(texts):
        parts = list(features(data, offsets))
        key = np.unique(np.concatenate([d for d, _ in parts]) << BITS | np.concatenate([f for _, f in parts]))
        bounds = np.searchsorted(key >> BITS, np.arange(len(offsets)))
        out += np.split((key & ((1 << BITS) - 1)).astype(np.int32), bounds[1:-1]) if len(offsets) > 1 else []
    return out


def fit(
    rows: list[tuple[np.ndarray, int]], epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.01, seed: int = 17
) -> Model:
    """FTRL-proximal over (features, label) rows in a seeded order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    bias = 0.0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, label = rows[k]
            w = weights(i)
            bias = -zb / ((beta + nb**0.5) / alpha)  # the bias isn't regularised
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -60, 60))) - label
            root = np.sqrt(n[i] + g * g)
            z[i] += g - (root - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias
            nb += g * g
    index = np.flatnonzero(np.abs(z) > l1)
    return Model(float(-zb / ((beta + nb**0.5) / alpha)), index, weights(index).astype(np.float32))


def feature_column(text: Column) -> Column:
    """Distinct features (array<int>) of a text column."""

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(distinct_features(texts), pa.list_(pa.int32()))

    return of(F.lower(text))


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """Model from labelled documents; `usable` is a condition on the id column of rows to learn from."""
    known = labels.select(F.col(id_col).alias(id_col), F.col(label_col).cast("int").alias("y")).where(f"y in (0, 1) and {id_col} is not null")
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(id_col).agg(F.max("y").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # of a class with more rows than the bound, about as many as the bound, by hash
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), id_col), F.lit(1 << 30))
    share = F.when(F.col("y") == 1, sample / max(counts.get(1, 0), sample)).otherwise(sample / max(counts.get(0, 0), sample))
    picked = known.where(draw < share * (1 << 30)).withColumn("draw", draw)
    texts = docs.select(id_col, text_col).join(F.broadcast(picked), id_col)
    # which rows are learnt from: the first of either class by draw, as far as the bounds on rows and characters go
    last, seen, size = {}, {0: 0, 1: 0}, {0: 0, 1: 0}
    sized = texts.select("draw", F.col(id_col).alias("i"), "y", F.coalesce(F.length(text_col), F.lit(0)).alias("n")).toArrow().to_pylist()
    for r in sorted(sized, key=lambda r: (r["draw"], r["i"], r["n"])):
        y = r["y"]
        seen[y], size[y] = seen[y] + 1, size[y] + r["n"]
        if seen[y] <= sample and (seen[y] == 1 or size[y] <= MOST_CHARACTERS):
            last[y] = r["draw"]
        else:
            size[y] = MOST_CHARACTERS + 1  # none after the first left out
    near = F.lit(False)
    for y, d in last.items():
        near |= (F.col("y") == y) & (F.col("draw") <= d)
    rows = texts.where(near).select(id_col, "y", "draw", feature_column(F.col(text_col)).alias("features")).toArrow()
    order = np.lexsort((np.asarray(rows[id_col]), np.asarray(rows["draw"])))
    return fit([(rows["features"][k].values.to_numpy(), rows["y"][k].as_py()) for k in order.tolist()])


def score(text: Column, model: Model) -> Column:
    """Score (double) of a text column: the probability of label 1."""
    small_batches(SparkSession.active())
    held: list[np.ndarray] = []

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(model.dense())
        return pa.array(model.score(texts, held[0]), pa.float64())

    return of(F.lower(text))
