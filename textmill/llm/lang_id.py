"""Language ID: a bidirectional gated recurrent network over bytes, trained in NumPy.

The network reads a text's UTF-8 bytes forwards and backwards and gives every position a probability for each language;
a document's probabilities are the mean over all its positions, and long texts are read whole. To run many places at
once a text is cut into windows of `WINDOW` bytes, whose states are then carried over: each window is read anew from
the state that its neighbour ends with, up to the byte from which nothing changes by more than `SETTLED`, which a gated
network reaches soon; what hasn't settled at a window's end goes on into the next. So the windows' borders leave no
trace. The network learns by backpropagation through time over `STRETCH` bytes with the document's language as every
position's label.

Training uses at most `SAMPLE` documents of each language, chosen by a hash of their id, and their whole texts; that
bound is the only thing here that doesn't grow with the data. Languages are weighted alike.

Defined cases: a null text, and one without a letter, is `und` with score 0; so is everything when there is nothing to
learn from; null languages and null ids teach nothing; repeated rows are predicted alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import release, small_batches

WINDOW = 256
HIDDEN = 8
SAMPLE = 400
#: Bytes that training goes back through.
STRETCH = 64
#: Least number of training steps; more if a language's stretches need more to be read once.
STEPS = 150
BATCH = 384
#: Windows read at once; the arrays of a step stay in a core's cache.
BLOCK = 1024
SETTLED = 5e-5
#: The most of its state that a step keeps: what a byte says fades, so carried states settle within a few dozen bytes.
KEEP = 0.8
#: Steps between looks whether carried states have settled.
LOOK = 8
UNKNOWN = "und"
_DIRECTIONS = ("f", "b")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _init(classes: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in _DIRECTIONS:
        p["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden))  # what a byte adds to the update, reset and candidate
        p["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
        p["c" + d] = np.zeros((hidden, 1))
        p["o" + d] = rng.normal(0, 1 / np.sqrt(hidden), (classes, hidden))
    p["bias"] = np.zeros((classes, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _forward(p, d, steps, hidden):
    """States of one direction over steps of (byte values, mask or None), and what the way back needs."""
    h = np.zeros((hidden, len(steps[0][0])), np.float32)
    kept = []
    for b, mask in steps:
        x = p["x" + d][b].T
        u = p["u" + d] @ h
        zr = _sigmoid(x[: 2 * hidden] + u[: 2 * hidden])
        z, r = KEEP * zr[:hidden], zr[hidden:]
        un = u[2 * hidden :] + p["c" + d]
        n = np.tanh(x[2 * hidden :] + r * un)
        new = n + z * (h - n)
        if mask is not None:
            new = new * mask
        kept.append((b, mask, h, z, r, un, n, new))
        h = new
    return kept


def _backward(p, d, kept, into, hidden, grad):
    """Adds the gradients of one direction; into[t] is the gradient of step t's state from the output."""
    carried = np.zeros_like(into[0])
    gx, gu = np.zeros_like(p["x" + d]), np.zeros_like(p["u" + d])
    for (b, mask, h, z, r, un, n, _), own in zip(reversed(kept), reversed(into)):
        g = own + carried
        if mask is not None:
            g = g * mask
        dn = g * (1 - z) * (1 - n * n)
        dz = g * (h - n) * z * (1 - z / KEEP)
        dr = dn * un * r * (1 - r)
        dun = dn * r
        du = np.concatenate([dz, dr, dun])
        carried = g * z + p["u" + d].T @ du
        gu += du @ h.T
        grad["c" + d] += dun.sum(1, keepdims=True)
        np.add.at(gx, b, np.concatenate([dz, dr, dn]).T)
    grad["x" + d] += gx
    grad["u" + d] += gu


def loss_and_gradients(p, windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions of (n, length) windows, and its gradients."""
    hidden = p["cf"].shape[0]
    steps = [(np.ascontiguousarray(c), None) for c in windows.T]
    states = {"f": _forward(p, "f", steps, hidden), "b": _forward(p, "b", steps[::-1], hidden)}
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    into = {"f": [], "b": []}
    total, count = 0.0, windows.size
    for t in range(len(steps)):
        f, b = states["f"][t][-1], states["b"][-1 - t][-1]
        logits = p["of"] @ f + p["ob"] @ b + p["bias"]
        e = np.exp(logits - logits.max(0))
        q = e / e.sum(0)
        total -= np.log(q[labels, np.arange(len(labels))] + 1e-30).sum()
        q[labels, np.arange(len(labels))] -= 1
        q /= count
        grad["of"] += q @ f.T
        grad["ob"] += q @ b.T
        grad["bias"] += q.sum(1, keepdims=True)
        into["f"].append(p["of"].T @ q)
        into["b"].append(p["ob"].T @ q)
    _backward(p, "f", states["f"], into["f"], hidden, grad)
    _backward(p, "b", states["b"], into["b"][::-1], hidden, grad)
    return total / count, grad


@dataclass(frozen=True)
class Model:
    """Languages and parameters; a few kilobytes."""

    langs: tuple[str, ...]
    p: dict[str, np.ndarray]

    def _states(self, d: str, steps, h: np.ndarray) -> np.ndarray:
        """States (step, hidden, windows) of a direction from the states h on; `steps` each a byte row and a mask or None."""
        p, hidden, count = self.p, self.p["cf"].shape[0], h.shape[1]
        two = 2 * hidden
        # the logistic function by tanh of half the sum
        half = np.ones((3 * hidden, 1), np.float32)
        half[:two] = 0.5
        table = np.ascontiguousarray(p["x" + d] * half.T)
        weights, bias = p["u" + d] * half, p["c" + d]
        scale = half[:two] * np.repeat(np.array([[KEEP], [1]], np.float32), hidden, axis=0)
        out = np.empty((len(steps), hidden, count), np.float32)
        u = np.empty((3 * hidden, count), np.float32)
        x = np.empty((count, 3 * hidden), np.float32)
        for t, (b, mask) in enumerate(steps):
            np.take(table, b, axis=0, out=x, mode="clip")
            np.matmul(weights, h, out=u)
            zr, n = u[:two], u[two:]
            zr += x[:, :two].T
            np.tanh(zr, out=zr)
            zr *= scale
            zr += scale
            n += bias
            n *= zr[hidden:]
            n += x[:, two:].T
            np.tanh(n, out=n)
            new = out[t]
            np.subtract(h, n, out=new)
            new *= zr[:hidden]
            new += n
            if mask is not None:
                new *= mask
            h = new
        return out

    def _carried(self, d: str, steps, linked: np.ndarray, start: np.ndarray) -> np.ndarray:
        """States of windows of which those `linked` go on where the one before ends, the first where `start` is."""
        heads = np.flatnonzero(~linked | (np.arange(len(linked)) == 0))
        first = np.zeros((self.p["cf"].shape[0], len(heads)), np.float32)
        first[:, 0] = start
        # a text goes on much as it begins: the end of its first window is a good guess, and settles soon
        guess = self._states(d, [(b[heads], mask if mask is None else mask[heads]) for b, mask in steps], first)[-1]
        begin = guess[:, np.searchsorted(heads, np.arange(len(linked)), "right") - 1]
        begin[:, heads] = first
        out = self._states(d, steps, begin)
        while True:
            due = begin.copy()
            due[:, 1:] = np.where(linked[1:], out[-1][:, :-1], begin[:, 1:])
            some = np.flatnonzero(np.abs(due - begin).max(0) > SETTLED)
            if not len(some):
                return out
            begin[:, some] = h = due[:, some]
            for t in range(0, len(steps), LOOK):
                new = self._states(d, [(b[some], mask if mask is None else mask[some]) for b, mask in steps[t : t + LOOK]], h)
                moved = np.abs(new[-1] - out[t + len(new) - 1][:, some]).max(0) > SETTLED
                out[t : t + len(new), :, some] = new
                some, h = some[moved], new[-1][:, moved]
                if not len(some):
                    break

    def _backwards(self, windows: np.ndarray, lengths: np.ndarray, linked: np.ndarray, start: np.ndarray) -> np.ndarray:
        """States of the way back, the last window and the last byte first; what lies behind a text's end is zero."""
        shortest = int(lengths.min())
        masks = [None if t < shortest else (lengths[::-1] > t).astype(np.float32) for t in range(windows.shape[1])]
        rows = np.ascontiguousarray(windows[::-1].T)
        return self._carried("b", list(zip(rows, masks))[::-1], linked, start)

    def _pooled(self, windows: np.ndarray, lengths: np.ndarray, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sum over a window's positions of their probabilities, (windows, languages)."""
        shortest = int(lengths.min())
        total = np.zeros((len(self.langs), len(windows)), np.float32)
        for t in range(windows.shape[1]):
            q = self.p["of"] @ f[t]
            q += self.p["ob"] @ b[-1 - t][:, ::-1]
            q += self.p["bias"]
            np.exp(q, out=q)  # logits are bounded by the weights, states lying between -1 and 1
            q /= q.sum(0)
            if t >= shortest:
                q *= lengths > t
            total += q
        return total.T

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(documents, languages) for the texts data[offsets[i]:offsets[i + 1]]; zeros for an empty one."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = offsets[:-1][doc] + nth * WINDOW
        lengths = np.minimum(offsets[1:][doc] - starts, WINDOW)
        total = np.zeros((len(sizes), len(self.langs)))
        padded = np.concatenate([data[: offsets[-1]], np.zeros(WINDOW, np.uint8)])
        views = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
        goes_on, follows = np.append(nth[1:] > 0, False), nth > 0
        # between texts where that can be: only texts of over BLOCK windows go on in the next block
        begins, blocks, a = np.append(np.flatnonzero(~follows), len(doc)), [], 0
        while a < len(doc):
            z = int(begins[np.searchsorted(begins, a + BLOCK, "right") - 1])
            blocks.append(slice(a, z if z > a else a + BLOCK))
            a = blocks[-1].stop
        zero = np.zeros(self.p["cf"].shape[0], np.float32)
        back = lambda k, start: self._backwards(views[starts[k]], lengths[k], goes_on[k][::-1], start)
        # where a text goes on in the next block, the state that comes back from there
        behind, known = [zero] * len(blocks), {}
        for i in range(len(blocks) - 1, 0, -1):
            if nth[blocks[i].start]:
                known = {i: back(blocks[i], behind[i])}
                behind[i - 1] = known[i][-1][:, -1]
        ahead = zero
        for i, k in enumerate(blocks):
            windows = views[starts[k]]
            f = self._carried("f", [(row, None) for row in np.ascontiguousarray(windows.T)], follows[k], ahead if follows[k.start] else zero)
            b = known.pop(i) if i in known else back(k, behind[i])
            ahead = f[-1][:, -1]
            np.add.at(total, doc[k], self._pooled(windows, lengths[k], f, b))
        return total / np.maximum(sizes, 1)[:, None]


def stretches(text: str) -> np.ndarray:
    """The whole text as rows of STRETCH bytes; the last one reaches back, and a shorter text is repeated."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) < STRETCH:
        return np.resize(data, (1, STRETCH))
    whole = data[: len(data) // STRETCH * STRETCH].reshape(-1, STRETCH)
    return np.concatenate([whole, data[None, -STRETCH:]]) if len(data) % STRETCH else whole


def fit(
    windows: np.ndarray, labels: np.ndarray, langs: tuple[str, ...], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 11
) -> Model:
    """Model from (n, STRETCH) byte rows and the index of each one's language.

    Every row is read; languages come up alike, so those with fewer rows are read again.
    """
    rng = np.random.default_rng(seed)
    p = _init(len(langs), hidden, rng)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    groups = [rng.permutation(np.flatnonzero(labels == k)) for k in range(len(langs))]
    each = -(-batch // len(langs))
    steps = max(steps, -(-max(map(len, groups)) // each))
    for step in range(1, steps + 1):
        pick = np.concatenate([np.take(g, np.arange((step - 1) * each, step * each), mode="wrap") for g in groups])
        _, grad = loss_and_gradients(p, windows[pick], labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        lr = rate * (1 - step / (steps + 1))
        for k, g in grad.items():
            g = g * scale
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            p[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(langs, p)


def train(
    docs: DataFrame, usable: Callable[[Column], Column] | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model | None:
    """Model from the documents whose language is known; `usable` makes a condition of the id column. None without any."""
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where(
        F.col("i").isNotNull() & F.col("l").isNotNull() & (F.length("t") > 0) & (F.lit(True) if usable is None else usable(F.col("i")))
    )
    counts = {r.l: r.n for r in known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for l, n in sorted(counts.items()) for x in (l, sample / max(n, sample))))
    draw = F.pmod(F.xxhash64(F.lit("lang"), "i"), F.lit(1 << 30))
    picked = known.where(draw < F.element_at(share, F.col("l")) * (1 << 30)).select("i", "l", draw.alias("draw"), "t")
    langs = tuple(sorted(counts))
    rows, labels, seen = [], [], dict.fromkeys(langs, 0)
    for r in sorted(picked.toArrow().to_pylist(), key=lambda r: (r["draw"], r["i"], r["t"])):
        seen[r["l"]] += 1
        if seen[r["l"]] <= sample:
            rows.append(stretches(r["t"]))
            labels += [langs.index(r["l"])] * len(rows[-1])
    if not rows:
        return None
    labels = np.array(labels)
    there = np.unique(labels)
    return fit(np.concatenate(rows), np.searchsorted(there, labels), tuple(langs[k] for k in there))


def predict(text: Column, model: Model | None) -> Column:
    """Struct lang_pred, score of a text column."""
    kind = "lang_pred string, score double"
    unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return unknown

    def some(texts: pa.Array) -> pa.Array:
        found, at = [], 0
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        while at < len(texts):  # a few MB at once
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + (4 << 20), "right")) - 1)
            part = texts.slice(at, stop - at).cast(pa.large_string()).fill_null("")
            _, offsets, data = part.buffers()
            offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
            data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
            found.append(model.probabilities(data, offsets - offsets[0]))
            at = stop
        q = np.concatenate(found) if found else np.zeros((0, len(model.langs)))
        best = q.argmax(1)
        score = np.clip(q[np.arange(len(q)), best], 0.0, 1.0)
        langs = pa.array(model.langs, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([langs, pa.array(score, pa.float64())], names=["lang_pred", "score"])

    @F.arrow_udf(kind)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            yield from map(some, batches)
        finally:
            release()

    small_batches(SparkSession.active())
    # the function runs for every row, whatever stands around it; without a letter it gets nothing to read. It is marked
    # so that a filter on its result can't run it a second time
    letters = F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))
    return F.when(letters, of.asNondeterministic()(F.when(letters, text))).otherwise(unknown)
