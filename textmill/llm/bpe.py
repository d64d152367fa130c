"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

A pre-token starts as its bytes, a doubly linked list. Every adjacent pair whose joined bytes have a rank waits in
that rank's bucket; a two-level bitmap over the ranks tells the lowest rank that has a bucket by find-first-set, and
the bucket's leftmost position merges. An entry whose pair has changed since is stale and skipped. A merge costs a
few steps whatever the pre-token's length, so runs of millions of bytes without a break take time in proportion.
Pre-tokens that a worker doesn't remember go through one queue together, where a rank's bucket is taken at once.

Defined cases: a null text is encoded as an empty one, to no ids; lone surrogates can't occur in a Spark string;
repeated rows get equal rows; an empty table gives an empty result. Only the columns asked for are read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import release, small_batches

#: A vocabulary goes to every executor, so its file is bounded; a larger one is an error.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens whose ids a worker remembers, in each of two generations.
REMEMBERED = 150_000
#: Longer pre-tokens aren't remembered.
REMEMBERED_LENGTH = 64
#: New pre-tokens that go through one queue together; more would leave the processor's caches.
TOGETHER = 1024
#: Pre-tokens of texts that wait for the ids of new ones.
WAITING = 1 << 17
#: Ids that a worker gathers before it sends them back, and those of one document more.
MOST_IDS = 1 << 20
_LOW_BITS = 8
_LOW = (1 << _LOW_BITS) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class RankQueue:
    """Linked-list positions by rank under a bitmap of two levels: words of 256 ranks, and which words aren't empty.

    A bucket is a position, a heap of them, or None; a drained queue is as new.
    """

    __slots__ = ("top", "words", "buckets")

    def __init__(self, ranks: int) -> None:
        self.top = 0
        self.words = [0] * ((ranks >> _LOW_BITS) + 1)
        self.buckets: list[int | list[int] | None] = [None] * ranks

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.buckets[rank] = position
            high = rank >> _LOW_BITS
            word = self.words[high]
            if not word:
                self.top |= 1 << high
            self.words[high] = word | 1 << (rank & _LOW)
        elif bucket.__class__ is int:
            self.buckets[rank] = [bucket, position] if bucket < position else [position, bucket]
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """Lowest rank and its leftmost position; the queue must not be empty."""
        top = self.top
        high = (top & -top).bit_length() - 1
        word = self.words[high]
        rank = high << _LOW_BITS | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        if bucket.__class__ is list:
            position = heappop(bucket)
            if bucket:
                return rank, position
        else:
            position = bucket
        self.buckets[rank] = None
        word &= word - 1
        self.words[high] = word
        if not word:
            self.top = top & top - 1
        return rank, position


def encode_piece(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> tuple[int, ...]:
    """Ids of one pre-token; the queue is empty before and after."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    push, pop = queue.push, queue.pop
    pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair that starts here, -1 without one
    for i, rank in enumerate(pair):
        if rank >= 0:
            push(rank, i)
    pair.append(-1)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue.top:
        rank, i = pop()
        if pair[i] != rank:
            continue  # stale
        j = after[i]
        end = after[j]
        pair[j] = -1
        after[i] = end
        if end < n:
            before[end] = i
            pair[i] = new = get(piece[i : after[end]], -1)
            if new >= 0:
                push(new, i)
        else:
            pair[i] = -1
        left = before[i]
        if left >= 0:
            new = get(piece[left:end], -1)
            if pair[left] != new:
                pair[left] = new
                if new >= 0:
                    push(new, left)
    ids, i = [], 0
    while i < n:
        j = after[i]
        ids.append(ranks[piece[i:j]])
        i = j
    return tuple(ids)


class Bytes:
    """Ranks by single byte and by pair of bytes, -1 without one."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.one, self.two = np.full(256, -1, np.int64), np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.one[token[0]] = rank
            elif len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank


def encode_pieces(pieces: list[bytes], ranks: dict[bytes, int], queue: RankQueue, table: Bytes) -> list[list[int]]:
    """Ids of pre-tokens that aren't empty, all in one queue, which is empty before and after.

    Pairs of different pre-tokens don't touch, so a rank's bucket is taken at once, from the left. If a merge makes a
    pair of lower rank, that goes first: what is left of the bucket waits.
    """
    if not pieces:
        return []
    get, buckets, words = ranks.get, queue.buckets, queue.words
    flat = b"".join(pieces)
    codes = np.frombuffer(flat, np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    single = table.one[codes]
    if (single < 0).any():
        raise KeyError(bytes([codes[single < 0][0]]))
    pairs = np.append(table.two[codes[:-1] << 8 | codes[1:]], -1)
    pairs[ends - 1] = -1  # the last of a pre-token has none
    before, after = np.arange(-1, len(flat) - 1), np.arange(1, len(flat) + 1)
    before[ends - sizes] = -1
    ids, pair, after, before = single.tolist(), pairs.tolist(), after.tolist(), before.tolist()
    before.append(-1)
    order = np.argsort(pairs, kind="stable")
    order = order[np.searchsorted(pairs, 0, sorter=order) :]
    for rank, i in zip(pairs[order].tolist(), order.tolist()):
        if buckets[rank] is None:
            buckets[rank] = [i]
            words[rank >> _LOW_BITS] |= 1 << (rank & _LOW)
            queue.top |= 1 << (rank >> _LOW_BITS)
        else:
            buckets[rank].append(i)
    while top := queue.top:
        high = (top & -top).bit_length() - 1
        word = words[high]
        rank = high << _LOW_BITS | (word & -word).bit_length() - 1
        words[high] = word = word & word - 1
        if not word:
            queue.top = top & top - 1
        bucket, buckets[rank] = buckets[rank], None
        if bucket.__class__ is list:
            if len(bucket) > 1:
                bucket.sort()
            bucket = iter(bucket)
        lower = False
        for i in bucket:
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            after[i] = end = after[j]
            ids[i], ids[j] = rank, -1
            pair[j] = -1
            new = -1
            if before[end] >= 0:  # of the same pre-token
                before[end] = i
                new = get(flat[i : after[end]], -1)
            pair[i] = new
            if new >= 0:
                waiting = buckets[new]
                if waiting.__class__ is list:
                    waiting.append(i)
                else:
                    lower |= new < rank
                    _await(queue, new, i)
            left = before[i]
            if left >= 0:
                new = get(flat[left:end], -1)
                if pair[left] != new:
                    pair[left] = new
                    if new >= 0:
                        waiting = buckets[new]
                        if waiting.__class__ is list:
                            waiting.append(left)
                        else:
                            lower |= new < rank
                            _await(queue, new, left)
            if lower:
                # the rest keeps its order, and no new pair has this rank but by a lower one's merge
                buckets[rank] = bucket
                words[high] |= 1 << (rank & _LOW)
                queue.top |= 1 << high
                break
    ids = np.array(ids)
    some = ids >= 0
    stops = np.cumsum(np.add.reduceat(some, ends - sizes, dtype=np.int64)).tolist()
    ids = ids[some].tolist()
    return [ids[a:b] for a, b in zip([0, *stops], stops)]


def _await(queue: RankQueue, rank: int, position: int) -> None:
    """Puts a position into a bucket that is none yet, or the rest of one."""
    rest = queue.buckets[rank]
    queue.buckets[rank] = [position] if rest is None else [*rest, position]
    queue.words[rank >> _LOW_BITS] |= 1 << (rank & _LOW)
    queue.top |= 1 << (rank >> _LOW_BITS)


class _Memory(dict):
    """Ids by pre-token, in two generations; a subscript gives a list that is filled by the next `fill`, if it is new."""

    __slots__ = ("old", "ranks", "queue", "table", "cold")

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.old: dict[str, Sequence[int]] = {}
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values(), default=-1) + 1)
        self.table = Bytes(ranks)
        self.cold: list[tuple[bytes, list[int]]] = []

    def __missing__(self, piece: str) -> Sequence[int]:
        ids = self.old.get(piece)
        if ids is None:
            coded = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(coded)
            if whole is not None:
                ids = (whole,)
            elif not 0 < len(piece) <= REMEMBERED_LENGTH:
                return encode_piece(coded, self.ranks, self.queue)
            else:
                ids = []
                self.cold.append((coded, ids))
                if len(self.cold) >= TOGETHER:
                    self.fill()
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def fill(self) -> None:
        cold, self.cold = self.cold, []
        try:
            made = encode_pieces([x for x, _ in cold], self.ranks, self.queue, self.table)
        except KeyError:  # a byte without a rank: no list may stay unfilled
            self.clear()
            self.old = {}
            raise
        for (_, ids), found in zip(cold, made):
            ids[:] = found


class Codec:
    """Encoder and decoder; remembers the ids of recent pre-tokens, a bounded number of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in ranks.values()}
        self.forget()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text; texts wait for one another's new pre-tokens, so that these are computed together."""
        waiting, n = [], 0
        for text in texts:
            waiting.append(list(map(self.ids_of, self.pieces(text))))
            n += len(waiting[-1])
            if n >= WAITING:
                yield from self._joined(waiting)
                waiting, n = [], 0
        yield from self._joined(waiting)

    def _joined(self, waiting: list[list[Sequence[int]]]) -> Iterator[list[int]]:
        self.fill()
        for ids in waiting:
            yield list(chain.from_iterable(ids))

    def forget(self) -> None:
        memory = _Memory(self.ranks)
        self.ids_of, self.fill = memory.__getitem__, memory.fill

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def listed(self, ids: Iterable[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.names.__getitem__, ids))


_CODECS: dict[int, Codec] = {}


def _codec(key: int, ranks, pattern: str) -> Codec:
    """One codec for a worker process; a reused worker keeps it."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks.value, pattern)
    return _CODECS[key]


def _shared(spark, path: str, pattern: str):
    ranks = load_ranks(path)
    small_batches(spark)
    digest = hashlib.sha256(pattern.encode() + repr(len(ranks)).encode())
    for token in ranks:
        digest.update(token)
    return spark.sparkContext.broadcast(ranks), int.from_bytes(digest.digest()[:8], "big")


class _Rows:
    """Rows of ids, gathered into one flat buffer without a Python number for each."""

    def __init__(self) -> None:
        self.flat, self.ends = array("i"), array("i", [0])

    def add(self, ids: list[int]) -> None:
        self.flat.extend(ids)
        self.ends.append(len(self.flat))

    def arrow(self) -> pa.ListArray:
        whole = lambda a: pa.Array.from_buffers(pa.int32(), len(a), [None, pa.py_buffer(a)])
        return pa.ListArray.from_arrays(whole(self.ends), whole(self.flat))


@contextmanager
def _task(key: int, ranks, pattern: str) -> Iterator[Codec]:
    """The worker's codec for a task, after which what it remembers goes: the worker lives on, other stages' needs too."""
    codec = _codec(key, ranks, pattern)
    try:
        yield codec
    finally:
        codec.forget()
        release()


def encoder(spark, path: str, pattern: str):
    """Function from a text column to a column of ids (array<int>)."""
    ranks, key = _shared(spark, path, pattern)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        codec, rows = _codec(key, ranks, pattern), _Rows()
        for ids in codec.encode_all(t.as_py() or "" for t in texts):
            rows.add(ids)
        return rows.arrow()

    return encode


def decoder(spark, path: str, pattern: str):
    """Function from a column of ids to a column of the bytes they stand for."""
    ranks, key = _shared(spark, path, pattern)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        codec = _codec(key, ranks, pattern)
        return pa.array((codec.decode(x.as_py() or ()) for x in ids), pa.binary())

    return decode


def encoded(spark, docs: DataFrame, keep: list[str], path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The columns `keep` of the documents with ids (array<int>), n_tokens and round_trip (whether these very ids decode to
    the text), each text encoded once. What goes back to Spark is cut by bytes, so a worker holds little of it.
    """
    ranks, key = _shared(spark, path, pattern)
    kept = docs.select(*keep)
    made = T.StructType([*kept.schema.fields, *T._parse_datatype_string("ids array<int>, n_tokens long, round_trip boolean").fields])
    # the text goes by place, so kept columns may have any name
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(text_col).alias(f"c{len(keep)}"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _task(key, ranks, pattern) as codec:
            for batch in batches:
                texts, start = batch.column(len(keep)), 0
                every = codec.encode_all(t.as_py() or "" for t in texts)
                while start < len(batch):
                    found, same = _Rows(), []
                    while start + len(same) < len(batch) and len(found.flat) < MOST_IDS:
                        ids = next(every)
                        same.append(codec.decode(ids) == (texts[start + len(same)].as_py() or "").encode("utf-8", "surrogatepass"))
                        found.add(ids)
                    part = batch.slice(start, len(same))
                    counts = np.diff(np.frombuffer(found.ends, np.int32)).astype(np.int64)
                    columns = [*part.columns[: len(keep)], found.arrow(), pa.array(counts), pa.array(same, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, names=made.names)
                    start += len(same)

    return rows.mapInArrow(of, made)


def digests(spark, text: Column, path: str, pattern: str) -> Column:
    """Struct n_tokens, ids_sha256, decoded_sha256 of a text column: encoded, decoded from the ids, and hashed."""
    ranks, key = _shared(spark, path, pattern)
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with _task(key, ranks, pattern) as codec:
            for texts in batches:
                rows = []
                for ids in codec.encode_all(t.as_py() or "" for t in texts):
                    sha = hashlib.sha256(codec.listed(ids).encode()).hexdigest()
                    rows.append({"n_tokens": len(ids), "ids_sha256": sha, "decoded_sha256": hashlib.sha256(codec.decode(ids)).hexdigest()})
                yield pa.array(rows, kind)

    return digested(text)
