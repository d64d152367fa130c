import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from textmill.llm import bpe
from textmill.llm.common import read
from textmill.llm.queries import QUERIES, vocabulary


@pytest.fixture(scope="module")
def codec():
    path, pattern = vocabulary()
    return bpe.Codec(bpe.load_ranks(path), pattern)


@pytest.fixture(scope="module")
def reference():
    path, pattern = vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def test_query_agrees_with_tiktoken(spark, sf_mid, reference):
    got = {r.doc_id: r for r in QUERIES["op6_bpe"](spark, sf_mid).collect()}
    docs = read(spark, sf_mid, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_random_texts(codec, reference):
    rng = random.Random(4)
    alphabet = "abcdeo tthin  \n\t\r'sÉéñß漢字🙂0123.,-_=\u0301\u00a0\x00"
    for _ in range(800):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_very_long_pre_tokens(codec, reference):
    rng = random.Random(6)
    for text in ("a" * 30_000, "ab" * 20_000, "".join(rng.choice("aeinst") for _ in range(40_000)), "é" * 9_999, " " * 20_000, "=" * 10_001):
        assert codec.encode(text) == reference.encode_ordinary(text)
    long = "".join(rng.choice("aeinst") for _ in range(400_000))
    assert codec.decode(codec.encode(long)) == long.encode()


def test_memory_of_pieces_is_bounded(monkeypatch):
    path, pattern = vocabulary()
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    codec = bpe.Codec(bpe.load_ranks(path), pattern)
    text = " ".join(f"word{i}x" for i in range(500)) * 2
    assert codec.decode(codec.encode(text)) == text.encode()
    memory = codec.ids_of.__self__
    assert len(memory) <= 10 and len(memory.old) <= 10


def test_queue_takes_lowest_rank_then_leftmost():
    rng = random.Random(2)
    items = [(rng.randrange(60_000), rng.randrange(1000)) for _ in range(2000)]
    queue = bpe.RankQueue(60_000)
    for item in items:
        queue.push(*item)
    assert [queue.pop() for _ in items] == sorted(items) and not queue.top


def test_edges(spark, edge_docs, no_docs, reference):
    path, pattern = vocabulary()
    ids = bpe.encoder(spark, path, pattern)(F.col("text"))
    out = edge_docs.select("text", ids.alias("ids")).withColumn("back", bpe.decoder(spark, path, pattern)(F.col("ids")))
    for r in out.collect():
        assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    assert no_docs.select(bpe.digests(spark, F.col("text"), path, pattern)).collect() == []


def test_vocabulary_size_is_checked(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCABULARY_BYTES", 100)
    with pytest.raises(ValueError):
        bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def plain_merges(piece, ranks):
    """Ids by merging the leftmost pair of lowest rank, again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[x] for x in parts]


def test_joint_queue_on_any_ranks():
    """Ranks in random order, so merges often make pairs of lower rank; pre-tokens don't touch one another."""
    rng = random.Random(9)
    for _ in range(60):
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(60)} | {b"a", b"b", b"c"}
        ranks = {t: i for i, t in enumerate(rng.sample(sorted(tokens), len(tokens)))}
        queue = bpe.RankQueue(len(ranks))
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 50))]
        got = bpe.encode_pieces(pieces, ranks, queue, bpe.Bytes(ranks))
        assert got == [plain_merges(x, ranks) for x in pieces]
        assert not queue.top and not any(queue.words) and queue.buckets == [None] * len(ranks)
    assert bpe.encode_pieces([], ranks, queue, bpe.Bytes(ranks)) == []


def test_new_pre_tokens_share_a_queue(monkeypatch, reference):
    """Those of several texts are computed in one call; only long ones are computed alone."""
    path, pattern = vocabulary()
    codec, calls, together = bpe.Codec(bpe.load_ranks(path), pattern), [], bpe.encode_pieces
    monkeypatch.setattr(bpe, "encode_piece", None)
    monkeypatch.setattr(bpe, "encode_pieces", lambda pieces, *a: calls.append(len(pieces)) or together(pieces, *a))
    texts = [" ".join(f"qzx{chr(97 + i % 26)}{chr(97 + j)}vw" for j in range(20)) for i in range(20)] + ["", "\u00e9\u00e8x"]
    assert list(codec.encode_all(texts)) == [reference.encode_ordinary(t) for t in texts]
    assert len([n for n in calls if n]) == 1 and sum(calls) >= 400


def test_byte_without_rank_is_an_error_each_time():
    codec = bpe.Codec({b"a": 0, b"b": 1, b"ab": 2}, r"\w+")
    for _ in range(2):
        with pytest.raises(KeyError):
            codec.encode("abx")
    assert codec.encode("aba") == [2, 0]
