import pytest

from textmill.operators import benchmark

LINE = "write a function to find the longest chain of pairs"
CODE = "def find_chain(pairs):\n    result = sorted(pairs, key=lambda p: p[1])\n    total = [1 for _ in result]\n    return max(total) if total else None"


@pytest.fixture(scope="module")
def deny(spark):
    rows = [(LINE, CODE, ["assert find_chain([(1, 2), (3, 4)]) == 2 and True"])]
    return benchmark.denylist(spark.createDataFrame(rows, "text string, code string, tests array<string>"), code="code", tests=("tests",)).cache()


def test_reasons(spark, deny):
    body = CODE.split("\n")
    texts = {
        1: "this is from MBPP, yes", 2: 'x "task_id" y "test_list" z "challenge_test_list"', 3: CODE.replace("    ", "\t") + "\n\n",
        4: f"intro\n  {LINE.replace(' ', '  ')}\nend", 5: "\n".join(["import x", *body, "print(1)"]), 6: "assert find_chain([(1, 2), (3, 4)]) == 2 and True",
        7: "def find_chain(pairs):\n    something else entirely here, with another body", 8: "mbppx is a word", 9: "", 10: body[1] + "\n" + body[2],
        11: "def find_chain(x):\n    pass\n" + body[1] + "\n" + body[2],
    }
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r.id: r.reason for r in benchmark.guard(docs, deny).collect()}
    assert got == {
        1: "mbpp-marker", 2: "mbpp-json-shape", 3: "mbpp-exact-code", 4: "mbpp-problem-or-test", 5: "mbpp-embedded-code", 6: "mbpp-problem-or-test", 11: "mbpp-embedded-code",
    }


def test_broadcast_and_shuffle_agree(spark, deny, monkeypatch):
    docs = spark.createDataFrame([(1, LINE), (2, "x"), (3, CODE)], "id long, text string")
    want = sorted(benchmark.hits(docs, deny).collect())
    monkeypatch.setattr(benchmark, "BROADCAST_DIGESTS", 0)
    assert sorted(benchmark.hits(docs, deny).collect()) == want and len(want) > 2


def test_too_few_items(spark):
    with pytest.raises(ValueError):
        benchmark.denylist(spark.createDataFrame([("a",)], "text string"), least_items=2)
