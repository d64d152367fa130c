import hashlib

import pytest
from pyspark.sql import functions as F

from textmill.config import SftPolicy
from textmill.operators import sft

GOOD = {
    "id": "0" * 32, "input": "Write a loop", "output": "for x in y", "domain": "generic", "generation_algorithm": "self-instruct", "average_test_score": 0.5,
    "llm_judgement": "{}", "unit_tests": '["a", "b"]', "tests_execution_status": '["pass", "fail"]',
}
SCHEMA = "id string, input string, output string, domain string, generation_algorithm string, average_test_score double, llm_judgement string, unit_tests string, tests_execution_status string"
POLICY = SftPolicy(max_prompt_bytes=400, max_completion_bytes=400, min_score=0.2, max_tokens=50)
CASES = [
    ({}, None), ({"id": "xyz"}, "schema:id"), ({"id": None}, "schema:id"), ({"input": None}, "schema:input"), ({"output": None}, "schema:output"),
    ({"input": " \n"}, "quality:empty-prompt"), ({"output": ""}, "quality:empty-completion"), ({"input": "a\0"}, "quality:nul-byte"),
    ({"input": "é" * 201}, "quality:prompt-bytes"), ({"output": "x" * 401}, "quality:completion-bytes"), ({"domain": "other"}, "schema:domain"),
    ({"domain": None}, "schema:domain"), ({"generation_algorithm": "x"}, "schema:generation-algorithm"), ({"average_test_score": None}, "schema:average-test-score"),
    ({"average_test_score": float("nan")}, "schema:average-test-score"), ({"average_test_score": 1.5}, "schema:average-test-score"),
    ({"average_test_score": 0.1}, "quality:test-score"), ({"llm_judgement": None}, "schema:metadata"), ({"llm_judgement": "[]"}, "schema:llm-judgement-json"),
    ({"unit_tests": "{"}, "schema:unit-tests-json"), ({"tests_execution_status": "{}"}, "schema:test-status-json"), ({"unit_tests": '["a"]'}, "schema:test-count-mismatch"),
    ({"input": "BAD  prompt"}, "benchmark:group-propagated"), ({"output": "key AKIA" + "A" * 16}, "secret:aws-access-key"),
    ({"output": "-----BEGIN PRIVATE KEY-----"}, "secret:private-key"), ({"output": "xoxb-" + "a" * 20}, "secret:slack-token"), ({"output": "ghp_" + "a" * 36}, "secret:github-token"),
    ({"output": "a <|endoftext|>"}, "quality:rendering"), ({"input": "w " * 46}, "length:over-context"),
]


def test_every_reason(spark):
    rows = spark.createDataFrame([tuple((GOOD | change).values()) for change, _ in CASES], SCHEMA).coalesce(1).withColumn("n", F.monotonically_increasing_id())
    bad = spark.createDataFrame([("bad prompt",)], "p string").select(sft.prompt_group(F.col("p")).alias("group_id"))
    got = sft.decide(rows, POLICY, bad, metadata=True).orderBy("n").collect()
    assert [r.reason for r in got] == [reason for _, reason in CASES]
    assert got[0].split in ("train", "validation") and all(r.split is None for r in got[1:])


def test_context_limit_is_inclusive(spark):
    rows = spark.createDataFrame([tuple((GOOD | {"input": "w " * n, "output": "x"}).values()) for n in (46, 47)], SCHEMA)
    assert sorted((r.tokens, r.reason) for r in sft.decide(rows, POLICY).collect()) == [(51, None), (52, "length:over-context")]


def test_groups_ignore_case_and_space(spark):
    rows = spark.createDataFrame([("Hello  World",), ("hello world\n",), ("hello worlds",)], "p string").select(sft.prompt_group(F.col("p")).alias("g")).collect()
    assert rows[0] == rows[1] != rows[2] and rows[0].g == "prompt-sha256:" + hashlib.sha256(b"hello world").hexdigest()


def test_split_is_the_first_64_bits(spark):
    groups = [f"g{i}" for i in range(300)]
    policy = SftPolicy(validation_per_million=300_000)
    rows = spark.createDataFrame([(g,) for g in groups], "g string").select("g", sft.group_split(F.col("g"), policy).alias("s")).collect()
    for r in rows:
        value = int.from_bytes(hashlib.sha256(f"{policy.seed}\0{r.g}".encode()).digest()[:8], "big") % 1_000_000
        assert r.s == ("validation" if value < 300_000 else "train")


@pytest.mark.parametrize(
    ("roles", "problem"),
    [
        (["user", "assistant"], None), (["system", "user", "assistant", "user"], None), (["assistant", "user"], "alternation"), (["user", "user"], "alternation"),
        (["system"], "no_user"), (["user", "system"], "alternation"), (["user", "robot"], "unknown_role"), (["user", "assistant", "assistant"], "alternation"),
    ],
)
def test_chat(spark, roles, problem):
    rows = spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    m = sft.messages(rows.orderBy(F.desc("turn")))
    assert m.select(sft.chat_problem(F.col("messages")).alias("p")).first().p == problem


def test_rendering(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "v")], "conv_id long, turn long, role string, text string")
    m = sft.messages(rows)
    r = m.select(sft.rendered(F.col("messages")).alias("t"), sft.rendered(F.col("messages"), prompt_only=True).alias("p"), sft.turn_counts(F.col("messages")).alias("c")).first()
    assert r.t == "<|system|>\ns\n<|user|>\nu\n<|assistant|>\na<|endoftext|>\n<|user|>\nv" and r.p == r.t + "\n<|assistant|>\n"
    assert [x.sampled for x in r.c] == [False, False, True, False]
    assert [tuple(x) for x in sft.pairs(rows).collect()] == [(1, 1, "u", "a")]
