"""Instruction conversations: validation, prompt groups, decisions and chat text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.config import SftPolicy
from textmill.functions import text as tx
from textmill.operators.admission import first_failing
from textmill.operators.pack import token_ids

# Secret patterns by name, in order, and the chat template.
SECRETS = {
    "private-key": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "aws-access-key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "github-token": r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b",
    "slack-token": r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
}
OPENERS = {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"}
SEPARATOR = "\n"
END = "<|endoftext|>"


def secret_kind(text: Column) -> Column:
    """Name of the first pattern that a text holds, or null."""
    return first_failing({name: text.rlike(pattern) for name, pattern in SECRETS.items()})


def prompt_group(prompt: Column) -> Column:
    """One id for all case and white space variants of a prompt."""
    return F.concat(F.lit("prompt-sha256:"), F.sha2(tx.normalized(prompt), 256))


def group_split(group: Column, policy: SftPolicy) -> Column:
    """Split by the first 64 bits of a digest, modulo a million; two halves, as a long holds 63."""
    digest = F.sha2(F.concat(F.lit(policy.seed + "\0"), group), 256)
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    place = (half(1) % 1_000_000 * (2**32 % 1_000_000) + half(9)) % 1_000_000
    return F.when(place < policy.validation_per_million, "validation").otherwise("train")


def messages(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): each conversation's (turn, role, text) in order. A conversation is one row's worth."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def chat_problem(m: Column) -> Column:
    """Why a conversation is invalid, or null: roles alternate from user after an optional system message."""
    body = F.when(F.element_at(m, 1)["role"] == "system", F.slice(m, F.lit(2), F.size(m) - 1)).otherwise(m)
    wrong = F.exists(
        F.transform(body, lambda x, i: F.struct(x["role"].alias("role"), i.alias("i"))),
        lambda x: ~x["role"].eqNullSafe(F.when(x["i"] % 2 == 0, "user").otherwise("assistant")),
    )
    known = F.array(*map(F.lit, OPENERS))
    return first_failing({
        "unknown_role": F.exists(m, lambda x: x["role"].isNull() | ~F.array_contains(known, x["role"])),
        "empty_content": F.exists(m, lambda x: x["text"].isNull() | (F.trim(F.regexp_replace(x["text"], r"\s", "")) == "")),
        "no_user": ~F.exists(m, lambda x: x["role"] == "user"),
        "alternation": wrong,
    })


def rendered(m: Column, prompt_only: bool = False) -> Column:
    """Chat text: openers, contents, an end after every assistant message, a separator between messages."""
    opener = F.create_map(*(F.lit(x) for kv in OPENERS.items() for x in kv))
    parts = F.transform(m, lambda x: F.concat(F.element_at(opener, x["role"]), x["text"], F.when(x["role"] == "assistant", F.lit(END)).otherwise(F.lit(""))))
    text = F.array_join(parts, SEPARATOR)
    return F.concat(text, F.lit(SEPARATOR + OPENERS["assistant"])) if prompt_only else text


def response(text: Column) -> Column:
    """A generated reply up to its first end."""
    return F.substring_index(text, END, 1)


def turn_counts(m: Column) -> Column:
    """For each message its place, role, words and whether the model writes it."""
    return F.transform(m, lambda x, i: F.struct(i.alias("place"), x["role"].alias("role"), tx.word_count(x["text"]).alias("words"), (x["role"] == "assistant").alias("sampled")))


def message_tokens(m: Column, vocabulary: int) -> Column:
    """For each message its role and ids: those of its words, and the end id 0 after what the model writes."""
    end = lambda x: F.when(x["role"] == "assistant", F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.transform(m, lambda x: F.struct(x["role"].alias("role"), F.concat(token_ids(x["text"], vocabulary), end(x)).alias("ids")))


def token_masks(rows: DataFrame, vocabulary: int) -> DataFrame:
    """(conv_id, message, nth, token, sampled, content) of every id of the conversations (conv_id, messages)."""
    each = rows.select("conv_id", F.posexplode(message_tokens(F.col("messages"), vocabulary)).alias("message", "m"))
    ids = each.select("conv_id", "message", (F.col("m.role") == "assistant").alias("sampled"), F.posexplode("m.ids").alias("nth", "token"))
    return ids.select("conv_id", "message", "nth", "token", "sampled", (F.col("token") != 0).alias("content"))


def message_spans(rows: DataFrame, vocabulary: int) -> DataFrame:
    """(conv_id, spans): start and stop of each message's ids in its conversation."""
    sizes = F.transform(message_tokens(F.col("messages"), vocabulary), lambda x: F.size(x["ids"]))
    none = F.array().cast("array<struct<start: int, stop: int>>")

    def step(spans: Column, n: Column) -> Column:
        start = F.when(F.size(spans) == 0, 0).otherwise(F.element_at(spans, -1)["stop"])
        return F.concat(spans, F.array(F.struct(start.alias("start"), (start + n).alias("stop"))))

    return rows.select("conv_id", F.aggregate(sizes, none, step).alias("spans"))


def pairs(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it in its conversation."""
    m = F.col("messages")
    follow = F.transform(m, lambda x, i: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("prompt"), F.get(m, i + 1)["role"].alias("next"), F.get(m, i + 1)["text"].alias("completion")))
    kept = F.filter(follow, lambda x: (x["role"] == "user") & (x["next"] == "assistant"))
    return messages(turns).select("conv_id", F.explode(kept).alias("p")).select("conv_id", "p.turn", "p.prompt", "p.completion")


def decide(rows: DataFrame, policy: SftPolicy, contaminated: DataFrame | None = None, metadata: bool = False) -> DataFrame:
    """Rows with group_id, tokens, reason (null if accepted) and split. The first reason that holds is given.

    Rows have id, input, output, domain, generation_algorithm, average_test_score and, where `metadata` is checked,
    llm_judgement, unit_tests and tests_execution_status (JSON). `contaminated` has the group ids to reject.
    """
    p, c, score = F.col("input"), F.col("output"), F.col("average_test_score").cast("double")
    blank = lambda x: F.trim(F.regexp_replace(x, r"\s", "")) == ""
    rows = rows.withColumns({"group_id": prompt_group(p), "tokens": tx.word_count(p) + tx.word_count(c) + 4})
    if contaminated is None:
        rows = rows.withColumn("hit", F.lit(False))
    else:
        groups = contaminated.select(F.col("group_id").alias("g")).distinct()
        rows = rows.join(groups, F.col("group_id") == F.col("g"), "left").withColumn("hit", F.col("g").isNotNull()).drop("g")
    tests = {
        "schema:id": F.col("id").isNull() | ~F.col("id").rlike("^[0-9a-f]{32}$"),
        "schema:input": p.isNull(),
        "schema:output": c.isNull(),
        "quality:empty-prompt": blank(p),
        "quality:empty-completion": blank(c),
        "quality:nul-byte": F.contains(p, F.lit("\0")) | F.contains(c, F.lit("\0")),
        "quality:prompt-bytes": F.octet_length(p) > policy.max_prompt_bytes,
        "quality:completion-bytes": F.octet_length(c) > policy.max_completion_bytes,
        "schema:domain": F.col("domain").isNull() | ~F.col("domain").isin(*policy.domains),
        "schema:generation-algorithm": F.col("generation_algorithm").isNull() | ~F.col("generation_algorithm").isin(*policy.algorithms),
        "schema:average-test-score": score.isNull() | F.isnan(score) | (score < 0) | (score > 1),
        "quality:test-score": score < policy.min_score,
    }
    if metadata:
        tests_, statuses, judgement = F.col("unit_tests"), F.col("tests_execution_status"), F.col("llm_judgement")
        tests |= {
            "schema:metadata": judgement.isNull() | tests_.isNull() | statuses.isNull(),
            "schema:llm-judgement-json": F.json_object_keys(judgement).isNull(),
            "schema:unit-tests-json": F.json_array_length(tests_).isNull(),
            "schema:test-status-json": F.json_array_length(statuses).isNull(),
            "schema:test-count-mismatch": F.json_array_length(tests_) != F.json_array_length(statuses),
        }
    secret = secret_kind(F.concat_ws("\n", p, c))
    tests |= {"benchmark:group-propagated": F.col("hit")}
    reason = F.coalesce(
        first_failing(tests), F.when(secret.isNotNull(), F.concat(F.lit("secret:"), secret)),
        first_failing({"quality:rendering": F.contains(p, F.lit(END)) | F.contains(c, F.lit(END)), "length:over-context": F.col("tokens") - 1 > policy.max_tokens, "length:no-target": F.col("tokens") < 2}),
    )
    rows = rows.withColumn("reason", reason).drop("hit")
    return rows.withColumn("split", F.when(F.col("reason").isNull(), group_split(F.col("group_id"), policy)))


def contaminated_groups(rows: DataFrame, guard_hits: DataFrame) -> DataFrame:
    """First pass: the prompt groups of all contaminated rows (id), whatever else is wrong with them."""
    return rows.join(guard_hits.select("id").distinct(), "id", "left_semi").select(prompt_group(F.col("input")).alias("group_id")).distinct()


def counters(decided: DataFrame) -> DataFrame:
    """Rows and trained tokens by split or reason and domain."""
    outcome = F.coalesce("reason", F.concat(F.lit("accepted:"), "split"))
    return decided.groupBy(outcome.alias("outcome"), "domain").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("tokens") - 1).alias("tokens"))
