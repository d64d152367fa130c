import pytest

from textmill.operators import control, curate, pack
from textmill.plans import control as plans


def test_good_quotas_have_no_problem(spark):
    rows = spark.createDataFrame(plans.QUOTAS, plans._COLUMNS)
    assert control.quota_problems(rows, plans.CATEGORIES, plans.SOURCES).collect() == []


def test_stage_states():
    needs = {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"], "e": ["d"]}
    assert control.stage_states(needs, ["a"]) == {"a": "complete", "b": "ready", "c": "ready", "d": "waiting", "e": "waiting"}
    assert control.stage_states(needs, ["a", "c"], ["b"]) == {"a": "complete", "b": "failed", "c": "complete", "d": "blocked", "e": "blocked"}
    # a stage done before what it needs isn't complete
    assert control.stage_states(needs, ["e"])["e"] == "waiting"
    for circle in ({"a": ["b"], "b": ["a"]}, {"a": ["x"]}):
        with pytest.raises(ValueError):
            control.stage_states(circle, [])


def test_stages_run_in_order_and_a_failure_blocks_what_is_behind():
    ran = []

    def work(name):
        def run():
            ran.append(name)
            if name == "b":
                raise RuntimeError("broken")

        return run

    needs = {"a": [], "b": ["a"], "c": ["a"], "d": ["b"]}
    states, errors = control.run_stages(needs, {s: work(s) for s in needs})
    assert states == {"a": "complete", "b": "failed", "c": "complete", "d": "blocked"} and errors == {"b": "broken"} and ran == ["a", "b", "c"]
    ran.clear()
    states, errors = control.run_stages(needs, {s: work(s) for s in needs}, done=["a"], dry=True)
    assert states["b"] == "ready" and not ran and not errors


def test_generations(spark):
    table = lambda rows: spark.createDataFrame(rows, "archive string, digest string")
    plan = lambda a, b: {r.archive: (r.action, r.recanonicalize) for r in control.generation_plan(table(a), table(b)).collect()}
    old = [("x", "1"), ("y", "2")]
    assert plan(old, old) == {"x": ("reuse", False), "y": ("reuse", False)}
    assert plan(old, [*old, ("z", "3")]) == {"x": ("reuse", True), "y": ("reuse", True), "z": ("fingerprint", True)}
    assert plan(old, [("x", "9")]) == {"x": ("fingerprint", True), "y": ("drop", True)}


def test_identity_is_the_first_name_that_is_not_blank(spark):
    from pyspark.sql import functions as F

    rows = [(1, True, None), (2, False, " u "), (3, True, "\t"), (4, False, "")]
    df = spark.createDataFrame(rows, "id long, code boolean, first string").withColumn("identity", curate.first_named(F.col("first"), F.when(F.col("id") == 4, "fallback")))
    assert {r.id: r.identity for r in df.collect()} == {1: None, 2: "u", 3: None, 4: "fallback"}
    assert {r.id: r.reason for r in curate.missing_identity(df).collect()} == {1: curate.MISSING_REPO, 3: curate.MISSING_REPO}


def test_near_duplicates_share_fate_and_split(spark):
    """A near copy takes its cluster's name, so one document of both is chosen; unmapped ones keep theirs."""
    fp = spark.createDataFrame([(1, "c1", "f1"), (2, "c2", "f2"), (3, "c3", "f3")], "id long, content_hash string, final_cluster string")
    mapped = curate.near_mapped(fp, spark.createDataFrame([(1, "n"), (2, "n")], "id long, cluster_id string"))
    got = {r.id: r.final_cluster for r in mapped.collect()}
    assert got[1] == got[2] and got[3] == "f3" and len(got[1]) == 64 and mapped.columns == ["id", "content_hash", "final_cluster"]


def test_resuming_within_a_batch_is_an_error(spark):
    order = spark.range(20).selectExpr("id as position", "'d' as domain", "id as row_id")
    assert sorted(r.position for r in pack.resumed(order, 2, 2, 8, 1).collect()) == [10, 11, 14, 15, 18, 19]
    with pytest.raises(ValueError):
        pack.resumed(order, 2, 2, 6, 0)
