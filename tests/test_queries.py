import os

import duckdb
import pytest

import __spark_entry__
from textmill.plans import control, curation, ingest, neardup, packing, sft, sinks, variants

MODULES = (curation, neardup, packing, sft, ingest, sinks, control, variants)
NAMES = [(m, n) for m in MODULES for n in m.ORACLES]
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def listed(rows):
    return sorted(str(sorted((k, float(v) if type(v).__name__ == "Decimal" else v) for k, v in r.items())) for r in rows)


@pytest.mark.parametrize(("module", "name"), NAMES, ids=[n for _, n in NAMES])
def test_query_agrees_with_sql(spark, sf, duck, module, name):
    if "order" in name or name in ("microbatch_ranks", "resumed_batches", "feasible_rows", "row_sample", "sft_contaminated_groups"):
        folder = "/root/testdata/sf0.01"  # the smallest tables hold too little for these
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    else:
        folder, con = sf, duck
    ours = module.QUERIES[name](spark, folder).toArrow().to_pylist()
    assert listed(ours) == listed(con.execute(module.ORACLES[name]).to_arrow_table().to_pylist())


def test_preflight(spark, sf):
    row = control.QUERIES["refinement_preflight"](spark, sf).first()
    assert row.within and 0 < row.sampled <= row.pairs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_have_no_cross_product(spark, sf):
    for name in ("canonical_map", "eligible_supply", "decisions", "archive_report"):
        plan = curation.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_they_need(spark, sf):
    plan = ingest.QUERIES["url_quarantine"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[-1]


def test_library_does_not_import_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(f"{root}/textmill"):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "textmill.llm" not in open(f"{folder}/{f}").read()
