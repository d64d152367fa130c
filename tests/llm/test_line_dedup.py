from pyspark.sql import functions as F

from textmill.llm import line_dedup


def rows(df):
    return sorted((r.doc_id if r.doc_id is not None else 99, r.text, r["__removed"]) for r in df.collect())


def brute(docs, min_sites, long_sites=line_dedup.LONG_SITES, long_words=line_dedup.LONG_WORDS):
    bare = lambda x: x.strip(line_dedup.EDGE)
    need = lambda b: long_sites if len(b.split()) >= long_words else min_sites
    spread, first = {}, {}
    for i, text, site in docs:
        for pos, line in enumerate((text or "").split("\n")):
            if b := bare(line):
                spread.setdefault(b, set()).add(site)
                first[b] = min(first.get(b, (10**9, 0)), (i, pos))
    out = []
    for i, text, site in docs:
        if text is None:
            out.append((i, None, 0))
            continue
        lines = text.split("\n")
        gone = {p for p, x in enumerate(lines) if (b := bare(x)) and len(spread[b]) >= need(b) and first[b] != (i, p)}
        if 3 * sum(len(bare(lines[p])) for p in gone) > 2 * sum(len(bare(x)) for x in lines):
            gone = set()  # a copy
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone)))
    return sorted(out, key=str)


def test_agrees_with_sql(same, sf_mid):
    same("op1_line_dedup", sf_mid)


def test_agrees_with_brute_force(spark):
    docs = []
    for i in range(120):
        lines = [f"own line {i}", "everywhere" + " " * (i % 3), f"shared by {i % 7}", "", f"tail {i % 40}", "everywhere"]
        lines += [f"passage {i % 50} " + "of many words " * 13] * (i % 4 == 0) + [f"{k} " * 39 + "short of it" * (k % 2) for k in range(i % 3)]
        docs.append((i, "\n".join(lines), f"site{i % 12}"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for min_sites in (2, 6, 12, 13):
        got = line_dedup.dedup_lines(df, min_sites)
        assert sorted(((r[0], r[1], r[3]) for r in got.select("doc_id", "text", "source", "__removed").collect()), key=str) == brute(docs, min_sites)


def test_shuffled_paths_agree(spark, monkeypatch):
    docs = [(i, f"line {i}\ncommon\nhalf {i % 2}", f"s{i % 5}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    with_broadcast = rows(line_dedup.dedup_lines(df, 3))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert rows(line_dedup.dedup_lines(df, 3)) == with_broadcast


def test_sketch_decides_far_lines_alike(spark, monkeypatch):
    docs = [(i, f"common\nhalf {i % 2}\nown {i}", f"s{i}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    exact = rows(line_dedup.dedup_lines(df, 20))
    monkeypatch.setattr(line_dedup, "NEAR", (0.5, 1e9))
    assert rows(line_dedup.dedup_lines(df, 20)) == exact


def test_edges(edge_docs, no_docs):
    out = line_dedup.dedup_lines(edge_docs, 2)
    assert out.columns == [*edge_docs.columns, "__removed"]
    got = rows(out)
    text = "alpha beta gamma delta\nshared line here"
    # both copies of document 1 hold the first occurrence; the null id comes after all others
    assert got.count((1, text, 0)) == 2
    # it holds nothing else, so it's a copy and stays whole
    assert (99, text, 0) in got
    assert (7, "École über ñandú 漢字 🙂", 1) in got
    assert any(r == (2, None, 0) for r in got if r[1] is None) and (3, "", 0) in got and (4, " \n\t ", 0) in got
    assert line_dedup.dedup_lines(no_docs).collect() == []


def test_long_lines_need_fewer_sites(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(60))
    docs = [(i, f"{own(i)}\n{passage}\nAll rights reserved.", f"s{i}") for i in range(line_dedup.LONG_SITES)]
    got = {r[0]: r[1] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == {0: docs[0][1]} | {i: f"{own(i)}\nAll rights reserved." for i in range(1, line_dedup.LONG_SITES)}


def test_copies_stay_whole(spark):
    docs = [(i, "\n".join(f"line {k} of a copied page" for k in range(9)), f"s{i}") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert rows(line_dedup.dedup_lines(df)) == [(i, t, 0) for i, t, _ in docs]


def test_any_names(spark):
    """Columns named like everything inside keep their values."""
    names = "d id doc gone need long some first sites pos size h1 h2 line __positions __id".split()
    df = spark.createDataFrame([(i, f"own {i}\nshared line", f"s{i}", *range(len(names))) for i in range(6)], ["doc_id", "text", "source", *names])
    for r in line_dedup.dedup_lines(df).collect():
        assert r["__removed"] == (r.doc_id > 0 and len(f"own {r.doc_id}") * 2 >= 11) and list(r)[3:-1] == list(range(len(names)))


def test_native(edge_docs):
    out = line_dedup.dedup_lines(edge_docs, 2).select(F.count("*"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
