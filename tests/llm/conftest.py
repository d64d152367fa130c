import duckdb
import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, "alpha beta gamma delta\nshared line here", "en", "a", 1),
        (1, "alpha beta gamma delta\nshared line here", "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (None, "alpha beta gamma delta\nshared line here", "en", "c", 1),
        (4, " \n\t ", "fr", None, 3),
        (5, "mot " * 30_000, "fr", "c", 120_000),
        (6, "x" * 50_000, None, "d", 50_000),
        (7, "École über ñandú 漢字 🙂\nshared line here", "de", "é", 20),
    ]
    wide = DOCUMENTS + ", score double, fp string, site string, line string, size int, times int, h int, id int, s int, host string, url string"
    return spark.createDataFrame([r + (0.5, "f", "s", "l", 1, 2, 3, 4, 5, "h", "u") for r in rows], wide)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture
def duck():
    def run(sql, folder):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        return con.execute(sql).to_arrow_table().to_pylist()

    return run


@pytest.fixture
def same(spark, duck):
    """Asserts that a registered query and its SQL agree on a folder of tables."""

    def check(name, folder):
        from textmill.llm import queries

        key = lambda rows: sorted(str(sorted(r.items())) for r in rows)
        ours = [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]
        assert key(ours) == key(duck(queries.ORACLES[name], folder))

    return check
