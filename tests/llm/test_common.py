import time

from pyspark.sql import functions as F

from textmill.llm import similar
from textmill.llm.common import cut


def shuffle_files(spark):
    """Names of the shuffle files on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def left_by(spark, made):
    """Shuffle files that are there after `made()` and weren't before; removal isn't waited for by Spark."""
    before = shuffle_files(spark)
    kept, until = made(), time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return kept, left


def test_stored_step_leaves_no_shuffle_files(spark):
    """Not even while the plan it came from is held, which keeps Spark's cleaner from them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    df = spark.range(2000).groupBy((F.col("id") % 700).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out, left = left_by(spark, lambda: cut(df))
    assert not left
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect())) and out.count() == 700
    assert spark.conf.get(name, None) == before


def test_classes_leave_little(spark):
    """Of near-dedup's classes only the last, lazy step may leave files: the counts of all prefixes are gone before it."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j % (i % 7 + 9)}" for j in range(60))) for i in range(60)], "doc_id long, text string")
    found, left = left_by(spark, lambda: similar.classes(docs))
    assert not left and found.count() == 60
