"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.storage import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v); the root is the least node of its component.

    Every node points to the least node it knows of; each round it learns its neighbours' pointers and then jumps to
    its pointer's pointer, so a path of n nodes takes about log n rounds. Rows never outnumber nodes and edges.
    """
    both = cut(edges.where("u != v").select("u", "v").unionByName(edges.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "node"))
    for _ in range(max_rounds):
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("root").alias("best"))
        heard = labels.join(near, labels.node == near.u).select("node", F.least("root", "best").alias("at"), F.col("root").alias("old"))
        # what a node learns its pointer learns too, else long chains crawl
        told = heard.groupBy(F.col("old").alias("n")).agg(F.min("at").alias("t"))
        linked = heard.join(told, heard.node == told.n, "left").select("node", "old", F.least("at", F.coalesce("t", "at")).alias("at"))
        up = linked.select(F.col("node").alias("n"), F.col("at").alias("top"))
        jumped = cut(linked.join(up, linked["at"] == up.n).select("node", F.least("at", "top").alias("root"), (F.least("at", "top") != F.col("old")).alias("moved")))
        moved = jumped.where("moved").isEmpty()
        labels = jumped.select("node", "root")
        if moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
