"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._scratch import stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of links(a, b): the smallest node that can be reached. Nodes without links have no row.

    Each round writes its links to the shared folder, so lineage stays short. A round hangs every larger neighbour, then every
    smaller one, on a node's smallest neighbour; the rounds end when nothing moves, after about log2(longest path) of them.
    Nulls and self-links are dropped.
    """
    edges = stored(_oriented(links), "links")
    before = _sum(edges)
    for _ in range(max_rounds):
        if not before[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        grown = _star(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        after = stored(_star(grown, larger=False), "links")
        now = _sum(after)
        if now == before:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        edges, before = after, now
    raise RuntimeError("components did not settle")


def _oriented(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges hold both directions (larger) or a > b; each node's other neighbours move to its smallest one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = edges.join(least, edges["a"] == least["n"])
    if larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def _sum(edges: DataFrame) -> tuple:
    x = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return x[0], x[1]
