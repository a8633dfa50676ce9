"""Connected components of a link table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tables import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (u > v): the neighbours of each node are hung on the smallest of them."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = written(least, "least")  # a table, so that a join can split the edges of a node with many
    hung = both.join(least, "u")
    if large:
        hung = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return hung.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, component): the smallest node reachable. Nodes without a link are not listed.

    Null ends are ignored. The number of rounds grows with the logarithm of the longest path; only two sums per round reach the driver."""
    edges = (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = written(edges, "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or tuple(now) == before:
            break
        before = tuple(now)
        edges = written(_star(_star(edges, True), False), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
