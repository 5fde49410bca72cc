"""Connected components of a graph in a DataFrame, by the alternating star method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link nodes to the least node around each node: those above it (large star), or those below and itself (small).

    Minima are pre-aggregated; the join's side by node holds one row a node, so a hub's edges can be split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Return (node, root): each node of ``edges`` (columns a, b, both long) and the least node that it is linked to.

    Nodes without an edge to another node don't occur in the result. Every round is written to the shared folder.
    The number of rounds grows with the logarithm of the longest path.
    """
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = now.agg(mark.alias("x")).first()["x"]
    while before["n"]:
        now = cut(_star(_star(now, large=True), large=False))
        after = now.agg(mark.alias("x")).first()["x"]
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
