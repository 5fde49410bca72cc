"""A tree of digests over ranges of ids: what differs between two versions of a table, found without reading the rest.

A leaf is the digest of the rows of LEAF ids in a row; a node that of FANOUT nodes below it. Levels are tables of a row a
node, so a tree is made by grouping, and compared from the top by joining only the children of nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsetlab.model import CONTENT
from subsetlab.session import cut

LEAF, FANOUT = 1000, 64


def line(columns: list[str] | None = None) -> Column:
    """Write a row's content; a null is told from any text."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns or CONTENT])


def tree(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Return level (0: leaves), node, digest and n of ``rows``, whose draw_id is a whole number written as text.

    Rows that are equal count each. A row whose draw_id isn't such a number (or null) belongs to node -1.
    A leaf gathers the rows of LEAF ids; repeated ids make it larger.
    """
    no = F.coalesce(F.col("draw_id").try_cast("long"), F.lit(-LEAF).cast("long"))
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    level = rows.groupBy(F.floor(no / LEAF).alias("node")).agg(digest(F.sha2(line(columns), 256)).alias("digest"), F.count(F.lit(1)).alias("n"))
    level = out = cut(level.select(F.lit(0).alias("level"), "node", "digest", "n"))
    k = 0
    # Up to the root and the node of rows without a number.
    while level.limit(3).count() > 2:
        k += 1
        named = F.concat_ws(":", F.format_string("%020d", "node"), "digest")
        level = level.groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(digest(named).alias("digest"), F.sum("n").alias("n"))
        level = cut(level.select(F.lit(k).alias("level"), "node", "digest", "n"))
        out = out.unionByName(level)
    return out


def differing_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """Return the nodes of the leaves that differ between two trees (or are in one only), going down from the highest common level."""
    top = min(t.agg(F.coalesce(F.max("level"), F.lit(0)).alias("k")).first()["k"] for t in (a, b))
    below = None
    for k in range(top, -1, -1):
        sides = [t.where(F.col("level") == k) for t in (a, b)]
        if below is not None:
            # Only children of nodes that differ are looked at: few, unless much has changed.
            sides = [s.withColumn("_up", F.floor(F.col("node") / FANOUT)).join(below, "_up", "left_semi") for s in sides]
        both = sides[0].select("node", F.col("digest").alias("x")).join(sides[1].select("node", F.col("digest").alias("y")), "node", "full")
        differ = cut(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("node"))
        below = differ.withColumnRenamed("node", "_up")
    return differ


def differences(old: DataFrame, new: DataFrame, old_tree: DataFrame | None = None, new_tree: DataFrame | None = None) -> DataFrame:
    """Return draw_id and change (added, removed, changed) between two versions with one row an id.

    With stored trees only the id ranges of differing leaves are read: they are handed to the scans as bounds on draw_id
    where ids have one width, and each side's rows are joined to the leaves that differ.
    """
    old_tree = tree(old) if old_tree is None else old_tree
    new_tree = tree(new) if new_tree is None else new_tree
    leaves = differing_leaves(old_tree, new_tree)
    ends = leaves.agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n")).first()

    def side(rows: DataFrame, name: str) -> DataFrame:
        no = F.coalesce(F.col("draw_id").try_cast("long"), F.lit(-LEAF).cast("long"))
        if ends["n"] and ends["a"] >= 0:
            low, high = ends["a"] * LEAF, (ends["b"] + 1) * LEAF - 1
            width = len(str(high))
            if width <= 5:
                rows = rows.where(F.col("draw_id").between(f"{low:05d}", f"{high:05d}") | (F.length("draw_id") != 5))
        return rows.withColumn("node", F.floor(no / LEAF)).join(leaves, "node", "left_semi").select("draw_id", F.sha2(line(), 256).alias(name))

    both = side(old, "x").join(side(new, "y"), "draw_id", "full")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return both.select("draw_id", change.alias("change")).where("change is not null")
