"""Connected components of large graphs, as rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of ``edges`` (a, b; longs) a node that all of its component share.

    Each round every node joins its neighbour of least priority, a hash of the id, and the edges between joined nodes are
    dropped: with random priorities a fixed share of the nodes goes each round, for chains as for stars, so the rounds grow
    with the logarithm of the nodes. Loops and repeated edges don't matter; no edges give no rows.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("p"), F.col(c).alias("id"))
    edges = materialize(edges.select("a", "b").where("a <> b").distinct())
    roots: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["id"].alias("root"))
        least = materialize(least)
        to = lambda c: least.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to"))  # noqa: B023, E731
        edges = materialize(edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct())
        if roots is None:
            roots = least
        else:
            step = least.select(F.col("node").alias("root"), F.col("root").alias("further"))
            roots = materialize(roots.join(step, "root", "left").select("node", F.coalesce("further", "root").alias("root")))
    if roots is None:
        roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
