"""Connected components of an edge table, with only joins and sums: nothing is gathered on the driver or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stage, unstage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node that can be reached; rows with a null node are left out.

    Each round, a node's parent becomes the least of its grandparent and its neighbours' grandparents, and the same is
    offered to its old parent, so paths halve. Every round's parents are a staged table; joins are on staged tables, so
    that a parent of very many nodes is a skewed join side, which adaptive execution splits. A round's tables go when the next has its own.
    """
    both = edges.select("a", "b").where("a <> b")
    both = stage(both.union(both.select("b", "a")).distinct(), "edges")
    parents = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("p"), F.lit(True).alias("moved")), "parents")
    while True:
        above = parents.select(F.col("node").alias("p"), F.col("p").alias("gp"))
        grand = stage(parents.select("node", "p").join(above, "p").select("node", "p", "gp"), "grandparents")
        near = both.join(grand.select(F.col("node").alias("b"), F.col("gp").alias("offer")), "b").groupBy(F.col("a").alias("node")).agg(F.min("offer").alias("offer"))
        near = stage(near.join(grand, "node"), "offers")
        offers = near.select("node", "offer").union(near.select("p", "offer")).union(grand.select("node", "gp")).groupBy("node").agg(F.min("offer").alias("offer"))
        before, parents = parents, stage(grand.join(offers, "node").select("node", F.least("gp", "offer").alias("p"), (F.least("gp", "offer") != F.col("p")).alias("moved")), "parents")
        unstage(before, grand, near)
        if not parents.where("moved").limit(1).count():
            unstage(both)
            return parents.select("node", F.col("p").alias("root"))
