"""Connected components of an edge table by rounds of contraction: joins and minima only, no group is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeq.llm.base import stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: of one type with an order) -> (node, root) for every node of an edge; nodes of one component share the root, a node of it.

    In each round a node goes to the neighbour, or itself, of the least hash; a random order takes a constant share of the nodes
    off in every round, also on long chains. Self-loops and repeated edges are allowed. Each round is written to the shared folder.
    """
    both = edges.select("a", "b").where("a <> b")
    alive = stored(both.union(both.select("b", "a")).distinct(), "edges")
    roots = None
    while not alive.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        least = alive.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v")))["v"].alias("to"))
        step = stored(least, "step")
        to_a, to_b = step.toDF("a", "a2"), step.toDF("b", "b2")
        roots = step.toDF("node", "root") if roots is None else roots.join(step.toDF("root", "r2"), "root", "left").select("node", F.coalesce("r2", "root").alias("root"))
        roots = stored(roots, "roots")
        alive = stored(alive.join(to_a, "a").join(to_b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
