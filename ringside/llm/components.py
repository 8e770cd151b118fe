"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the least node that it
    reaches. Each round takes the least root among the neighbours and then
    follows the root's own root, so long chains halve; a written table cuts the
    lineage of each round. Self links give a node its own row.
    """
    both = save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root"))
    roots = save(roots, "roots")
    for _ in range(rounds):
        near = both.join(roots, both["b"] == roots["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("via"))
        stepped = roots.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "via").alias("root"))
        up = roots.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
        jumped = save(stepped.join(up, stepped["root"] == up["_n"], "left").select("node", "old", F.least("root", "_up").alias("root")), "roots")
        roots = jumped.select("node", "root")
        if not jumped.filter("old <> root").limit(1).count():
            return roots
    raise RuntimeError(f"components did not settle in {rounds} rounds")
