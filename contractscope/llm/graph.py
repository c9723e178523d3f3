"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractscope.llm.frames import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b); a component's name is its smallest node.

    Each round takes the smallest name among a node's neighbours, with partial sums before the shuffle, and then the
    name of that name, so long chains shrink by halves. Every round is cut off into the shared checkpoint folder.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    names = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(most_rounds):
        near = both.join(names.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = names.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = names.select(F.col("node").alias("component"), F.col("component").alias("root"))
        after = cut(step.join(jump, "component").select("node", "old", F.least("component", "root").alias("component")))
        names = after.select("node", "component")
        if after.filter("old <> component").isEmpty():
            return names
    raise RuntimeError("components did not settle")
