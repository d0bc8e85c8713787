"""Connected components as Spark joins.

Each round every node hooks to the smallest node (by a mixed id) among itself and its
neighbours, and the edges are rewritten to the hooked nodes; loops and repeats go. The graph
shrinks by a constant factor a round because the order is pseudo-random, also on long chains.
The hooks of all rounds, composed, give each node's root. Nothing reaches the driver but a
row count per round; each round's tables are checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, root) for every node that has an edge.

    ``root`` is one node of the component, the same for all its nodes. Loops and repeated
    edges do no harm; no edges give an empty result.
    """
    edges = checkpointed(edges.where("a <> b").select("a", "b").distinct())
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        hooks = checkpointed(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(rank("b")).alias("low"))
            .select("node", F.least(F.col("low"), F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n")))["n"].alias("root")))
        nxt = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = hooks if labels is None else checkpointed(
            labels.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        ha = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        hb = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = checkpointed(
            edges.join(ha, "a").join(hb, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if edges.isEmpty():
            return labels
