"""Connected components of a large edge table: alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, scratch


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long edges to (node, root) of each node that isn't the smallest of its component; root is that one.

    Each round is a few aggregations and equi-joins over the edges and is written to the shared
    folder; rounds grow with the logarithm of the longest path. No edge leaves the executors.
    Loops and repeated edges are fine; nodes without an edge to another node are not returned.
    """
    with scratch(edges.sparkSession) as keep:
        pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        seen = None
        for _ in range(max_rounds):
            # Every neighbour above a node moves to the smallest of that node's neighbourhood.
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            pairs = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "up")
            # The neighbours below a node, and the node, move to the smallest of them.
            least = pairs.groupBy("u").agg(F.min("v").alias("m"))
            down = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            pairs = cut(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "down")
            now = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
            if now == seen:
                return keep(pairs).select(F.col("u").alias("node"), F.col("v").alias("root"))
            seen = now
    raise RuntimeError("components did not settle")
