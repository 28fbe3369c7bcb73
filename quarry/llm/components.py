"""Connected components of a graph given as a table of edges, by Spark joins alone.

Large-star and small-star steps alternate until the edges no longer change; then each node
points to the smallest node of its component. Every step is checkpointed in the shared
folder. The minimum over a node's neighbours is aggregated before the shuffle. A node with very
many edges is a hot key of the join that follows; as both sides of that join are plain
shuffles of written tables, the adaptive skew join can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point downwards (v < u)."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u")
    return (moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v; long): ``root`` is the smallest node
    that it reaches. Repeated edges and loops do no harm; no edges, no rows."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = stored(edges.where("u <> v").distinct(), "edges")
    nodes = stored(nodes, "nodes")
    mark = None
    while True:
        links = stored(_small_star(stored(_large_star(links), "large-star")), "small-star")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return nodes.join(links, nodes["node"] == links["u"], "left").select("node", F.coalesce("v", "node").alias("root"))
