"""Connected components by alternating large-star and small-star steps.

Only DataFrame joins and grouped minima; edges are stored in the shared folder
after each round, so lineage stays short and nothing reaches the driver but a
count and a checksum. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour larger than a node to the smallest node around it."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return (both.join(least, "src").filter("dst > src")
            .select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node's smaller neighbours, and the node, to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    links = down.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src != dst")
    return links.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(src, dst)`` (longs); component is its smallest node.

    Loops and repeated or reversed edges are allowed; no edges give no rows."""
    edges = stored(edges.filter("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        edges = stored(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("dst").alias("node")).distinct()
    return (edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))
