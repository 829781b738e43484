"""Connected components of link tables, by stars.

Alternates two steps until nothing changes (Kiveris et al., "Connected Components in MapReduce and Beyond"): the large star
links every larger neighbour of a node to the node's smallest neighbour, the small star every smaller one.  The number of
rounds grows with the logarithm of the longest chain.  Each step is a grouped minimum (combined before the shuffle), written
and joined back, so a node with very many links is never held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.lineage import by_sort
from skysift.llm.common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` has ``a < b``; one star step, again with ``a < b``."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select(F.col("b"), F.col("a")))
    if large:
        low = both.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("low", "node").alias("low"))
        moved = both.where("near > node")
    else:
        low = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low"))
        moved = links.select(F.col("b").alias("node"), F.col("a").alias("near"))
    low = materialize(low, "star-lows")
    out = moved.join(by_sort(low), "node").select(F.col("low").alias("a"), F.col("near").alias("b"))
    if not large:
        out = out.union(low.select(F.col("low"), F.col("node")))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node with a link; ``root`` is the smallest node reachable.  ``links`` has columns ``a, b``."""
    now = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    mark = None
    while True:
        now = materialize(_star(_star(now, large=True), large=False), "links")
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if tuple(row) == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())
        mark = tuple(row)
