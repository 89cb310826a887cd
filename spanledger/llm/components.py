"""Connected components of a table of links, by passing on the smallest number and short cuts; state lives in checkpointed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that its links lead to. Only nodes with a link have a row; nulls link nothing.

    Every round, each node's larger neighbours are linked with its smallest neighbour, then its smaller neighbours likewise; it ends when
    nothing changes, in a number of rounds that grows with the logarithm of the longest chain. A hot node is summed where its links lie (minimum)
    and joined back by key, which Spark can split."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = cut_lineage(edges)
    seen = None
    while True:
        # Large star: neighbours above a node go to the smallest of its neighbours and itself.
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the same for neighbours below, and the node itself.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut_lineage(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen is not None and tuple(now) == seen:
            break
        seen = tuple(now)
    out = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())
