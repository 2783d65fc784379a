"""Connected components of links, for any number of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that the links (a, b) reach; nodes without a link are left out.

    Large and small stars in turn: every node's neighbours are hung on the
    smallest of them until nothing changes. The number of rounds grows with the
    logarithm of the longest chain. A node with many links is summed up per task
    before its rows meet, and each round is written down.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = written(edges, name)
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u > v").distinct(), f"{name}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        hung = large.join(low, F.col("u") == F.col("c")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.union(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
        small = written(small, f"{name}-small")
        if same(edges, small):
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        edges = small


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets of edges are equal, by count and a sum of hashes."""
    total = lambda d: tuple(
        d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )
    return total(a) == total(b)
