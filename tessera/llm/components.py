"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Work


def components(work: Work, edges: DataFrame, name: str = "stars") -> DataFrame:
    """node, root: the smallest node of each component, for every node with an edge and not a root itself.

    edges has columns a and b (numbers). Each round links every node's larger neighbours to its smallest one, then its
    smaller neighbours to the smallest of them; this keeps components and ends in stars after about log n rounds. Only
    minima are gathered by node, and written before they are joined, so that Spark can split the edges of a node with
    many. Every round is a written table.
    """
    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first())

    stars = work.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    i, before = 0, summary(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = work.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}_large")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.write(large, f"{name}_linked")
        low = work.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}_small")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = work.write(small.select("e.*").filter("u <> v").distinct(), f"{name}{i + 1}")
        work.drop(f"{name}{i}")
        stars, i, now = after, i + 1, summary(after)
        if now == before:  # by count and two digests of all edges
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
