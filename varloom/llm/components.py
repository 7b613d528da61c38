"""Connected components of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b); component is its smallest reachable node.

    Every round hangs the larger neighbours of each node on its smallest one, then the smaller ones,
    until all links lead to the smallest node of their component; paths halve from round to round.
    Minima are taken before they are joined, and a second key makes the joins deal their sides anew, so
    that Spark can split a node with many links; each round is cut from its lineage.
    """
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _tagged(both).join(_tagged(least), ["a", "tag"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _tagged(large).join(_tagged(smallest), ["a", "tag"]).select(F.explode(F.array(F.struct(F.col("a").alias("x"), "m"), F.struct(F.col("b").alias("x"), "m"))).alias("e"))
        edges = checkpointed(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct())
        if (now := _mark(edges)) == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _tagged(df: DataFrame) -> DataFrame:
    return df.withColumn("tag", F.xxhash64("a"))


def _mark(edges: DataFrame) -> tuple:
    """What differs between different sets of links: their number and a sum of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
