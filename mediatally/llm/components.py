"""Connected components of a link table, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediatally.session import stage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(links: DataFrame, *, larger: bool) -> DataFrame:
    """Every neighbour of a node (only larger ones, or only smaller ones and the node) is linked to the node's smallest neighbour."""
    seen = _both_ways(links) if larger else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("centre"), F.least("a", "m").alias("m"))
    least = stage(least, "star-centres")
    met = seen.join(least, seen["a"] == least["centre"])
    if larger:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("centre").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def smallest_reachable(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`node` and `root`, the smallest node that `links` (`a`, `b`) reach from it, itself included.

    Large-star and small-star steps in turn until the links stay as they are, which takes a number of rounds that grows
    with the logarithm of the component's size. Each round is written to the shared folder; a node with very many
    links is summed up before the shuffle and its links are split between tasks in the join. The driver sees two sums per round.
    """
    current = stage(links.filter(F.col("a") != F.col("b")).distinct(), "links")
    before = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        current = stage(_stars(stage(_stars(current, larger=True), "large-stars"), larger=False), "small-stars")
    roots = current.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    joined = nodes.join(roots, "node", "left")
    return joined.select("node", F.coalesce("root", F.col("node")).alias("root"))
