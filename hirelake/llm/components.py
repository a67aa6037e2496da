"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node of the neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. ``edges``: (a, b) with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    tied = edges.join(least, "a")
    return (tied.select(F.col("b").alias("a"), F.col("least").alias("b")).filter(F.col("a") > F.col("b"))
            .union(least.select("a", F.col("least").alias("b"))).distinct())


def connected(edges: DataFrame, label: str = "component") -> DataFrame:
    """(node, component) for each node that has a link; component is the smallest node that can be reached.

    ``edges``: columns a, b of one orderable type, without nulls, in any direction; repeats and loops do no harm.
    Each step is settled in the shared folder, so lineage stays short and a lost executor costs one step. The steps
    end when they change nothing; their number grows with the logarithm of a component's size. Only a count and a
    checksum reach the driver.
    """
    current = settle(edges.filter(F.col("a") != F.col("b"))
                     .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    state = None
    while True:
        seen = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (seen["n"], seen["x"]) == state or not seen["n"]:
            break
        state = (seen["n"], seen["x"])
        current = settle(_small_star(_large_star(current)), label)
    return (current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
