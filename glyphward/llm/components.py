"""Connected components by alternating large-star and small-star rounds, each kept in the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _lowest(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the lowest neighbour of u or u itself.

    The join's key is the complement of u, while the minimum was grouped by u: both sides are dealt anew, and
    the rows of a node with very many neighbours can be split among tasks.
    """
    m = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), F.least("m", "u").alias("m"))
    return edges.withColumn("k", F.bitwise_not("u")).join(m.hint("merge"), "k").drop("k")


def _unfinished(edges: DataFrame) -> bool:
    """Whether a node has several lower neighbours, or lower and higher ones; else all components are stars."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return bool(ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").take(1))


def connected_components(links: DataFrame) -> DataFrame:
    """node, root (the lowest node that links reach) for each node in links (u, v), two long columns.

    Links with a null end and from a node to itself count for nothing; links may repeat.
    """
    edges = durable(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while _unfinished(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _lowest(large)
        small = low.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = durable(small)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
