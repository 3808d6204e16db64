"""Connected components of links by alternating large and small stars, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, scratch, written


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) of every node in a link (a, b) of longs; root is the component's least node.

    Each round hangs every node's larger neighbours, then its smaller ones, on its least neighbour
    (Kiveris et al., 2014); rounds grow with the logarithm of a component's diameter. Minima are
    aggregated before the shuffle, and the joins that follow are plain equi-joins that Spark's skew
    handling splits, so a node with many links doesn't meet in one task. Each round is written to
    the shared folder, and the one before it deleted.
    """
    spark = links.sparkSession
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    at = scratch(spark, "stars")
    edges = written(edges, "stars", at)
    seen = _state(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch(spark, "stars")
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars", after)
        drop_path(spark, at)
        at, before, seen = after, seen, _state(edges)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """The number of edges and two sums over them; equal when nothing changed."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.shiftrightunsigned(h, 24)), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).first())
