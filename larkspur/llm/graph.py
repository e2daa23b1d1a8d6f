"""Connected components by alternating large and small stars, on edges between 64-bit numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import written


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b), a > b: each node's larger (or smaller) neighbours go to its smallest neighbour.

    The smallest neighbours are written, so that both sides of the join are plain and AQE can split a node with very many.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("w")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("m", "u").alias("m"))
        least = written(least, "least")
        out = both.where("w > u").join(least.hint("merge"), "u").select(F.col("w").alias("a"), F.col("m").alias("b"))
    else:
        least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        out = edges.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only, and that one has none: each component is a star."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b) but the smallest of each component, which is the component."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = written(edges, "edges")
    while not _stars(edges):
        edges = written(_starred(_starred(edges, True), False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
