"""Connected components of a graph in a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import durable


def _least(edges: DataFrame) -> DataFrame:
    """u with the least of itself and its neighbours v; partial sums keep a node of many edges cheap."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).select(F.col("u").alias("_u"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    d = both.join(_least(both), F.col("u") == F.col("_u")).filter("v > u")
    return d.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    d = down.join(_least(down), F.col("u") == F.col("_u"))
    pairs = d.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return pairs.filter("u != v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root of every node with an edge (u, v); root is the least node that it reaches.

    Each round leaves a table in the shared folder. The graph has converged when a round changes no edge.
    """
    edges = durable(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u != v").distinct(), "edges")
    said = None
    for _ in range(most_rounds):
        edges = durable(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == said:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
        said = now
    raise RuntimeError("the components did not settle")
