"""Connected components of links between integers, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footprints.llm.storage import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked with the vertex's smallest neighbour, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours are linked with the smallest of them. Edges go from the larger to the smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every edge (a, b) goes from a vertex of no other edge to one from which none goes, b being smaller."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("leaving"), F.lit(0).alias("reached"))
    ends = ends.unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("leaving"), F.lit(1).alias("reached")))
    return ends.groupBy("id").agg(F.sum("leaving").alias("leaving"), F.max("reached").alias("reached")).where("leaving + reached > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every vertex of links (a, b); component is the smallest vertex it can reach.

    Smallest neighbours are aggregated before they are shuffled, and joined back with Spark free to split a vertex that has
    many links. Each round is written to the shared folder; the last one is that which leaves stars. Links of a vertex with itself keep the vertex.
    """
    links = written(links.select("a", "b"), "links")
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    while not _stars(edges):
        edges = written(_small_star(_large_star(edges)), "links")
    itself = links.select(F.explode(F.array("a", "b")).alias("id"))
    found = itself.select("id", F.col("id").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("b").alias("component")))
    return found.groupBy("id").agg(F.min("component").alias("component"))
