"""Connected components of an edge table by alternating large and small stars, each round one staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.sources.files import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m")).select("_a", F.least("_a", "_m").alias("_m"))
    return both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    down = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m"))
    near = down.join(least, F.col("a") == F.col("_a")).where(F.col("b") != F.col("_m")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return near.unionByName(least.select(F.col("_a").alias("a"), F.col("_m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) of any orderable type, in any direction. One row (a, b) for each node that is not the
    smallest of its component: the node and that smallest node. Repeated edges and loops do no harm."""
    spark = edges.sparkSession
    stars = stage(spark, edges.where(F.col("a") != F.col("b")), "edges")
    mark = None
    while True:
        stars = stage(spark, _large_star(stars), "large_stars")
        stars = stage(spark, _small_star(stars), "small_stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return stars
        mark = now
