"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from esquina.operators.stage import settle


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (``a, b``), ``comp`` being the least node that it reaches.

    Alternates large-star and small-star steps: every node ties its neighbours to the least one. Minima are
    aggregated before they are shuffled, so a node with very many neighbours is no burden, and each step is a
    written table. The driver sees two numbers for each step.
    """
    current = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        current = settle(small_star(large_star(current)), "edges")
    own = current.select(F.col("b").alias("node"), F.col("b").alias("comp"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(own).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("m"))
    tied = both.filter("b > a").join(least, F.col("a") == F.col("node"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    tied = edges.join(least, F.col("a") == F.col("node")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()
