"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (columns a, b) that is not the smallest itself.

    Alternates large-star and small-star steps until every node points at the smallest of its component; each round is
    a few joins and sums over the edges left, and each is written to the shared folder. Loops (a = a) and
    repeated edges count for nothing.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while True:
        heads = now.select(F.col("b").alias("a")).distinct()
        settled = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0
        if settled and now.join(heads, "a", "left_semi").limit(1).count() == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        now = keep(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
