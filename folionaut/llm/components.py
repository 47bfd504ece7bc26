"""Connected components by jobs: every node's label falls to the smallest it can reach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b", tidy: bool = False) -> DataFrame:
    """node, component (smallest node reachable) of every node that has a link; links: pairs, in any order, repeats allowed.

    Alternates large-star and small-star steps: the number of rounds grows with the logarithm of the longest path.
    Each round is a written table, so that lineage stays short; sums of the links tell when nothing moves any more.
    `tidy`: links is a written table that hardly repeats itself, so the rounds begin with it; they end as soon as only stars are left, which one grouping tells.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    given, state = tidy, None
    if not tidy:
        edges = written(spark, edges.where("u <> v").distinct(), "links")
    while True:
        # Large star: larger neighbours of a node link to the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: a node and its smaller neighbours link to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, edges = edges, written(spark, small, "links")
        if not given:
            discard(before)
        given = False
        if tidy:
            # Stars: nobody has two smaller neighbours, or a smaller and a larger one.
            ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
            ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            if ends.where("up > 1 or up = 1 and down = 1").isEmpty():
                break
            continue
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
