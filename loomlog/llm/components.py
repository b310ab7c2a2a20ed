"""Connected components of an edge table, by alternating large and small stars.

Each round is two aggregations and two joins over the edges; the edges of a round are written to the
shared folder, so a lost executor costs one round at most. So are its aggregates: a join of two plain exchanges
can be split where a node is a hub. Nothing but two sums reaches the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "large-lows")
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = stage(down.groupBy("a").agg(F.min("b").alias("m")), "small-lows")
    return down.join(low, "a").select("b", "m").where("b <> m").unionAll(low.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of its component for every node that has an edge to another.

    edges has columns a and b of an ordered type; loops and repeats are allowed. A component of
    diameter d needs about log d rounds.
    """
    now = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        large = stage(_large_star(now), "large-stars")
        now = stage(_small_star(large).where("a <> b").distinct(), "stars")
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(sums)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
