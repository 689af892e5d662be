"""Connected components of an edge table by rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import written
from .spread import spread_join

#: Rounds after which the loop gives up; each shrinks the longest path by half or better.
ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of the undirected edges (long columns a and b): component is the least node.

    Every round is two group-bys with minima that combine before the shuffle and two joins, in which the edges of a
    hub are dealt into parts. Round tables are written to the shared folder, so lineage stays short and lost executors
    cost part of a round. Self loops and repeated edges do not matter; an edge with a null end counts for nothing; no
    edges give no rows.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = written(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(ROUNDS):
        both = now.union(now.select("b", "a"))
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        # large star: every larger neighbour of a node goes to the node's least neighbour
        large = spread_join(both.where("b > a"), least, ["a"], "n", F.xxhash64("b")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "large")
        # small star: a node and its smaller neighbours go to the least of them
        lower = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "lower")
        small = spread_join(large, lower, ["a"], "n", F.xxhash64("b"))
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = written(small.where("a <> b").distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
