"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Large star: each node links its larger neighbours to the least of its neighbourhood; small star: it links itself
    and its smaller neighbours. Minima are aggregated before the shuffle; a node with very many edges is a skewed key
    of the join, which Spark splits."""
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (
        down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge table (a long, b long); root is the component's smallest node. Nodes and
    edges never leave the executors: each round writes the edge table to the shared folder, and only its size and a sum
    of hashes, which tell whether it still changes, come to the driver."""
    now = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        now = table(_star(_star(now, True), False), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
