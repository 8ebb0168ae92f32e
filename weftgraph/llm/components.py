"""Connected components of a table of links, by alternating star joins.

Each round joins every node to the least node next to it (large star, small
star), so trees flatten in a logarithmic number of rounds. A node's least
neighbour is a grouped minimum with map-side combining; where it is joined
back to the links, nodes with very many of them are joined by broadcast, so a
hub is no single task's work. Rounds are cut by checkpoints in the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, hot_keys, join_unique


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); root is the least node of its component."""
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        # Large star: larger neighbours of a node go to the least of its neighbourhood.
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        large = join_unique(both, least.select("a", F.least("a", "m").alias("m")), ["a"], hot=hot_keys(least, ["a"]))
        large = cut(large.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # Small star: smaller neighbours of a node and the node itself go to the least of them.
        least = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_unique(large, least.select("a", "m"), ["a"], hot=hot_keys(least, ["a"]))
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = cut(small.where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")
