"""Small graphs for tests and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph, masks_by_thirds

#: The edges of the nine-node example.
SIMPLE_EDGES = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 4), (8, 7), (8, 6), (8, 5), (7, 6), (7, 5), (6, 5), (5, 4)]
#: Zachary's karate club (1977), members counted from 0, each tie once.
KARATE_TIES = {
    0: [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31],
    1: [2, 3, 7, 13, 17, 19, 21, 30],
    2: [3, 7, 8, 9, 13, 27, 28, 32],
    3: [7, 12, 13],
    4: [6, 10],
    5: [6, 10, 16],
    6: [16],
    8: [30, 32, 33],
    9: [33],
    13: [33],
    14: [32, 33],
    15: [32, 33],
    18: [32, 33],
    19: [33],
    20: [32, 33],
    22: [32, 33],
    23: [25, 27, 29, 32, 33],
    24: [25, 27, 31],
    25: [31],
    26: [29, 33],
    27: [33],
    28: [31, 33],
    29: [32, 33],
    30: [32, 33],
    31: [32, 33],
    32: [33],
}
#: Members who stayed with the instructor.
KARATE_FIRST_CLUB = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 16, 17, 19, 21]


def _edges(spark: SparkSession, pairs: list[tuple[int, int]], prob: bool, seed: int) -> DataFrame:
    edges = spark.createDataFrame(pairs, "src long, dst long")
    return edges.withColumn("prob", F.randn(seed).cast("float")) if prob else edges


def simple_graph(spark: SparkSession, prob: bool = False, feat_size: int = -1, seed: int = 0) -> Graph:
    """Nine nodes, fourteen edges; the feature is the node's number, labels alternate, masks by thirds."""
    nodes = spark.range(9).withColumnRenamed("id", "node_id")
    own = F.array(F.col("node_id").cast("float"))
    nodes = nodes.select("node_id", (own if feat_size == -1 else random_features(feat_size, seed)).alias("features"), (F.col("node_id") % 2).cast("int").alias("label"))
    return Graph(nodes.withColumns(masks_by_thirds(9)), _edges(spark, SIMPLE_EDGES, prob, seed))


def karate(spark: SparkSession, prob: bool = False, feat_size: int = -1, seed: int = 0) -> Graph:
    """The karate club, both directions of each tie; two classes, one for each club."""
    pairs = [(a, b) for a, bs in KARATE_TIES.items() for b in bs]
    nodes = spark.range(34).withColumnRenamed("id", "node_id")
    own = F.array(F.col("node_id").cast("float"))
    label = F.when(F.col("node_id").isin(KARATE_FIRST_CLUB), 0).otherwise(1)
    nodes = nodes.select("node_id", (own if feat_size == -1 else random_features(feat_size, seed)).alias("features"), label.alias("label"))
    return Graph(nodes.withColumns(masks_by_thirds(34)), _edges(spark, pairs + [(b, a) for a, b in pairs], prob, seed))


def random_features(width: int, seed: int = 0):
    """An array column of standard normal floats, one seed a component."""
    return F.array(*(F.randn(seed * 1_000_003 + j).cast("float") for j in range(width)))
