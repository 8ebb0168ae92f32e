"""Graphs over the TPC-H style tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.common import table
from weftgraph.graph import Graph, both_directions


def part_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts (their key) and suppliers (number of parts plus their key), linked both ways where a line item joins them.

    Masks go by the last digit of the node id: 0-6 train, 7-8 validation, 9 test.
    """
    part = table(spark, sf_dir, "part")
    parts = F.lit(part.agg(F.max("p_partkey") + 1).first()[0])
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), "l_suppkey")
    ends = lambda rows: rows.select("src", (F.col("l_suppkey") + parts).alias("dst"))
    nodes = part.select(F.col("p_partkey").alias("node_id")).unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + parts).alias("node_id")))
    return Graph(_masked(nodes), both_directions(ends(lines.distinct())), ends(lines))


def customer_order(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and orders (number of customers plus their key), linked both ways."""
    customer = table(spark, sf_dir, "customer")
    customers = F.lit(customer.agg(F.max("c_custkey") + 1).first()[0])
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + customers).alias("dst"))
    nodes = customer.select(F.col("c_custkey").alias("node_id")).unionByName(pairs.select(F.col("dst").alias("node_id")))
    return Graph(_masked(nodes), both_directions(pairs))


def customer_order_parts(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(node_id, part_id): customers by chunk, orders with their customer, but every tenth with the next part."""
    customer = table(spark, sf_dir, "customer")
    customers = F.lit(customer.agg(F.max("c_custkey") + 1).first()[0])
    chunk = lambda c: F.floor(F.col(c) / (customers / k))
    own = customer.select(F.col("c_custkey").alias("node_id"), chunk("c_custkey").cast("int").alias("part_id"))
    moved = F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0)
    theirs = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + customers).alias("node_id"), ((chunk("o_custkey") + moved) % k).cast("int").alias("part_id"))
    return own.unionByName(theirs)


def _masked(nodes: DataFrame) -> DataFrame:
    digit = F.col("node_id") % 10
    return nodes.select("node_id", (digit <= 6).alias("train_mask"), digit.between(7, 8).alias("val_mask"), (digit == 9).alias("test_mask"))


def with_embeddings(spark: SparkSession, sf_dir: str, nodes: DataFrame, width: int = 64) -> DataFrame:
    """Adds x (the first ``width`` components as doubles) and label from embeddings, by node id modulo their number."""
    vectors = table(spark, sf_dir, "embeddings")
    count = max(1, vectors.count())
    vectors = vectors.select("vec_id", F.slice(F.col("embedding"), 1, width).cast("array<double>").alias("x"), "label")
    return nodes.withColumn("vec_id", F.col("node_id") % count).join(vectors, "vec_id").drop("vec_id")
