"""Where a partition depends on others: edges by part, node classes, exchange plan, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def part_book(parts: DataFrame) -> DataFrame:
    """(part_id, lo, hi, num_nodes): the contiguous ranges that parts would have if nodes were numbered by part."""
    sizes = parts.groupBy("part_id").agg(F.count("*").alias("num_nodes"))
    hi = F.sum("num_nodes").over(Window.orderBy("part_id"))  # a row for each part
    return sizes.select("part_id", (hi - F.col("num_nodes")).alias("lo"), hi.alias("hi"), "num_nodes")


def owners_by_range(ids: DataFrame, book: DataFrame) -> DataFrame:
    """(node_id, part_id) by the range that an id falls into; the book is broadcast, having one row a part."""
    return ids.join(F.broadcast(book), (F.col("node_id") >= F.col("lo")) & (F.col("node_id") < F.col("hi"))).select("node_id", "part_id")


def part_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(src, dst, src_part, dst_part)"""
    end = lambda c: parts.select(F.col("node_id").alias(c), F.col("part_id").alias(f"{c}_part"))
    return edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst").select("src", "dst", "src_part", "dst_part")


def boundary(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """The edges from another part."""
    return part_edges(edges, parts).where("src_part <> dst_part")


def dependents(crossing: DataFrame) -> DataFrame:
    """(part_id, owner_part, node_id): local nodes with an in-edge from the owner's part."""
    return crossing.select(F.col("dst_part").alias("part_id"), F.col("src_part").alias("owner_part"), F.col("dst").alias("node_id")).distinct()


def exchange(crossing: DataFrame) -> DataFrame:
    """(consumer_part, owner_part, node_id): what each part needs, and by the same rows what each owner sends."""
    return crossing.select(F.col("dst_part").alias("consumer_part"), F.col("src_part").alias("owner_part"), F.col("src").alias("node_id")).distinct()


def to_send(plan: DataFrame, produced: DataFrame) -> DataFrame:
    """The plan's rows for the nodes that an owner has just produced."""
    return plan.join(produced.select("node_id").distinct(), "node_id", "left_semi")


def node_classes(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(part_id, node_id, cls): D local with a remote in-neighbour, I other local ones, H remote in-neighbours."""
    crossing = boundary(edges, parts)
    d = crossing.select(F.col("dst_part").alias("part_id"), F.col("dst").alias("node_id")).distinct().withColumn("cls", F.lit("D"))
    local = parts.select("part_id", "node_id").join(d, ["part_id", "node_id"], "left").withColumn("cls", F.coalesce("cls", F.lit("I")))
    halo = crossing.select(F.col("dst_part").alias("part_id"), F.col("src").alias("node_id")).distinct().withColumn("cls", F.lit("H"))
    return local.unionByName(halo)


def exclusive_dependencies(crossing: DataFrame) -> DataFrame:
    """(part_id, owner_part, n): local nodes that depend on that owner alone."""
    one = crossing.groupBy(F.col("dst_part").alias("part_id"), "dst").agg(F.min("src_part").alias("owner_part"), F.max("src_part").alias("other"))
    return one.where("owner_part = other").groupBy("part_id", "owner_part").agg(F.count("*").alias("n"))


def report(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(part_id, n_all, n_local, n_edges, n_dependent, pct_dependent, n_remote)"""
    classes = node_classes(edges, parts).groupBy("part_id").agg(F.count("*").alias("n_all"), F.count_if(F.col("cls") != "H").alias("n_local"), F.count_if(F.col("cls") == "D").alias("n_dependent"), F.count_if(F.col("cls") == "H").alias("n_remote"))
    into = edges.join(parts.withColumnRenamed("node_id", "dst"), "dst").groupBy("part_id").agg(F.count("*").alias("n_edges"))
    pct = F.round(100.0 * F.col("n_dependent") / F.col("n_local"), 6)
    return classes.join(into, "part_id", "left").select("part_id", "n_all", "n_local", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "n_dependent", pct.alias("pct_dependent"), "n_remote")


def halo_features(plan: DataFrame, features: DataFrame) -> DataFrame:
    """(consumer_part, owner_part, node_id, x): the rows that cross in an exchange."""
    return plan.join(features, "node_id").select("consumer_part", "owner_part", "node_id", "x")
