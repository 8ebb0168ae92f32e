"""Mini-batches of local nodes. In Spark a task is the batch; bins serve to compare and to write batches out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.common import ranked


def scaled_bin_size(bin_size: int, layer: int, in_feats: int, n_hidden: int) -> int:
    """Later layers have narrower inputs, so their bins hold more nodes; never fewer than as given."""
    return bin_size if layer == 0 else bin_size * max(1, in_feats // n_hidden)


def _rank_in(rows: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``own``, the rank by node id within a group. Range partitions count their rows, so a large group is no single task's work."""
    rank = ranked(rows, *group, "node_id")
    first = rank.groupBy(*group).agg(F.min("rank").alias("first"))  # a row for each group
    return rank.join(F.broadcast(first), group).withColumn("own", F.col("rank") - F.col("first"))


def naive(parts: DataFrame, bin_size: int) -> DataFrame:
    """(part_id, node_id, bin_id): consecutive slices of a part's nodes by id."""
    return _rank_in(parts.select("part_id", "node_id"), ["part_id"]).select("part_id", "node_id", F.floor(F.col("own") / bin_size).cast("int").alias("bin_id"))


def priority(classes: DataFrame, bin_size: int) -> DataFrame:
    """(part_id, node_id, bin_id): all D nodes in bin 0, then slices of the I nodes."""
    local = _rank_in(classes.where("cls in ('D', 'I')").select("part_id", "node_id", "cls"), ["part_id", "cls"])
    bin_id = F.when(F.col("cls") == "D", 0).otherwise(1 + F.floor(F.col("own") / bin_size))
    return local.select("part_id", "node_id", bin_id.cast("int").alias("bin_id"))


METHODS = {"naive": naive, "prio": priority}
