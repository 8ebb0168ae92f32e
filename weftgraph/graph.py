"""Graphs as two DataFrames: nodes(node_id, ...) and edges(src, dst, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """A directed graph. Ids are global everywhere and never renumbered. Where edges are both directions of some pairs (src, dst), each once, these may stand beside them, and may repeat."""

    nodes: DataFrame
    edges: DataFrame
    pairs: DataFrame | None = None

    def without_self_loops(self) -> Graph:
        return Graph(self.nodes, self.edges.where("src <> dst"))

    def with_self_loops(self) -> Graph:
        """Exactly one loop at each node, whatever loops there were; other edge columns are null there."""
        loops = self.nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
        return Graph(self.nodes, self.edges.where("src <> dst").unionByName(loops, allowMissingColumns=True))

    def symmetrised(self) -> Graph:
        """The simple graph with both directions of every edge; node columns stay."""
        return Graph(self.nodes, both_directions(self.edges).distinct())

    def induced(self, keep: Column) -> Graph:
        """The subgraph of the nodes for which ``keep`` holds."""
        nodes = self.nodes.where(keep)
        ids = nodes.select("node_id")
        edges = self.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
        return Graph(nodes, edges.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*self.edges.columns))

    def inductive(self) -> tuple[Graph, Graph, Graph]:
        """What training, validation and test may see: train nodes, train and validation nodes, all."""
        return self.induced(F.col("train_mask")), self.induced(F.col("train_mask") | F.col("val_mask")), self

    def degrees(self) -> DataFrame:
        """(node_id, din, dout) of every node, zeros included."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
        found = ends.groupBy("node_id").agg(F.sum("i").alias("din"), F.sum("o").alias("dout"))
        return self.nodes.select("node_id").join(found, "node_id", "left").fillna(0)

    def stats(self) -> DataFrame:
        """One row: n_nodes, n_edges, n_train, n_val, n_test."""
        n = self.nodes.agg(F.count("*").alias("n_nodes"), F.count_if("train_mask").alias("n_train"), F.count_if("val_mask").alias("n_val"), F.count_if(test_rows()).alias("n_test"))
        return n.withColumn("n_edges", self.edges.agg(F.count("*")).scalar())


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, in one pass over the edges."""
    return edges.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))


def graph_of_edges(edges: DataFrame) -> Graph:
    """Nodes 0 to the largest end of any edge."""
    last = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return Graph(edges.sparkSession.range(0 if last is None else last + 1).withColumnRenamed("id", "node_id"), edges)


def num_nodes(edges: DataFrame) -> DataFrame:
    return edges.agg((F.coalesce(F.greatest(F.max("src"), F.max("dst")), F.lit(-1)) + 1).alias("num_nodes"))


def test_rows() -> Column:
    """All rows outside train and validation; a stored test mask is not asked."""
    return ~(F.col("train_mask") | F.col("val_mask"))


def masks_by_position(n: Column | int, first: float = 0.7, second: float = 0.9) -> dict[str, Column]:
    """The first 70 % train, the next 20 % validation, the rest test, by node id."""
    n = F.lit(n) if isinstance(n, int) else n
    a, b = F.floor(n * first), F.floor(n * second)
    i = F.col("node_id")
    return {"train_mask": i < a, "val_mask": (i >= a) & (i < b), "test_mask": i >= b}


def masks_by_thirds(n: int) -> dict[str, Column]:
    third, i = n // 3, F.col("node_id")
    return {"train_mask": i < third, "val_mask": (i >= third) & (i < 2 * third), "test_mask": i >= 2 * third}


def masks_by_roles(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """Adds the masks from roles(node_id, role), whose roles are tr, va and te; false where a node has none."""
    masks = {"train_mask": "tr", "val_mask": "va", "test_mask": "te"}
    given = roles.groupBy("node_id").agg(*(F.max(F.col("role") == r).alias(m) for m, r in masks.items()))
    return nodes.join(given, "node_id", "left").fillna(False, list(masks))


def gather(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the given node ids."""
    return rows.join(ids.select("node_id").distinct(), "node_id", "left_semi")


def scatter(rows: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` overwritten where ``new`` has the node."""
    return rows.join(new.select("node_id", F.col(column).alias("__new")), "node_id", "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def fill_missing(ids: DataFrame, rows: DataFrame, column: str, width: int) -> DataFrame:
    """One row for each id, zeros where ``rows`` has none."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return ids.select("node_id").join(rows.select("node_id", column), "node_id", "left").withColumn(column, F.coalesce(column, zeros))


def num_classes(nodes: DataFrame, label: str = "label") -> DataFrame:
    value = F.col(label).cast("double")
    return nodes.where(value.isNotNull() & ~F.isnan(value)).agg(F.count_distinct(label).alias("num_classes"))
