"""What parts depend on: counts, sizes, and a state of them that moves of single nodes change.

A part depends on a node outside it that is an out-neighbour of a member. The
state is a base, each part's counts and each node's part and gain, and a log of
what changed around moved nodes, so that a pass of moves shuffles nothing but
what lies around these nodes. Tables are sorted by node, so scans for few nodes
read few pages.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.common import Scratch, few
from weftgraph.graph import Graph, both_directions

KEY = ["part_id", "node_id"]


def member_counts(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(part_id, node_id, cnt): how many members of each part have the node as out-neighbour, inside or outside it; edges are distinct."""
    return edges.select("src", "dst").join(parts.withColumnRenamed("node_id", "src"), "src").groupBy("part_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("cnt"))


def dependencies(counts: DataFrame, parts: DataFrame) -> DataFrame:
    """(part_id, node_id, cnt) of the nodes outside the part."""
    own = parts.select("node_id", F.col("part_id").alias("own"))
    return counts.where("cnt > 0").join(own, "node_id").where("own <> part_id").select("part_id", "node_id", "cnt")


def dependency_sizes(outside: DataFrame, parts: DataFrame) -> DataFrame:
    """(part_id, n) for every part, zeros included."""
    found = outside.groupBy("part_id").agg(F.count("*").alias("n"))
    return parts.select("part_id").distinct().join(found, "part_id", "left").fillna(0, ["n"])


@dataclass
class State:
    """counts (part_id, node_id, cnt) and nodes (node_id, own, gain, deg) as a base; what changed since in logs.

    gain is the number of nodes that the part depends on through this member
    alone; edges are distinct and in both directions.
    """

    edges: DataFrame
    scratch: Scratch
    counts: DataFrame
    nodes: DataFrame
    count_log: list[DataFrame] = field(default_factory=list)  # (part_id, node_id, d)
    node_log: list[DataFrame] = field(default_factory=list)  # (node_id, pass, to, d)
    passes: int = 0
    bases: int = 1

    @classmethod
    def of(cls, graph: Graph, parts: DataFrame, scratch: Scratch) -> State:
        edges = both_directions(graph.edges.where("src <> dst")).repartitionByRange("src", "dst").distinct()  # stays in its ranges
        edges = scratch.keep(edges.sortWithinPartitions("src", "dst"))
        parts = scratch.keep(parts.select("node_id", "part_id"))
        counts = scratch.keep(member_counts(edges, parts))
        single = dependencies(counts, parts).where("cnt = 1").select("part_id", F.col("node_id").alias("dst"))
        own = parts.select(F.col("node_id").alias("src"), "part_id")
        gain = edges.join(own, "src").join(single, ["part_id", "dst"]).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("gain"))
        deg = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("deg"))
        nodes = parts.withColumnRenamed("part_id", "own").join(gain, "node_id", "left").join(deg, "node_id", "left").fillna(0, ["gain", "deg"])
        return cls(edges, scratch, counts, scratch.keep(nodes))

    def counts_of(self, keys: DataFrame) -> DataFrame:
        """(part_id, node_id, cnt) of the given keys, base and log together; keys that no member has are missing."""
        found = self.counts.join(keys, KEY).select(*KEY, "cnt")
        for log in self.count_log:
            found = found.unionByName(log.join(keys, KEY).select(*KEY, F.col("d").alias("cnt")))
        return found.groupBy(*KEY).agg(F.sum("cnt").alias("cnt"))

    def nodes_now(self) -> DataFrame:
        if not self.node_log:
            return self.nodes
        log = reduce(DataFrame.unionByName, self.node_log)
        log = log.groupBy("node_id").agg(F.sum("d").alias("d"), F.max(F.when(F.col("to").isNotNull(), F.struct("pass", "to"))).alias("last"))
        now = self.nodes.join(log, "node_id", "left")
        return now.select("node_id", F.coalesce("last.to", "own").alias("own"), (F.col("gain") + F.coalesce("d", F.lit(0))).alias("gain"), "deg")

    def counts_now(self) -> DataFrame:
        rows = self.counts
        for log in self.count_log:
            rows = rows.unionByName(log.select(*KEY, F.col("d").alias("cnt")))
        return rows.groupBy(*KEY).agg(F.sum("cnt").alias("cnt")).where("cnt > 0")

    def compact(self) -> None:
        """The base anew, and an empty log."""
        self.counts, self.nodes = self.scratch.keep(self.counts_now()), self.scratch.keep(self.nodes_now())
        self.count_log, self.node_log = [], []
        self.bases += 1


def apply_moves(state: State, moves: list[tuple[int, int, int, int]]) -> dict[int, int]:
    """Adds moves (node, from, to, its gain before) to the log: the changed counts, and the gains that change with them. Returns by part what its number of dependencies changes by."""
    spark, keep = state.edges.sparkSession, state.scratch.keep
    moved = few(spark, moves, m="long", frm="int", to="int", before="long")
    held = F.broadcast(moved)  # two for each swap
    near = keep(state.edges.where(F.col("src").isin([m[0] for m in moves])).join(held, F.col("src") == F.col("m")).select("m", "frm", "to", F.col("dst").alias("node_id")))
    signed = F.inline(F.array(F.struct(F.col("frm").alias("part_id"), F.lit(-1).cast("long").alias("d")), F.struct(F.col("to").alias("part_id"), F.lit(1).cast("long").alias("d"))))
    delta = near.select("node_id", signed).groupBy(*KEY).agg(F.sum("d").alias("d"))
    itself = moved.select(F.col("m").alias("node_id"), F.explode(F.array("frm", "to")).alias("part_id")).select(*KEY, F.lit(0).cast("long").alias("d"))
    keys = keep(delta.unionByName(itself).groupBy(*KEY).agg(F.sum("d").alias("d")))
    now = state.nodes_now().select("node_id", "own").join(F.broadcast(moved.select(F.col("m").alias("node_id"), "to")), "node_id", "left")
    told = keys.join(state.counts_of(keys.select(*KEY)), KEY, "left").join(now, "node_id")
    alone = lambda own, cnt: ((own != F.col("part_id")) & (cnt == 1)).cast("long")
    needed = lambda own, cnt: ((own != F.col("part_id")) & (cnt > 0)).cast("long")
    old, new, after = F.coalesce("cnt", F.lit(0)), F.coalesce("cnt", F.lit(0)) + F.col("d"), F.coalesce("to", "own")
    told = keep(told.select(*KEY, alone(F.col("own"), old).alias("s0"), alone(after, new).alias("s1"), (needed(after, new) - needed(F.col("own"), old)).alias("n")))
    differs = told.where("s0 <> s1").select(F.col("node_id").alias("src"), "part_id", (F.col("s1") - F.col("s0")).alias("g"))
    others = keep(state.edges.join(differs, "src").select(F.col("dst").alias("node_id"), "part_id", "g"))
    others = others.join(now.where("to is null").select("node_id", F.col("own").alias("part_id")), ["node_id", "part_id"]).groupBy("node_id").agg(F.sum("g").alias("d"))
    own = near.withColumnRenamed("to", "part_id").join(told, KEY).groupBy("m").agg(F.sum("s1").alias("gain"))
    own = moved.join(own, "m", "left").select(F.col("m").alias("node_id"), "to", (F.coalesce("gain", F.lit(0)) - F.col("before")).alias("d"))
    log = own.unionByName(others.withColumn("to", F.lit(None).cast("int"))).withColumn("pass", F.lit(state.passes))
    state.node_log.append(keep(log.select("node_id", "pass", "to", "d")))
    state.count_log.append(keys.where("d <> 0"))
    return {r["part_id"]: r["n"] for r in told.groupBy("part_id").agg(F.sum("n").alias("n")).collect()}  # a row a part
