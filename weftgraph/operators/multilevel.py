"""A multilevel partitioner: match, contract, split the coarsest graph, and refine on the way back.

Nodes propose to their heaviest neighbour and mutual proposals are matched, a
few rounds a level; nodes that are left over join others left over at the same
neighbour, so stars shrink too. Contraction is two joins and a grouped sum.
When no more nodes are left than a fixed bound they are split into parts by
growing and moving in one task; that graph's size does not depend on the
input's. Back at each finer level, nodes move to the part with most of their
edges, an independent set of them in a round, so that every round lowers the
cut by the sum of its gains; parts take no more than their room.

Edges are joined with what holds one row a node, hot nodes by broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.common import Scratch, cut, hot_keys, join_unique, small_tasks
from weftgraph.graph import Graph, both_directions

#: The coarsest graph has as many nodes at most, or as many for each part.
COARSEST, COARSEST_A_PART = 1024, 16
#: Nodes that are left over at one neighbour and become one.
TOGETHER = 4


@dataclass
class Level:
    """nodes (node_id, w); edges (src, dst, w), both directions of each, without loops; hot (node_id)."""

    nodes: DataFrame
    edges: DataFrame
    hot: DataFrame
    n: int
    keep: Callable[[DataFrame], DataFrame] = cut

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> Level:
        nodes, edges = keep(nodes), keep(edges)
        hot = keep(hot_keys(keep(edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n"))), ["node_id"]))
        return cls(nodes, edges, hot, nodes.count(), keep)

    def beside(self, rows: DataFrame, table: DataFrame, end: str, how: str = "inner") -> DataFrame:
        """Rows with a node at ``end`` joined with a table of one row a node."""
        return join_unique(rows, table.withColumnRenamed("node_id", end), [end], how, hot=self.hot.withColumnRenamed("node_id", end))


def tie(a: str, b: str) -> Column:
    """A number for an unordered pair of nodes, the same in every engine."""
    low, high = F.least(a, b) % (1 << 31), F.greatest(a, b) % (1 << 31)
    return (low * 2654435761 % 4294967296 * 31 + high * 40503) % 4294967296


def proposals(edges: DataFrame) -> DataFrame:
    """(src, dst): the heaviest edge of each node, of equals the one with the largest tie number, then the least neighbour."""
    best = F.max_by("dst", F.struct("w", tie("src", "dst").alias("t"), (-F.col("dst")).alias("least")))
    return edges.groupBy("src").agg(best.alias("dst"))


def matches(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(a, b), a < b: the pairs that propose to each other."""
    with small_tasks(edges.sparkSession):
        to = keep(proposals(edges))
    back = to.select(F.col("src").alias("b"), F.col("dst").alias("a"))
    return to.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a < b").join(back, ["a", "b"])


def matching(level: Level, heaviest: int, rounds: int = 3) -> DataFrame:
    """(node_id, into): the node that each one becomes; no match is heavier than ``heaviest``."""
    weights = level.nodes.select("node_id", "w")
    free = level.beside(level.beside(level.edges, weights.withColumnRenamed("w", "sw"), "src"), weights.withColumnRenamed("w", "dw"), "dst")
    free = level.keep(free.where(F.col("sw") + F.col("dw") <= heaviest).select("src", "dst", "w"))
    pairs = []
    for _ in range(rounds):
        found = level.keep(matches(free, level.keep))
        pairs.append(found)
        taken = found.select(F.explode(F.array("a", "b")).alias("node_id")).withColumn("taken", F.lit(True))
        free = level.beside(level.beside(free, taken, "src", "left").where("taken is null").drop("taken"), taken, "dst", "left").where("taken is null").drop("taken")
        free = level.keep(free)
    into = pairs[0]
    for more in pairs[1:]:
        into = into.unionByName(more)
    into = level.keep(into.select(F.explode(F.array(F.struct(F.col("a").alias("node_id"), F.col("a").alias("into")), F.struct(F.col("b").alias("node_id"), F.col("a").alias("into")))).alias("m")).select("m.*"))
    # The others go with others at their heaviest neighbour, or with others that have none.
    rest = level.nodes.join(into, "node_id", "left_anti").where(F.col("w") * TOGETHER <= heaviest)
    rest = level.keep(rest.join(proposals(level.edges).withColumnsRenamed({"src": "node_id", "dst": "at"}), "node_id", "left").select("node_id", F.coalesce("at", F.lit(-1)).alias("at")))
    counts = level.keep(rest.groupBy("at").agg(F.count("*").alias("n")))
    slot = F.pmod(F.xxhash64("node_id"), F.ceil(F.col("n") / TOGETHER)).alias("slot")
    rest = level.keep(join_unique(rest, counts, ["at"], hot=level.keep(hot_keys(counts, ["at"]))).select("node_id", "at", slot))
    least = rest.groupBy("at", "slot").agg(F.min("node_id").alias("into"))
    into = into.unionByName(rest.join(least, ["at", "slot"]).select("node_id", "into"))
    return level.keep(level.nodes.join(into, "node_id", "left").select("node_id", F.coalesce("into", "node_id").alias("into")))


def contracted(level: Level, into: DataFrame) -> Level:
    """The graph of the groups: weights of nodes and of edges between two groups are summed."""
    nodes = level.nodes.join(into, "node_id").groupBy(F.col("into").alias("node_id")).agg(F.sum("w").alias("w"))
    ends = level.beside(level.edges, into.withColumnRenamed("into", "a"), "src")
    ends = level.beside(ends, into.withColumnRenamed("into", "b"), "dst").where("a <> b")
    return Level.of(nodes, ends.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), level.keep)


# The coarsest graph, in one task


def neighbourhoods(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(neighbours, weights) of each node, as views into one sorted copy of the edges."""
    by = np.lexsort((dst, src))
    src, dst, w = src[by], dst[by], w[by]
    bounds = np.searchsorted(src, np.arange(n + 1))
    return [(dst[a:b], w[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def grown(weights: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]], k: int, seed: int) -> np.ndarray:
    """Parts one after another: each takes what it has most edges to, until it has its share of the weight that is left."""
    rng = np.random.default_rng(seed)
    part, left, order = np.full(len(weights), -1), float(weights.sum()), rng.permutation(len(weights))
    pull = np.zeros(len(weights))
    for p in range(k - 1):
        share, own, heap, at = left / (k - p), 0.0, [], 0
        pull[:] = 0
        while own < share:
            while heap and (part[heap[0][1]] >= 0 or -heap[0][0] != pull[heap[0][1]]):
                heapq.heappop(heap)
            if heap:
                u = heapq.heappop(heap)[1]
            else:
                while at < len(order) and part[order[at]] >= 0:
                    at += 1
                if at == len(order):
                    break
                u = int(order[at])
            if own and own + weights[u] / 2 > share:
                break
            part[u] = p
            own += weights[u]
            for v, w in zip(*near[u], strict=True):
                if part[v] < 0:
                    pull[v] += w
                    heapq.heappush(heap, (-pull[v], int(v)))
        left -= own
    part[part < 0] = k - 1
    return part


def moved(weights: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]], part: np.ndarray, k: int, room: float, passes: int = 6) -> tuple[float, np.ndarray]:
    """(cut, parts): passes in which each node moves once at most, the best move first, back to the best state of the pass."""
    n = len(weights)
    links = np.zeros((n, k))
    for u, (v, w) in enumerate(near):
        np.add.at(links[u], part[v], w)
    load = np.bincount(part, weights, k).astype(float)
    total = sum(float(w.sum()) for _, w in near)
    rows = np.arange(n)
    lost = (total - float(links[rows, part].sum())) / 2
    for _ in range(passes):
        begin, best, at, free = lost, lost, 0, np.ones(n, bool)
        done: list[tuple[int, int]] = []
        over = load.max() > room
        while True:
            gain = links - links[rows, part][:, None]
            gain[~free] = -np.inf
            gain[rows, part] = -np.inf
            fits = load[None, :] + weights[:, None] <= room
            lighter = over & (load[part][:, None] > room) & (load[None, :] + weights[:, None] < load[part][:, None])
            gain[~(fits | lighter)] = -np.inf
            flat = int(np.argmax(gain))
            u, p = divmod(flat, k)
            if gain[u, p] == -np.inf or len(done) - at > 64 + n // 8:
                break
            q = int(part[u])
            lost -= gain[u, p]
            load[q] -= weights[u]
            load[p] += weights[u]
            part[u], free[u] = p, False
            v, w = near[u]
            np.add.at(links, (v, np.full(len(v), q)), -w)
            np.add.at(links, (v, np.full(len(v), p)), w)
            done.append((u, q))
            if (load.max() <= room and over) or (lost < best and load.max() <= max(room, load.max() if over else 0)):
                best, at, over = lost, len(done), bool(load.max() > room)
        for u, q in reversed(done[at:]):
            p = int(part[u])
            load[p] -= weights[u]
            load[q] += weights[u]
            part[u] = q
            v, w = near[u]
            np.add.at(links, (v, np.full(len(v), p)), -w)
            np.add.at(links, (v, np.full(len(v), q)), w)
        lost = best
        if best >= begin:
            break
    return lost, part


def coarse_parts(level: Level, k: int, room: float, tries: int = 4) -> DataFrame:
    """(node_id, part_id) of a graph of a bounded number of nodes: the best of some tries."""

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        ids, weights = nodes.column("node_id").to_numpy(), nodes.column("w").to_numpy().astype(float)
        order = np.argsort(ids)
        ids, weights = ids[order], weights[order]
        src, dst, w = np.searchsorted(ids, edges.column("src").to_numpy()), np.searchsorted(ids, edges.column("dst").to_numpy()), edges.column("w").to_numpy().astype(float)
        near = neighbourhoods(len(ids), src, dst, w)
        states = [moved(weights, near, grown(weights, near, k, seed), k, room) for seed in range(tries)]
        best = min(states, key=lambda s: (max(np.bincount(s[1], weights, k).max(), room), s[0]))[1]
        return pa.table({"node_id": ids, "part_id": pa.array(best, pa.int32())})

    one = F.lit(0).alias("one")
    return level.nodes.groupBy(one).cogroup(level.edges.groupBy(one)).applyInArrow(run, "node_id long, part_id int")


# On the way back


def refined(level: Level, parts: DataFrame, k: int, room: int, rounds: int = 4) -> DataFrame:
    """Parts after rounds of moves, an independent set of them in each."""
    for number in range(rounds):
        links = level.beside(level.edges, parts, "dst").groupBy("src", "part_id").agg(F.sum("w").alias("c"))
        own = parts.select(F.col("node_id").alias("src"), F.col("part_id").alias("own"))
        best = links.join(own, "src").groupBy("src", "own").agg(
            F.coalesce(F.max(F.when(F.col("part_id") == F.col("own"), F.col("c"))), F.lit(0)).alias("inside"),
            F.max(F.when(F.col("part_id") != F.col("own"), F.struct("c", (-F.col("part_id")).alias("p")))).alias("to"),
        )
        wish = best.where("to.c > inside").select(F.col("src").alias("node_id"), "own", (-F.col("to.p")).alias("to"), (F.col("to.c") - F.col("inside")).alias("gain"))
        wish = level.keep(wish.join(level.nodes, "node_id").withColumn("turn", F.xxhash64("node_id", F.lit(number))))
        loads = {r["part_id"]: r["w"] for r in parts.join(level.nodes, "node_id").groupBy("part_id").agg(F.sum("w").alias("w")).collect()}  # a row a part
        # Of neighbours that wish to move, the one with the larger gain does.
        prior = F.struct("gain", "turn", "node_id")
        near = level.beside(level.edges.select("src", "dst"), wish.select("node_id", prior.alias("a")), "src")
        near = level.beside(near, wish.select("node_id", prior.alias("b")), "dst").where("b > a").select(F.col("src").alias("node_id")).distinct()
        wish = level.keep(wish.join(near, "node_id", "left_anti"))
        # A part takes the largest gains first, by powers of two, as long as it has room; of the power that is too many, a share.
        power = F.floor(F.log2("gain")).cast("int")
        sizes = wish.groupBy("to", power.alias("power")).agg(F.sum("w").alias("w")).orderBy("to", F.desc("power")).collect()  # some 60 rows a part at most
        taken, left = [], {}
        for r in sizes:
            space = left.setdefault(r["to"], room - loads.get(r["to"], 0))
            share = 1.0 if r["w"] <= space else max(0.0, space / r["w"] - 0.05)
            left[r["to"]] = space - r["w"] if share == 1.0 else 0
            taken.append((r["to"], r["power"], share))
        if not any(share for *_, share in taken):
            break
        shares = level.nodes.sparkSession.createDataFrame(taken, "to int, power int, share double")
        draw = F.pmod(F.xxhash64("turn"), F.lit(1 << 20)) / float(1 << 20)
        moves = wish.withColumn("power", power).join(F.broadcast(shares), ["to", "power"]).where(draw < F.col("share")).select("node_id", "to")
        parts = level.keep(parts.join(moves, "node_id", "left").select("node_id", F.coalesce("to", "part_id").cast("int").alias("part_id")))
    return parts


def first_level(graph: Graph, keep: Callable[[DataFrame], DataFrame] = cut) -> Level:
    """The graph without directions and loops; an edge weighs as many as there are between its ends."""
    edges = both_directions(graph.edges.where("src <> dst")).groupBy("src", "dst").agg(F.count("*").alias("w"))
    with small_tasks(edges.sparkSession):
        return Level.of(graph.nodes.select("node_id", F.lit(1).cast("long").alias("w")), edges, keep)


def multilevel_parts(graph: Graph, k: int, imbalance: float = 0.03, rounds: int = 4, levels: list[int] | None = None) -> DataFrame:
    """(node_id, part_id): k parts, none larger than its even share by more than ``imbalance`` as far as it can be; ``levels`` gets the number of nodes at each level."""
    scratch = Scratch(graph.nodes.sparkSession, "multilevel")
    found, ups = [first_level(graph, scratch.keep)], []
    total, bound = found[0].n, max(COARSEST, COARSEST_A_PART * k)
    heaviest = max(2 * TOGETHER, int(1.5 * total / bound) + 1)
    while found[-1].n > bound:
        into = matching(found[-1], heaviest)
        coarser = contracted(found[-1], into)
        if coarser.n > 0.9 * found[-1].n:  # little fits together any more
            heaviest *= 2
        if coarser.n < found[-1].n:
            ups.append(into)
            found.append(coarser)
    room = int(np.ceil((1 + imbalance) * total / k))
    if levels is not None:
        levels.extend(x.n for x in found)
    parts = scratch.keep(coarse_parts(found[-1], k, room))
    for level, into in zip(reversed(found[:-1]), reversed(ups), strict=True):
        parts = scratch.keep(into.join(parts.withColumnRenamed("node_id", "into"), "into").select("node_id", "part_id"))
        parts = refined(level, parts, k, room, rounds)
    parts = cut(parts)
    scratch.clear()
    return parts
