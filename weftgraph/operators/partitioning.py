"""Assigning nodes to parts, and refining an assignment by swaps.

``multilevel`` lowers the cut; ``grown_parts`` is a quicker choice without a
promise: labels spread along edges, and nodes sorted by label are then cut into
even chunks. An assignment made elsewhere can be read instead.
"""

from __future__ import annotations

import itertools
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.common import Scratch, cut, few, ranked
from weftgraph.graph import Graph, both_directions
from weftgraph.operators.dependence import State, apply_moves, dependencies, dependency_sizes, member_counts
from weftgraph.operators.multilevel import multilevel_parts

__all__ = ["PARTITIONERS", "balance_rate", "choose_swap", "chunk_parts", "dependencies", "dependency_sizes", "edge_cut", "grown_parts", "hashed_parts", "member_counts", "partition", "random_parts", "refine", "swap_counts", "swapped"]

#: Iterations of swaps from one base of the state to the next.
PASSES_A_BASE = 10


def random_parts(nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return nodes.select("node_id", F.least(F.floor(F.rand(seed) * k), F.lit(k - 1)).cast("int").alias("part_id"))


def hashed_parts(nodes: DataFrame, k: int) -> DataFrame:
    """Parts by an arithmetic hash of the id, the same in every engine."""
    return nodes.select("node_id", ((F.col("node_id") * 2654435761 % 4294967296) % k).cast("int").alias("part_id"))


def chunk_parts(nodes: DataFrame, k: int, n: int | Column | None = None) -> DataFrame:
    """Consecutive ids in k even chunks; n defaults to the number of nodes."""
    n = nodes.agg(F.count("*")).scalar() if n is None else F.lit(n) if isinstance(n, int) else n
    return nodes.select("node_id", F.least(F.floor(F.col("node_id") / (n / k)), F.lit(k - 1)).cast("int").alias("part_id"))


def grown_parts(graph: Graph, k: int, rounds: int = 5) -> DataFrame:
    """Even parts of nodes that took the same label from their neighbours; a node's own label has a vote too, or two ends of a star would swap theirs for ever."""
    labels = cut(graph.nodes.select("node_id", F.col("node_id").alias("label")))
    edges = both_directions(graph.edges.where("src <> dst")).distinct()
    edges = cut(edges.unionByName(graph.nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))))
    for _ in range(rounds):
        votes = edges.join(labels.withColumnRenamed("node_id", "src"), "src").groupBy("dst", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("dst").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("best"))
        labels = cut(labels.join(best, F.col("node_id") == F.col("dst"), "left").select("node_id", F.coalesce("best", "label").alias("label")))
    return _even(labels, k)


def _even(labels: DataFrame, k: int) -> DataFrame:
    """Nodes in the order of (label, node_id), in k even chunks."""
    rank = ranked(labels, "label", "node_id")
    n = rank.agg(F.count("*")).scalar()
    return rank.select("node_id", F.least(F.floor(F.col("rank") * k / n), F.lit(k - 1)).cast("int").alias("part_id"))


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row (n_edges, n_cut, n_remote, largest): edges, those between parts, nodes that a part needs from another, and the largest part."""
    end = lambda c: parts.select(F.col("node_id").alias(c), F.col("part_id").alias(f"{c}_part"))
    rows = edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst")
    needs = rows.where("src_part <> dst_part").select("dst_part", "src").distinct()
    counts = rows.agg(F.count("*").alias("n_edges"), F.count_if(F.col("src_part") != F.col("dst_part")).alias("n_cut"))
    return counts.withColumns({"n_remote": needs.agg(F.count("*")).scalar(), "largest": parts.groupBy("part_id").agg(F.count("*").alias("n")).agg(F.max("n")).scalar()})


PARTITIONERS = {
    "random": lambda graph, k, **o: random_parts(graph.nodes, k, **o),
    "hash": lambda graph, k, **o: hashed_parts(graph.nodes, k, **o),
    "chunk": lambda graph, k, **o: chunk_parts(graph.nodes, k, **o),
    "grown": lambda graph, k, **o: grown_parts(graph, k, **o),
    "multilevel": lambda graph, k, **o: multilevel_parts(graph, k, **o),
    "balanced": lambda graph, k, **o: refine(graph, grown_parts(graph, k), **o),
}


def partition(graph: Graph, k: int, method: str = "chunk", **options) -> DataFrame:
    return PARTITIONERS[method](graph, k, **options)


def balance_rate(sizes: DataFrame) -> DataFrame:
    """One row, rate: the smallest over the largest; null where no part depends on another."""
    return sizes.agg(F.try_divide(F.min("n"), F.max("n")).alias("rate"))


def choose_swap(edges: DataFrame, parts: DataFrame, counts: DataFrame, psd: str = "reference", most: int = 1) -> DataFrame:
    """(ps, pt, ns, nt): ns of the most dependent part goes for nt of the least dependent one; ``most`` rows at most.

    ns has the most neighbours on which ps depends through one member only,
    nt the fewest neighbours that count; equal ones go by id. What does not
    count for nt is empty by the rule as it stands (``reference``), or all
    that ps depends on or owns but the nodes freed by ns (``union``). Edges
    are distinct. Only the edges of the two parts' members are grouped.
    """
    return _choose(edges, parts, cut(dependencies(counts, parts)), psd, most)


def _choose(edges: DataFrame, parts: DataFrame, outside: DataFrame, psd: str, most: int) -> DataFrame:
    if psd not in ("reference", "union"):
        raise ValueError(psd)
    spark = edges.sparkSession
    kinds = "ps int, pt int, ns long, nt long"
    sizes = [(r["n"], r["part_id"]) for r in dependency_sizes(outside, parts).collect()]  # a row for each part
    if not sizes:
        return spark.createDataFrame([], kinds)
    ps, pt = max(sizes)[1], min(sizes)[1]
    members = lambda p: parts.where(F.col("part_id") == p).select("node_id")
    of = lambda p: edges.join(members(p).withColumnRenamed("node_id", "src"), "src", "left_semi")
    single = outside.where((F.col("part_id") == ps) & (F.col("cnt") == 1)).select(F.col("node_id").alias("dst"))
    gain = of(ps).join(single, "dst", "left_semi").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("gain"))
    best = members(ps).join(gain, "node_id", "left").fillna(0, ["gain"]).orderBy(F.desc("gain"), "node_id").limit(most)
    ns = [r["node_id"] for r in best.collect()]
    counted = of(pt)
    if psd == "union" and ns:
        freed = edges.where(F.col("src") == ns[0]).join(single, "dst", "left_semi").select(F.col("dst").alias("node_id"))
        near = outside.where(F.col("part_id") == ps).select("node_id").join(freed, "node_id", "left_anti")
        owned = members(ps).where(F.col("node_id") != ns[0])
        counted = counted.join(near.unionByName(owned).distinct().withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    cost = counted.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("cost"))
    least = members(pt).join(cost, "node_id", "left").fillna(0, ["cost"]).orderBy("cost", "node_id").limit(most)
    nt = [r["node_id"] for r in least.collect()]
    return spark.createDataFrame([(ps, pt, a, b) for a, b in zip(ns, nt, strict=False)], kinds)


def swapped(parts: DataFrame, ps, pt, ns, nt) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    part = F.when(F.col("node_id") == lit(ns), lit(pt)).when(F.col("node_id") == lit(nt), lit(ps)).otherwise(F.col("part_id"))
    return parts.select("node_id", part.cast("int").alias("part_id"))


def swap_counts(edges: DataFrame, counts: DataFrame, ps: int, pt: int, ns: int, nt: int) -> DataFrame:
    """The member counts after a swap: plus and minus one at the neighbours of the two nodes."""
    sign = lambda frm, to, x: edges.where(F.col("src") == x).select(F.col("dst").alias("node_id"), F.explode(F.array(F.struct(F.lit(frm).alias("part_id"), F.lit(-1).cast("long").alias("cnt")), F.struct(F.lit(to).alias("part_id"), F.lit(1).cast("long").alias("cnt")))).alias("d")).select("d.part_id", "node_id", "d.cnt")
    return counts.unionByName(sign(ps, pt, ns)).unionByName(sign(pt, ps, nt)).groupBy("part_id", "node_id").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def refine(graph: Graph, parts: DataFrame, max_iter: int | None = None, check_every: int = 10, keep_best: bool = False, psd: str = "reference", swaps: int = 1, log: list[dict] | None = None) -> DataFrame:
    """Swaps until the balance rate of the dependency sizes has not grown between two checks; part sizes stay.

    It always stops: the rate grows from check to check and is 1 at most. A
    ``max_iter`` that ends it before gives a warning. ``swaps`` pairs go at
    once in an iteration; the surveyed rule takes one. Each iteration adds a
    row to ``log``: iteration, ps, pt, how many were swapped, the rate, and
    the smallest and largest number of dependencies of a part.

    The state of ``dependence`` is carried from iteration to iteration: what
    the rule looks at, a member's gain and degree, is a column there and
    changes around the swapped nodes alone. The cost of ``union`` depends on
    the whole state, and is counted in each iteration. The assignment at the
    stop is returned, or the best seen.
    """
    scratch = Scratch(graph.edges.sparkSession, "refine")
    state = State.of(graph, parts, scratch)
    own = state.nodes.select("node_id", F.col("own").alias("part_id"))
    sizes = {r["part_id"]: r["n"] for r in dependency_sizes(dependencies(state.counts, own), own).collect()}  # a row for each part
    moved: list[list[tuple[int, int, int, int]]] = []
    last, best, best_rate = 0.0, 0, -1.0
    for i in itertools.count():
        if i == max_iter:
            warnings.warn(f"refine ended by max_iter={max_iter}, not by its stop rule", stacklevel=2)
            break
        order = [(n, p) for p, n in sizes.items()]
        if not order or max(order)[1] == min(order)[1]:
            break
        ps, pt = max(order)[1], min(order)[1]
        nodes = state.nodes_now()
        give = nodes.where(F.col("own") == ps).orderBy(F.desc("gain"), "node_id").limit(swaps).collect()
        if psd == "reference":
            take = nodes.where(F.col("own") == pt).orderBy("deg", "node_id").limit(swaps).collect()
        else:
            now = scratch.keep(nodes.select("node_id", F.col("own").alias("part_id")))
            rows = _choose(state.edges, now, scratch.keep(dependencies(state.counts_now(), now)), psd, swaps).collect()
            ids = {r["nt"]: at for at, r in enumerate(rows)}
            take = sorted(nodes.where(F.col("node_id").isin(list(ids))).collect(), key=lambda r: ids[r["node_id"]])
        moves = [m for a, b in zip(give, take, strict=False) for m in ((a["node_id"], ps, pt, a["gain"]), (b["node_id"], pt, ps, b["gain"]))]
        if not moves:
            break
        state.passes = i
        for p, n in apply_moves(state, moves).items():
            sizes[p] += n
        moved.append(moves)
        if len(state.count_log) == PASSES_A_BASE:
            state.compact()
        least, most = min(sizes.values()), max(sizes.values())
        rate = least / most if most else 0.0
        if log is not None:
            log.append({"iteration": i, "ps": ps, "pt": pt, "swapped": len(moves) // 2, "rate": rate, "least": least, "most": most})
        if rate > best_rate:
            best, best_rate = len(moved), rate
        if i % check_every == 0:
            if rate <= last:
                break
            last = rate
    to = {m: t for moves in moved[: best if keep_best else len(moved)] for m, _, t, _ in moves}  # two for each swap
    if to:
        own = own.join(F.broadcast(few(scratch.spark, list(to.items()), node_id="long", to="int")), "node_id", "left").select("node_id", F.coalesce("to", "part_id").alias("part_id"))
    out = cut(own)
    scratch.clear()
    return out
