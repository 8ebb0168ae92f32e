"""Balancing dependencies by many independent swaps a pass.

Parts go in pairs, the most dependent with the least dependent one, the second
with the second last and so on. Swaps of different pairs change nothing for
each other. Within a pair a bounded number of candidates is tried in all
combinations, each with its exact effect on both parts' dependencies, and swaps
are taken that share no neighbour and are not neighbours, so their effects add
up. A pair's larger number never grows and its smaller one never falls, so the
balance rate never falls.

The state is a base, each part's counts and each node's part and gain, and a
log of what changed around swapped nodes. A pass reads the base for its
candidates' neighbours and adds to the log; the base is written anew every
tenth pass at most.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.common import Scratch, cut, few
from weftgraph.graph import Graph
from weftgraph.operators.dependence import State, apply_moves, dependencies, dependency_sizes

#: Candidates of a part by each of two orders, swaps of a pair in a pass, and passes from one base to the next.
CANDIDATES, SWAPS, PASSES_A_BASE = 8, 8, 10


def candidates(nodes: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(node_id, own, other, pair, gives, gain): of each pair's more dependent part the largest gains and degrees, of the other the least degrees and gains."""
    spark = nodes.sparkSession
    roles = [r for k, (ps, pt) in enumerate(pairs) for r in ((ps, pt, k, True), (pt, ps, k, False))]
    rows = nodes.join(F.broadcast(few(spark, roles, own="int", other="int", pair="int", gives="boolean")), "own")  # a row for each part
    picked = []
    for gives, orders in ((True, (F.desc("gain"), F.desc("deg"))), (False, (F.asc("deg"), F.asc("gain")))):
        for order in orders:
            rank = F.row_number().over(Window.partitionBy("own").orderBy(order, "node_id"))  # limited within tasks first
            picked.append(rows.where(F.col("gives") == gives).withColumn("rank", rank).where(F.col("rank") <= CANDIDATES).drop("rank", "deg"))
    return reduce(DataFrame.unionByName, picked).distinct()


@dataclass
class Effects:
    """What the moves of single candidates change, and what two of them share, by pair of parts."""

    single: dict[tuple[int, int], dict]
    shared: dict[tuple[int, int, int], dict]
    adjacent: dict[tuple[int, int, int], dict]
    gains: dict[int, int]


def effects(state: State, nodes: DataFrame, picked: DataFrame) -> Effects:
    """Of candidates, whose number is bounded by that of the parts."""
    x_own = nodes.select(F.col("node_id").alias("x"), F.col("own").alias("xo"))
    near = state.edges.join(F.broadcast(picked), F.col("src") == F.col("node_id")).select("pair", "node_id", "own", "other", "gives", F.col("dst").alias("x"))
    near = state.scratch.keep(near.join(x_own, "x"))
    keys = near.select(F.explode(F.array("own", "other")).alias("part_id"), F.col("x").alias("node_id")).distinct()
    counts = state.scratch.keep(state.counts_of(state.scratch.keep(keys)))
    at = lambda c: counts.select(F.col("part_id").alias(c), F.col("node_id").alias("x"), F.col("cnt").alias(f"{c}_cnt"))
    near = near.join(at("own"), ["own", "x"], "left").join(at("other"), ["other", "x"], "left").fillna(0, ["own_cnt", "other_cnt"])
    leave = ((F.col("xo") != F.col("own")) & (F.col("own_cnt") == 1)).cast("int").alias("leave")
    enter = ((F.col("xo") != F.col("other")) & (F.col("other_cnt") == 0)).cast("int").alias("enter")
    near = state.scratch.keep(near.select("pair", "node_id", "x", leave, enter, (F.col("xo") == F.col("own")).cast("int").alias("inside"), (F.col("xo") == F.col("other")).cast("int").alias("touch")))
    sums = near.groupBy("pair", "node_id").agg(*(F.sum(c).alias(c) for c in ("leave", "enter", "inside", "touch")))
    single = {(r["pair"], r["node_id"]): r.asDict() for r in picked.select("pair", "node_id", "gives").join(sums, ["pair", "node_id"], "left").fillna(0).collect()}
    a, b = (near.select("pair", "x", F.col("node_id").alias(s), F.col("leave").alias(f"leave_{s}"), F.col("enter").alias(f"enter_{s}")) for s in "ab")
    both = a.join(b, ["pair", "x"]).where("a < b")  # the candidates of a pair that share a neighbour: a bounded number
    both = both.groupBy("pair", "a", "b").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("leave_a", "enter_a", "leave_b", "enter_b")))
    shared = {(r["pair"], r["a"], r["b"]): r.asDict() for r in both.collect()}
    beside = near.join(F.broadcast(picked.select("pair", F.col("node_id").alias("x"))), ["pair", "x"])
    adjacent = {(r["pair"], r["node_id"], r["x"]): r.asDict() for r in beside.collect()}
    gains = {r["node_id"]: r["gain"] for r in picked.select("node_id", "gain").collect()}
    return Effects(single, shared, adjacent, gains)


def change(e: Effects, pair: int, u: int, v: int) -> tuple[int, int]:
    """What swapping u, of the part that gives, and v does to the dependencies of u's part and of v's."""
    a, b = e.single[pair, u], e.single[pair, v]
    both = e.shared.get((pair, min(u, v), max(u, v)))
    less = lambda kind, node: both[f"{kind}_{'a' if node < (v if node == u else u) else 'b'}"] if both else 0
    linked = (pair, u, v) in e.adjacent
    beyond = lambda node, other: e.adjacent[pair, node, other]["leave"] if linked else 0
    at_u = -(a["leave"] - less("leave", u) - beyond(u, v)) + (a["inside"] + linked > 0) + b["enter"] - less("enter", v) - (b["touch"] > 0)
    at_v = -(b["leave"] - less("leave", v) - beyond(v, u)) + (b["inside"] + linked > 0) + a["enter"] - less("enter", u) - (a["touch"] > 0)
    return at_u, at_v


def chosen(e: Effects, pair: int, n: tuple[int, int], most: int = SWAPS) -> list[tuple[int, int, int, int]]:
    """(u, v, change at u's part, change at v's) of independent swaps, each the one that brings the two numbers closest."""
    nodes = [k for p, k in e.single if p == pair]
    give, take = [k for k in nodes if e.single[pair, k]["gives"]], [k for k in nodes if not e.single[pair, k]["gives"]]
    tried = {(u, v): change(e, pair, u, v) for u in give for v in take}
    apart = lambda x, y: x != y and (pair, min(x, y), max(x, y)) not in e.shared and (pair, x, y) not in e.adjacent
    out: list[tuple[int, int, int, int]] = []
    high, low = n
    while tried and len(out) < most:
        now = {k: (high + d, low + f) for k, (d, f) in tried.items() if max(high + d, low + f) <= high and min(high + d, low + f) >= low}
        if not now:
            break
        (u, v), (a, b) = min(now.items(), key=lambda x: (abs(x[1][0] - x[1][1]), sum(x[1]), x[0]))
        if (abs(a - b), a + b) >= (high - low, high + low):
            break
        out.append((u, v, a - high, b - low))
        high, low = a, b
        if high < low:
            break
        tried = {(p, q): d for (p, q), d in tried.items() if all(apart(s, t) for s in (p, q) for t in (u, v))}
    return out


def refine_batches(graph: Graph, parts: DataFrame, max_passes: int | None = None, log: list[dict] | None = None) -> DataFrame:
    """(node_id, part_id) after passes of independent swaps, until no pair of parts has one that brings it closer; part sizes stay.

    ``log`` gets a row a pass: pass, swaps, rate, least, most, and how many
    times the state has been written whole.
    """
    scratch = Scratch(graph.edges.sparkSession, "batches")
    state = State.of(graph, parts, scratch)
    own = state.nodes.select("node_id", F.col("own").alias("part_id"))
    sizes = {r["part_id"]: r["n"] for r in dependency_sizes(dependencies(state.counts, own), own).collect()}  # a row for each part
    for number in itertools.count():
        order = sorted(sizes, key=lambda p: (sizes[p], p))
        pairs = [(order[-1 - i], order[i]) for i in range(len(order) // 2) if sizes[order[-1 - i]] > sizes[order[i]]]
        if not pairs or number == max_passes:
            break
        nodes = state.nodes_now()
        picked = scratch.keep(candidates(nodes, pairs))
        e, moves, state.passes = effects(state, nodes, picked), [], number
        for k, (ps, pt) in enumerate(pairs):
            for u, v, d_ps, d_pt in chosen(e, k, (sizes[ps], sizes[pt])):
                moves += [(u, ps, pt, e.gains[u]), (v, pt, ps, e.gains[v])]
                sizes[ps], sizes[pt] = sizes[ps] + d_ps, sizes[pt] + d_pt
        if not moves:
            break
        apply_moves(state, moves)
        if len(state.count_log) == PASSES_A_BASE:
            state.compact()
        if log is not None:
            log.append({"pass": number, "swaps": len(moves) // 2, "rate": min(sizes.values()) / max(sizes.values()), "least": min(sizes.values()), "most": max(sizes.values()), "bases": state.bases})
    last = cut(state.nodes_now().select("node_id", F.col("own").alias("part_id")))
    scratch.clear()
    return last
