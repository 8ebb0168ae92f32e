"""Independent swaps: exact effects, a rate that never falls, and a state that logs keep right."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.common import Scratch, cut
from weftgraph.graph import Graph
from weftgraph.operators import batches, partitioning
from weftgraph.sources.fixtures import simple_graph


def sizes_of(edges, parts):
    """The dependencies of each part by definition."""
    found = {p: set() for p in parts.values()}
    for u, v in edges:
        for a, b in ((u, v), (v, u)):
            if a != b and parts[a] != parts[b]:
                found[parts[a]].add(b)
    return {p: len(x) for p, x in found.items()}


def made(spark, seed, n=60, m=150, k=4):
    rng = random.Random(seed)
    edges = sorted({(int(n * rng.random() ** 2), rng.randrange(n)) for _ in range(m)})
    parts = {i: min(k - 1, i * k // n) for i in range(n)}
    graph = Graph(spark.range(n).withColumnRenamed("id", "node_id"), spark.createDataFrame(edges, "src long, dst long"))
    return edges, parts, graph, spark.createDataFrame(list(parts.items()), "node_id long, part_id int")


@pytest.mark.parametrize("seed", [1, 2])
def test_effects_are_exact_and_the_log_keeps_the_state(spark, seed):
    edges, parts, graph, frame = made(spark, seed)
    state = batches.State.of(graph, frame, Scratch(spark, "test"))
    for number in range(2):
        sizes = sizes_of(edges, parts)
        order = sorted(sizes, key=lambda p: (sizes[p], p))
        pairs = [(order[-1], order[0]), (order[-2], order[1])]
        picked = cut(batches.candidates(state.nodes_now(), pairs))
        e = batches.effects(state, state.nodes_now(), picked)
        for pair, (ps, pt) in enumerate(pairs):
            mine = [k for p, k in e.single if p == pair]
            for u in (x for x in mine if parts[x] == ps):
                for v in (x for x in mine if parts[x] == pt):
                    after = sizes_of(edges, parts | {u: pt, v: ps})
                    assert batches.change(e, pair, u, v) == (after[ps] - sizes[ps], after[pt] - sizes[pt])
        moves = []
        for pair, (ps, pt) in enumerate(pairs):
            found = batches.chosen(e, pair, (sizes[ps], sizes[pt]))
            for u, v, _, _ in found:
                moves += [(u, ps, pt, e.gains[u]), (v, pt, ps, e.gains[v])]
            after = sizes_of(edges, parts | {u: pt for u, *_ in found} | {v: ps for _, v, *_ in found})
            assert (after[ps], after[pt]) == (sizes[ps] + sum(f[2] for f in found), sizes[pt] + sum(f[3] for f in found))
        assert moves
        state.passes = number
        batches.apply_moves(state, moves)
        parts |= {m: to for m, _, to, _ in moves}
        fresh = batches.State.of(graph, spark.createDataFrame(list(parts.items()), "node_id long, part_id int"), Scratch(spark, "test"))
        rows = lambda s: sorted(tuple(r) for r in s.nodes_now().select("node_id", "own", "gain", "deg").collect())
        assert rows(state) == rows(fresh)
        if number:
            state.compact()
            counts = lambda s: sorted(tuple(r) for r in s.counts.select("part_id", "node_id", "cnt").collect())
            assert rows(state) == rows(fresh) and counts(state) == counts(fresh)


def test_the_rate_never_falls_below_single_swaps(spark):
    toy = simple_graph(spark)
    toy = Graph(toy.nodes.select("node_id"), toy.edges)
    for graph, k in ((toy, 2), (made(spark, 5)[2], 4)):
        parts = cut(partitioning.chunk_parts(graph.nodes, k))
        log: list[dict] = []
        mine = batches.refine_batches(graph, parts, log=log)
        rates = [r["rate"] for r in log]
        assert rates == sorted(rates)
        single = partitioning.refine(graph, parts, max_iter=12) if k == 4 else partitioning.refine(graph, parts)
        edges = [(r["src"], r["dst"]) for r in graph.edges.collect()]
        rate = {}
        for name, p in (("mine", mine), ("single", single), ("before", parts)):
            s = sizes_of(edges, {r["node_id"]: r["part_id"] for r in p.collect()})
            rate[name] = min(s.values()) / max(s.values())
        assert rate["mine"] >= max(rate["single"], rate["before"])
        if log:
            assert rate["mine"] == rates[-1] and log[-1]["bases"] <= 1 + len(log) / 10
        count = lambda p: sorted((r["part_id"], r["count"]) for r in p.groupBy("part_id").count().collect())
        assert count(mine) == count(parts)


def test_the_base_is_written_every_tenth_pass(spark, monkeypatch):
    monkeypatch.setattr(batches, "PASSES_A_BASE", 2), monkeypatch.setattr(batches, "SWAPS", 1)
    _, _, graph, frame = made(spark, 7)
    log: list[dict] = []
    batches.refine_batches(graph, frame, max_passes=3, log=log)
    assert len(log) >= 2 and log[-1]["bases"] == 1 + len(log) // 2


def test_parts_without_dependencies(spark):
    graph = Graph(spark.range(8).withColumnRenamed("id", "node_id"), spark.createDataFrame([(0, 1), (4, 5)], "src long, dst long"))
    parts = partitioning.chunk_parts(graph.nodes, 2)
    assert batches.refine_batches(graph, parts).where(F.col("part_id") == 1).count() == 4


def test_single_swaps_follow_the_rule_and_read_what_lies_around(spark, monkeypatch):
    """Each iteration against the rule by definition, over a base written anew after two."""
    monkeypatch.setattr(partitioning, "PASSES_A_BASE", 2)
    edges, parts, graph, frame = made(spark, 3)
    near = {x: {b for u, v in edges for a, b in ((u, v), (v, u)) if a == x != b} for x in parts}
    log: list[dict] = []
    with pytest.warns(UserWarning):
        got = partitioning.refine(graph, frame, max_iter=3, log=log)
    for row in log:
        sizes = sizes_of(edges, parts)
        ps, pt = max((n, p) for p, n in sizes.items())[1], min((n, p) for p, n in sizes.items())[1]
        members = lambda p: [x for x in parts if parts[x] == p]  # noqa: B023, E731
        single = {x for x in parts if parts[x] != ps and sum(parts[y] == ps for y in near[x]) == 1}
        ns, nt = min(members(ps), key=lambda x: (-len(near[x] & single), x)), min(members(pt), key=lambda x: (len(near[x]), x))
        parts |= {ns: pt, nt: ps}
        sizes = sizes_of(edges, parts)
        assert (row["ps"], row["pt"], row["least"], row["most"]) == (ps, pt, min(sizes.values()), max(sizes.values()))
    assert len(log) == 3 and {r["node_id"]: r["part_id"] for r in got.collect()} == parts
