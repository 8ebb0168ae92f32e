"""Hops over pairs: the same results as over both directions of them, and one shuffle of edges."""

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph, both_directions
from weftgraph.operators import aggregate as agg

PAIRS = [(a, 40 + (a * 7 + b) % 9) for a in range(30) for b in range(a % 5)] + [(1, 41), (1, 41), (2, 999), (33, 42)]


@pytest.fixture
def graph(spark):
    """Pairs that repeat or have ends that are no nodes; nodes without edges."""
    nodes = spark.createDataFrame([(i, [float(i), float(i * i % 11)]) for i in [*range(32), *range(40, 52)]], "node_id long, x array<double>")
    pairs = spark.createDataFrame(PAIRS, "src long, dst long")
    return Graph(nodes, both_directions(pairs.distinct()), pairs)


@pytest.mark.parametrize("hashed", [(True, True), (True, False), (False, False)])
def test_hops_over_pairs_give_what_edges_give(spark, graph, hashed):
    pairs = agg.dealt(graph.pairs, graph.nodes, 2)
    reach = agg.Reach(None, hashed[0], agg.Pairs(pairs.rows, pairs.block, pairs.n, hashed))
    assert sorted(map(tuple, pairs.edges.collect())) == sorted(map(tuple, graph.edges.collect()))
    degrees, long = graph.degrees(), graph.nodes.select("node_id", F.posexplode("x").alias("j", "v"))
    hops = [
        lambda r: agg.neighbour_mean(graph.nodes, graph.edges, 2, r),
        lambda r: agg.neighbour_max(graph.nodes, graph.edges, 2, r),
        lambda r: agg.self_and_neighbour_mean(graph.nodes, graph.edges, 2, r),
        lambda r: agg.degree_normalised_sum(graph.nodes, graph.edges, degrees, 2, False, r),
        lambda r: agg.degree_normalised_sum(graph.nodes, graph.edges, degrees, 2, True, r),
        lambda r: agg.neighbour_mean_long(long, graph.edges, r),
    ]
    for hop in hops:
        got, want = (sorted((tuple([*r[:-1], *[round(v, 9) for v in (r[-1] if isinstance(r[-1], list) else [r[-1]])]]) for r in hop(reach_).collect()), key=str) for reach_ in (reach, agg.Reach()))
        assert got == want and got


def test_pairs_serve_only_where_their_ends_lie_apart(spark, graph):
    for more in [(45, 5), (None, 41), (3, None)]:
        assert agg.dealt(graph.pairs.unionByName(spark.createDataFrame([more], "src long, dst long")), graph.nodes, 2) is None
    assert agg.dealt(graph.pairs.where("src < 0"), graph.nodes, 2) is None


def test_edges_are_shuffled_once(spark, graph, tmp_path):
    """Before, distinct pairs were shuffled by their ends, and both directions of them once more by their sources."""
    graph.pairs.write.parquet(f"{tmp_path}/pairs")
    graph.nodes.write.parquet(f"{tmp_path}/nodes")
    pairs, nodes = spark.read.parquet(f"{tmp_path}/pairs"), spark.read.parquet(f"{tmp_path}/nodes")
    frame = agg.neighbour_mean(nodes, both_directions(pairs.distinct()), 2, agg.Reach(None, True, agg.dealt(pairs, nodes, 2)))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    made = [line for line in plan[: plan.index("Initial Plan")].splitlines() if "ReusedExchange" in line]
    assert len(made) >= 3  # the pairs twice, and vectors once, are read again


def test_many_vectors_get_more_partitions(graph, monkeypatch):
    """So that a partition's vectors stay a hash table, and edges are not sorted on disk."""
    monkeypatch.setattr(agg, "HASH_BYTES", 200)
    pairs = agg.dealt(graph.pairs, graph.nodes, 2)
    assert pairs.n == 13 and pairs.rows.rdd.getNumPartitions() == 13 and pairs.hashed == (True, False)
