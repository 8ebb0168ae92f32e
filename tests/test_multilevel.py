"""The multilevel partitioner: valid matches, weights that stay, parts within their room, and fewer cut edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph import common
from weftgraph.common import cut
from weftgraph.graph import Graph
from weftgraph.operators import multilevel, partitioning
from weftgraph.sources.fixtures import karate


def clustered(spark, groups=24, size=20):
    """Rings of dense groups with single edges between them."""
    n = groups * size
    ids = spark.range(n).select(F.col("id").alias("node_id"))
    inside = ids.select(F.col("node_id").alias("src"), F.explode(F.array(*(F.lit(d) for d in (1, 2, 3, 5)))).alias("d"))
    inside = inside.select("src", (F.floor(F.col("src") / size) * size + (F.col("src") % size + F.col("d")) % size).alias("dst"))
    between = spark.range(groups).select((F.col("id") * size).alias("src"), ((F.col("id") + 1) % groups * size).alias("dst"))
    return Graph(cut(ids), cut(inside.unionByName(between)))


def test_matches_are_mutual_and_disjoint(spark):
    graph = clustered(spark)
    level = multilevel.first_level(graph)
    found = [(r["a"], r["b"]) for r in multilevel.matches(level.edges).collect()]
    ends = [x for pair in found for x in pair]
    assert found and len(set(ends)) == len(ends)
    edges = {(r["src"], r["dst"]): r["w"] for r in level.edges.collect()}
    assert all(pair in edges for pair in found)


def test_contraction_keeps_weights(spark):
    graph = clustered(spark)
    level = multilevel.first_level(graph)
    into = multilevel.matching(level, 8)
    assert into.count() == level.n and into.select("node_id").distinct().count() == level.n
    coarser = multilevel.contracted(level, into)
    assert coarser.n < 0.7 * level.n and coarser.nodes.agg(F.sum("w")).first()[0] == level.n and coarser.nodes.agg(F.max("w")).first()[0] <= 12
    of = {r["node_id"]: r["into"] for r in into.collect()}
    crossing = sum(r["w"] for r in level.edges.collect() if of[r["src"]] != of[r["dst"]])
    assert coarser.edges.agg(F.sum("w")).first()[0] == crossing


def test_leaves_of_a_star_come_together(spark):
    n = 300
    star = Graph(spark.range(n).withColumnRenamed("id", "node_id"), spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))
    level = multilevel.first_level(star)
    assert multilevel.contracted(level, multilevel.matching(level, 8)).n < 0.5 * n


def test_fewer_cut_edges_than_random_and_chunk(spark, monkeypatch):
    monkeypatch.setattr(multilevel, "COARSEST", 100)
    graph, levels = clustered(spark), []
    shuffled = Graph(graph.nodes.select((F.col("node_id") * 77 % 480).alias("node_id")), graph.edges.select((F.col("src") * 77 % 480).alias("src"), (F.col("dst") * 77 % 480).alias("dst")))
    parts = multilevel.multilevel_parts(shuffled, 4, levels=levels)
    assert len(levels) > 2 and levels[-1] <= 100
    sizes = [r["count"] for r in parts.groupBy("part_id").count().collect()]
    assert sum(sizes) == 480 and len(sizes) == 4 and max(sizes) <= 124
    own = partitioning.edge_cut(shuffled.edges, parts).first()["n_cut"]
    others = [partitioning.edge_cut(shuffled.edges, partitioning.partition(shuffled, 4, m)).first()["n_cut"] for m in ("hash", "chunk")]
    assert own < 0.1 * min(others)


def test_karate_and_odd_graphs(spark):
    graph = karate(spark)
    own, chunk = (partitioning.edge_cut(graph.edges, partitioning.partition(graph, 4, m)).first()["n_cut"] for m in ("multilevel", "chunk"))
    assert own < chunk
    alone = Graph(spark.range(10).withColumnRenamed("id", "node_id"), spark.createDataFrame([(3, 3)], "src long, dst long"))
    assert sorted(r["count"] for r in multilevel.multilevel_parts(alone, 3).groupBy("part_id").count().collect()) == [3, 3, 4]


def test_every_round_of_moves_lowers_the_cut(spark):
    graph = clustered(spark)
    level = multilevel.first_level(graph)
    parts = partitioning.hashed_parts(graph.nodes, 4)
    cuts = [partitioning.edge_cut(graph.edges, parts).first()["n_cut"]]
    for _ in range(3):
        parts = multilevel.refined(level, parts, 4, 140, rounds=1)
        cuts.append(partitioning.edge_cut(graph.edges, parts).first()["n_cut"])
    assert cuts[0] > cuts[1] >= cuts[2] >= cuts[3] and max(r["count"] for r in parts.groupBy("part_id").count().collect()) <= 150


@pytest.mark.parametrize("seed", range(3))
def test_moves_in_one_task_keep_count(seed):
    rng = np.random.default_rng(seed)
    n, k = 40, 3
    a = np.triu(rng.integers(0, 3, (n, n)) * (rng.random((n, n)) < 0.2), 1)
    a = a + a.T
    near = [(np.flatnonzero(r), r[np.flatnonzero(r)].astype(float)) for r in a]
    start = multilevel.grown(np.ones(n), near, k, seed)
    assert np.bincount(start, minlength=k).min() > 0
    cut_of = lambda p: a[p[:, None] != p[None, :]].sum() / 2
    before = cut_of(start)
    lost, part = multilevel.moved(np.ones(n), near, start.copy(), k, 15)
    assert lost == cut_of(part) <= before and np.bincount(part, minlength=k).max() <= 15


def test_neighbourhoods_share_one_copy_of_the_edges():
    n = 200
    src, dst = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    near = multilevel.neighbourhoods(n, src, dst, (src * n + dst).astype(float))
    assert all((v == np.arange(n)).all() and (w == u * n + np.arange(n)).all() for u, (v, w) in enumerate(near))
    held = {id(x.base): x.base.nbytes for pair in near for x in pair}  # before: a copy of all edges for each node
    assert sum(held.values()) <= 2 * n * n * 8


def test_edges_are_dealt_into_more_tasks_where_a_task_has_much(spark, monkeypatch):
    monkeypatch.setattr(common, "TASK_BYTES", 2048)
    tasks, n = [], spark.conf.get("spark.sql.shuffle.partitions")
    noted = lambda df: (kept := common.cut(df), tasks.append(kept.rdd.getNumPartitions()))[0]
    edges = common.cut(spark.range(6000).select((F.col("id") % 997).alias("src"), (F.col("id") * 7919 % 1009).alias("dst")))
    graph = Graph(spark.range(1009).withColumnRenamed("id", "node_id"), edges)
    adaptive = "spark.sql.adaptive.coalescePartitions"
    with common.setting(spark, f"{adaptive}.parallelismFirst", "false"), common.setting(spark, f"{adaptive}.minPartitionSize", "1k"):
        multilevel.matches(multilevel.first_level(graph, noted).edges, noted)
    assert max(tasks) > int(n) and tasks[-1] > int(n) and spark.conf.get("spark.sql.shuffle.partitions") == n
