"""Bins as units: their frontiers, and the same results as of the whole graph."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import classify
from weftgraph.plans import bins, blocks, layers
from weftgraph.sources.fixtures import simple_graph


@pytest.fixture(scope="module")
def case(spark):
    nodes = spark.range(30).select(F.col("id").alias("node_id"), F.array(F.col("id") / 8.0, F.lit(1.0)).alias("x"))
    edges = spark.range(29).select(F.col("id").alias("src"), F.explode(F.array((F.col("id") * 3 + 1) % 30, F.lit(4).cast("long"))).alias("dst")).distinct()
    parts = nodes.select("node_id", F.floor(F.col("node_id") / 10).cast("int").alias("part_id"))
    return Graph(nodes, edges), parts


def test_frontiers_of_the_toy_graph(spark):
    graph = simple_graph(spark)
    own = graph.nodes.select("node_id", F.lit(0).alias("part_id"), (F.col("node_id") >= 5).cast("int").alias("bin_id"))
    found = [{(r["bin_id"], r["node_id"]) for r in f.collect()} for f in blocks.frontiers(graph.edges, own, 2)]
    assert {n for b, n in found[2] if b == 0} == {0, 1, 2, 3, 4}
    assert {n for b, n in found[1] if b == 0} == {0, 1, 2, 3, 4, 5} and {n for b, n in found[0] if b == 0} == {0, 1, 2, 3, 4, 5, 6, 7, 8}
    sizes = {(r["bin_id"], r["layer"]): tuple(r)[3:] for r in blocks.block_sizes(graph.edges, own, 2).collect()}
    assert sizes[0, 1] == (6, 5, 8) and sizes[0, 0] == (9, 6, 11) and sizes[1, 0][:2] == (4, 4)


def test_a_frontier_is_never_broadcast(case):
    """A checkpoint's estimate may say that a frontier is small; its hash table would be in every task's memory and grow with the nodes."""
    graph, parts = case
    binned = bins.naive(parts, 4)
    assert "Broadcast" not in blocks.block(graph.edges, binned.localCheckpoint())._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["naive", "priority"])
def test_bins_give_what_the_whole_graph_gives(case, kind):
    graph, parts = case
    binned = bins.naive(parts, 4) if kind == "naive" else bins.priority(classify.node_classes(graph.edges, parts), 3)
    rng, model = np.random.default_rng(1), layers.sage(2, 3, 2)
    params = [layer.initial(rng) for layer in model]
    got = {r["node_id"]: r["out"] for r in blocks.forward(graph, binned, graph.nodes, model, params).collect()}
    ctx, h = layers.Context.of(graph), graph.nodes.select("node_id", "x")
    for layer, p in zip(model, params, strict=True):
        layer.run(h, p, ctx)
        h = layer.output
    want = {r["node_id"]: r["x"] for r in h.collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    with pytest.raises(ValueError, match="means"):
        blocks.forward(graph, binned, graph.nodes, layers.sage(2, 3, 2, aggregator="gcn"), params)


def test_a_node_that_many_bins_need_is_computed_once(case):
    """A node that all of 100 bins need has its vector joined to an edge once a layer, not once a bin."""
    spark = case[0].nodes.sparkSession
    nodes = spark.range(101).select(F.col("id").alias("node_id"), F.array(F.col("id") / 8.0, F.lit(1.0)).alias("x"))
    edges = spark.range(1, 101).select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")), F.struct(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst")))).alias("e")).select("e.*")
    binned = nodes.select(F.lit(0).alias("part_id"), F.col("node_id").cast("int").alias("bin_id"), "node_id")
    seen = []

    class Seen(layers.SageLayer):
        def run(self, h, *rest, **options):
            seen.append(h.count())
            return super().run(h, *rest, **options)

    model = [Seen(2, 3, relu=True), Seen(3, 2)]
    out = blocks.forward(Graph(nodes, edges), binned, nodes, model, [layer.initial(np.random.default_rng(1)) for layer in model])
    assert out.count() == 101 and seen == [101, 101]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_the_query_tells_the_bin_of_each_result(spark):
    """Results that lose their bins are those of the whole graph: the binning had no effect on them."""
    from weftgraph.oracles import ORACLES
    from weftgraph.queries import QUERIES

    duckdb, folder = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("part", "supplier", "lineitem", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    columns = ["part_id", "bin_id", "node_id", "j", "v"]
    rows = QUERIES["bin_two_layer_forward"](spark, folder)
    assert rows.columns == columns
    got = sorted(map(tuple, rows.collect()))
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['bin_two_layer_forward']})").fetchall()
    assert got == sorted(want) and len({r[:2] for r in got}) > 4
