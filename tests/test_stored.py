"""Hops over graphs stored by part against plain hops, and what they shuffle."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import aggregate as agg
from weftgraph.plans import layers
from weftgraph.plans.stored import PartStore, StoredContext
from weftgraph.plans.train import Trainer

WIDTH = 3


def plan_nodes(node):
    """All nodes of an executed plan, adaptive stages included."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from plan_nodes(node.executedPlan())
        return
    if name.endswith("QueryStageExec"):
        yield from plan_nodes(node.plan())
        return
    yield node
    children = node.children()
    for k in range(children.size()):
        yield from plan_nodes(children.apply(k))


def exchanges(df):
    """(rows written) of each shuffle of a frame that is run by this."""
    df.collect()
    found = [n for n in plan_nodes(df._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "ShuffleExchangeExec"]
    return [n.metrics().apply("shuffleRecordsWritten").value() for n in found]


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """A graph of four parts with a hub that a third of all edges enter, one that many leave, and a node without edges."""
    rng = random.Random(1)
    n = 400
    pairs = {(rng.randrange(n - 1), rng.randrange(n - 1)) for _ in range(1500)} | {(k, 7) for k in range(0, n - 1)} | {(11, k) for k in range(0, n - 1, 2)}
    nodes = spark.range(n).select(F.col("id").alias("node_id"), (F.col("id") % 10 < 7).alias("train_mask"), (F.col("id") % 10 == 7).alias("val_mask"), (F.col("id") % 3).cast("int").alias("label"))
    nodes = nodes.withColumn("features", F.array(*((F.col("node_id") * (j + 3) % 17 / 16.0) for j in range(WIDTH))))
    graph = Graph(nodes, spark.createDataFrame(sorted(pairs), "src long, dst long").repartition(4))
    parts = nodes.select("node_id", F.when(F.col("node_id") < 250, F.floor(F.col("node_id") / 100)).otherwise(9).cast("int").alias("part_id"))
    path = str(tmp_path_factory.mktemp("store") / "graph")
    return graph, parts, PartStore.write(graph, parts, path), path


def rows(df, width=WIDTH, column="a"):
    return {r["node_id"]: [round(v, 9) for v in r[column]] for r in df.select("node_id", column).collect()}


def test_hops_equal_plain_ones(spark, case):
    graph, _, store, path = case
    for found in (store, PartStore.open(spark, path)):
        ctx = StoredContext.over(found)
        h = ctx.placed(graph.nodes.select("node_id", F.col("features").alias("x")))
        assert rows(ctx.neighbour_mean(h, WIDTH)) == rows(agg.neighbour_mean(h, graph.edges, WIDTH))
        assert rows(ctx.neighbour_sum(h, WIDTH)) == rows(agg.neighbour_sum(h, graph.edges, WIDTH))
        back = graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        assert rows(ctx.neighbour_sum(h, WIDTH, reverse=True)) == rows(agg.neighbour_sum(h, back, WIDTH))
        most = found.hop(h, WIDTH, f=F.max).select("node_id", F.array("c0", "c1", "c2").alias("a"))
        assert rows(most) == rows(agg.neighbour_max(h, graph.edges, WIDTH))
        assert ctx.edges.count() == graph.edges.count()


@pytest.mark.parametrize("reverse", [False, True])
def test_a_hop_shuffles_the_plan_alone(spark, case, reverse):
    graph, _, store, _ = case
    ctx = StoredContext.over(store)
    h = ctx.placed(graph.nodes.select("node_id", F.col("features").alias("x")))
    plan = {r["way"]: (r["n_pulled"], r["n_pushed"]) for r in store.plan().collect()}["backward" if reverse else "forward"]
    assert sorted(exchanges(store.hop(h, WIDTH, reverse))) == sorted(plan) and sum(plan) > 0
    crossing = graph.edges.count()
    assert sum(plan) < crossing


def test_a_hubs_edges_are_spread_over_the_parts(case):
    _, _, store, _ = case
    into = store.table("at_dst").where("dst = 7").count() + store.table("inner").where("dst = 7").count()
    pushed = store.table("at_src").where("dst = 7").groupBy("home").count().collect()
    assert len(pushed) == 3 and into <= 100 and sum(r["count"] for r in pushed) + into >= 399


@pytest.mark.parametrize("aggregator", ["mean", "gcn"])
def test_two_layers_and_their_gradients(spark, case, aggregator):
    graph, _, store, _ = case
    own = [Trainer(graph, layers.sage(WIDTH, 4, 3, aggregator=aggregator, dropout=0.3), ctx=ctx, rate=0.05) for ctx in (None, StoredContext.over(store))]
    plain, stored = ([m[:2] + (round(m[3], 9), round(m[4], 9)) for m in t.fit(2)] for t in own)
    assert plain == stored
    for a, b in zip(own[0].params, own[1].params, strict=True):
        for name in a:
            assert np.allclose(a[name], b[name], atol=1e-9)


def test_gcn_over_a_store(spark, case):
    graph, _, store, _ = case
    own = [Trainer(graph, layers.gcn(WIDTH, 4, 3), ctx=ctx, rate=0.05) for ctx in (None, StoredContext.over(store))]
    assert [round(m[3], 9) for m in own[0].fit(2)] == [round(m[3], 9) for m in own[1].fit(2)]


def test_no_layer_of_a_later_epoch_shuffles_edges(spark, case):
    graph, _, store, path = case
    trainer = Trainer(graph, layers.sage(WIDTH, 4, 3), ctx=StoredContext.over(PartStore.open(spark, path)), rate=0.05)
    trainer.fit(1)
    edges = graph.edges.count()
    plan = {r["way"]: r["n_pulled"] + r["n_pushed"] for r in store.plan().collect()}
    h = trainer.features
    for layer, params in zip(trainer.layers, trainer.params, strict=True):
        moved = exchanges(layer.forward(h, params, trainer.ctx))
        assert sum(moved) == plan["forward"] < edges
        layer.run(h, params, trainer.ctx)
        h = layer.output
