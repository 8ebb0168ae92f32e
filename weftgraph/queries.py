"""Queries over the test tables, one for each operator, through the library's own functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.common import cut, new_folder, table
from weftgraph.functions import activations, losses
from weftgraph.functions.scaling import standard_scale
from weftgraph.graph import Graph, fill_missing, gather, masks_by_position, masks_by_roles, num_classes, num_nodes, scatter
from weftgraph.operators import aggregate as agg
from weftgraph.operators import batches, classify, multilevel, partitioning
from weftgraph.plans import bins, blocks, layers
from weftgraph.plans.stored import PartStore, StoredContext
from weftgraph.plans.train import Adam, Trainer
from weftgraph.sources import sinks, text
from weftgraph.sources.fixtures import karate, simple_graph
from weftgraph.sources.registry import datasets
from weftgraph.sources.tables import customer_order, customer_order_parts, part_supplier, with_embeddings

K, WIDTH, HIDDEN, CLASSES = 4, 64, 8, 10
DIGITS = 5

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(c) -> F.Column:
    """Rounded, and zero without a sign."""
    return F.round(c, DIGITS) + F.lit(0.0)


def long(rows: DataFrame, column: str = "a", key: tuple[str, ...] = ("node_id",)) -> DataFrame:
    return rows.select(*key, F.posexplode(column).alias("j", "v")).select(*key, "j", rounded(F.col("v")).alias("v"))


def dyadic(n: int, m: int, shift: int = 0) -> np.ndarray:
    """Weights that are exact in binary, so that no sum depends on its order."""
    i, j = np.meshgrid(np.arange(n), np.arange(m), indexing="ij")
    return ((i * 7 + j * 13 + shift) % 17 - 8) / 16.0


def dyadic_bias(m: int, shift: int = 0) -> np.ndarray:
    return ((np.arange(m) * 5 + shift) % 7 - 3) / 8.0


def features(spark: SparkSession, sf_dir: str, width: int = WIDTH) -> tuple[Graph, DataFrame]:
    graph = part_supplier(spark, sf_dir)
    return graph, with_embeddings(spark, sf_dir, graph.nodes, width)


def within(graph: Graph, width: int = WIDTH) -> agg.Reach:
    """Pairs if the graph has them, and hash tables of the vectors if so many fit, which the nodes alone tell."""
    pairs = None if graph.pairs is None else agg.dealt(graph.pairs, graph.nodes, width)
    return agg.Reach(None, agg.fits(graph.nodes.sparkSession, graph.nodes.count(), width), pairs)


def chunked(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    graph = part_supplier(spark, sf_dir)
    return graph, partitioning.chunk_parts(graph.nodes, K)


def co_located(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    return customer_order(spark, sf_dir), customer_order_parts(spark, sf_dir, K)


# Graphs


@query
def edges_distinct_bidirected(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return Graph(lines, lines).symmetrised().edges


@query
def remove_add_self_loops(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"))
    return Graph(nodes, lines).with_self_loops().edges


@query
def in_out_degree(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return Graph(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id")), lines).degrees()


@query
def graph_stats(spark, sf_dir):
    return part_supplier(spark, sf_dir).stats()


@query
def max_id_num_nodes(spark, sf_dir):
    return num_nodes(part_supplier(spark, sf_dir).edges)


@query
def num_label_classes(spark, sf_dir):
    return num_classes(table(spark, sf_dir, "embeddings"))


@query
def positional_split_counts(spark, sf_dir):
    nodes = part_supplier(spark, sf_dir).nodes.select("node_id")
    masks = masks_by_position(nodes.agg(F.count("*")).scalar())
    return nodes.withColumns(masks).agg(*(F.count_if(m).alias(m) for m in masks))


@query
def mask_split_counts(spark, sf_dir):
    nodes = with_embeddings(spark, sf_dir, part_supplier(spark, sf_dir).nodes, 1)
    test = ~(F.col("train_mask") | F.col("val_mask"))
    return nodes.groupBy("label").agg(F.count_if("train_mask").alias("n_train"), F.count_if("val_mask").alias("n_val"), F.count_if(test).alias("n_test"))


@query
def adjacency_lists(spark, sf_dir):
    return text.adjacency_lists(part_supplier(spark, sf_dir))


@query
def inductive_subgraph_train(spark, sf_dir):
    return part_supplier(spark, sf_dir).inductive()[0].edges


@query
def gather_rows(spark, sf_dir):
    graph, nodes = features(spark, sf_dir)
    return long(gather(nodes, graph.nodes.where("val_mask")), "x")


@query
def scatter_rows(spark, sf_dir):
    graph, nodes = features(spark, sf_dir)
    new = graph.nodes.where("test_mask").select("node_id", F.array(*(F.lit(float(j)) for j in range(WIDTH))).alias("x"))
    return long(scatter(nodes.select("node_id", "x"), new, "x"), "x")


@query
def multilabel_class_map(spark, sf_dir):
    """The labels table as multi-hot rows of all documents, zeros where a document has none."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"))
    given = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("node_id")).agg(F.array(F.max("quality"), F.max("toxic")).alias("classes"))
    return long(text.class_matrix(docs, given, 2), "labels")


@query
def role_list_masks(spark, sf_dir):
    """Masks from rows of (node_id, role), as a role file gives them."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"))
    digit = F.col("node_id") % 3
    roles = nodes.select("node_id", F.when(digit == 0, "tr").when(digit == 1, "va").otherwise("te").alias("role"))
    return masks_by_roles(nodes, roles)


@query
def dataset_registry(spark, sf_dir):
    return datasets(spark)


@query
def simple_graph_hop(spark, sf_dir):
    """The nine-node example over vectors of the embeddings table."""
    graph = simple_graph(spark)
    h = with_embeddings(spark, sf_dir, graph.nodes.select("node_id"))
    return long(agg.zero_filled(graph.nodes, agg.neighbour_mean(h, graph.edges, WIDTH, within(graph)), "a", WIDTH))


@query
def karate_degrees(spark, sf_dir):
    """Degrees in the club, and the account balances of the suppliers that the neighbours stand for."""
    graph = karate(spark)
    balance = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), "s_acctbal")
    around = graph.edges.join(balance, "src").groupBy(F.col("dst").alias("node_id")).agg(F.round(F.sum("s_acctbal"), 2).alias("around"))
    return graph.degrees().join(around, "node_id", "left").fillna(0.0, ["around"])


# Parts


@query
def chunk_partition(spark, sf_dir):
    return chunked(spark, sf_dir)[1]


@query
def hash_random_partition(spark, sf_dir):
    return partitioning.hashed_parts(part_supplier(spark, sf_dir).nodes, K)


@query
def partition_book_ranges(spark, sf_dir):
    return classify.part_book(co_located(spark, sf_dir)[1])


@query
def range_join_owner(spark, sf_dir):
    graph, parts = chunked(spark, sf_dir)
    return classify.owners_by_range(graph.nodes.select("node_id"), classify.part_book(parts))


@query
def boundary_edges(spark, sf_dir):
    graph, parts = co_located(spark, sf_dir)
    return classify.boundary(graph.edges, parts)


@query
def node_class_dih(spark, sf_dir):
    graph, parts = co_located(spark, sf_dir)
    return classify.node_classes(graph.edges, parts)


@query
def dependent_sets(spark, sf_dir):
    graph, parts = co_located(spark, sf_dir)
    return classify.dependents(classify.boundary(graph.edges, parts))


@query
def exclusive_dep_counts(spark, sf_dir):
    graph, parts = co_located(spark, sf_dir)
    return classify.exclusive_dependencies(classify.boundary(graph.edges, parts))


@query
def exchange_plan(spark, sf_dir):
    graph, parts = co_located(spark, sf_dir)
    return classify.exchange(classify.boundary(graph.edges, parts))


@query
def send_counts(spark, sf_dir):
    """How many of the customers, as just produced, each owner sends to each consumer."""
    graph, parts = co_located(spark, sf_dir)
    plan = classify.exchange(classify.boundary(graph.edges, parts))
    sent = classify.to_send(plan, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id")))
    return sent.groupBy("consumer_part", "owner_part").agg(F.count("*").alias("n"))


@query
def halo_features(spark, sf_dir):
    graph, parts = co_located(spark, sf_dir)
    plan = classify.exchange(classify.boundary(graph.edges, parts))
    rows = classify.halo_features(plan, with_embeddings(spark, sf_dir, graph.nodes, WIDTH))
    rows = rows.select("consumer_part", "owner_part", "node_id", F.posexplode("x").alias("j", "v"))
    return rows.withColumn("v", rounded(F.col("v")))


@query
def halo_zero_fill(spark, sf_dir):
    """Features of train nodes only, zeros for the rest until they are exchanged."""
    graph, nodes = features(spark, sf_dir)
    return long(fill_missing(graph.nodes, nodes.where("train_mask"), "x", WIDTH), "x")


@query
def partition_report(spark, sf_dir):
    graph, parts = co_located(spark, sf_dir)
    return classify.report(graph.edges, parts)


@query
def dep_counters(spark, sf_dir):
    graph, parts = co_located(spark, sf_dir)
    return partitioning.dependencies(partitioning.member_counts(graph.edges, parts), parts)


@query
def dep_balance_rate(spark, sf_dir):
    graph, parts = co_located(spark, sf_dir)
    outside = partitioning.dependencies(partitioning.member_counts(graph.edges, parts), parts)
    return partitioning.balance_rate(partitioning.dependency_sizes(outside, parts)).select(rounded(F.col("rate")).alias("rate"))


def swapping(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, parts, and the counts of members that have a node as neighbour."""
    graph, parts = co_located(spark, sf_dir)
    return graph.edges, parts, partitioning.member_counts(graph.edges, parts)


@query
def swap_candidates(spark, sf_dir):
    return partitioning.choose_swap(*swapping(spark, sf_dir))


@query
def swap_one_step(spark, sf_dir):
    edges, parts, counts = swapping(spark, sf_dir)
    return partitioning.swapped(parts, *partitioning.choose_swap(edges, parts, counts).first())


@query
def swap_three_steps(spark, sf_dir):
    return partitioning.refine(*co_located(spark, sf_dir), max_iter=3)


@query
def swap_loop(spark, sf_dir):
    graph, parts = co_located(spark, sf_dir)
    return partitioning.refine(graph, parts)


@query
def swap_batches(spark, sf_dir):
    """Independent swaps of paired parts until none brings them closer."""
    return batches.refine_batches(*co_located(spark, sf_dir))


@query
def grown_partition(spark, sf_dir):
    return partitioning.grown_parts(part_supplier(spark, sf_dir), K)


@query
def matching_round(spark, sf_dir):
    """Parts and suppliers that are each other's heaviest neighbour."""
    return multilevel.matches(multilevel.first_level(part_supplier(spark, sf_dir)).edges)


@query
def multilevel_partition(spark, sf_dir):
    return partitioning.partition(part_supplier(spark, sf_dir), K, "multilevel")


@query
def bins_naive(spark, sf_dir):
    return bins.naive(co_located(spark, sf_dir)[1], 100)


@query
def bins_prio(spark, sf_dir):
    graph, parts = co_located(spark, sf_dir)
    return bins.priority(classify.node_classes(graph.edges, parts), bins.scaled_bin_size(50, 1, WIDTH, HIDDEN))


@query
def bin_block_sizes(spark, sf_dir):
    """What two layers need for each bin of consecutive nodes."""
    graph, parts = co_located(spark, sf_dir)
    return blocks.block_sizes(graph.edges, bins.naive(parts, 100), 2)


@query
def bin_two_layer_forward(spark, sf_dir):
    """The two layers bin by bin, each result with its bin: D nodes of a part, then slices of the others."""
    graph, nodes = features(spark, sf_dir)
    binned = bins.priority(classify.node_classes(graph.edges, partitioning.chunk_parts(graph.nodes, K)), 200)
    params = [sage_params(WIDTH, HIDDEN, 0), sage_params(HIDDEN, CLASSES, 3)]
    return long(blocks.forward(graph, binned, nodes, layers.sage(WIDTH, HIDDEN, CLASSES), params), "out", (*blocks.BIN, "node_id"))


# Hops


@query
def sage_mean_hop(spark, sf_dir):
    graph, nodes = features(spark, sf_dir)
    return long(agg.neighbour_mean(nodes, graph.edges, WIDTH, reach=within(graph)))


@query
def hot_source_hop(spark, sf_dir):
    """Parts hear from the return flags of their line items: each of the three sources has some third of all edges."""
    lines = table(spark, sf_dir, "lineitem").select(F.ascii("l_returnflag").cast("long").alias("flag"), "l_partkey")
    edges = cut(lines.select((-F.col("flag")).alias("src"), F.col("l_partkey").alias("dst")))
    flags = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("dout"))
    vectors = with_embeddings(spark, sf_dir, flags.select((-F.col("node_id")).alias("node_id"))).select((-F.col("node_id")).alias("node_id"), "x")
    return long(agg.neighbour_mean(vectors, edges, WIDTH, agg.Reach(agg.hot_nodes(flags, "dout", WIDTH), True)))


@query
def sage_mean_hop_long(spark, sf_dir):
    graph, nodes = features(spark, sf_dir)
    rows = agg.neighbour_mean_long(nodes.select("node_id", F.posexplode("x").alias("j", "v")), graph.edges, within(graph))
    return rows.select("node_id", "j", rounded(F.col("v")).alias("v"))


@query
def sage_gcn_hop(spark, sf_dir):
    graph, nodes = features(spark, sf_dir)
    return long(agg.self_and_neighbour_mean(nodes, graph.edges, WIDTH, reach=within(graph)))


@query
def sage_pool_hop(spark, sf_dir):
    graph, nodes = features(spark, sf_dir)
    pooled = agg.linear(nodes.select("node_id", "x"), [("x", dyadic(WIDTH, HIDDEN))], dyadic_bias(HIDDEN), "p")
    pooled = pooled.select("node_id", activations.each(F.col("p"), activations.relu).alias("x"))
    return long(agg.neighbour_max(pooled, graph.edges, HIDDEN, within(graph)))


@query
def sage_lstm_hop(spark, sf_dir):
    graph, nodes = features(spark, sf_dir)
    return long(agg.lstm_aggregate(nodes, graph.edges, dyadic(WIDTH, 4 * WIDTH), dyadic(WIDTH, 4 * WIDTH, 3), np.zeros(4 * WIDTH), within(graph)))


@query
def gcn_norm_hop(spark, sf_dir):
    graph, nodes = features(spark, sf_dir)
    reach = within(graph)
    degrees = (graph if reach.pairs is None else Graph(graph.nodes, reach.pairs.edges)).degrees()
    return long(agg.degree_normalised_sum(nodes, graph.edges, degrees, WIDTH, reach=reach))


def sage_params(n_in: int, n_out: int, shift: int) -> dict[str, np.ndarray]:
    return {"W_self": dyadic(n_in, n_out, shift), "b_self": np.zeros(n_out), "W_neigh": dyadic(n_in, n_out, shift + 5), "b_neigh": dyadic_bias(n_out, shift)}


def forward(graph: Graph, nodes: DataFrame, model: list[layers.Layer], params: list[dict]) -> list[DataFrame]:
    """Each layer's result; the last one's is not cut."""
    ctx, h, caches = layers.Context.of(graph), cut(nodes.select("node_id", "x")), []
    for layer, p in zip(model, params, strict=True):
        caches.append(layer.run(h, p, ctx, keep=layer is not model[-1]))
        h = layer.output
    return caches


@query
def sage_layer_linear_relu(spark, sf_dir):
    graph, nodes = features(spark, sf_dir)
    return long(forward(graph, nodes, [layers.SageLayer(WIDTH, HIDDEN, relu=True)], [sage_params(WIDTH, HIDDEN, 0)])[-1], "out")


def two_layer_sage(spark, sf_dir) -> tuple[Graph, DataFrame, DataFrame]:
    graph, nodes = features(spark, sf_dir)
    caches = forward(graph, nodes, layers.sage(WIDTH, HIDDEN, CLASSES), [sage_params(WIDTH, HIDDEN, 0), sage_params(HIDDEN, CLASSES, 3)])
    return graph, nodes, caches[-1]


@query
def sage_two_layer_forward(spark, sf_dir):
    return long(two_layer_sage(spark, sf_dir)[2], "out")


@query
def halo_two_layer_forward(spark, sf_dir):
    """The same over edges stored by part, with an exchange of halo rows alone."""
    graph, nodes = features(spark, sf_dir)
    ctx = StoredContext.over(PartStore.write(graph, partitioning.chunk_parts(graph.nodes, K), new_folder(spark, "store")))
    h = ctx.placed(nodes.select("node_id", "x"))
    first, second = layers.sage(WIDTH, HIDDEN, CLASSES)
    first.run(h, sage_params(WIDTH, HIDDEN, 0), ctx)
    return long(second.run(first.output, sage_params(HIDDEN, CLASSES, 3), ctx, keep=False), "out")


@query
def gcn_two_layer_forward(spark, sf_dir):
    graph, nodes = features(spark, sf_dir)
    params = [{"W": dyadic(WIDTH, HIDDEN), "b": dyadic_bias(HIDDEN)}, {"W": dyadic(HIDDEN, CLASSES, 3), "b": dyadic_bias(CLASSES, 3)}]
    return long(forward(graph, nodes, layers.gcn(WIDTH, HIDDEN, CLASSES), params)[-1], "out")


GAT_HEADS, GAT_WIDTH = 2, 4


def gat_params() -> dict[str, np.ndarray]:
    wide = GAT_HEADS * GAT_WIDTH
    return {"W": dyadic(WIDTH, wide), "al": dyadic(GAT_HEADS, GAT_WIDTH, 1), "ar": dyadic(GAT_HEADS, GAT_WIDTH, 2), "b": np.zeros(wide)}


@query
def gat_edge_softmax(spark, sf_dir):
    graph, nodes = features(spark, sf_dir)
    heads = layers.GatLayer(WIDTH, GAT_WIDTH, heads=GAT_HEADS).scored(nodes, gat_params())
    alpha = agg.edge_softmax(cut(graph.edges), heads, GAT_HEADS)
    return alpha.select("src", "dst", *(rounded(F.col("alpha")[k]).alias(f"alpha{k}") for k in range(GAT_HEADS)))


@query
def gat_layer_concat(spark, sf_dir):
    graph, nodes = features(spark, sf_dir)
    return long(forward(graph, nodes, [layers.GatLayer(WIDTH, GAT_WIDTH, heads=GAT_HEADS)], [gat_params()])[-1], "out")


@query
def gat_layer_mean(spark, sf_dir):
    graph, nodes = features(spark, sf_dir)
    return long(forward(graph, nodes, [layers.GatLayer(WIDTH, GAT_WIDTH, heads=GAT_HEADS, mean_heads=True)], [gat_params()])[-1], "out")


@query
def dropout_forward(spark, sf_dir):
    nodes = features(spark, sf_dir)[1]
    return long(nodes.select("node_id", activations.dropout(F.col("x"), 0.5, 7).alias("x")), "x")


@query
def standard_scale_train(spark, sf_dir):
    graph, nodes = features(spark, sf_dir)
    return long(standard_scale(nodes.select("node_id", "x"), graph.nodes.where("train_mask"), "x"), "x")


# Losses, metrics, gradients


def logits(spark, sf_dir) -> DataFrame:
    """Train rows with dyadic logits z, label and part_id."""
    graph, nodes = features(spark, sf_dir)
    parts = partitioning.chunk_parts(graph.nodes, K)
    rows = agg.linear(nodes.where("train_mask").select("node_id", "x", "label"), [("x", dyadic(WIDTH, CLASSES))], dyadic_bias(CLASSES))
    return rows.join(parts, "node_id")


@query
def cross_entropy_loss(spark, sf_dir):
    rows = cut(logits(spark, sf_dir))
    kinds = [losses.cross_entropy(rows, r).select(F.lit(r).alias("reduction"), rounded(F.col("loss")).alias("loss")) for r in ("global_mean", "partition_mean")]
    return kinds[0].unionByName(kinds[1])


def multilabel_rows(spark, sf_dir) -> DataFrame:
    given = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("node_id")).agg(F.array(F.max("quality").cast("double"), F.max("toxic").cast("double")).alias("labels"))
    nodes = with_embeddings(spark, sf_dir, given, WIDTH)
    return agg.linear(nodes, [("x", dyadic(WIDTH, 2))], dyadic_bias(2))


@query
def bce_logits_loss(spark, sf_dir):
    return losses.bce_sum(multilabel_rows(spark, sf_dir)).select(rounded(F.col("loss")).alias("loss"))


@query
def micro_f1(spark, sf_dir):
    return losses.micro_f1(multilabel_rows(spark, sf_dir)).select(rounded(F.col("micro_f1")).alias("micro_f1"))


@query
def accuracy(spark, sf_dir):
    return losses.accuracy(logits(spark, sf_dir)).select(rounded(F.col("accuracy")).alias("accuracy"))


@query
def predicted_class(spark, sf_dir):
    return logits(spark, sf_dir).select("node_id", activations.argmax(F.col("z")).alias("predicted"))


def last_gradient(spark, sf_dir) -> DataFrame:
    rows = cut(logits(spark, sf_dir))
    return losses.cross_entropy_gradient(rows, F.lit(1.0 / max(1, rows.count())))


@query
def softmax_grad_last_layer(spark, sf_dir):
    g = last_gradient(spark, sf_dir)
    return long(g.select("node_id", F.transform("g", lambda v: v * 1000.0).alias("g")), "g")


def _entries(spark, named: dict[str, np.ndarray]) -> DataFrame:
    rows = [(n, i, j, float(v)) for n, m in named.items() for (i, j), v in np.ndenumerate(np.atleast_2d(m))]
    return spark.createDataFrame(rows, "name string, i int, j int, v double").withColumn("v", rounded(F.col("v")))


@query
def weight_grad_last_layer(spark, sf_dir):
    g = last_gradient(spark, sf_dir).select("x", "g")
    return _entries(spark, layers.outer_sums(g, {"W": ("x", "g"), "b": (None, "g")}, {"W": (WIDTH, CLASSES), "b": (CLASSES,)}))


@query
def partition_grad_mean(spark, sf_dir):
    """The bias gradient of each part's own mean loss, averaged over parts."""
    rows = cut(logits(spark, sf_dir))
    sizes = rows.groupBy("part_id").agg(F.count("*").alias("n"))
    g = losses.cross_entropy_gradient(rows.join(F.broadcast(sizes), "part_id"), 1.0 / F.col("n"))
    own = g.select("part_id", F.posexplode("g").alias("j", "v")).groupBy("part_id", "j").agg(F.sum("v").alias("v"))
    return own.groupBy("j").agg(rounded(F.avg("v")).alias("v"))


@query
def gradient_merge_sum(spark, sf_dir):
    """Gradients that consumers hold for a node, summed at its owner: here each consumer holds the node's embedding."""
    graph, parts = co_located(spark, sf_dir)
    rows = classify.halo_features(classify.exchange(classify.boundary(graph.edges, parts)), with_embeddings(spark, sf_dir, graph.nodes, WIDTH))
    return long(rows.groupBy("node_id").agg(F.array(*(F.sum(F.col("x")[j]) for j in range(WIDTH))).alias("g")), "g")


@query
def backprop_hidden_grad(spark, sf_dir):
    """The gradient at the input of a mean layer, for the output gradient x * 1 (its first components)."""
    graph, nodes = features(spark, sf_dir)
    layer, p = layers.SageLayer(WIDTH, HIDDEN), sage_params(WIDTH, HIDDEN, 0)
    ctx, nodes = layers.Context.of(graph), cut(nodes.select("node_id", "x"))
    cache = layer.run(nodes, p, ctx, keep=False)
    g = nodes.select("node_id", F.slice("x", 1, HIDDEN).alias("g"))
    return long(layer.pull(cache, g, p, ctx)[1], "g")


def stepped(spark, sf_dir) -> dict[str, np.ndarray]:
    """The last layer's weights after one step of Adam on its gradient."""
    g = last_gradient(spark, sf_dir).select("x", "g")
    grads = layers.outer_sums(g, {"W": ("x", "g"), "b": (None, "g")}, {"W": (WIDTH, CLASSES), "b": (CLASSES,)})
    params = {"W": dyadic(WIDTH, CLASSES), "b": dyadic_bias(CLASSES)}
    Adam(0.01).step(params, grads)
    return params


@query
def adam_single_step(spark, sf_dir):
    return _entries(spark, stepped(spark, sf_dir))


def trainer(spark, sf_dir, **options) -> Trainer:
    graph, nodes = features(spark, sf_dir)
    nodes = nodes.withColumnRenamed("x", "features")
    return Trainer(Graph(nodes, graph.edges), layers.sage(WIDTH, HIDDEN, CLASSES), **options)


@query
def train_epochs_loss(spark, sf_dir):
    return sinks.metrics_frame(spark, trainer(spark, sf_dir, rate=0.05).fit(2)).drop("seconds", "nodes_per_sec")


@query
def evaluate_test_mask(spark, sf_dir):
    graph, nodes, out = two_layer_sage(spark, sf_dir)
    rows = nodes.where(~(F.col("train_mask") | F.col("val_mask"))).select("node_id", "label").join(out.select("node_id", F.col("out").alias("z")), "node_id")
    both = losses.accuracy(rows).withColumn("loss", losses.cross_entropy(rows).scalar())
    return both.select(rounded(F.col("accuracy")).alias("accuracy"), rounded(F.col("loss")).alias("loss"))


@query
def throughput_metrics(spark, sf_dir):
    nodes = part_supplier(spark, sf_dir).nodes
    split = F.when(F.col("train_mask"), "train").when(F.col("val_mask"), "val").otherwise("test")
    rows = nodes.groupBy(split.alias("split")).agg(F.count("*").alias("n_nodes")).withColumn("seconds", F.when(F.col("split") == "train", 4.0).otherwise(0.5))
    return losses.throughput(rows)


# Files


@query
def text_roundtrip(spark, sf_dir):
    """Edges written as an adjacency file and read back."""
    folder = new_folder(spark, "files")
    graph = part_supplier(spark, sf_dir)
    text.write_adjacency(graph, f"{folder}/graph")
    return text.read_adjacency(spark, f"{folder}/graph")[1]


@query
def assignment_roundtrip(spark, sf_dir):
    folder = new_folder(spark, "files")
    text.write_assignment(chunked(spark, sf_dir)[1], f"{folder}/parts")
    return text.read_assignment(spark, f"{folder}/parts")


@query
def edge_list_roundtrip(spark, sf_dir):
    folder = new_folder(spark, "files")
    part_supplier(spark, sf_dir).edges.select(F.concat_ws(" ", "src", "dst")).write.text(f"{folder}/edges.txt")
    return text.cached_edges(spark, f"{folder}/edges.txt", f"{folder}/edges.parquet")


@query
def part_files_roundtrip(spark, sf_dir):
    """The nodes of part 1, its own and its halo, from the written parts."""
    folder = new_folder(spark, "files")
    sinks.materialise(*co_located(spark, sf_dir), f"{folder}/parts")
    return sinks.load_part(spark, f"{folder}/parts", 1).nodes.select("node_id", "owner_part", "is_local")


@query
def checkpoint_roundtrip(spark, sf_dir):
    """Weights after a step, written as a checkpoint and read back."""
    folder, params = new_folder(spark, "files"), [stepped(spark, sf_dir)]
    sinks.save_checkpoint(spark, f"{folder}/params", params)
    found, _ = sinks.load_checkpoint(spark, f"{folder}/params", [{n: m.shape for n, m in p.items()} for p in params])
    return sinks.params_frame(spark, found).select("layer", "name", "i", "j", rounded(F.col("value")).alias("value"))
