"""Known datasets and how to load one by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph, graph_of_edges, masks_by_position, masks_by_roles
from weftgraph.sources import fixtures, text


@dataclass(frozen=True)
class Dataset:
    in_feats: int
    n_classes: int
    multilabel: bool = False


#: Feature width and number of classes of public datasets, in order of look-up.
DATASETS = {
    "simple": Dataset(1, 2),
    "karate": Dataset(1, 2),
    "cora": Dataset(1433, 7),
    "reddit": Dataset(602, 41),
    "citeseer": Dataset(3703, 6),
    "pubmed": Dataset(500, 3),
    "products": Dataset(100, 47),
    "papers100M": Dataset(128, 172),
    "amazon": Dataset(200, 107, True),
    "yelp": Dataset(300, 100, True),
    "twitter-2010": Dataset(128, 10),
}


def describe(name: str, in_feats: int = -1) -> Dataset:
    """The first dataset whose key is part of ``name``; ``in_feats`` other than -1 overrides the width."""
    for key, found in DATASETS.items():
        if key in name:
            return found if in_feats == -1 else Dataset(in_feats, found.n_classes, found.multilabel)
    raise KeyError(f"no known dataset in {name!r}")


def datasets(spark: SparkSession) -> DataFrame:
    rows = [(k, d.in_feats, d.n_classes, d.multilabel) for k, d in DATASETS.items()]
    return spark.createDataFrame(rows, "name string, in_feats int, n_classes int, multilabel boolean")


def load(spark: SparkSession, name: str, folder: str | None = None, prob: bool = False, feat_size: int = -1, seed: int = 0) -> Graph:
    """A graph by name: built in, or from ``folder``.

    A folder holds nodes.parquet and edges.parquet, and where masks are not
    columns of the nodes, split.parquet (node_id, split) as public node
    property benchmarks give their index lists; amazon and yelp hold
    nodes.parquet, adj_full.parquet, adj_train.parquet, role.json and
    class_map.json; others may hold an edge list, edges.txt. A suffix ``+loop``
    adds self loops.
    """
    if name.endswith("+loop"):
        return _with_prob(load(spark, name.removesuffix("+loop"), folder, False, feat_size, seed).with_self_loops(), prob, seed)
    if name == "simple":
        return fixtures.simple_graph(spark, prob, feat_size, seed)
    if name == "karate":
        return fixtures.karate(spark, prob, feat_size, seed)
    if folder is None:
        raise ValueError(f"{name} needs a folder")
    if "amazon" in name or "yelp" in name:
        graph = text.load_multilabel(spark, folder, describe(name).n_classes)
    elif "webgraph" in name or "twitter" in name:
        edges = text.cached_edges(spark, f"{folder}/edges.txt", f"{folder}/edges.parquet")
        graph = web_graph(edges, feat_size if feat_size != -1 else 128, seed)
        return _with_prob(graph, prob, seed)
    else:
        nodes = canonical_names(spark.read.parquet(f"{folder}/nodes.parquet"))
        if "train_mask" not in nodes.columns and (split := _read_if_there(spark, f"{folder}/split.parquet")) is not None:
            nodes = masks_by_roles(nodes, split_roles(split))
        graph = Graph(nodes, spark.read.parquet(f"{folder}/edges.parquet"))
        if "reddit" in name or "ogb" in name or "products" in name or "papers" in name:
            graph = graph.with_self_loops()
    if feat_size != -1:
        graph = Graph(graph.nodes.withColumn("features", fixtures.random_features(feat_size, seed)), graph.edges)
    return _with_prob(graph, prob, seed)


def _with_prob(graph: Graph, prob: bool, seed: int) -> Graph:
    return Graph(graph.nodes, graph.edges.withColumn("prob", F.randn(seed).cast("float"))) if prob else graph


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def split_roles(split: DataFrame) -> DataFrame:
    """(node_id, role) from (node_id, split), the latter train, valid or test."""
    role = F.when(F.col("split") == "train", "tr").when(F.col("split").startswith("val"), "va").when(F.col("split") == "test", "te")
    return split.select("node_id", role.alias("role"))


def canonical_names(nodes: DataFrame) -> DataFrame:
    """feat as features; labels, or its first column, as label; a NaN label as null."""
    if "feat" in nodes.columns:
        nodes = nodes.withColumnRenamed("feat", "features")
    if "labels" in nodes.columns:
        nodes = nodes.withColumnRenamed("labels", "label")
    if dict(nodes.dtypes).get("label", "").startswith("array"):
        nodes = nodes.withColumn("label", F.get("label", F.lit(0)))
    if dict(nodes.dtypes).get("label") in ("float", "double"):
        nodes = nodes.withColumn("label", F.when(~F.isnan("label"), F.col("label")).cast("int"))
    return nodes


def web_graph(edges: DataFrame, feat_size: int = 128, seed: int = 0, n_labels: int = 10) -> Graph:
    """A bare edge list as a graph without loops at random features and labels, split 70/20/10 by position."""
    graph = graph_of_edges(edges)
    n = graph.nodes.count()
    label = F.floor(F.rand(seed + 1) * n_labels).cast("float")
    nodes = graph.nodes.withColumns({"features": fixtures.random_features(feat_size, seed), "label": label, **masks_by_position(n)})
    return Graph(nodes, edges.where("src <> dst")).with_self_loops()
