"""Text and JSON formats: edge lists, adjacency files, assignments, role and class files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph, masks_by_roles
from weftgraph.sources.arrays import read_csr, read_npy


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) from lines of two whitespace-separated ids; other lines are ignored."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(part) >= 2)
    return rows.select(F.try_element_at(part, F.lit(1)).try_cast("long").alias("src"), F.try_element_at(part, F.lit(2)).try_cast("long").alias("dst")).where("src is not null and dst is not null")


def cached_edges(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """The edge list, parsed once and kept as Parquet beside it."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(cache)
    except AnalysisException:
        read_edge_list(spark, path).write.parquet(cache)
        return spark.read.parquet(cache)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, or of the files of a folder in the order of their names, from 0.

    Lines are numbered within each block of a file and shifted by the blocks
    before it; the blocks' sizes are the only thing that meets in one task.
    """
    block = ["file", "start"]
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    sizes = rows.groupBy(*block).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy(*block)) - F.col("n"))
    return rows.join(F.broadcast(before), block).select((F.col("at") - F.col("first") + F.col("before")).alias("line"), "value")


def read_adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an adjacency file: a header, then each node's neighbours counted from 1; repeats count once."""
    lines = numbered_lines(spark, path)
    rows = lines.where("line > 0").select((F.col("line") - 1).alias("src"), F.split(F.trim("value"), r"\s+").alias("all"))
    edges = rows.select("src", F.explode("all").alias("to")).where("to <> ''").select("src", (F.col("to").cast("long") - 1).alias("dst")).distinct()
    n = lines.where("line = 0").select(F.split(F.trim("value"), r"\s+")[0].cast("long")).first()[0]
    return spark.range(n).withColumnRenamed("id", "node_id"), edges


def read_assignment(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, part_id): line i is the part of node i."""
    return numbered_lines(spark, path).where("trim(value) <> ''").select(F.col("line").alias("node_id"), F.trim("value").cast("int").alias("part_id"))


def adjacency_lists(graph: Graph) -> DataFrame:
    """(node_id, nbrs): every node's neighbours counted from 1, in order, space separated; empty where it has none."""
    lists = graph.edges.groupBy("src").agg(F.array_join(F.sort_array(F.collect_list(F.col("dst") + 1)), " ").alias("nbrs"))
    found = graph.nodes.select("node_id").join(lists, F.col("node_id") == F.col("src"), "left")
    return found.select("node_id", F.coalesce("nbrs", F.lit("")).alias("nbrs"))


def write_adjacency(graph: Graph, path: str) -> None:
    """A header of nodes and half the edges, then a line for each node, also the last ones without neighbours."""
    stats = graph.nodes.agg(F.count("*").alias("n")).withColumn("m", graph.edges.agg(F.count("*")).scalar())
    header = stats.select(F.lit(-1).cast("long").alias("node_id"), F.concat_ws(" ", F.col("n").cast("string"), F.round(F.col("m") / 2).cast("long").cast("string")).alias("value"))
    lines = adjacency_lists(graph).select("node_id", F.col("nbrs").alias("value"))
    header.unionByName(lines).orderBy("node_id").select("value").write.mode("overwrite").text(path)


def write_assignment(parts: DataFrame, path: str) -> None:
    parts.orderBy("node_id").select(F.col("part_id").cast("string")).write.mode("overwrite").text(path)


def read_roles(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, role) from a JSON file of id lists by role (tr, va, te)."""
    lists = spark.read.schema("tr array<long>, va array<long>, te array<long>").json(path, multiLine=True)
    named = F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("ids")) for r in ("tr", "va", "te")))
    return lists.select(F.explode(named).alias("l")).select(F.explode("l.ids").alias("node_id"), "l.role")


def class_matrix(nodes: DataFrame, class_map: DataFrame, n_classes: int) -> DataFrame:
    """Adds labels, an array of n_classes floats, from class_map(node_id, classes); zeros where a node has none."""
    named = class_map.select("node_id", F.col("classes").cast("array<float>").alias("labels"))
    return nodes.join(named, "node_id", "left").withColumn("labels", F.coalesce("labels", F.array_repeat(F.lit(0.0).cast("float"), n_classes)))


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, classes) from a JSON object of node id to array."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "map<string, array<double>>")))
    return rows.select(F.col("key").cast("long").alias("node_id"), F.col("value").alias("classes"))


def load_multilabel(spark: SparkSession, folder: str, n_classes: int) -> Graph:
    """Features scaled by the nodes of the training graph, multi-hot labels, masks from role lists, one loop at each node.

    The folder has features and the two graphs as Parquet tables, or as the
    arrays that they are published in: feats.npy, adj_full.npz, adj_train.npz.
    """
    from weftgraph.common import listed
    from weftgraph.functions.scaling import standard_scale

    there = listed(spark, folder)
    edges = lambda name: spark.read.parquet(f"{folder}/{name}.parquet") if f"{name}.parquet" in there else read_csr(spark, f"{folder}/{name}.npz")
    if "nodes.parquet" in there:
        nodes = spark.read.parquet(f"{folder}/nodes.parquet")
    else:
        nodes = read_npy(spark, f"{folder}/feats.npy").select(F.col("row").alias("node_id"), F.col("values").cast("array<float>").alias("features"))
    nodes = standard_scale(nodes, edges("adj_train").select(F.col("src").alias("node_id")).distinct())
    nodes = masks_by_roles(class_matrix(nodes, read_class_map(spark, f"{folder}/class_map.json"), n_classes), read_roles(spark, f"{folder}/role.json"))
    return Graph(nodes, edges("adj_full")).with_self_loops()
