"""Graphs kept by part: hops over stored edges in place, with an exchange of halo rows alone.

Edges are written once, bucketed by the part that holds them: those within a
part there, those between two parts at the end that makes the exchange
smaller. For each pair of parts either the owner sends the vectors of its
nodes that the other needs (pull), or it adds them up for each node of the
other and sends the sums (push), whichever is fewer rows; edges into or out of
very many neighbours always go by sums, so a hub's edges are spread over the
parts of its neighbours. Backwards, along reversed edges, the same tables serve
with the two roles exchanged.

A hop joins and aggregates within buckets; only the rows of the plan are
shuffled. Layers' results are written bucketed in the same way, so that no
later layer, epoch or session shuffles edges or vectors again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.common import cut, discard, new_folder
from weftgraph.graph import Graph
from weftgraph.plans.layers import Context

#: A node whose edges to and from other parts are more than this share of a part's even share of all such edges is a hub.
HUB_SHARE = 0.125


def homes(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """(part_id, home): for each part a number that Spark's hash takes to a bucket of its own; a row for each part."""
    found = sorted(r["part_id"] for r in parts.select("part_id").distinct().collect())
    n = max(1, len(found))
    own = spark.range(64 * n + 1024).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("bucket")).agg(F.min("id").alias("home"))
    at = spark.createDataFrame(list(enumerate(found)), "bucket int, part_id int")
    return cut(at.join(own, "bucket").select("part_id", "home"))


class PartStore:
    """Bucketed tables of a graph in a folder: nodes, inner, at_src, at_dst, sends_src and sends_dst."""

    TABLES = ("nodes", "inner", "at_src", "at_dst", "sends_src", "sends_dst")

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        # Rows that are bucketed by their part may be joined by part and node without another shuffle.
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self._named: dict[str, str] = {}

    @classmethod
    def write(cls, graph: Graph, parts: DataFrame, path: str) -> PartStore:
        """Writes a graph whose nodes all have a part; edges keep their repetitions."""
        spark = graph.edges.sparkSession
        at = homes(spark, parts)
        store = cls(spark, path, max(1, at.count()))
        where = cut(parts.join(F.broadcast(at), "part_id").select("node_id", "home"))  # a row for each part
        end = lambda c: where.select(F.col("node_id").alias(c), F.col("home").alias(f"{c}_home"))
        edges = cut(graph.edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst"))
        crossing = edges.where("src_home <> dst_home")
        total = crossing.count()
        hub = lambda c: crossing.groupBy(c).agg(F.count("*").alias("n")).where(F.col("n") > max(64, HUB_SHARE * total / store.buckets)).select(c, F.lit(True).alias(f"{c}_hub"))
        marked = crossing.join(F.broadcast(hub("src")), "src", "left").join(F.broadcast(hub("dst")), "dst", "left")  # eight a part at most, by their share
        marked = cut(marked.withColumn("by", F.when(F.col("dst_hub"), "src").when(F.col("src_hub"), "dst")).drop("src_hub", "dst_hub"))
        pair = ["src_home", "dst_home"]
        sizes = marked.where("by is null").groupBy(*pair).agg(F.approx_count_distinct("src").alias("s"), F.approx_count_distinct("dst").alias("d"))
        marked = marked.join(sizes, pair, "left").withColumn("by", F.coalesce("by", F.when(F.col("d") < F.col("s"), "src").otherwise("dst")))
        held = lambda c, other: marked.where(F.col("by") == c).select(F.col(f"{c}_home").alias("home"), "src", "dst", F.col(f"{other}_home").alias("other"))
        store._save("at_src", held("src", "dst"))
        store._save("at_dst", held("dst", "src"))
        store._save("inner", edges.where("src_home = dst_home").select(F.col("src_home").alias("home"), "src", "dst"))
        # Where edges are held at one end, the owner of the other end sends that end's vectors, forward or backward.
        for near, far in (("src", "dst"), ("dst", "src")):
            needs = store.table(f"at_{far}").select(F.col("other").alias("home"), F.col(near).alias("node_id"), F.col("home").alias("to"))
            store._save(f"sends_{near}", needs.distinct())
        degrees = Graph(graph.nodes, graph.edges).degrees()
        store._save("nodes", where.join(degrees, "node_id").select("home", "node_id", "din", "dout"))
        spark.createDataFrame([(store.buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/layout")
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PartStore:
        """A store that was written before, maybe by another session."""
        store = cls(spark, path, spark.read.parquet(f"{path}/layout").first()["buckets"])
        for name in cls.TABLES:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{name}").schema)
            named = store._named[name] = f"weft_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {named} ({columns}) USING parquet CLUSTERED BY (home) INTO {store.buckets} BUCKETS LOCATION '{path}/{name}'")
        return store

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._named[name])

    def _save(self, name: str, rows: DataFrame) -> None:
        self._named[name] = self.keep(rows.repartition(self.buckets, "home"), f"{self.path}/{name}")

    def keep(self, rows: DataFrame, path: str) -> str:
        """Writes rows bucketed by home; those that lie by home already are written where they are. The table's name."""
        named = f"weft_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "home").option("path", path).saveAsTable(named)
        return named

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with a home, shuffled to its bucket."""
        return rows.repartition(self.buckets, "home")

    def plan(self) -> DataFrame:
        """(way, n_pulled, n_pushed): the rows that one hop shuffles, forward and backward."""
        rows = []
        for way, near, far in (("forward", "src", "dst"), ("backward", "dst", "src")):
            pushed = self.table(f"at_{near}").select("home", "other", far).distinct().count()
            rows.append((way, self.table(f"sends_{near}").count(), pushed))
        return self.spark.createDataFrame(rows, "way string, n_pulled long, n_pushed long")

    def hop(self, h: DataFrame, width: int, reverse: bool = False, f: Callable[[Column], Column] = F.sum, column: str = "x") -> DataFrame:
        """(home, node_id, n, c0, ...): ``f`` of each component over in-neighbours (out-neighbours if ``reverse``), and how many there are.

        ``f`` is a sum, or a maximum or minimum. h (home, node_id, x) lies by home.
        """
        near, far = ("dst", "src") if reverse else ("src", "dst")
        names = [f"c{j}" for j in range(width)]
        vectors = h.select("home", F.col("node_id").alias(near), column)

        def added(rows: DataFrame, *by: str) -> DataFrame:
            return rows.groupBy("home", *by).agg(F.count("*").alias("n"), *(f(F.col(column)[j]).alias(c) for j, c in enumerate(names)))

        def again(rows: DataFrame) -> DataFrame:
            return rows.groupBy("home", far).agg(F.sum("n").alias("n"), *(f(c).alias(c) for c in names))

        inner = added(self.table("inner").join(vectors, ["home", near]), far)
        sent = self.table(f"sends_{near}").join(h.select("home", "node_id", column), ["home", "node_id"])
        halo = self.dealt(sent.select(F.col("to").alias("home"), F.col("node_id").alias(near), column))
        pulled = added(self.table(f"at_{far}").select("home", "src", "dst").join(halo, ["home", near]), far)
        sums = added(self.table(f"at_{near}").join(vectors, ["home", near]), "other", far)
        pushed = again(self.dealt(sums.select(F.col("other").alias("home"), far, "n", *names)))
        key = ["home", "node_id"]
        found = self.table("nodes").select(*key)
        for k, rows in enumerate((inner, pulled, pushed)):  # side by side, as each lies by home
            found = found.join(rows.select("home", F.col(far).alias("node_id"), F.struct("n", *names).alias(f"r{k}")), key, "left")
        number = sum((F.coalesce(F.col(f"r{k}.n"), F.lit(0)) for k in range(3)), F.lit(0))
        merged = []
        for c in names:
            own = [F.col(f"r{k}.{c}") for k in range(3)]
            if f is F.sum:
                merged.append(sum((F.coalesce(o, F.lit(0.0)) for o in own), F.lit(0.0)).alias(c))
            else:
                merged.append((F.greatest if f is F.max else F.least)(*own).alias(c))
        return found.select(*key, number.alias("n"), *merged).where("n > 0")


@dataclass
class StoredContext(Context):
    """What layers ask for, from a store. Results are kept bucketed in ``folder``."""

    store: PartStore = field(default=None)
    folder: str = field(default=None)
    generations: list[list[str]] = field(default_factory=list)
    key = ("home", "node_id")

    @classmethod
    def over(cls, store: PartStore, folder: str | None = None) -> StoredContext:
        edges = store.table("inner").select("src", "dst").unionByName(store.table("at_src").select("src", "dst")).unionByName(store.table("at_dst").select("src", "dst"))
        return cls(store.table("nodes").select("home", "node_id"), edges, store=store, folder=folder or new_folder(store.spark, "stored"))

    @property
    def degrees(self) -> DataFrame:
        return self.store.table("nodes")

    def keep(self, rows: DataFrame) -> DataFrame:
        named = self.store.keep(rows, f"{self.folder}/{len(self.generations)}/{uuid.uuid4().hex}")
        if self.generations:
            self.generations[-1].append(named)
        return self.store.spark.table(named)

    def turn(self) -> None:
        self.generations.append([])
        old = len(self.generations) - 2
        if old > 0:
            for named in self.generations[old - 1]:
                self.store.spark.sql(f"DROP TABLE {named}")
            discard(self.store.spark, f"{self.folder}/{old}")

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with a node_id, with their home; they stay through all generations if they come before the first."""
        return self.keep(self.store.dealt(rows.join(self.store.table("nodes").select("home", "node_id"), "node_id")))

    def mapped(self, rows: DataFrame) -> DataFrame:
        return self.keep(rows)  # a step in Python forgets that its rows lie by home

    def neighbour_mean(self, h: DataFrame, width: int) -> DataFrame:
        return self.store.hop(h, width).select(*self.key, F.array(*(F.col(f"c{j}") / F.col("n") for j in range(width))).alias("a"))

    def neighbour_sum(self, h: DataFrame, width: int, reverse: bool = False) -> DataFrame:
        return self.store.hop(h, width, reverse).select(*self.key, F.array(*(f"c{j}" for j in range(width))).alias("a"))
