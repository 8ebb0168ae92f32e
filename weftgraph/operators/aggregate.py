"""Neighbour aggregation over in-edges. Vectors are array<double> columns of fixed width; h has (node_id, x).

Each hop is one join of the edges with the vectors at their source and one
grouped aggregate by destination. The aggregate is a built-in for each
component with map-side combining, so a node with very many in-edges is no
single task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.common import cut, hot_keys, join_unique, releasing
from weftgraph.graph import both_directions


#: Bytes of vectors that a partition's hash table may hold; where they are more, the join sorts. And of the vectors of hot nodes that are broadcast.
HASH_BYTES, HOT_BYTES = 128 << 20, 64 << 20
#: Components of a node up to which rows of them may go as a vector.
DENSE = 512


#: Blocks of ids for each shuffle partition, and how many times the mean block's nodes a block may hold.
BLOCKS, UNEVEN = 4, 4
#: Blocks of destinations for each partition where all their in-edges are worked on one after another; more of them even the work out.
SEQUENCE_BLOCKS = 16


@dataclass(frozen=True)
class Pairs:
    """Edges that go both ways between two kinds of nodes, each once and in one direction: rows (block, src, dst) in n partitions by the block of src.

    One shuffle serves both directions. What goes to src is summed up where the
    pairs lie, since a vector goes once to each block that needs it; what goes
    to dst is summed up there first. ``hashed``: whether a partition's vectors
    of src, and those of dst, may be hash tables.
    """

    rows: DataFrame
    block: Callable[[Column], Column]
    n: int
    hashed: tuple[bool, bool]

    @property
    def edges(self) -> DataFrame:
        return both_directions(self.rows.select("src", "dst"))

    def place(self, rows: DataFrame) -> DataFrame:
        """Rows of a node, with its block as ``block``, in the partitions of the pairs."""
        return rows.withColumn("block", self.block(F.col("node_id"))).repartition(self.n, "block")


def dealt(pairs: DataFrame, nodes: DataFrame, width: int) -> Pairs | None:
    """Pairs (src, dst), which may repeat, for vectors of a width; none unless ids of src and dst lie apart from each other and no id is missing."""
    ends = pairs.agg(*(f(c).alias(f"{name}_{c}") for c in ("src", "dst") for name, f in (("low", F.min), ("high", F.max))), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("nulls")).first()  # one row
    if ends["nulls"] or ends["low_src"] is None or not (ends["high_src"] < ends["low_dst"] or ends["high_dst"] < ends["low_src"]):
        return None
    row = 8 * width + 40
    n = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * row // HASH_BYTES))
    block = blocks(nodes.select("node_id"), partitions=n)
    needed = BLOCKS * (ends["high_dst"] - ends["low_dst"] + 1) * row  # at most
    pairs.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # None is missing; saying so gives all readers the same plan below the shuffle, which is then made once. The distinct stays in its partitions.
    known = F.col("src").isNotNull() & F.col("dst").isNotNull() & block(F.col("src")).isNotNull() & block(F.col("dst")).isNotNull()
    rows = pairs.select("src", "dst").where(known).withColumn("block", block(F.col("src"))).repartition(n, "block").distinct()
    return Pairs(rows, block, n, (True, needed <= HASH_BYTES))


@dataclass(frozen=True)
class Reach:
    """How vectors get to edges: those of hot nodes by broadcast, the others by a hash table of each partition's vectors, or by sorting.

    ``hashed`` None: as the number of vectors, counted then, allows. ``pairs``:
    the same edges as pairs, which serve in their stead where results allow.
    """

    hot: DataFrame | None = None
    hashed: bool | None = None
    pairs: Pairs | None = None


def fits(spark: SparkSession, vectors: int, width: int) -> bool:
    """Whether a partition's share of so many vectors may be a hash table."""
    return vectors * (8 * width + 40) <= HASH_BYTES * int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_nodes(degrees: DataFrame, column: str, width: int, total: int | None = None) -> DataFrame | None:
    """(node_id) of nodes with more than a share of all edges, so small that a task has room for it and so large that their vectors may be broadcast; none if there are none."""
    tasks = 8 * int(degrees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = hot_keys(degrees, ["node_id"], column, 1 / max(1, min(tasks, HOT_BYTES // (8 * width + 40))), total)
    return None if found.isEmpty() else found


def blocks(nodes: DataFrame, each: int = BLOCKS, partitions: int | None = None) -> Callable[[Column], Column]:
    """A number for each id such that ids near each other mostly share it: consecutive ranges, or a hash where ids lie too unevenly for that.

    Nodes near each other are often linked to the same nodes. So what is dealt
    by blocks has fewer partial sums of a destination, and fewer partitions
    need a source's vector, than what is dealt by single ids.
    """
    n = each * (partitions or int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ends = nodes.agg(F.min("node_id").alias("low"), F.max("node_id").alias("high"), F.count("*").alias("n")).first()  # one row
    if not ends["n"]:
        return lambda c: F.lit(0).cast("long")
    low, step = float(ends["low"]), float(max(1, -(-(ends["high"] - ends["low"] + 1) // n)))
    ranges = lambda c: F.floor(F.least(F.greatest((c.cast("double") - low) / step, F.lit(-1.0)), F.lit(float(n)))).cast("long")
    largest = nodes.groupBy(ranges(F.col("node_id")).alias("block")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]  # of n rows
    return ranges if largest <= UNEVEN * max(1.0, ends["n"] / n) else lambda c: F.pmod(F.xxhash64(c), F.lit(n))


def at_end(edges: DataFrame, nodes: DataFrame, end: str, width: int, *columns: str, reach: Reach = Reach()) -> DataFrame:
    """The edges with columns of the node at one end. A hash table is of the nodes; left to itself, the planner may build it of the edges and stream the nodes through few tasks."""
    hashed = fits(edges.sparkSession, nodes.count(), width) if reach.hashed is None else reach.hashed
    hint = "shuffle_hash" if hashed else "merge"
    right = nodes.select(F.col("node_id").alias(end), *columns)
    if reach.hot is None:
        return edges.join(right.hint(hint), end)
    return join_unique(edges, right, [end], hot=reach.hot.withColumnRenamed("node_id", end), hint=hint)


def _over_edges(edges: DataFrame, h: DataFrame, width: int, reach: Reach, column: str = "x") -> DataFrame:
    """The edges with vectors of their sources. Edges of hot sources are first brought near others of their destination, so that no task adds up vectors for all nodes; Spark splits what is large."""
    edges = edges.select("src", "dst")
    if reach.hot is None:
        return _by_block(edges, h, width, reach, column)
    held = F.broadcast(reach.hot.withColumnRenamed("node_id", "src"))
    cold = at_end(edges.join(held, "src", "left_anti"), h, "src", width, column, reach=Reach(None, reach.hashed))
    vectors = h.select(F.col("node_id").alias("src"), column).join(held, "src", "left_semi")
    return cold.unionByName(edges.join(held, "src", "left_semi").hint("rebalance", "dst").join(F.broadcast(vectors), "src"))


def _by_block(edges: DataFrame, h: DataFrame, width: int, reach: Reach, column: str) -> DataFrame:
    """The edges with vectors of their sources, joined in partitions by the sources' blocks, which the session must let a join keep."""
    edges.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    hashed = fits(edges.sparkSession, h.count(), width) if reach.hashed is None else reach.hashed
    block, n = blocks(h.select("node_id")), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = edges.withColumn("block", block(F.col("src"))).repartition(n, "block")
    right = h.select(F.col("node_id").alias("src"), column).withColumn("block", block(F.col("src"))).repartition(n, "block")
    return left.join(right.hint("shuffle_hash" if hashed else "merge"), ["block", "src"]).drop("block")


def _components(column: str, width: int, f) -> list[Column]:
    return [f(F.col(column)[j]).alias(f"c{j}") for j in range(width)]


def _packed(rows: DataFrame, width: int, name: str = "a") -> DataFrame:
    return rows.select(F.col("dst").alias("node_id"), F.array(*(f"c{j}" for j in range(width))).alias(name))


def _both_ways(pairs: Pairs, placed: DataFrame, aggregates: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(dst, aggregates) of the nodes at the pairs' dst, and (block, dst, aggregates) of those at their src, where the pairs lie; placed has (block, node_id, x)."""
    hint = ["shuffle_hash" if hashed else "merge" for hashed in pairs.hashed]
    own = placed.select("block", F.col("node_id").alias("src"), "x")
    there = pairs.rows.join(own.hint(hint[0]), ["block", "src"]).groupBy("dst").agg(*aggregates)
    needs = pairs.rows.groupBy("block", "dst").agg(F.count("*").alias("n")).where("n > 0")  # a distinct would take the place of that of the pairs, and shuffle them anew
    needs = needs.select(F.col("block").alias("at"), "dst", pairs.block(F.col("dst")).alias("block")).repartition(pairs.n, "block")
    sent = needs.join(placed.select("block", F.col("node_id").alias("dst"), "x").hint(hint[0]), ["block", "dst"]).select(F.col("at").alias("block"), "dst", "x").repartition(pairs.n, "block")
    here = pairs.rows.join(sent.hint(hint[1]), ["block", "dst"]).groupBy("block", "src").agg(*aggregates)
    return there, here.withColumnRenamed("src", "dst")


def _grouped(h: DataFrame, edges: DataFrame, width: int, reach: Reach, aggregates: list[Column]) -> DataFrame:
    """(dst, aggregates of x over in-edges)."""
    if reach.pairs is None:
        return _over_edges(edges, h, width, reach).groupBy("dst").agg(*aggregates)
    there, here = _both_ways(reach.pairs, reach.pairs.place(h.select("node_id", "x")), aggregates)
    return there.unionByName(here.drop("block"))


def _beside(placed: DataFrame, pairs: Pairs, width: int, rows: tuple[DataFrame, DataFrame], count: str) -> DataFrame:
    """placed (block, node_id, ...), which may lack no node that is asked for, with what ``_both_ways`` gives of components and a count: (count, s), null without in-edges."""
    there, here = (r.select(*key, F.col(count).alias(f"{count}{i}"), F.array(*(f"c{j}" for j in range(width))).alias(f"s{i}")) for i, (r, key) in enumerate(zip(rows, (["dst"], ["block", "dst"]), strict=True)))
    both = placed.join(pairs.place(there.withColumnRenamed("dst", "node_id")), ["block", "node_id"], "left").join(here.withColumnRenamed("dst", "node_id"), ["block", "node_id"], "left")
    return both.withColumns({count: F.coalesce(f"{count}0", f"{count}1"), "s": F.coalesce("s0", "s1")}).drop("s0", "s1", f"{count}0", f"{count}1")


def neighbour_mean(h: DataFrame, edges: DataFrame, width: int, reach: Reach = Reach()) -> DataFrame:
    """(node_id, a) for nodes with an in-edge."""
    rows = _grouped(h, edges, width, reach, [F.count("*").alias("n"), *_components("x", width, F.sum)])  # one count for all
    return rows.select(F.col("dst").alias("node_id"), F.array(*(F.col(f"c{j}") / F.col("n") for j in range(width))).alias("a"))


def neighbour_sum(h: DataFrame, edges: DataFrame, width: int, reach: Reach = Reach()) -> DataFrame:
    return _packed(_grouped(h, edges, width, reach, _components("x", width, F.sum)), width)


def neighbour_max(h: DataFrame, edges: DataFrame, width: int, reach: Reach = Reach()) -> DataFrame:
    return _packed(_grouped(h, edges, width, reach, _components("x", width, F.max)), width)


def neighbour_mean_long(long: DataFrame, edges: DataFrame, reach: Reach = Reach()) -> DataFrame:
    """The same over rows (node_id, j, v): (node_id, j, v).

    Where every node has all of the components 0 to n - 1, up to ``DENSE`` of
    them, they go along edges as one vector, and else row by row. Whether they
    have is asked in an action of its own, which leaves nothing on disk.
    """
    first, last = long.agg(F.min("j"), F.max("j")).first()  # one row
    if first == 0 and last < DENSE:
        names = [f"c{j}" for j in range(last + 1)]
        h = long.groupBy("node_id").agg(F.count("*").alias("n"), *(F.max(F.when(F.col("j") == j, F.col("v"))).alias(c) for j, c in enumerate(names)))
        h = h.select("node_id", "n", F.array(*names).alias("x"))
        with releasing(h.sparkSession):
            dense = h.where((F.col("n") != len(names)) | F.exists("x", F.isnull)).isEmpty()
        if dense:
            return neighbour_mean(h, edges, len(names), reach).select("node_id", F.posexplode("a").alias("j", "v"))
    return edges.select("src", "dst").join(long.select(F.col("node_id").alias("src"), "j", "v"), "src").groupBy("dst", "j").agg(F.avg("v").alias("v")).withColumnRenamed("dst", "node_id")


def self_and_neighbour_mean(h: DataFrame, edges: DataFrame, width: int, reach: Reach = Reach()) -> DataFrame:
    """(own vector + sum of in-neighbours) / (in-degree + 1), for every node of h."""
    aggregates = [F.count("*").alias("din"), *_components("x", width, F.sum)]
    if reach.pairs is None:
        rows = _over_edges(edges, h, width, reach).groupBy("dst").agg(*aggregates)
        rows = rows.select(F.col("dst").alias("node_id"), "din", F.array(*(f"c{j}" for j in range(width))).alias("s"))
        both = h.select("node_id", "x").join(rows, "node_id", "left")
    else:
        placed = reach.pairs.place(h.select("node_id", "x"))
        both = _beside(placed, reach.pairs, width, _both_ways(reach.pairs, placed, aggregates), "din")
    own = F.when(F.col("s").isNull(), F.col("x")).otherwise(F.zip_with("x", "s", lambda x, s: (x + s) / (F.col("din") + 1)))
    return both.select("node_id", own.alias("a"))


def degree_normalised_sum(h: DataFrame, edges: DataFrame, degrees: DataFrame, width: int, every: bool = False, reach: Reach = Reach()) -> DataFrame:
    """Sum of x_u / sqrt(dout_u * din_v) with the degrees of the whole graph, at least 1; zeros for nodes without in-edges if ``every``."""
    root = lambda c: F.sqrt(F.greatest(c, F.lit(1)))
    scaled = F.transform("x", lambda v: v / F.col("root")).alias("x")
    divided = lambda s: F.coalesce(F.transform(s, lambda v: v / F.col("root")), F.array_repeat(F.lit(0.0), width)).alias("a")
    if reach.pairs is None:
        out = degrees.select("node_id", root("dout").alias("root"))
        rows = neighbour_sum(h.select("node_id", "x").join(out, "node_id").select("node_id", scaled), edges, width, reach)
        into = degrees.select("node_id", root("din").alias("root"))
        return into.join(rows, "node_id", "left" if every else "inner").select("node_id", divided("a"))
    roots = reach.pairs.place(degrees.select("node_id", root("dout").alias("out"), root("din").alias("into")))
    placed = reach.pairs.place(h.select("node_id", "x")).join(roots.withColumnRenamed("out", "root"), ["block", "node_id"]).select("block", "node_id", scaled)
    rows = _both_ways(reach.pairs, placed, [F.count("*").alias("n"), *_components("x", width, F.sum)])
    both = _beside(roots.withColumnRenamed("into", "root"), reach.pairs, width, rows, "n")
    return (both if every else both.where("n is not null")).select("node_id", divided("s"))


def max_pooled(h: DataFrame, edges: DataFrame, width: int, reach: Reach = Reach()) -> DataFrame:
    """(node_id, a, at): each component's maximum over in-neighbours, and the least neighbour that has it."""
    best = [F.max(F.struct(F.col("x")[j].alias("v"), (-F.col("src")).alias("u"))).alias(f"m{j}") for j in range(width)]
    rows = _over_edges(edges, h, width, reach).groupBy("dst").agg(*best)
    return rows.select(F.col("dst").alias("node_id"), F.array(*(f"m{j}.v" for j in range(width))).alias("a"), F.array(*(-F.col(f"m{j}.u") for j in range(width))).alias("at"))


def zero_filled(nodes: DataFrame, rows: DataFrame, column: str, width: int) -> DataFrame:
    zeros = F.array_repeat(F.lit(0.0), width)
    return nodes.select("node_id").join(rows.select("node_id", column), "node_id", "left").withColumn(column, F.coalesce(column, zeros))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-v))


def _runs(dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each run of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1])))
    return starts, np.diff(np.append(starts, len(dst)))


def _lstm(weights: np.ndarray, recurrent: np.ndarray, bias: np.ndarray, each: bool):
    """Runs over (dst, x, src) sorted by dst and src; gives each edge's step, or only each node's last state."""
    d = recurrent.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried, met = None, np.zeros((2, d)), 0
        for batch in batches:
            if not len(batch):
                continue
            dst = batch.column(0).to_numpy()
            fed = matrix(batch.column(1)) @ weights + bias
            starts, sizes = _runs(dst)
            state, cell, at = np.zeros((len(starts), d)), np.zeros((len(starts), d)), np.zeros(len(starts), np.int64)
            if last is not None and last == dst[0]:
                (state[0], cell[0]), at[0] = carried, met
            elif last is not None and not each:
                yield _states([last], carried[:1])
            before = np.zeros((2, len(dst), d) if each else (0, 0, 0))
            for step in range(int(sizes.max())):
                on = np.flatnonzero(sizes > step)
                if each:
                    before[:, starts[on] + step] = state[on], cell[on]
                i, f, g, o = np.split(fed[starts[on] + step] + state[on] @ recurrent, 4, axis=1)
                cell[on] = _sigmoid(f) * cell[on] + _sigmoid(i) * np.tanh(g)
                state[on] = _sigmoid(o) * np.tanh(cell[on])
            if each:
                number = np.arange(len(dst)) - np.repeat(starts - at, sizes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), arrays(before[0]), arrays(before[1])], ["dst", "x", "src", "at", "state", "cell"])
            else:
                yield _states(dst[starts[:-1]], state[:-1])
            last, carried, met = dst[-1], np.stack([state[-1], cell[-1]]), int(at[-1] + sizes[-1])
        if last is not None and not each:
            yield _states([last], carried[:1])

    return run


def lstm_aggregate(h: DataFrame, edges: DataFrame, weights: np.ndarray, recurrent: np.ndarray, bias: np.ndarray, reach: Reach = Reach()) -> DataFrame:
    """(node_id, a): last hidden state of an LSTM over a node's in-neighbours in the order of their ids.

    Edges are dealt by destination and sorted. All nodes of a batch step
    together from one in-neighbour to the next, and the state of a node whose
    in-edges go on is carried to the next batch. The aggregate depends on the
    order, so one node's in-edges are one task's work: a large in-degree takes
    time, but no memory. Gates are in the order input, forget, cell, output;
    weights (d, 4 d), recurrent (d, 4 d).
    """
    return _sequences(edges, h, len(weights), reach).mapInArrow(_lstm(weights, recurrent, bias, False), "node_id long, a array<double>")


def lstm_steps(h: DataFrame, edges: DataFrame, weights: np.ndarray, recurrent: np.ndarray, bias: np.ndarray, reach: Reach = Reach()) -> DataFrame:
    """(dst, x, src, at, state, cell): each edge's place in its sequence, and the states before it."""
    return _sequences(edges, h, len(weights), reach).mapInArrow(_lstm(weights, recurrent, bias, True), "dst long, x array<double>, src long, at long, state array<double>, cell array<double>")


def _sequences(edges: DataFrame, h: DataFrame, width: int, reach: Reach) -> DataFrame:
    """(dst, x, src), all in-edges of a node in one partition in the order of their sources.

    Sums cannot be combined before the shuffle, but a vector goes once to each
    block of destinations that needs it, and not along every edge. Edges are
    sorted before they meet their vectors, by hash tables that keep the order;
    sorted after, each would bring its vector to the sort's memory and disk.
    What blocks need is counted, so that a partition's vectors fit.
    """
    edges.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    block, n = blocks(h.select("node_id"), SEQUENCE_BLOCKS), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.select("src", "dst", block(F.col("dst")).alias("block"))
    with releasing(edges.sparkSession):
        needs = cut(dealt.select("block", "src").distinct())
    n = max(n, -(-needs.count() * (8 * width + 40) // HASH_BYTES))
    vectors = at_end(needs, h, "src", width, "x", reach=reach).repartition(n, "block")
    # A number of each edge keeps the planner from dropping the sort below the join; the one above finds its order there and is dropped instead.
    rows = dealt.repartition(n, "block").sortWithinPartitions("dst", "src").withColumn("at", F.monotonically_increasing_id())
    rows = rows.join(vectors.hint("shuffle_hash"), ["block", "src"]).where("at >= 0")
    return rows.sortWithinPartitions("dst", "src").select("dst", "x", "src")


def lstm_gradient(steps: DataFrame, g: DataFrame, weights: np.ndarray, recurrent: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(src, x, state, dx, dz) of each edge, from the gradient g (node_id, g) at the last states.

    The steps are gone through backwards, again all nodes of a batch together,
    with two gradients carried from edge to edge.
    """
    d = recurrent.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, np.zeros((2, d))
        for batch in batches:
            if not len(batch):
                continue
            dst, (x, state, cell, given) = batch.column(0).to_numpy(), (matrix(batch.column(k)) for k in (2, 3, 4, 5))
            starts, sizes = _runs(dst)
            dh, dc = given[starts], np.zeros((len(starts), d))
            if last is not None and last == dst[0]:
                dh[0], dc[0] = carried
            i, f, c, o = np.split(x @ weights + state @ recurrent + bias, 4, axis=1)
            i, f, c, o = _sigmoid(i), _sigmoid(f), np.tanh(c), _sigmoid(o)
            now = np.tanh(f * cell + i * c)
            dz = np.zeros((len(dst), 4 * d))
            for step in range(int(sizes.max())):
                on = np.flatnonzero(sizes > step)
                r = starts[on] + step
                inner = dc[on] + dh[on] * o[r] * (1 - now[r] ** 2)
                dz[r] = np.hstack([inner * c[r] * i[r] * (1 - i[r]), inner * cell[r] * f[r] * (1 - f[r]), inner * i[r] * (1 - c[r] ** 2), dh[on] * now[r] * o[r] * (1 - o[r])])
                dh[on], dc[on] = dz[r] @ recurrent.T, inner * f[r]
            last, carried = dst[-1], np.stack([dh[-1], dc[-1]])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), arrays(dz @ weights.T), arrays(dz)], ["src", "x", "state", "dx", "dz"])

    rows = steps.join(g.select(F.col("node_id").alias("dst"), "g"), "dst").repartition("dst").sortWithinPartitions("dst", F.desc("at"))
    return rows.select("dst", "src", "x", "state", "cell", "g").mapInArrow(run, "src long, x array<double>, state array<double>, dx array<double>, dz array<double>")


def _states(ids, states: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(ids, np.int64)), arrays(states)], ["node_id", "a"])


def linear(rows: DataFrame, inputs: list[tuple[str, np.ndarray]], bias: np.ndarray | None, out: str = "z") -> DataFrame:
    """Adds ``out``: the sum over (column, matrix) of column times matrix, plus bias, by Arrow batches."""
    names = rows.columns
    kinds = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = sum(matrix(batch.column(names.index(c))) @ w for c, w in inputs)
            total = total + bias if bias is not None else total
            yield pa.RecordBatch.from_arrays([*batch.columns, arrays(total)], [*names, out])

    return rows.mapInArrow(run, kinds)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix; a null row is not allowed."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def arrays(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width) if width else np.zeros(n + 1), pa.int32()), pa.array(np.ascontiguousarray(values).reshape(-1), pa.float64()))


def _leaky(v: Column, slope: float) -> Column:
    return F.when(v > 0, v).otherwise(v * slope)


def _scored(edges: DataFrame, heads: DataFrame, n_heads: int, slope: float, reach: tuple[Reach, Reach], width: int, *carried: str) -> DataFrame:
    """(src, dst, carried columns of src, top, w): by head, the largest score at dst, and exp(score - that one) of each edge.

    Scores grow with el, so the largest at a node comes from the largest el of
    its in-neighbours: one grouped maximum over the edges, joined to the nodes.
    """
    most = at_end(edges.select("src", "dst"), heads, "src", n_heads, "el", reach=reach[0]).groupBy("dst").agg(*_components("el", n_heads, F.max))
    right = _packed(most, n_heads, "most").join(heads.select("node_id", "er"), "node_id")
    right = right.select("node_id", "er", F.zip_with("most", "er", lambda m, r: _leaky(m + r, slope)).alias("top"))
    rows = at_end(edges.select("src", "dst"), heads, "src", width + n_heads, "el", *carried, reach=reach[0])
    rows = at_end(rows, right, "dst", 2 * n_heads, "er", "top", reach=reach[1])
    w = F.transform(F.arrays_zip("el", "er", "top"), lambda t: F.exp(_leaky(t["el"] + t["er"], slope) - t["top"]))
    return rows.select("src", "dst", *carried, "top", w.alias("w"))


def edge_softmax(edges: DataFrame, heads: DataFrame, n_heads: int, slope: float = 0.2, reach: tuple[Reach, Reach] = (Reach(), Reach())) -> DataFrame:
    """(src, dst, alpha): attention of each in-edge by head; heads has (node_id, el, er), arrays by head.

    The sum by destination is a grouped aggregate joined back, so that no
    node's in-edges are gathered.
    """
    rows = cut(_scored(edges, heads, n_heads, slope, _measured(heads, 2 * n_heads, reach), 0))
    total = _packed(rows.groupBy("dst").agg(*_components("w", n_heads, F.sum)), n_heads, "total").withColumnRenamed("node_id", "dst")
    total = total.withColumnRenamed("dst", "node_id")
    return at_end(rows, total, "dst", n_heads, "total", reach=_measured(heads, 2 * n_heads, reach)[1]).select("src", "dst", F.zip_with("w", "total", lambda w, t: w / t).alias("alpha"))


def _measured(heads: DataFrame, width: int, reach: tuple[Reach, Reach]) -> tuple[Reach, Reach]:
    """The same, with the choice between hashing and sorting made once for all joins."""
    if all(r.hashed is not None for r in reach):
        return reach
    hashed = fits(heads.sparkSession, heads.count(), width)
    return tuple(Reach(r.hot, hashed) for r in reach)


def attended_sum(edges: DataFrame, heads: DataFrame, n_heads: int, width: int, slope: float = 0.2, factor: Column | None = None, reach: tuple[Reach, Reach] = (Reach(), Reach())) -> DataFrame:
    """(node_id, s, lse): by head, the attention-weighted sum of q (heads laid end to end) over in-edges; heads has (node_id, q, el, er).

    One grouped aggregate: weights and weighted sums are divided at the node.
    ``factor`` (by head, of src and dst) multiplies what an edge passes on. lse
    is the logarithm of the sum of the scores' exponentials, by head.
    """
    rows = _scored(edges, heads, n_heads, slope, _measured(heads, n_heads * (width + 1), reach), n_heads * width, "q").withColumn("f", F.lit(None) if factor is None else factor)
    passed = lambda k: F.col("w")[k] if factor is None else F.col("w")[k] * F.col("f")[k]
    sums = [F.sum(passed(k) * F.col("q")[k * width + j]).alias(f"c{k * width + j}") for k in range(n_heads) for j in range(width)]
    tops = [F.max(F.col("top")[k]).alias(f"m{k}") for k in range(n_heads)]  # one value at a node
    rows = rows.groupBy("dst").agg(*sums, *(F.sum(F.col("w")[k]).alias(f"t{k}") for k in range(n_heads)), *tops)
    shares = F.array(*(F.col(f"c{k * width + j}") / F.col(f"t{k}") for k in range(n_heads) for j in range(width)))
    return rows.select(F.col("dst").alias("node_id"), shares.alias("s"), F.array(*(F.col(f"m{k}") + F.log(f"t{k}") for k in range(n_heads))).alias("lse"))


def attention_gradient(edges: DataFrame, heads: DataFrame, n_heads: int, width: int, slope: float = 0.2, factor: Column | None = None, reach: tuple[Reach, Reach] = (Reach(), Reach())) -> tuple[DataFrame, DataFrame]:
    """((node_id, dl, dq), (node_id, dr)): gradients at el and q as a source and at er as a destination, from ds at ``attended_sum``'s s.

    heads has (node_id, q, el, er, ds, lse, total); total, by head, is s times
    ds, which is what the weighted gradients of a node's in-edges sum up to. So
    an edge's gradient needs its two ends alone, and two passes over the edges
    do, one for each end; nothing of an edge is stored.
    """
    reach = _measured(heads, n_heads * (width + 3), reach)
    rows = at_end(edges.select("src", "dst"), heads, "src", n_heads * (width + 1), "el", "q", reach=reach[0])
    rows = at_end(rows, heads, "dst", n_heads * (width + 3), "er", "lse", "total", "ds", reach=reach[1])
    alpha = F.transform(F.arrays_zip("el", "er", "lse"), lambda t: F.exp(_leaky(t["el"] + t["er"], slope) - t["lse"]))
    rows = rows.withColumn("alpha", alpha).withColumn("f", F.array_repeat(F.lit(1.0), n_heads) if factor is None else factor)

    def at_score(k: int) -> Column:
        product = sum((F.col("q")[k * width + j] * F.col("ds")[k * width + j] for j in range(width)), F.lit(0.0))
        return F.col("alpha")[k] * (F.col("f")[k] * product - F.col("total")[k]) * F.when(F.col("el")[k] + F.col("er")[k] > 0, 1.0).otherwise(slope)

    rows = rows.withColumn("de", F.array(*(at_score(k) for k in range(n_heads))))
    scores = _components("de", n_heads, F.sum)
    passed = [F.sum(F.col("alpha")[k] * F.col("f")[k] * F.col("ds")[k * width + j]).alias(f"p{k * width + j}") for k in range(n_heads) for j in range(width)]
    packed = lambda name, n: F.array(*(f"{name}{j}" for j in range(n)))
    out = rows.groupBy("src").agg(*scores, *passed).select(F.col("src").alias("node_id"), packed("c", n_heads).alias("dl"), packed("p", n_heads * width).alias("dq"))
    into = rows.groupBy("dst").agg(*scores).select(F.col("dst").alias("node_id"), packed("c", n_heads).alias("dr"))
    return out, into
