import pytest
from pyspark.sql import functions as F

from weftgraph.common import cut
from weftgraph.graph import Graph, fill_missing, gather, graph_of_edges, masks_by_position, num_classes, num_nodes, scatter
from weftgraph.operators import aggregate as agg
from weftgraph.operators import classify, partitioning
from weftgraph.plans import bins
from weftgraph.plans.prepare import grid, prepare, run_grid
from weftgraph.sources import registry, sinks, text
from weftgraph.sources.fixtures import karate, simple_graph


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def parts_of(spark, ids):
    return spark.createDataFrame(list(enumerate(ids)), "node_id long, part_id int")


def classes(df, part):
    found = {"D": set(), "I": set(), "H": set()}
    for r in df.where(F.col("part_id") == part).collect():
        found[r["cls"]].add(r["node_id"])
    return found


def test_simple_graph_shape(spark):
    graph = simple_graph(spark)
    s = graph.stats().first()
    assert (s["n_nodes"], s["n_edges"], s["n_train"], s["n_val"], s["n_test"]) == (9, 14, 3, 3, 3)
    assert [r["label"] for r in graph.nodes.orderBy("node_id").collect()] == [0, 1] * 4 + [0]
    assert num_classes(graph.nodes).first()[0] == 2
    assert num_nodes(graph.edges).first()[0] == 9
    assert len(simple_graph(spark, prob=True, feat_size=3).nodes.first()["features"]) == 3


def test_karate_has_78_ties_both_ways(spark):
    graph = karate(spark)
    assert graph.edges.count() == 156
    assert graph.symmetrised().edges.count() == 156
    degrees = {r["node_id"]: r["din"] for r in graph.degrees().collect()}
    assert degrees[33] == 17 and degrees[0] == 16 and degrees[11] == 1


def test_loops_and_symmetry(spark):
    edges = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (2, 1)], "src long, dst long")
    graph = graph_of_edges(edges)
    assert graph.without_self_loops().edges.count() == 3
    assert rows(graph.with_self_loops().edges.distinct(), "src", "dst") == [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2)]
    assert rows(graph.symmetrised().edges, "src", "dst") == [(0, 0), (0, 1), (1, 0), (1, 2), (2, 1)]
    empty = graph_of_edges(edges.limit(0))
    assert empty.nodes.count() == 0 and num_nodes(empty.edges).first()[0] == 0


def test_chunk_and_classes_of_the_simple_graph(spark):
    graph = simple_graph(spark)
    parts = partitioning.chunk_parts(graph.nodes, 2)
    assert [p for _, p in rows(parts, "node_id", "part_id")] == [0] * 5 + [1] * 4
    directed = classify.node_classes(graph.edges, parts)
    assert classes(directed, 0) == {"D": {4}, "I": {0, 1, 2, 3}, "H": {5}}
    assert classes(directed, 1) == {"D": set(), "I": {5, 6, 7, 8}, "H": set()}
    both = classify.node_classes(graph.symmetrised().edges, parts)
    assert classes(both, 1) == {"D": {5}, "I": {6, 7, 8}, "H": {4}}


@pytest.mark.parametrize("method", ["random", "hash", "chunk", "grown"])
def test_partition_properties(spark, method):
    p = prepare(karate(spark), 3, method)
    parts = {r["node_id"]: r["part_id"] for r in p.parts.collect()}
    assert len(parts) == 34 and set(parts.values()) <= {0, 1, 2}
    found = p.classes.collect()
    for k in set(parts.values()):
        own = {c: {r["node_id"] for r in found if r["part_id"] == k and r["cls"] == c} for c in "DIH"}
        assert own["D"] | own["I"] == {n for n, q in parts.items() if q == k}
        assert not own["D"] & own["I"] and not own["H"] & (own["D"] | own["I"])
    plan = p.exchange.collect()
    assert all(parts[r["node_id"]] == r["owner_part"] != r["consumer_part"] for r in plan)
    assert {(r["consumer_part"], r["node_id"]) for r in plan} == {(r["part_id"], r["node_id"]) for r in found if r["cls"] == "H"}
    book = p.book.orderBy("part_id").collect()
    assert book[0]["lo"] == 0 and book[-1]["hi"] == 34


def test_grown_parts_are_even(spark):
    sizes = [r["count"] for r in partitioning.grown_parts(karate(spark), 4).groupBy("part_id").count().collect()]
    assert sum(sizes) == 34 and max(sizes) - min(sizes) <= 1


def test_swap_loop_ends_by_its_stop_rule(spark, monkeypatch):
    from weftgraph import queries

    graph, swaps, choose = karate(spark), [], partitioning._choose
    monkeypatch.setattr(queries, "co_located", lambda spark, sf_dir: (graph, partitioning.chunk_parts(graph.nodes, 4)))
    monkeypatch.setattr(partitioning, "_choose", lambda *a, **b: swaps.append(1) or choose(*a, **b))
    assert queries.QUERIES["swap_loop"](spark, "").count() == 34
    assert len(swaps) > 10 and len(swaps) % 10 == 1  # a check that compares two rates
    with pytest.warns(UserWarning, match="max_iter=1"):
        partitioning.refine(graph, partitioning.chunk_parts(graph.nodes, 4), max_iter=1)


def test_swap_golden_steps(spark):
    graph = simple_graph(spark).symmetrised()
    parts = partitioning.chunk_parts(graph.nodes, 2)
    counts = partitioning.member_counts(graph.edges, parts)
    outside = partitioning.dependencies(counts, parts)
    assert rows(partitioning.dependency_sizes(outside, parts), "part_id", "n") == [(0, 1), (1, 1)]
    swap = partitioning.choose_swap(graph.edges, parts, counts).first()
    assert tuple(swap) == (1, 0, 5, 4)
    parts, counts = partitioning.swapped(parts, *swap), partitioning.swap_counts(graph.edges, counts, *swap)
    assert [p for _, p in rows(parts, "node_id", "part_id")] == [0, 0, 0, 0, 1, 0, 1, 1, 1]
    outside = partitioning.dependencies(counts, parts)
    assert rows(outside, "part_id", "node_id", "cnt") == [(0, 4, 2), (0, 6, 1), (0, 7, 1), (0, 8, 1), (1, 3, 1), (1, 5, 4)]
    assert partitioning.balance_rate(partitioning.dependency_sizes(outside, parts)).first()[0] == 0.5
    again = partitioning.choose_swap(graph.edges, parts, counts).first()
    assert (again["ps"], again["ns"], again["nt"]) == (0, 5, 4)


def test_refine_keeps_sizes_and_the_best(spark):
    graph = simple_graph(spark)
    parts = partitioning.chunk_parts(graph.nodes, 2)
    last = partitioning.refine(graph, parts, max_iter=2)
    assert sorted(r["count"] for r in last.groupBy("part_id").count().collect()) == [4, 5]
    best = partitioning.refine(graph, parts, max_iter=2, keep_best=True, psd="union")
    assert best.count() == 9


def test_refine_counts_by_deltas_and_logs(spark):
    graph = karate(spark)
    start = partitioning.hashed_parts(graph.nodes, 3)
    log = []
    with pytest.warns(UserWarning):
        end = partitioning.refine(graph, start, max_iter=4, swaps=2, log=log)
    sizes = lambda p: sorted(r["count"] for r in p.groupBy("part_id").count().collect())
    assert sizes(start) == sizes(end) and [r["iteration"] for r in log] == list(range(len(log)))
    edges = graph.edges.distinct()
    found = [r["n"] for r in partitioning.dependency_sizes(partitioning.dependencies(partitioning.member_counts(edges, end), end), end).collect()]
    assert (log[-1]["least"], log[-1]["most"]) == (min(found), max(found)) and all(r["swapped"] <= 2 for r in log)
    cut_of = {m: partitioning.edge_cut(edges, partitioning.partition(graph, 2, m)).first() for m in ("hash", "grown")}
    assert cut_of["grown"]["n_cut"] < cut_of["hash"]["n_cut"] and cut_of["grown"]["n_edges"] == 156


def test_exclusive_and_report(spark):
    graph = simple_graph(spark).symmetrised()
    parts = parts_of(spark, [0, 0, 0, 1, 1, 1, 2, 2, 2])
    crossing = classify.boundary(graph.edges, parts)
    want = {}
    owner = dict(enumerate([0, 0, 0, 1, 1, 1, 2, 2, 2]))
    needs = {}
    for r in graph.edges.collect():
        if owner[r["src"]] != owner[r["dst"]]:
            needs.setdefault(r["dst"], set()).add(owner[r["src"]])
    for n, owners in needs.items():
        if len(owners) == 1:
            key = (owner[n], next(iter(owners)))
            want[key] = want.get(key, 0) + 1
    assert {(a, b): n for a, b, n in rows(classify.exclusive_dependencies(crossing), "part_id", "owner_part", "n")} == want
    for r in classify.report(graph.edges, parts).collect():
        assert r["n_all"] == r["n_local"] + r["n_remote"]


def test_bins(spark):
    graph = simple_graph(spark).symmetrised()
    parts = partitioning.chunk_parts(graph.nodes, 2)
    naive = rows(bins.naive(parts, 2), "node_id", "bin_id")
    assert [b for _, b in naive] == [0, 0, 1, 1, 2, 0, 0, 1, 1]
    prio = dict(rows(bins.priority(classify.node_classes(graph.edges, parts), 2), "node_id", "bin_id"))
    assert prio == {0: 1, 1: 1, 2: 2, 3: 2, 4: 0, 5: 0, 6: 1, 7: 1, 8: 2}
    assert bins.scaled_bin_size(10, 1, 4, 16) == 10 and bins.scaled_bin_size(10, 1, 64, 16) == 40


def test_mean_in_neighbours_of_the_simple_graph(spark):
    graph = simple_graph(spark)
    h = graph.nodes.select("node_id", F.col("features").cast("array<double>").alias("x"))
    got = {r["node_id"]: r["a"][0] for r in agg.neighbour_mean(h, graph.edges, 1).collect()}
    assert got == {1: 0, 2: 0.5, 3: 1, 4: 4, 5: 7, 6: 7.5, 7: 8}
    long = agg.neighbour_mean_long(h.select("node_id", F.posexplode("x").alias("j", "v")), graph.edges)
    assert {r["node_id"]: r["v"] for r in long.collect()} == got
    filled = fill_missing(graph.nodes, agg.neighbour_mean(h, graph.edges, 1), "a", 1)
    assert {r["node_id"]: r["a"][0] for r in filled.collect()} == got | {0: 0, 8: 0}
    new = h.where("node_id = 3").select("node_id", F.array(F.lit(-1.0)).alias("x"))
    assert [r["x"][0] for r in scatter(h, new, "x").orderBy("node_id").collect()][:5] == [0, 1, 2, -1, 4]
    assert gather(h, new).count() == 1


def test_text_formats(spark, tmp_path):
    graph = karate(spark)
    text.write_adjacency(graph, f"{tmp_path}/g")
    nodes, edges = text.read_adjacency(spark, f"{tmp_path}/g")
    assert nodes.count() == 34 and rows(edges, "src", "dst") == rows(graph.edges, "src", "dst")
    (tmp_path / "by_hand").write_text("3 1\n2 2\n\n\n")
    nodes, edges = text.read_adjacency(spark, f"{tmp_path}/by_hand")
    assert nodes.count() == 3 and rows(edges, "src", "dst") == [(0, 1)]
    parts = partitioning.hashed_parts(graph.nodes, 3)
    text.write_assignment(parts, f"{tmp_path}/p")
    assert rows(text.read_assignment(spark, f"{tmp_path}/p"), "node_id", "part_id") == rows(parts, "node_id", "part_id")
    (tmp_path / "e.txt").write_text("0 1\n 1\t2 \n\nnot an edge\n")
    assert rows(text.cached_edges(spark, f"{tmp_path}/e.txt", f"{tmp_path}/e.parquet"), "src", "dst") == [(0, 1), (1, 2)]
    (tmp_path / "e.txt").unlink()
    assert text.cached_edges(spark, f"{tmp_path}/e.txt", f"{tmp_path}/e.parquet").count() == 2


def test_multilabel_folder(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), 5.0]) for i in range(4)], "node_id long, features array<double>").write.parquet(f"{tmp_path}/nodes.parquet")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (2, 2)], "src long, dst long")
    edges.write.parquet(f"{tmp_path}/adj_full.parquet")
    edges.where("src < 2").write.parquet(f"{tmp_path}/adj_train.parquet")
    (tmp_path / "role.json").write_text('{"tr": [0, 1], "va": [2], "te": [3]}')
    (tmp_path / "class_map.json").write_text('{"0": [1, 0], "2": [1, 1]}')
    graph = text.load_multilabel(spark, str(tmp_path), 2)
    found = {r["node_id"]: r for r in graph.nodes.collect()}
    assert [found[i]["features"][0] for i in range(4)] == [-1, 1, 3, 5] and found[0]["features"][1] == 0
    assert [list(found[i]["labels"]) for i in range(4)] == [[1, 0], [0, 0], [1, 1], [0, 0]]
    assert [found[i]["train_mask"] for i in range(4)] == [True, True, False, False] and found[3]["test_mask"]
    assert graph.edges.where("src = dst").count() == 4


def test_part_files(spark, tmp_path):
    graph = simple_graph(spark)
    parts = partitioning.chunk_parts(graph.nodes, 2)
    sinks.materialise(graph, parts, str(tmp_path))
    part = sinks.load_part(spark, str(tmp_path), 0)
    assert rows(part.nodes, "node_id", "is_local") == [(0, True), (1, True), (2, True), (3, True), (4, True), (5, False)]
    assert part.edges.count() == 8


def test_registry(spark):
    assert registry.describe("ogbn-products").n_classes == 47
    assert registry.describe("my-cora", 5).in_feats == 5
    assert registry.describe("amazon").multilabel and registry.describe("yelp").multilabel
    with pytest.raises(KeyError):
        registry.describe("unheard of")
    assert registry.load(spark, "simple+loop").edges.count() == 23
    nodes = spark.createDataFrame([(0, [1.0]), (1, [float("nan")])], "node_id long, labels array<double>")
    assert [r["label"] for r in registry.canonical_names(nodes).orderBy("node_id").collect()] == [1, None]
    looped = registry.load(spark, "simple+loop", prob=True).edges
    assert looped.columns == ["src", "dst", "prob"] and looped.where("prob is null").count() == 0
    web = registry.web_graph(spark.createDataFrame([(0, 1), (1, 9)], "src long, dst long"), 4)
    s = web.stats().first()
    assert (s["n_train"], s["n_val"], s["n_test"], s["n_edges"]) == (7, 2, 1, 12)


def test_folder_with_index_lists(spark, tmp_path):
    spark.createDataFrame([(i, [0.5, float(i)], [float("nan") if i == 3 else float(i % 2)]) for i in range(4)], "node_id long, feat array<double>, labels array<double>").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([(0, 1), (2, 2)], "src long, dst long").write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([(0, "train"), (1, "valid"), (2, "test"), (3, "test")], "node_id long, split string").write.parquet(f"{tmp_path}/split.parquet")
    graph = registry.load(spark, "ogbn-products", str(tmp_path))
    found = {r["node_id"]: r for r in graph.nodes.collect()}
    assert [found[i]["label"] for i in range(4)] == [0, 1, 0, None] and [found[i]["train_mask"] for i in range(4)] == [True, False, False, False]
    assert graph.edges.count() == 5 and num_classes(graph.nodes).first()[0] == 2
    sinks.write_graph(graph, f"{tmp_path}/again")
    assert registry.load(spark, "pubmed", f"{tmp_path}/again").edges.count() == 5


def test_series_of_runs(spark):
    found = run_grid(simple_graph(spark), 2, grid(method=["chunk", "hash"]))
    assert {(r["run"], r["part_id"]) for r in found.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_small_helpers(spark):
    assert grid(a=[1, 2], b=["x"]) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    nodes = spark.range(10).withColumnRenamed("id", "node_id")
    assert nodes.withColumns(masks_by_position(10)).where("val_mask").count() == 2
    inner = Graph(nodes.withColumns(masks_by_position(10)), spark.createDataFrame([(0, 1), (6, 7), (7, 8)], "src long, dst long")).inductive()
    assert [g.edges.count() for g in inner] == [1, 3, 3]


def test_hot_sources_are_spread(spark):
    """One source on a third of all edges: no task of the join has three times the median's rows, and the hop is the plain one."""
    n = 60_000
    edges = spark.range(n).repartition(8).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(4000))).cast("long").alias("src"), (F.col("id") % 997).alias("dst"))
    edges = cut(edges)
    h = spark.range(4000).select(F.col("id").alias("node_id"), F.array(F.col("id") / 8.0, F.lit(1.0)).alias("x"))
    degrees = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("dout"))
    hot = agg.hot_nodes(degrees, "dout", 2)
    assert [r["node_id"] for r in hot.collect()] == [5]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8"), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = [r["count"] for r in agg.at_end(edges, h, "src", 2, "x", reach=agg.Reach(hot, True)).groupBy(F.spark_partition_id()).count().collect()]
        alone = [r["count"] for r in agg.at_end(edges, h, "src", 2, "x", reach=agg.Reach(None, True)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before), spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(rows) == sum(alone) == n and max(rows) < 3 * sorted(rows)[len(rows) // 2] and max(alone) > 3 * sorted(alone)[len(alone) // 2]
    means = lambda reach: {r["node_id"]: [round(v, 9) for v in r["a"]] for r in agg.neighbour_mean(h, edges, 2, reach).collect()}
    assert means(agg.Reach(hot, False)) == means(agg.Reach())
    assert agg.hot_nodes(degrees.where("node_id <> 5"), "dout", 2) is None
    assert agg.fits(spark, 10, 64) and not agg.fits(spark, 10**9, 64)


def test_hub_attention_with_hot_ends(spark):
    """Attention where one node is at most edges, as with plain joins."""
    edges = cut(spark.range(3000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).cast("long").alias("src"), F.when(F.col("id") % 4 == 1, 1).otherwise(F.col("id") % 61).cast("long").alias("dst")).distinct())
    heads = spark.range(61).select(F.col("id").alias("node_id"), F.array(F.col("id") / 64.0, F.lit(0.5)).alias("q"), F.array((F.col("id") % 7) / 8.0).alias("el"), F.array((F.col("id") % 5) / 8.0).alias("er"))
    hot = spark.createDataFrame([(0,), (1,)], "node_id long")
    reach = agg.Reach(hot, False), agg.Reach(hot, True)
    got, want = ({r["node_id"]: [round(v, 9) for v in (*r["s"], *r["lse"])] for r in agg.attended_sum(edges, heads, 1, 2, reach=x).collect()} for x in (reach, (agg.Reach(), agg.Reach())))
    assert got == want


def test_long_hops_send_vectors_where_nodes_have_every_component(spark, monkeypatch):
    graph = simple_graph(spark)
    rows = graph.nodes.select("node_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j")).withColumn("v", F.col("node_id") * 2.0 + F.col("j"))
    want = {(r["node_id"], r["j"]): r["v"] for r in graph.edges.join(rows.withColumnRenamed("node_id", "src"), "src").groupBy(F.col("dst").alias("node_id"), "j").agg(F.avg("v").alias("v")).collect()}
    calls, mean = [], agg.neighbour_mean
    monkeypatch.setattr(agg, "neighbour_mean", lambda *a: calls.append(a[2]) or mean(*a))
    found = lambda long: {(r["node_id"], r["j"]): r["v"] for r in agg.neighbour_mean_long(long, graph.edges).collect()}
    assert found(rows) == want and calls == [3]
    gaps = rows.where("not (node_id = 2 and j = 1)")
    twice = gaps.unionByName(rows.where("node_id = 2 and j = 0"))  # as many rows as components, but one is missing
    for other in (gaps, twice, rows.withColumn("v", F.when(F.col("node_id") != 3, F.col("v")))):
        found(other)
        assert calls == [3]
    assert found(gaps)[3, 1] == 2.0 and found(rows.limit(0)) == {}


def test_edges_of_hot_sources_meet_their_destinations_before_vectors_do(spark):
    edges = spark.range(400).select((F.col("id") % 2).alias("src"), (F.col("id") % 50).alias("dst"))
    h = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 5.0])], "node_id long, x array<double>")
    rows = agg.neighbour_mean(h, edges, 2, agg.Reach(h.select("node_id"), True))
    assert "RebalancePartitions [dst" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r["node_id"]: r["a"] for r in rows.collect()} == {d: [1.0, 2.0] if d % 2 == 0 else [3.0, 5.0] for d in range(50)}
