"""The queries again as SQL over the same tables, for a second engine; of those that SQL expresses."""

from __future__ import annotations

import re

from weftgraph.queries import CLASSES, GAT_HEADS, GAT_WIDTH, HIDDEN, K, WIDTH
from weftgraph.sources.fixtures import KARATE_TIES, SIMPLE_EDGES
from weftgraph.sources.registry import DATASETS

ORACLES: dict[str, str] = {}


def oracle(name: str, *parts: str) -> None:
    """Common table expressions and a final select."""
    *tables, last = parts
    ORACLES[name] = (f"WITH {', '.join(tables)} " if tables else "") + last


def r(x: str) -> str:
    return f"(round({x}, 5) + 0.0)"


LINES = "lines AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)"
PS = """n_parts AS (SELECT max(p_partkey) + 1 AS n FROM part),
pairs AS (SELECT DISTINCT l_partkey AS src, l_suppkey + (SELECT n FROM n_parts) AS dst FROM lineitem),
edges AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs),
ids AS (SELECT p_partkey AS node_id FROM part UNION ALL SELECT s_suppkey + (SELECT n FROM n_parts) FROM supplier),
nodes AS (SELECT node_id, node_id % 10 <= 6 AS train_mask, node_id % 10 BETWEEN 7 AND 8 AS val_mask, node_id % 10 = 9 AS test_mask FROM ids)"""
CROSSING = """crossing AS (
  SELECT e.src, e.dst, s.part_id AS src_part, d.part_id AS dst_part
  FROM edges e JOIN parts s ON e.src = s.node_id JOIN parts d ON e.dst = d.node_id WHERE s.part_id <> d.part_id)"""
CO = f"""n_customers AS (SELECT max(c_custkey) + 1 AS n FROM customer),
pairs AS (SELECT o_custkey AS src, o_orderkey + (SELECT n FROM n_customers) AS dst FROM orders),
edges AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs),
nodes AS (SELECT c_custkey AS node_id FROM customer UNION ALL SELECT dst FROM pairs),
parts AS (
  SELECT c_custkey AS node_id, floor(c_custkey / ((SELECT n FROM n_customers) / {K}))::INTEGER AS part_id FROM customer
  UNION ALL
  SELECT o_orderkey + (SELECT n FROM n_customers), ((floor(o_custkey / ((SELECT n FROM n_customers) / {K}))::INTEGER + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) % {K})::INTEGER FROM orders),
{CROSSING}"""
CHUNK = f"parts AS (SELECT node_id, least(floor(node_id / ((SELECT count(*) FROM ids) / {K})), {K - 1})::INTEGER AS part_id FROM ids)"
COUNTS = """counts AS (SELECT p.part_id, e.dst AS node_id, count(*) AS cnt FROM (SELECT DISTINCT src, dst FROM edges) e JOIN parts p ON e.src = p.node_id GROUP BY ALL),
outside AS (SELECT c.part_id, c.node_id, c.cnt FROM counts c JOIN parts p ON c.node_id = p.node_id WHERE p.part_id <> c.part_id),
sizes AS (SELECT p.part_id, count(o.node_id) AS n FROM (SELECT DISTINCT part_id FROM parts) p LEFT JOIN outside o ON p.part_id = o.part_id GROUP BY ALL)"""
SWAP = """ends AS (SELECT arg_max(part_id, (n, part_id)) AS ps, arg_min(part_id, (n, part_id)) AS pt FROM sizes),
single AS (SELECT node_id FROM outside WHERE cnt = 1 AND part_id = (SELECT ps FROM ends)),
gain AS (SELECT p.node_id, count(s.node_id) AS gain FROM parts p LEFT JOIN (SELECT DISTINCT src, dst FROM edges) e ON p.node_id = e.src LEFT JOIN single s ON e.dst = s.node_id WHERE p.part_id = (SELECT ps FROM ends) GROUP BY ALL),
cost AS (SELECT p.node_id, count(e.dst) AS cost FROM parts p LEFT JOIN (SELECT DISTINCT src, dst FROM edges) e ON p.node_id = e.src WHERE p.part_id = (SELECT pt FROM ends) GROUP BY ALL),
swap AS (SELECT ps, pt, (SELECT arg_min(node_id, (-gain, node_id)) FROM gain) AS ns, (SELECT arg_min(node_id, (cost, node_id)) FROM cost) AS nt FROM ends)"""


def features(width: int = WIDTH, base: str = PS) -> str:
    return f"""{base},
vectors AS (SELECT n.*, e.embedding, e.label FROM nodes n JOIN embeddings e ON n.node_id % (SELECT count(*) FROM embeddings) = e.vec_id),
h AS (SELECT node_id, unnest(range({width}))::INTEGER AS j, unnest(embedding[1:{width}])::DOUBLE AS v FROM vectors)"""


def weights(n: int, m: int, shift: int = 0) -> str:
    return f"(SELECT a.range AS j, b.range AS k, ((a.range * 7 + b.range * 13 + {shift}) % 17 - 8) / 16.0::DOUBLE AS w FROM range({n}) a, range({m}) b)"


def bias(shift: int, j: str = "j") -> str:
    return f"((({j} * 5 + {shift}) % 7 - 3) / 8.0::DOUBLE)"


def product(rows: str, n: int, m: int, shift: int = 0) -> str:
    """(node_id, j, v): rows times weights."""
    return f"(SELECT x.node_id, w.k::INTEGER AS j, sum(x.v * w.w) AS v FROM {rows} x JOIN {weights(n, m, shift)} w ON x.j = w.j GROUP BY ALL)"


def mean_of(rows: str) -> str:
    return f"(SELECT e.dst AS node_id, x.j, avg(x.v) AS v FROM edges e JOIN {rows} x ON e.src = x.node_id GROUP BY ALL)"


def sage_layer(rows: str, n: int, m: int, shift: int, relu: bool) -> str:
    z = f"""(SELECT s.node_id, s.j, s.v + coalesce(t.v, 0) + {bias(shift, "s.j")} AS v
      FROM {product(rows, n, m, shift)} s LEFT JOIN {product(mean_of(rows), n, m, shift + 5)} t ON s.node_id = t.node_id AND s.j = t.j)"""
    return f"(SELECT node_id, j, greatest(v, 0.0::DOUBLE) AS v FROM {z})" if relu else z


def gcn_sum(rows: str) -> str:
    return f"""(SELECT n.node_id, x.j, coalesce(sum(x.v / sqrt(greatest(so.dout, 1))) / any_value(sqrt(greatest(dn.din, 1))), 0) AS v
      FROM nodes n JOIN edges e ON n.node_id = e.dst JOIN {rows} x ON e.src = x.node_id JOIN dout so ON e.src = so.node_id JOIN din dn ON e.dst = dn.node_id GROUP BY ALL)"""


DEGREES = "dout AS (SELECT src AS node_id, count(*) AS dout FROM edges GROUP BY ALL), din AS (SELECT dst AS node_id, count(*) AS din FROM edges GROUP BY ALL)"
LONG = f"SELECT node_id, j, {r('v')} AS v FROM "

# Graphs

oracle("edges_distinct_bidirected", "SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem UNION SELECT l_suppkey, l_partkey FROM lineitem")
oracle("remove_add_self_loops", LINES, "SELECT src, dst FROM lines WHERE src <> dst UNION ALL SELECT p_partkey, p_partkey FROM part")
oracle("in_out_degree", LINES, "SELECT p_partkey AS node_id, (SELECT count(*) FROM lines WHERE dst = p_partkey) AS din, (SELECT count(*) FROM lines WHERE src = p_partkey) AS dout FROM part")
oracle("graph_stats", PS, "SELECT count(*) AS n_nodes, count_if(train_mask)::BIGINT AS n_train, count_if(val_mask)::BIGINT AS n_val, count_if(NOT (train_mask OR val_mask))::BIGINT AS n_test, (SELECT count(*) FROM edges) AS n_edges FROM nodes")
oracle("max_id_num_nodes", PS, "SELECT greatest(max(src), max(dst)) + 1 AS num_nodes FROM edges")
oracle("num_label_classes", "SELECT count(DISTINCT label) AS num_classes FROM embeddings WHERE label IS NOT NULL")
oracle("positional_split_counts", PS, """SELECT count_if(node_id < floor(n * 0.7))::BIGINT AS train_mask, count_if(node_id >= floor(n * 0.7) AND node_id < floor(n * 0.9))::BIGINT AS val_mask,
  count_if(node_id >= floor(n * 0.9))::BIGINT AS test_mask FROM ids, (SELECT count(*) AS n FROM ids)""")
oracle("mask_split_counts", features(1), "SELECT label, count_if(train_mask)::BIGINT AS n_train, count_if(val_mask)::BIGINT AS n_val, count_if(NOT (train_mask OR val_mask))::BIGINT AS n_test FROM vectors GROUP BY label")
oracle("adjacency_lists", PS, "SELECT n.node_id, coalesce(string_agg((e.dst + 1)::VARCHAR, ' ' ORDER BY e.dst), '') AS nbrs FROM ids n LEFT JOIN edges e ON n.node_id = e.src GROUP BY n.node_id")
oracle("inductive_subgraph_train", PS, "SELECT e.src, e.dst FROM edges e JOIN nodes a ON e.src = a.node_id JOIN nodes b ON e.dst = b.node_id WHERE a.train_mask AND b.train_mask")
oracle("gather_rows", features(), LONG + "(SELECT h.* FROM h JOIN nodes USING (node_id) WHERE val_mask)")
oracle("scatter_rows", features(), LONG + "(SELECT node_id, j, CASE WHEN test_mask THEN j::DOUBLE ELSE v END AS v FROM h JOIN nodes USING (node_id))")
oracle("multilabel_class_map", "g AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)",
       """SELECT doc_id AS node_id, j, coalesce(CASE j WHEN 0 THEN quality ELSE toxic END, 0)::DOUBLE AS v FROM documents LEFT JOIN g USING (doc_id), (SELECT unnest([0, 1])::INTEGER AS j)""")
oracle("role_list_masks", "SELECT s_suppkey AS node_id, s_suppkey % 3 = 0 AS train_mask, s_suppkey % 3 = 1 AS val_mask, s_suppkey % 3 = 2 AS test_mask FROM supplier")
oracle("dataset_registry", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {d.in_feats}, {d.n_classes}, {d.multilabel})" for k, d in DATASETS.items()) + ") t(name, in_feats, n_classes, multilabel)")
oracle("simple_graph_hop", "e(src, dst) AS (VALUES " + ", ".join(map(str, SIMPLE_EDGES)) + ")",
       f"h AS (SELECT range AS node_id, unnest(range({WIDTH}))::INTEGER AS j, unnest(embedding[1:{WIDTH}])::DOUBLE AS v FROM range(9) JOIN embeddings ON range % (SELECT count(*) FROM embeddings) = vec_id)",
       f"SELECT n.range AS node_id, w.range::INTEGER AS j, {r('coalesce(avg(h.v), 0)')} AS v FROM range(9) n, range({WIDTH}) w LEFT JOIN e ON e.dst = n.range LEFT JOIN h ON h.node_id = e.src AND h.j = w.range GROUP BY n.range, w.range")
oracle("karate_degrees", "t(a, b) AS (VALUES " + ", ".join(f"({a}, {b})" for a, bs in KARATE_TIES.items() for b in bs) + ")", "e AS (SELECT a AS src, b AS dst FROM t UNION ALL SELECT b, a FROM t)",
       """SELECT n.range AS node_id, (SELECT count(*) FROM e WHERE dst = n.range) AS din, (SELECT count(*) FROM e WHERE src = n.range) AS dout,
  coalesce((SELECT round(sum(s_acctbal), 2) FROM e JOIN supplier ON s_suppkey = src WHERE dst = n.range), 0) AS around FROM range(34) n""")

# Parts

oracle("chunk_partition", PS, CHUNK, "SELECT * FROM parts")
oracle("hash_random_partition", PS, f"SELECT node_id, ((node_id * 2654435761 % 4294967296) % {K})::INTEGER AS part_id FROM ids")
oracle("partition_book_ranges", CO, "SELECT part_id, (sum(n) OVER (ORDER BY part_id) - n)::BIGINT AS lo, (sum(n) OVER (ORDER BY part_id))::BIGINT AS hi, n AS num_nodes FROM (SELECT part_id, count(*) AS n FROM parts GROUP BY part_id)")
oracle("range_join_owner", PS, CHUNK, "b AS (SELECT part_id, sum(n) OVER (ORDER BY part_id) - n AS lo, sum(n) OVER (ORDER BY part_id) AS hi FROM (SELECT part_id, count(*) AS n FROM parts GROUP BY part_id))", "SELECT node_id, part_id FROM ids JOIN b ON node_id >= lo AND node_id < hi")
oracle("boundary_edges", CO, "SELECT * FROM crossing")
DIH = """d AS (SELECT DISTINCT dst_part AS part_id, dst AS node_id FROM crossing),
classes AS (
  SELECT p.part_id, p.node_id, CASE WHEN d.node_id IS NULL THEN 'I' ELSE 'D' END AS cls FROM parts p LEFT JOIN d ON p.part_id = d.part_id AND p.node_id = d.node_id
  UNION ALL SELECT DISTINCT dst_part, src, 'H' FROM crossing)"""
oracle("node_class_dih", CO, DIH, "SELECT part_id, node_id, cls FROM classes")
oracle("dependent_sets", CO, "SELECT DISTINCT dst_part AS part_id, src_part AS owner_part, dst AS node_id FROM crossing")
oracle("exclusive_dep_counts", CO, "o AS (SELECT dst_part AS part_id, dst, min(src_part) AS owner_part FROM crossing GROUP BY dst_part, dst HAVING count(DISTINCT src_part) = 1)", "SELECT part_id, owner_part, count(*) AS n FROM o GROUP BY part_id, owner_part")
oracle("exchange_plan", CO, "SELECT DISTINCT dst_part AS consumer_part, src_part AS owner_part, src AS node_id FROM crossing")
oracle("send_counts", CO, "SELECT dst_part AS consumer_part, src_part AS owner_part, count(DISTINCT src) AS n FROM crossing WHERE src IN (SELECT c_custkey FROM customer) GROUP BY dst_part, src_part")
oracle("halo_features", features(base=CO), f"SELECT c.dst_part AS consumer_part, c.src_part AS owner_part, c.src AS node_id, h.j, {r('h.v')} AS v FROM (SELECT DISTINCT dst_part, src_part, src FROM crossing) c JOIN h ON c.src = h.node_id")
oracle("halo_zero_fill", features(), LONG + "(SELECT h.node_id, j, CASE WHEN train_mask THEN v ELSE 0 END AS v FROM h JOIN nodes USING (node_id))")
oracle("partition_report", CO, DIH, """SELECT c.part_id, c.n_all, c.n_local, coalesce(e.n, 0) AS n_edges, c.n_dependent, round(100.0::DOUBLE * c.n_dependent / c.n_local, 6) AS pct_dependent, c.n_remote
  FROM (SELECT part_id, count(*) AS n_all, count_if(cls <> 'H')::BIGINT AS n_local, count_if(cls = 'D')::BIGINT AS n_dependent, count_if(cls = 'H')::BIGINT AS n_remote FROM classes GROUP BY part_id) c
  LEFT JOIN (SELECT part_id, count(*) AS n FROM edges JOIN parts ON dst = node_id GROUP BY part_id) e USING (part_id)""")
oracle("dep_counters", CO, COUNTS, "SELECT part_id, node_id, cnt FROM outside")
oracle("dep_balance_rate", CO, COUNTS, f"SELECT {r('min(n) / max(n)')} AS rate FROM sizes")
oracle("swap_candidates", CO, COUNTS, SWAP, "SELECT ps, pt, ns, nt FROM swap")
oracle("swap_one_step", CO, COUNTS, SWAP, "SELECT node_id, CASE WHEN node_id = (SELECT ns FROM swap) THEN (SELECT pt FROM swap) WHEN node_id = (SELECT nt FROM swap) THEN (SELECT ps FROM swap) ELSE part_id END AS part_id FROM parts")


def swap_step(before: str, n: int) -> list[str]:
    """Tables of one swap from the parts of ``before``; the last of them is parts_n."""
    named = lambda sql: re.sub(r"\b(counts|outside|sizes|ends|single|gain|cost|swap)\b", rf"\g<1>_{n}", re.sub(r"\bparts\b", before, sql))
    moved = f"parts_{n} AS MATERIALIZED (SELECT node_id, CASE WHEN node_id = (SELECT ns FROM swap_{n}) THEN (SELECT pt FROM swap_{n}) WHEN node_id = (SELECT nt FROM swap_{n}) THEN (SELECT ps FROM swap_{n}) ELSE part_id END AS part_id FROM {before})"
    return [re.sub(r"(?m)^(\w+) AS \(", r"\1 AS MATERIALIZED (", named(f"{COUNTS},\n{SWAP}")), moved]


oracle("swap_three_steps", CO, *swap_step("parts", 1), *swap_step("parts_1", 2), *swap_step("parts_2", 3), "SELECT node_id, part_id FROM parts_3")
oracle("bins_naive", CO, "SELECT part_id, node_id, floor((row_number() OVER (PARTITION BY part_id ORDER BY node_id) - 1) / 100)::INTEGER AS bin_id FROM parts")
oracle("bins_prio", CO, DIH, f"SELECT part_id, node_id, CASE WHEN cls = 'D' THEN 0 ELSE 1 + floor((row_number() OVER (PARTITION BY part_id, cls ORDER BY node_id) - 1) / {50 * (WIDTH // HIDDEN)}) END::INTEGER AS bin_id FROM classes WHERE cls <> 'H'")

oracle(
    "bin_block_sizes",
    CO,
    "f2 AS (SELECT part_id, floor((row_number() OVER (PARTITION BY part_id ORDER BY node_id) - 1) / 100)::INTEGER AS bin_id, node_id FROM parts)",
    "b1 AS (SELECT part_id, bin_id, src, dst FROM edges JOIN f2 ON dst = node_id)",
    "f1 AS (SELECT * FROM f2 UNION SELECT part_id, bin_id, src FROM b1)",
    "b0 AS (SELECT part_id, bin_id, src, dst FROM edges JOIN f1 ON dst = node_id)",
    "f0 AS (SELECT * FROM f1 UNION SELECT part_id, bin_id, src FROM b0)",
    " UNION ALL ".join(
        f"""SELECT part_id, bin_id, {k} AS layer, (SELECT count(*) FROM f{k} i WHERE i.part_id = o.part_id AND i.bin_id = o.bin_id) AS n_inputs, count(*) AS n_outputs,
  (SELECT count(*) FROM b{k} b WHERE b.part_id = o.part_id AND b.bin_id = o.bin_id) AS n_edges FROM f{k + 1} o GROUP BY part_id, bin_id"""
        for k in range(2)
    ),
)

# Hops and layers

oracle(
    "grown_partition",
    PS,
    "voters AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst UNION ALL SELECT node_id, node_id FROM ids)",
    "l0 AS (SELECT node_id, node_id AS label FROM ids)",
    *(
        f"""l{k + 1} AS (SELECT dst AS node_id, arg_min(label, struct_pack(n := -n, label := label)) AS label
  FROM (SELECT dst, label, count(*) AS n FROM voters JOIN l{k} ON src = node_id GROUP BY ALL) GROUP BY dst)"""
        for k in range(5)
    ),
    f"SELECT node_id, least(floor((row_number() OVER (ORDER BY label, node_id) - 1) * {K} / (SELECT count(*) FROM ids)), {K - 1})::INTEGER AS part_id FROM l5",
)
TIE = "((least(src, dst) % 2147483648) * 2654435761 % 4294967296 * 31 + greatest(src, dst) % 2147483648 * 40503) % 4294967296"
oracle(
    "matching_round",
    PS,
    "weighed AS (SELECT src, dst, count(*) AS w FROM edges WHERE src <> dst GROUP BY ALL)",
    f"wish AS (SELECT src, arg_max(dst, struct_pack(w := w, t := {TIE}, least := -dst)) AS dst FROM weighed GROUP BY src)",
    "SELECT a.src AS a, a.dst AS b FROM wish a JOIN wish b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst",
)
oracle("sage_mean_hop", features(), LONG + mean_of("h"))
oracle(
    "hot_source_hop",
    "lines AS (SELECT ascii(l_returnflag)::BIGINT AS flag, l_partkey AS dst FROM lineitem)",
    f"""vectors AS (SELECT flag, unnest(range({WIDTH}))::INTEGER AS j, unnest(embedding[1:{WIDTH}])::DOUBLE AS v
  FROM (SELECT DISTINCT flag FROM lines) JOIN embeddings ON flag % (SELECT count(*) FROM embeddings) = vec_id)""",
    f"SELECT dst AS node_id, j, {r('avg(v)')} AS v FROM lines JOIN vectors USING (flag) GROUP BY dst, j",
)
oracle("sage_mean_hop_long", features(), LONG + mean_of("h"))
oracle("sage_gcn_hop", features(), LONG + "(SELECT h.node_id, h.j, (any_value(h.v) + coalesce(sum(x.v), 0)) / (count(x.v) + 1) AS v FROM h LEFT JOIN edges e ON h.node_id = e.dst LEFT JOIN h x ON e.src = x.node_id AND x.j = h.j GROUP BY h.node_id, h.j)")
oracle("sage_pool_hop", features(), f"p AS (SELECT node_id, j, greatest(v + {bias(0)}, 0.0::DOUBLE) AS v FROM {product('h', WIDTH, HIDDEN)})", LONG + "(SELECT e.dst AS node_id, p.j, max(p.v) AS v FROM edges e JOIN p ON e.src = p.node_id GROUP BY ALL)")
oracle("gcn_norm_hop", features(), DEGREES, LONG + gcn_sum("h"))
oracle("sage_layer_linear_relu", features(), LONG + sage_layer("h", WIDTH, HIDDEN, 0, True))
TWO_SAGE = (features(), f"h1 AS MATERIALIZED {sage_layer('h', WIDTH, HIDDEN, 0, True)}", f"z AS MATERIALIZED {sage_layer('h1', HIDDEN, CLASSES, 3, False)}")
oracle("sage_two_layer_forward", *TWO_SAGE, LONG + "z")
PRIO = "CASE WHEN cls = 'D' THEN 0 ELSE 1 + floor((row_number() OVER (PARTITION BY part_id, cls ORDER BY node_id) - 1) / 200) END::INTEGER"
oracle("bin_two_layer_forward", *TWO_SAGE, CHUNK, CROSSING, DIH, f"binned AS (SELECT part_id, node_id, {PRIO} AS bin_id FROM classes WHERE cls <> 'H')",
       f"SELECT part_id, bin_id, node_id, j, {r('v')} AS v FROM z JOIN binned USING (node_id)")
oracle("halo_two_layer_forward", *TWO_SAGE, LONG + "z")
oracle("gcn_two_layer_forward", features(), DEGREES,
       f"h1 AS MATERIALIZED (SELECT node_id, j, greatest(v + {bias(0)}, 0.0::DOUBLE) AS v FROM {product(gcn_sum('h'), WIDTH, HIDDEN)})",
       f"h2 AS (SELECT node_id, j, greatest(v + {bias(3)}, 0.0::DOUBLE) AS v FROM {product(gcn_sum('h1'), HIDDEN, CLASSES, 3)})", LONG + "h2")
GAT = (features(), f"q AS MATERIALIZED {product('h', WIDTH, GAT_HEADS * GAT_WIDTH)}",
       f"""heads AS (
  SELECT q.node_id, q.j // {GAT_WIDTH} AS k, sum(q.v * l.w) AS el, sum(q.v * rr.w) AS er
  FROM q JOIN {weights(GAT_HEADS, GAT_WIDTH, 1)} l ON q.j // {GAT_WIDTH} = l.j AND q.j % {GAT_WIDTH} = l.k JOIN {weights(GAT_HEADS, GAT_WIDTH, 2)} rr ON q.j // {GAT_WIDTH} = rr.j AND q.j % {GAT_WIDTH} = rr.k
  GROUP BY ALL)""",
       "scores AS (SELECT e.src, e.dst, a.k, CASE WHEN a.el + b.er > 0 THEN a.el + b.er ELSE 0.2::DOUBLE * (a.el + b.er) END AS s FROM edges e JOIN heads a ON e.src = a.node_id JOIN heads b ON e.dst = b.node_id AND a.k = b.k)",
       "alpha AS (SELECT src, dst, k, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS alpha FROM scores WINDOW w AS (PARTITION BY dst, k))",
       f"att AS (SELECT a.dst AS node_id, q.j, sum(a.alpha * q.v) AS v FROM alpha a JOIN q ON a.src = q.node_id AND q.j // {GAT_WIDTH} = a.k GROUP BY ALL)",
       "full_att AS (SELECT q.node_id, q.j, coalesce(att.v, 0) AS v FROM q LEFT JOIN att USING (node_id, j))")
oracle("gat_edge_softmax", *GAT, f"SELECT src, dst, {r('max(CASE WHEN k = 0 THEN alpha END)')} AS alpha0, {r('max(CASE WHEN k = 1 THEN alpha END)')} AS alpha1 FROM alpha GROUP BY src, dst")
oracle("gat_layer_concat", *GAT, LONG + "full_att")
oracle("gat_layer_mean", *GAT, f"SELECT node_id, (j % {GAT_WIDTH})::INTEGER AS j, {r('avg(v)')} AS v FROM full_att GROUP BY node_id, j % {GAT_WIDTH}")
oracle("standard_scale_train", features(), "t AS MATERIALIZED (SELECT h.* FROM h JOIN (SELECT node_id FROM nodes WHERE train_mask) USING (node_id))",
       "s AS MATERIALIZED (SELECT j, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS sd FROM t GROUP BY j)", LONG + "(SELECT node_id, j, (v - m) / sd AS v FROM h JOIN s USING (j))")
PRIME = 2147483647
oracle("dropout_forward", features(), f"a AS (SELECT node_id, j, v, (node_id % {PRIME} * 1103515245 + (j + 1) * 12345677 + 7 * 7919 + 1) % {PRIME} AS a FROM h)",
       f"b AS (SELECT *, (a * a + (j + 1) * 40503) % {PRIME} AS b FROM a)", LONG + f"(SELECT node_id, j, CASE WHEN ((b * b + a) % {PRIME}) / {PRIME}::DOUBLE < 0.5 THEN 0.0 ELSE v / 0.5 END AS v FROM b)")

# Losses, metrics, gradients

LOGITS = (features(), CHUNK, f"""z AS MATERIALIZED (
  SELECT p.node_id, p.j, p.v + {bias(0, 'p.j')} AS v, n.label FROM {product('h', WIDTH, CLASSES)} p JOIN vectors n ON p.node_id = n.node_id WHERE n.train_mask)""",
          "soft AS (SELECT *, exp(v - max(v) OVER w) / sum(exp(v)) OVER w * exp(max(v) OVER w) AS p FROM z WINDOW w AS (PARTITION BY node_id))")
LOSS = "losses AS (SELECT s.node_id, -ln(s.p) AS loss, part_id FROM soft s JOIN parts USING (node_id) WHERE s.j = s.label)"
oracle("cross_entropy_loss", *LOGITS, LOSS, f"""SELECT 'global_mean' AS reduction, {r('avg(loss)')} AS loss FROM losses
  UNION ALL SELECT 'partition_mean', {r('avg(own)')} FROM (SELECT avg(loss) AS own FROM losses GROUP BY part_id)""")
PREDICTED = "predicted AS (SELECT node_id, arg_min(j, (-v, j))::INTEGER AS predicted, any_value(label) AS label FROM z GROUP BY node_id)"
oracle("accuracy", *LOGITS, PREDICTED, f"SELECT {r('avg((predicted = label)::INTEGER)')} AS accuracy FROM predicted")
oracle("predicted_class", *LOGITS, PREDICTED, "SELECT node_id, predicted FROM predicted")
MULTI = (f"""nodes AS (SELECT doc_id AS node_id, max(quality)::DOUBLE AS q, max(toxic)::DOUBLE AS t FROM labels GROUP BY doc_id),
vectors AS (SELECT n.*, e.embedding FROM nodes n JOIN embeddings e ON n.node_id % (SELECT count(*) FROM embeddings) = e.vec_id),
h AS (SELECT node_id, unnest(range({WIDTH}))::INTEGER AS j, unnest(embedding[1:{WIDTH}])::DOUBLE AS v FROM vectors)""",
         f"z AS (SELECT p.node_id, p.v + {bias(0, 'p.j')} AS x, CASE p.j WHEN 0 THEN q ELSE t END AS y FROM {product('h', WIDTH, 2)} p JOIN nodes USING (node_id))")
oracle("bce_logits_loss", *MULTI, f"SELECT {r('sum(greatest(x, 0) - x * y + ln(1 + exp(-abs(x))))')} AS loss FROM z")
oracle("micro_f1", *MULTI, f"SELECT {r('2 * sum((x > 0)::INTEGER * y) / (sum((x > 0)::INTEGER) + sum(y))')} AS micro_f1 FROM z")
GRAD = "g AS MATERIALIZED (SELECT node_id, j, (p - (j = label)::INTEGER) / (SELECT count(DISTINCT node_id) FROM z) AS g FROM soft)"
oracle("softmax_grad_last_layer", *LOGITS, GRAD, LONG + "(SELECT node_id, j, g * 1000 AS v FROM g)")
ENTRIES = """entries AS (
  SELECT 'W' AS name, h.j AS i, g.j AS j, sum(h.v * g.g) AS v FROM g JOIN h ON g.node_id = h.node_id GROUP BY h.j, g.j
  UNION ALL SELECT 'b', 0, j, sum(g) FROM g GROUP BY j)"""
oracle("weight_grad_last_layer", *LOGITS, GRAD, ENTRIES, f"SELECT name, i, j, {r('v')} AS v FROM entries")
oracle("adam_single_step", *LOGITS, GRAD, ENTRIES, f"""SELECT name, i, j, {r("CASE WHEN name = 'W' THEN ((i * 7 + j * 13) % 17 - 8) / 16.0 ELSE ((j * 5) % 7 - 3) / 8.0 END - 0.01 * ((0.1 * v) / (1 - 0.9)) / (sqrt((0.001 * v * v) / (1 - 0.999)) + 1e-8)")} AS v FROM entries""")
oracle("partition_grad_mean", *LOGITS, "own AS (SELECT part_id, j, sum(p - (j = label)::INTEGER) / count(*) AS v FROM soft JOIN parts USING (node_id) GROUP BY part_id, j)", f"SELECT j, {r('avg(v)')} AS v FROM own GROUP BY j")
oracle("gradient_merge_sum", features(base=CO), LONG + "(SELECT h.node_id, h.j, sum(h.v) AS v FROM (SELECT DISTINCT dst_part, src FROM crossing) c JOIN h ON c.src = h.node_id GROUP BY ALL)")
oracle("backprop_hidden_grad", features(), DEGREES, f"dz AS (SELECT * FROM h WHERE j < {HIDDEN})",
       f"own AS (SELECT d.node_id, w.j::INTEGER AS j, sum(d.v * w.w) AS v FROM dz d JOIN {weights(WIDTH, HIDDEN, 0)} w ON d.j = w.k GROUP BY ALL)",
       f"share AS (SELECT d.node_id, w.j::INTEGER AS j, sum(d.v * w.w) / any_value(din) AS v FROM dz d JOIN {weights(WIDTH, HIDDEN, 5)} w ON d.j = w.k JOIN din USING (node_id) GROUP BY d.node_id, w.j)",
       "back AS (SELECT e.src AS node_id, s.j, sum(s.v) AS v FROM edges e JOIN share s ON e.dst = s.node_id GROUP BY ALL)",
       LONG + "(SELECT o.node_id, o.j, o.v + coalesce(b.v, 0) AS v FROM own o LEFT JOIN back b ON o.node_id = b.node_id AND o.j = b.j)")
oracle("evaluate_test_mask", *TWO_SAGE, "t AS (SELECT z.*, label FROM z JOIN vectors USING (node_id) WHERE NOT (train_mask OR val_mask))",
       "s AS (SELECT *, exp(v - max(v) OVER w) / sum(exp(v)) OVER w * exp(max(v) OVER w) AS p FROM t WINDOW w AS (PARTITION BY node_id))",
       f"""SELECT {r('(SELECT avg((predicted = label)::INTEGER) FROM (SELECT arg_min(j, (-v, j)) AS predicted, any_value(label) AS label FROM t GROUP BY node_id))')} AS accuracy, {r('(SELECT avg(-ln(p)) FROM s WHERE j = label)')} AS loss""")
oracle("throughput_metrics", PS, "s AS (SELECT CASE WHEN train_mask THEN 'train' WHEN val_mask THEN 'val' ELSE 'test' END AS split, count(*) AS n_nodes FROM nodes GROUP BY 1)",
       "SELECT split, n_nodes, CASE WHEN split = 'train' THEN 4.0 ELSE 0.5 END::DOUBLE AS seconds, n_nodes / CASE WHEN split = 'train' THEN 4.0 ELSE 0.5 END::DOUBLE AS nodes_per_sec FROM s")

# Files

oracle("text_roundtrip", PS, "SELECT src, dst FROM edges")
oracle("assignment_roundtrip", PS, CHUNK, "SELECT node_id, part_id FROM parts")
oracle("edge_list_roundtrip", PS, "SELECT src, dst FROM edges")
oracle("part_files_roundtrip", CO, "SELECT node_id, part_id AS owner_part, part_id = 1 AS is_local FROM parts WHERE part_id = 1 OR node_id IN (SELECT src FROM crossing WHERE dst_part = 1)")
ORACLES["checkpoint_roundtrip"] = f"SELECT 0 AS layer, name, i, j, v AS value FROM ({ORACLES['adam_single_step']})"
