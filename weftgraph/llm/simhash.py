"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: bit-wise majority of the XXH64 of a text's word shingles.

Links: distinct fingerprints form a binary trie. The join walks pairs of trie
nodes of equal depth from the root down, adds up the bits in which their
prefixes differ, and drops a pair once the sum exceeds the budget. Four
rotations of the fingerprints, one for each 16-bit quarter moved to the front,
let the walk begin below depth 16 with equal prefixes only (of four quarters
with three differing bits, one is equal), so each (rotation, prefix) node is a
task key of its own. A node that holds too many fingerprints is split by its
next bits into pairs of child nodes within the budget, again and again, until
each pair is small; that is the same walk, done by Spark's joins. A task hands
on a spanning forest of the links that it finds, which keeps every component.

``similar_documents`` asks for a share of common shingles instead, which takes
wider fingerprints (``WIDE`` longs) and a wider error budget. A budget of a
sixth of the bits leaves no stretch of equal bits to begin with for sure, so
the walk starts from several tries, each over bits in an order of its own: a
pair meets where its first few bits in that order are equal, and is compared
in all bits there. There are as many orders as the stated recall at the budget
takes; the number of first bits grows with the number of fingerprints, so that
nodes stay small. Nodes that are large all the same are dealt in pairs of
blocks.

A null or wordless text has fingerprint zero and is linked like any other.
Rows may repeat and doc_id may be null: the component is the least non-null
id of the linked rows. Texts of any length are read whole; which of two equally
good links a forest keeps does not change a component. Extra columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, hot_keys, join_unique, slices
from weftgraph.llm.components import components

BITS, QUARTER, BUDGET = 64, 16, 3
#: Fingerprints under one pair of trie nodes that a task walks in one piece.
NODE_ROWS = 20_000
#: Longs of a wide fingerprint; the bits in which two of them may differ, near what a similarity of 0.8 gives; the share of such pairs that meet in some order.
WIDE, WIDE_BUDGET, RECALL = 8, 84, 0.98
_STEP = 6  # bits by which Spark splits a larger node


def _shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each run of so many words, or of all words where they are fewer."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lower-cased, only ASCII space splits
    h64 = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([h64(joined, seed)] if words else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    return np.fromiter((h64(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def _majority(hashes: np.ndarray) -> list[int]:
    """For each column of hashes, the bits that are set in over half of its rows."""
    n, columns = hashes.shape
    set_bits = np.zeros(columns * BITS, np.int64)
    for k in range(0, n, 255):  # so that counts fit a byte
        set_bits += np.unpackbits(hashes[k : k + 255].astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * set_bits > n).view(">u8").tolist() if n else [0] * columns


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    return _majority(_shingle_hashes(text, shingle, seed).reshape(-1, 1))[0]


def wide_fingerprint(text: str | None, shingle: int = 5, seed: int = 42) -> list[int]:
    """The fingerprint, and further ones of the shingles' hashes mixed anew."""
    h = _shingle_hashes(text, shingle, seed)[:, None]
    mixed = (h ^ (h >> np.uint64(31))) * (np.arange(1, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
    return _majority(np.concatenate((h, mixed ^ (mixed >> np.uint64(29))), axis=1))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle, seed) for part in slices(batch, 1) for t in part.column(1).to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def walk(left: np.ndarray, right: np.ndarray | None, depth: int, used: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b) of fingerprints within the budget, below one or more nodes.

    ``left`` (and ``right``, None for a node against itself) are sorted unsigned
    longs. Equal leading ``depth`` bits mark one node of ``left``; in ``right``
    there is one node, as in ``left``, whose prefix differs in ``used`` bits.
    """
    alone = right is None
    right = left if alone else right
    if alone:
        prefix = left >> np.uint64(BITS - depth) if depth else np.zeros(len(left), np.uint64)
        lo = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
        hi = np.append(lo[1:], len(left))
        stack = [(depth, lo, hi, lo, hi, np.full(len(lo), used))] if len(left) else []
    else:
        one = np.array([0])
        stack = [(depth, one, one + len(left), one, one + len(right), one + used)] if len(left) and len(right) else []
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while stack:
        d, al, ah, bl, bh, dist = stack.pop()
        if len(al) > 200_000:  # depth first from here, to bound the frontier
            half = len(al) // 2
            stack += [(d, al[:half], ah[:half], bl[:half], bh[:half], dist[:half]), (d, al[half:], ah[half:], bl[half:], bh[half:], dist[half:])]
            continue
        same = (al == bl) & (ah == bh) if alone else np.zeros(len(al), bool)
        leaf = (ah - al == 1) & (bh - bl == 1)  # the rest of both paths is one leaf each
        if leaf.any():
            a, b = al[leaf & ~same], bl[leaf & ~same]
            near = np.bitwise_count(left[a] ^ right[b]) <= budget
            found_a.append(a[near])
            found_b.append(b[near])
            al, ah, bl, bh, dist, same = (x[~leaf] for x in (al, ah, bl, bh, dist, same))
        if d == BITS or not len(al):
            continue  # equal leaves only: distinct values have none left
        bit = np.uint64(1 << (BITS - 1 - d))
        am, bm = _middle(left, al, ah, bit), _middle(right, bl, bh, bit)
        cross = dist + 1
        parts = [(al, am, bl, bm, dist), (am, ah, bm, bh, dist), (al, am, bm, bh, cross), (am[~same], ah[~same], bl[~same], bm[~same], cross[~same])]
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget)
        stack.append((d + 1, *(x[keep] for x in nxt)))
    return np.concatenate(found_a), np.concatenate(found_b)


def _middle(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where in each sorted range, equal above ``bit``, the values with that bit begin."""
    first = (fps[lo] | bit) & ~np.uint64(int(bit) - 1)
    return np.clip(np.searchsorted(fps, first), lo, hi)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the non-roots of the graph with links (a, b) on 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def _walk_groups(key: str):
    """For rows sorted by ``key`` and side: walks each group, or many groups of plain nodes at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            k = batch.schema.get_field_index(key)
            keys = batch.column(k).to_numpy(zero_copy_only=False)
            if held and keys[-1] == held[-1].column(k)[-1].as_py():
                held.append(batch)
                continue
            cut_at = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut_at or held:
                yield from _walked([*held, batch.slice(0, cut_at)])
            held = [batch.slice(cut_at)]
        if held:
            yield from _walked(held)

    def _walked(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        keys, side, fp, depth, used = (t.column(c).to_numpy() for c in (key, "side", "fp", "depth", "used"))
        rot = t.column("rot").to_numpy()
        fps = _rotate(fp.view(np.uint64), rot)
        out = []
        for r in range(BITS // QUARTER):  # nodes at the first depth, all at once
            own = np.flatnonzero((depth == QUARTER) & (rot == r))
            own = own[np.argsort(fps[own], kind="stable")]
            out.append((own, own, *walk(fps[own], None, QUARTER, 0)))
        deep = np.flatnonzero(depth > QUARTER)
        for g in np.split(deep, np.flatnonzero(np.diff(keys[deep])) + 1) if len(deep) else []:
            a, b = g[side[g] == 0], g[side[g] == 1]
            a, b = (x[np.argsort(fps[x], kind="stable")] for x in (a, b))
            d, u = int(depth[g[0]]), int(used[g[0]])
            out.append((a, b, *walk(fps[a], fps[b], d, u)) if len(b) else (a, a, *walk(fps[a], None, d, u)))
        x = np.concatenate([a[i] for a, _, i, _ in out])
        y = np.concatenate([b[j] for _, b, _, j in out])
        values, where = np.unique(fp, return_inverse=True)
        node, root = forest(where[x], where[y], len(values))
        yield pa.RecordBatch.from_arrays([pa.array(values[node]), pa.array(values[root])], ["a", "b"])

    return run


def _rotate(fps: np.ndarray, rot: np.ndarray) -> np.ndarray:
    left = (rot * QUARTER).astype(np.uint64)
    return np.where(rot == 0, fps, (fps << left) | (fps >> (np.uint64(BITS) - left) % np.uint64(BITS)))


def links(fps: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """(a, b): a spanning forest of the links among the distinct ``fp`` of the table.

    Shuffles five longs for each distinct fingerprint and rotation.
    """
    if budget >= BITS // QUARTER:
        raise ValueError("the budget must be below the number of quarters")
    rotated = F.col("fp")
    for r in range(1, BITS // QUARTER):
        w = r * QUARTER
        rotated = F.when(F.col("rot") == r, F.shiftleft("fp", w).bitwiseOR(F.shiftrightunsigned("fp", BITS - w))).otherwise(rotated)
    nodes = fps.select("fp").distinct().withColumn("rot", F.explode(F.array(*(F.lit(r) for r in range(BITS // QUARTER)))))
    nodes = nodes.withColumn("rfp", rotated).select(
        "fp", "rot", "rfp", F.lit(0).alias("side"), F.lit(QUARTER).alias("depth"), F.lit(0).alias("used"),
        F.shiftrightunsigned("rfp", BITS - QUARTER).alias("pa"), F.shiftrightunsigned("rfp", BITS - QUARTER).alias("pb"))
    node = ["rot", "depth", "used", "pa", "pb"]
    small, depth = [], QUARTER
    sizes = nodes.groupBy(*node).count().where(F.col("count") > node_rows)
    while depth < BITS and (large := cut(sizes)).take(1):
        over = nodes.join(F.broadcast(large) if large.count() <= 10_000 else large, node, "left")
        small.append(over.where("count is null").drop("count"))
        nodes, depth = cut(_split(over.where("count is not null").drop("count"), depth, budget)), min(BITS, depth + _STEP)
        sizes = nodes.groupBy(*node).count().where(F.col("count") > node_rows)
    for x in small:
        nodes = nodes.unionByName(x)
    key = F.xxhash64(*node).alias("key")
    dealt = nodes.select(key, "side", "fp", "depth", "used", "rot")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_walk_groups("key"), "a long, b long")


def _split(nodes: DataFrame, depth: int, budget: int) -> DataFrame:
    """Deals the fingerprints of large node pairs to the pairs of their child nodes within the budget."""
    step = min(_STEP, BITS - depth)
    child = F.shiftrightunsigned("rfp", BITS - depth - step).bitwiseAND((1 << step) - 1)
    nodes = nodes.withColumn("c", child)
    pair = ["rot", "depth", "used", "pa", "pb"]
    kids = nodes.groupBy(*pair, "side", "c").agg(F.lit(1).alias("one")).drop("one")  # 2 ** step of a node at most
    a, b = kids.where("side = 0").drop("side").withColumnRenamed("c", "ca"), kids.withColumnRenamed("c", "cb").withColumnRenamed("side", "bs")
    both = a.join(b, pair).where("(pa = pb and bs = 0 and ca <= cb) or (pa <> pb and bs = 1)")
    differ = (F.col("used") + F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")))).alias("u")
    both = both.select(*pair, "ca", "cb", differ).where(F.col("u") <= budget)
    down = lambda p, c: (F.shiftleft(p, step).bitwiseOR(F.col(c)))
    both = both.select(*pair, "ca", "cb", "u", down("pa", "ca").alias("na"), down("pb", "cb").alias("nb"))
    on_a = both.select(*pair, F.when(F.col("pa") == F.col("pb"), F.lit(0)).otherwise(F.lit(0)).alias("side"), F.col("ca").alias("c"), "u", "na", "nb", F.lit(0).alias("to"))
    on_b = both.where("na <> nb").select(*pair, F.when(F.col("pa") == F.col("pb"), F.lit(0)).otherwise(F.lit(1)).alias("side"), F.col("cb").alias("c"), "u", "na", "nb", F.lit(1).alias("to"))
    dealt = nodes.join(on_a.unionByName(on_b), [*pair, "side", "c"])
    return dealt.select("fp", "rot", "rfp", F.col("to").alias("side"), (F.col("depth") + step).alias("depth"), F.col("u").alias("used"), F.col("na").alias("pa"), F.col("nb").alias("pb"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the least id among the rows linked with it."""
    marked = cut(fingerprints(docs, id_col=id_col, text_col=text_col))
    distinct = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")))
    roots = components(links(distinct, budget)).withColumnRenamed("node", "fp")
    named = cut(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    of = cut(join_unique(named.select("fp", "root"), least.select("root", "component_id"), ["root"], hot=hot_keys(least, ["root"])).select("fp", "component_id"))
    return join_unique(marked, of, ["fp"], hot=hot_keys(distinct, ["fp"])).select(id_col, "fp", "component_id")


def similar_documents(docs: DataFrame, shingle: int = 5, budget: int = WIDE_BUDGET, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for every row, by wide fingerprints; component_id is the least id among the rows linked with it."""
    longs = [f"w{k}" for k in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                wide = np.array([wide_fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64).reshape(len(part), WIDE)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in wide.T)], [id_col, *longs])

    kind = docs.schema[id_col].dataType.simpleString()
    marked = cut(docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in longs)))
    distinct = marked.groupBy(*longs).agg(F.min(id_col).alias("least"), F.count("*").alias("n"))
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    roots = components(wide_links(distinct.select("node", *longs), budget, recall))
    named = cut(distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    of = cut(join_unique(named.select("root", *longs), least.select("root", "component_id"), ["root"], hot=hot_keys(least, ["root"])).drop("root"))
    return join_unique(marked, of, longs, hot=hot_keys(distinct, longs)).select(id_col, "component_id")


def bit_orders(n: int, budget: int, recall: float) -> np.ndarray:
    """The first bits of each order: so many bits that a node has a few hundred of n fingerprints, so many orders that the recall is met."""
    first = max(8, math.ceil(math.log2(n + 1)) - 8)
    equal = (1 - budget / (WIDE * BITS)) ** first
    rng = np.random.default_rng(first)
    return np.array([rng.choice(WIDE * BITS, first, replace=False) for _ in range(math.ceil(math.log(1 - recall) / math.log(1 - equal)))])


def wide_links(nodes: DataFrame, budget: int = WIDE_BUDGET, recall: float = RECALL, node_rows: int = NODE_ROWS) -> DataFrame:
    """(a, b): links among distinct wide fingerprints (node, w0, ...) that meet in some order of bits, enough to connect those of each trie node."""
    longs = [c for c in nodes.columns if c != "node"]
    orders = bit_orders(nodes.count(), budget, recall)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = _longs(batch, longs)
            for number, bits in enumerate(orders):
                key = np.full(len(batch), number, np.int64)
                for b in bits.tolist():
                    key = key << 1 | (wide[:, b // BITS] >> np.uint64(b % BITS) & np.uint64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], ["key", *batch.schema.names])

    kinds = "key long, node long, " + ", ".join(f"{c} long" for c in longs)
    rows = nodes.select("node", *longs).mapInArrow(keyed, kinds).withColumn("part", F.lit(0))
    large = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > node_rows))
    if not large.isEmpty():
        large = F.broadcast(large.select("key", F.ceil(F.col("n") / node_rows).cast("int").alias("blocks")))
        dealt = rows.join(large, "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")  # each pair of blocks is one part
        dealt = dealt.withColumn("part", 1 + F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
        rows = rows.join(large, "key", "left_anti").unionByName(dealt.select(*rows.columns))
    rows = rows.select(F.xxhash64("key", "part").alias("key"), "node", *longs).repartition("key").sortWithinPartitions("key", "node")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            keys, node, wide = t.column("key").to_numpy(), t.column("node").to_numpy(), _longs(t, longs)
            edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))).tolist()
            found = [(begin + a, begin + b) for begin, end in zip(edges, edges[1:], strict=False) if end - begin > 1 for a, b in [connect(wide[begin:end], budget)]]
            a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return rows.mapInArrow(compared, "a long, b long")


def _longs(rows: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy().view(np.uint64) for c in names], axis=1)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut anew so that no group is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last or (held and held[-1].column(0)[-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def connect(wide: np.ndarray, budget: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect all rows which differ in ``budget`` bits at most, directly or through others.

    Rows are compared with all others outside their component so far, so a
    dense group costs one pass and not all its pairs.
    """
    n = len(wide)
    root = np.arange(n)
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if n <= block:
        far = np.zeros((n, n), np.uint16)
        for column in wide.T:
            far += np.bitwise_count(column[:, None] ^ column[None, :])
        a, b = np.nonzero(np.triu(far <= budget, 1))
        return a, b
    for i in range(n - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        far = np.zeros(len(rest), np.int64)
        for column in wide.T:  # down the bits, until too many differ
            far += np.bitwise_count(column[rest] ^ column[i])
            near = far <= budget
            rest, far = rest[near], far[near]
        if len(rest):
            low = min(int(root[i]), int(root[rest].min()))
            root[np.isin(root, np.append(root[rest], root[i]))] = low
            found_a.append(np.full(len(rest), i))
            found_b.append(rest)
    return np.concatenate(found_a), np.concatenate(found_b)
