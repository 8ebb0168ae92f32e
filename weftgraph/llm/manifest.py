"""A Merkle manifest of a dataset: leaves by rank queries on bitmaps, levels by keyed slot arrays.

A row's leaf is the digest of its columns. Every task turns the ids that it
meets into bitmaps, one for each group and 4,096 ids, kept as lists of set bits
where that is shorter; tasks' bitmaps are merged by OR. Their population counts
make a directory of four levels, each a running sum over at most 8,192
neighbours, so an id's place among its group's leaves is the directory's count
before its bitmap plus the bits set below it: no leaf is sorted. Leaves then go
by their place, 512 to an array, and an array's levels are reduced in one task;
what is left of every array is a node of the next pass. On the way back, each
node's siblings are put before those of its array. The roots of the groups make
a last tree in the same way.

Work is dealt by group and array, so a group with most rows is no single
task's work. Every pass is cut by a checkpoint in the shared folder.

A null group comes first and a null id is the first of its group. Rows of one
group and id, null ids too, lie side by side in the order of their leaves,
equal leaves in any order; only such rows are sorted, by range. Null columns
are marked in the leaf apart from empty ones. Long texts are digested by the
engine. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.common import ranked
from weftgraph.llm.common import cut, join_unique

#: Bits of an id within a bitmap, of a directory level, and of a place within an array (three levels of eight).
LOW_BITS, LEVEL_BITS, BLOCK_BITS, RUN_BITS = 12, 13, 9, 3
#: The bitmap number of null ids, below that of any id.
NULL_CHUNK = -(1 << (63 - LOW_BITS)) - 1
#: Rows whose bitmaps a task holds before it hands them on.
HELD_ROWS = 1 << 18
PATH = "siblings array<string>, lefts array<int>, rights array<int>"


def entry(c: Column) -> Column:
    """A column's part of a leaf: ``-`` if null, else the bytes of its text, a colon and the text."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(entry, columns)).cast("binary"), 256)


def proof_digest() -> Column:
    """The digest of a row's siblings, level by level, left to right."""
    return F.sha2(F.array_join("siblings", "").cast("binary"), 256)


def folded(digest: Column) -> Column:
    """The root that a leaf's hex digest gives with the row's siblings."""
    zero = F.struct(digest.alias("d"), F.lit(1).alias("at"))

    def up(state: Column, level: Column) -> Column:
        left, right = level["lefts"], level["rights"]
        before, after = F.slice("siblings", state["at"], left), F.slice("siblings", state["at"] + left, right)
        d = F.sha2(F.concat(F.array_join(before, ""), state["d"], F.array_join(after, "")).cast("binary"), 256)
        return F.struct(d.alias("d"), (state["at"] + left + right).alias("at"))

    return F.aggregate(F.arrays_zip("lefts", "rights"), zero, up)["d"]


# Bitmaps


def packed(low: np.ndarray) -> bytes:
    """Distinct bit numbers as a bitmap, or where shorter as a list of 16-bit numbers after an odd byte."""
    if 2 * len(low) + 1 < (1 << LOW_BITS) // 8:
        return b"\0" + low.astype("<u2").tobytes()
    bits = np.zeros(1 << LOW_BITS, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """One flag for each bit."""
    if len(raw) == (1 << LOW_BITS) // 8:
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").astype(bool)
    bits = np.zeros(1 << LOW_BITS, bool)
    bits[np.frombuffer(raw, "<u2", offset=1)] = True
    return bits


def _own_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (g, chunk, low): (g, chunk, n, bits, twice), the ids that are there and those that are there more than once."""
    held: dict[tuple[str, int], list[np.ndarray]] = {}

    def done() -> pa.RecordBatch:
        out: list[tuple] = []
        for (g, chunk), found in held.items():
            low, times = np.unique(np.concatenate(found), return_counts=True)
            out.append((g, chunk, int(times.sum()), packed(low), packed(low[times > 1])))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["g", "chunk", "n", "bits", "twice"])

    rows = 0
    for batch in batches:
        groups = batch.column(0).dictionary_encode()
        chunk, low = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.uint16)
        order = np.lexsort((chunk, groups.indices.to_numpy()))
        code, chunk, low = groups.indices.to_numpy()[order], chunk[order], low[order]
        starts = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])))) if len(order) else []
        for a, b in zip(starts, [*starts[1:], len(order)], strict=False):
            held.setdefault((groups.dictionary[int(code[a])].as_py(), int(chunk[a])), []).append(low[a:b])
        rows += len(batch)
        if rows >= HELD_ROWS:
            yield done()
            rows = 0
    if held:
        yield done()


def _merged(group: pa.Table) -> pa.Table:
    """A bitmap's own parts by OR, and its population count."""
    bits, twice = np.zeros(1 << LOW_BITS, bool), np.zeros(1 << LOW_BITS, bool)
    for own, own_twice in zip(group.column("bits").to_pylist(), group.column("twice").to_pylist(), strict=True):
        new = unpacked(own)
        twice |= unpacked(own_twice) | (bits & new)
        bits |= new
    n = int(np.sum(group.column("n").to_numpy()))
    return pa.table({"g": group.column("g")[:1], "chunk": group.column("chunk")[:1], "n": [n], "bits": [packed(np.flatnonzero(bits))], "twice": pa.array([np.flatnonzero(twice).astype(np.int32).tolist()], pa.list_(pa.int32()))})


def bitmaps(rows: DataFrame) -> DataFrame:
    """(g, chunk, n, bits, twice) of rows (g, chunk, low); n counts rows, twice lists the ids that repeat."""
    own = rows.select("g", "chunk", "low").mapInArrow(_own_bitmaps, "g string, chunk long, n long, bits binary, twice binary")
    return own.groupBy("g", "chunk").applyInArrow(_merged, "g string, chunk long, n long, bits binary, twice array<int>")


def directory(counts: DataFrame, levels: int = 3) -> DataFrame:
    """(g, chunk, before, total) of (g, chunk, n): how many rows of the group come before the bitmap, and how many it has.

    Running sums go over the neighbours below one node of the next level, and
    that one's own sum is added, so no window has more than 8,192 rows or so.
    """
    order = Window.partitionBy("g", "up").orderBy("chunk")
    rows = counts.select("g", "chunk", "n", (F.shiftright("chunk", LEVEL_BITS) if levels else F.lit(0).cast("long")).alias("up"))
    own = rows.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    if not levels:
        return own.withColumn("total", F.sum("n").over(Window.partitionBy("g", "up"))).select("g", "chunk", "before", "total")
    above = directory(rows.groupBy("g", F.col("up").alias("chunk")).agg(F.sum("n").alias("n")), levels - 1)
    above = above.select("g", F.col("chunk").alias("up"), F.col("before").alias("above"), "total")
    return own.join(above, ["g", "up"]).select("g", "chunk", (F.col("before") + F.col("above")).alias("before"), "total")


def _places(group: pa.Table, found: pa.Table) -> pa.Table:
    """The rows with their slot: rows before the bitmap, bits below, and what repeated ids below have besides."""
    bits = unpacked(found.column("bits")[0].as_py()).astype(np.int64)
    for at, more in zip(found.column("repeated")[0].as_py() or [], found.column("more")[0].as_py() or [], strict=True):
        bits[at] += more
    below = np.cumsum(bits) - bits
    slot = found.column("before")[0].as_py() + below[group.column("low").to_numpy()]
    return group.append_column("slot", pa.array(slot)).append_column("total", pa.array(np.full(len(slot), found.column("total")[0].as_py())))


def slots(rows: DataFrame) -> DataFrame:
    """Adds slot and total to rows (g, id, leaf, ...): the place of each in its group, by id and leaf, and the group's size."""
    null = F.col("id").isNull()
    chunk, low = F.when(null, NULL_CHUNK).otherwise(F.shiftright("id", LOW_BITS)), F.when(null, 0).otherwise(F.col("id").bitwiseAND((1 << LOW_BITS) - 1))
    keyed = rows.withColumns({"chunk": chunk, "low": low.cast("int")})
    maps = cut(bitmaps(keyed))
    placed = maps.select("g", "chunk", "bits").join(directory(maps), ["g", "chunk"])
    key, names = ["g", "chunk", "low"], rows.columns
    repeated = maps.select("g", "chunk", F.explode("twice").alias("low"))
    kinds = ", ".join(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in keyed.columns) + ", slot long, total long"
    if repeated.isEmpty():
        placed = placed.withColumns({"repeated": F.array().cast("array<int>"), "more": F.array().cast("array<long>")})
        return keyed.groupBy("g", "chunk").cogroup(placed.groupBy("g", "chunk")).applyInArrow(_places, kinds).select(*names, "slot", "total")
    repeated = cut(repeated)
    many = cut(join_unique(keyed, repeated.withColumn("again", F.lit(True)), key).drop("again"))
    counts = cut(many.groupBy(*key).agg(F.count("*").alias("n")))
    more = counts.groupBy("g", "chunk").agg(F.sort_array(F.collect_list(F.struct("low", "n"))).alias("r"))  # as many as a bitmap has bits
    placed = placed.join(more, ["g", "chunk"], "left").withColumns({"repeated": F.col("r.low"), "more": F.transform("r.n", lambda n: n - 1)}).drop("r")
    single = join_unique(keyed, repeated.withColumn("again", F.lit(True)), key, "left").where("again is null").drop("again").select(*keyed.columns)
    found = single.groupBy("g", "chunk").cogroup(placed.groupBy("g", "chunk")).applyInArrow(_single_places, kinds).select(*names, "slot", "total")
    first = counts.select(*key).groupBy("g", "chunk").cogroup(placed.groupBy("g", "chunk")).applyInArrow(_single_places, "g string, chunk long, low int, slot long, total long")
    rank = cut(ranked(many.withColumn("copy", F.monotonically_increasing_id()), "g", "chunk", "low", "leaf", "copy"))
    least = rank.groupBy(*key).agg(F.min("rank").alias("least"))
    rest = join_unique(rank, cut(first.join(least, key)), key)
    return found.unionByName(rest.select(*names, (F.col("slot") + F.col("rank") - F.col("least")).alias("slot"), "total"))


def _single_places(group: pa.Table, found: pa.Table) -> pa.Table:
    """As ``_places``, where all rows of a bitmap may have gone elsewhere."""
    return _places(group, found) if len(group) else group.append_column("slot", pa.array([], pa.int64())).append_column("total", pa.array([], pa.int64()))


# Levels


def _levels(digests: list[str], n: int) -> list[list[str]]:
    """An array's nodes level by level, of a tree that has n nodes beside each other here; a tree ends at one node."""
    out = [digests]
    for _ in range(BLOCK_BITS // RUN_BITS):
        if n <= 1:
            break
        d = out[-1]
        out.append([hashlib.sha256("".join(d[i : i + 8]).encode()).hexdigest() for i in range(0, len(d), 8)])
        n = -(-n // 8)
    return out


def _filled(group: pa.Table) -> tuple[np.ndarray, list[str]]:
    """(order, digests): each slot's row, and digest; the slots of an array are consecutive."""
    slot = group.column("slot").to_numpy()
    order = np.empty(len(slot), np.int64)
    order[slot & ((1 << BLOCK_BITS) - 1)] = np.arange(len(slot))
    digests = group.column("digest").to_pylist()
    return order, [digests[k].hex() for k in order]


def _reduced(group: pa.Table) -> pa.Table:
    n = group.column("total")[0].as_py()
    top = _levels(_filled(group)[1], n)
    assert len(top[-1]) == 1
    left = n
    for _ in top[1:]:
        left = -(-left // 8)
    return pa.table({"g": group.column("g")[:1], "slot": [group.column("slot")[0].as_py() >> BLOCK_BITS], "digest": [bytes.fromhex(top[-1][0])], "total": [left]})


def _with_paths(group: pa.Table, above: pa.Table) -> pa.Table:
    """The array's rows with their siblings, from here to the root."""
    order, digests = _filled(group)
    levels = _levels(digests, group.column("total")[0].as_py())
    rest = [above.column(c)[0].as_py() for c in ("siblings", "lefts", "rights")]
    paths: list[list] = [[], [], []]
    for k in range(len(order)):
        own: list[list] = [[], [], []]
        for nodes in levels[:-1]:
            begin, at = k & ~7, k & 7
            run = nodes[begin : begin + 8]
            own[0] += run[:at] + run[at + 1 :]
            own[1].append(at), own[2].append(len(run) - 1 - at)
            k >>= RUN_BITS
        for path, mine, upper in zip(paths, own, rest, strict=True):
            path.append(mine + upper)
    kinds = pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())
    out = group.take(pa.array(order))
    for name, path, kind in zip(("siblings", "lefts", "rights"), paths, kinds, strict=True):
        out = out.append_column(name, pa.array(path, kind))
    for name in ("subroot", "root"):
        out = out.append_column(name, pa.array([above.column(name)[0].as_py()] * len(order), pa.string()))
    return out


def _block() -> Column:
    return F.shiftright("slot", BLOCK_BITS).alias("block")


def passes(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (g, slot, digest, total) that each pass leaves; the last has one for each g."""
    out, most = [], nodes.agg(F.max("total")).first()[0] or 0
    while not out or most > 1:
        nodes = cut(nodes.select("g", "slot", "digest", "total").groupBy("g", _block()).applyInArrow(_reduced, "g string, slot long, digest binary, total long"))
        out.append(nodes)
        most = -(-most // (1 << BLOCK_BITS))
    return out


def down(nodes: DataFrame, left: list[DataFrame], top: DataFrame) -> DataFrame:
    """The nodes with paths to the root; top has (g, siblings, lefts, rights, subroot, root) of each tree."""
    above = top.withColumn("slot", F.lit(0).cast("long"))
    for level in [*reversed(left[:-1]), nodes]:
        kinds = ", ".join(f"{c} {level.schema[c].dataType.simpleString()}" for c in level.columns)
        # An array's rows have one block, which is the slot of the node above.
        above = level.groupBy("g", _block()).cogroup(above.groupBy("g", "slot")).applyInArrow(_with_paths, f"{kinds}, {PATH}, subroot string, root string")
    return above


def manifest(docs: DataFrame, columns: dict[str, Column], id_col: Column, group_col: Column, also: dict[str, Column] | None = None) -> DataFrame:
    """(id, group, slot, leaf, siblings, lefts, rights, subroot, root, also): every row's place and proof.

    ``columns`` are digested, in their order; ``also`` are further columns of a
    row that are carried along. lefts and rights say how many siblings stand at
    either side, level by level.
    """
    also = also or {}
    group = F.when(group_col.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group_col.cast("string")))
    rows = docs.select(id_col.cast("long").alias("id"), group.alias("g"), F.unhex(leaf(list(columns.values()))).alias("leaf"), *(c.alias(n) for n, c in also.items()))
    nodes = cut(slots(cut(rows)).withColumn("digest", F.col("leaf")).drop("leaf"))
    left = passes(nodes)
    roots = ranked(left[-1].select("g", "digest"), "g")
    roots = cut(roots.select(F.lit("").alias("g"), F.col("rank").alias("slot"), "digest", F.lit(roots.count()).cast("long").alias("total"), F.col("g").alias("of")))
    root_left = passes(roots)
    none = F.array()
    top = root_left[-1].select("g", none.cast("array<string>").alias("siblings"), none.cast("array<int>").alias("lefts"), none.cast("array<int>").alias("rights"), F.lit("").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    groups = down(roots, root_left, top)
    groups = cut(groups.select(F.col("of").alias("g"), "siblings", "lefts", "rights", F.lower(F.hex("digest")).alias("subroot"), "root"))
    found = down(nodes, left, groups)
    name = F.when(F.col("g") != "", F.substr("g", F.lit(2)))
    return found.select("id", name.alias("group"), "slot", F.lower(F.hex("digest")).alias("leaf"), "siblings", "lefts", "rights", "subroot", "root", *also)
