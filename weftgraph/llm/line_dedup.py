"""Line dedup by a segment-partition edit join.

A line goes if an equal line stands earlier in the corpus, or if a line near it
does: one within ``max_edits`` edits anywhere, or one that differs in a single
stretch, of a twenty-fifth of the longer line at most (a changed word, say).

Lines within k edits share one of k + 1 even segments, shifted by k at most;
so each distinct line puts the hashes of its own segments into an index and
probes it with the few substrings, by length, that could be another line's
segment. Lines that differ in one stretch share the segment before or after
it, which is nearly half of them; its size goes by length classes, and a line
probes its own class and the one below. Pairs that meet are verified, by a
banded bit-parallel edit distance and by their common ends.

A key that very many lines share (the halves of one line's many variants)
would make pairs by the square. Such keys are counted first and taken out of
the join; their lines are dealt into blocks, pairs of blocks are compared by
character counts in tasks of bounded size, and only pairs within reach are
verified. Nothing is dropped, and of pairs only the later line is handed on.
Equal lines are one line to all of this: they are first grouped by a 128-bit
hash with map-side combining.

"Earlier" is by (doc_id, text, line number), null ids last; rows equal in id
and text count as one document. Blank lines always stay, and lines below
``min_chars`` are compared for equality only. A null text stays null and has
no lines; very long texts and lines are read whole. Extra columns are carried
through unless they bear the names added here; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, hot_keys, join_unique, row_key

MAX_EDITS, MIN_CHARS = 1, 16
#: A changed stretch may have one of so many characters of the longer line.
STRETCH = 25
#: Index rows of one key from which on its lines are compared by blocks, and lines in a block.
HOT_KEY, BLOCK = 16, 500
#: Broadcast a set of line hashes (one long each) up to so many rows; beyond, it is shuffled.
BROADCAST_ROWS = 500_000


def edit_distance_within(a: str, b: str, k: int) -> int | None:
    """The edit distance of a and b if it is k at most, by bit-parallel columns of the 2k + 1 diagonals around the middle one."""
    if abs(len(a) - len(b)) > k:
        return None
    n = min(len(a), len(b))
    lo = 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if max(len(a), len(b)) <= 1 or not a or not b:  # one edit, or only insertions
        d = max(len(a), len(b))
        return d if d <= k else None
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + k)
    full = (1 << 2 * k + 1) - 1
    top, end = 1 << 2 * k, 1 << (len(a) - len(b) + k)
    # Bit d of column j stands for row j - k + d. Rows above the first cost one more each, so that row 0 grows by one a column.
    down = (1 << k + 1) - 1  # the cell is one less than the one above it
    up = full ^ down  # one more
    d = abs(len(a) - len(b))
    for j, c in enumerate(b, 1):
        up, down = up >> 1 | top, down >> 1
        match = where.get(c, 0) >> (j - 1) & full
        level = ((((match & up) + up) ^ up) | match | down) & full  # diagonal steps that cost nothing
        if not level & end:
            d += 1
            if d > k:
                return None
        right_up, right_down = down | full & ~(level | up), up & level
        up, down = full & (right_down << 1 | ~(level | right_up << 1)), level & right_up << 1 & full
    return d


def segment_keys(line: Column, k: int, length: Column | None = None) -> list[tuple[bool, Column]]:
    """(own, hash): hashes of the line's own k + 1 segments, and of its substrings that may be a segment of a line shorter by 0 to k.

    A length that is a column already is not counted anew for each of them.
    """
    out, own_length = [], F.char_length(line) if length is None else length
    for shorter in range(k + 1):
        length = own_length - shorter
        short, longer = F.floor(length / (k + 1)).cast("int"), (length % (k + 1)).cast("int")
        for i in range(k + 1):
            before = F.greatest(F.lit(0), longer - (k + 1 - i))  # of the longer segments, which come last
            start, size = short * i + before, short + F.when(longer >= k + 1 - i, 1).otherwise(0)
            for move in range(max(-i, shorter - (k - i)), min(i, shorter + (k - i)) + 1):
                piece = F.substring(line, (start + move + 1), size)
                out.append((shorter == 0 and move == 0, F.xxhash64(length, F.lit(i), piece)))
    return out


def length_class(line: Column) -> Column:
    """A class spans a twentieth, more than a stretch, so a line is in the class of any shorter one or in the next."""
    return F.floor(F.log(F.char_length(line)) / math.log(1.05)).cast("int")


def end_keys(line: Column, of: Column | None = None) -> list[tuple[bool, Column]]:
    """(own, hash): hashes of the line's ends, each nearly half of it, by its own length class ``of`` and the one below."""
    of = length_class(line) if of is None else of
    out = []
    for below in (0, 1):
        size = F.floor(F.lit(0.45) * F.pow(F.lit(1.05), of - below)).cast("int")
        out += [(below == 0, F.xxhash64(F.lit("head"), of - below, F.left(line, size))), (below == 0, F.xxhash64(F.lit("tail"), of - below, F.right(line, size)))]
    return out


def common_ends(a: str, b: str) -> int:
    """How many characters of the shorter one are a common head or else a common tail."""
    n = min(len(a), len(b))

    def longest(same: Callable[[int], bool], most: int) -> int:
        low = 0
        while low < most:
            middle = (low + most + 1) // 2
            low, most = (middle, most) if same(middle) else (low, middle - 1)
        return low

    head = longest(lambda k: a[:k] == b[:k], n)
    return head + longest(lambda k: a[len(a) - k :] == b[len(b) - k :], n - head)


def is_near(a: str, b: str, k: int) -> bool:
    most = max(len(a), len(b))
    return most - common_ends(a, b) <= most // STRETCH or edit_distance_within(a, b, k) is not None


def has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\n\x0b\f\r")) != ""


def lines_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, no, ord, h1, h2, line) of every line with a word; ord orders the lines of the corpus.

    What a document's lines share is computed below the explode, once a document.
    """
    whole = docs.select(row_key().alias("row"), F.coalesce("doc_id", F.lit(2**63 - 1)).cast("decimal(19,0)").alias("d"), F.col(text_col).alias("text"))
    at = F.pmod("row.a", F.lit(10**9)) * F.lit(10**10).cast("decimal(11,0)")  # ten digits for the line, nine to tell texts of one id apart
    first = (F.col("d") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + at).cast("decimal(38,0)")
    split = whole.select("row", first.alias("at"), "text").select("row", "at", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    split = split.where(has_word(F.col("line")))
    return split.select("row", "no", (F.col("at") + F.col("no")).cast("decimal(38,0)").alias("ord"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), "line")


def late_lines(lines: DataFrame, keys: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """(h1, h2) of the lines that have an earlier line near them; keys has (h1, own, key)."""
    own = keys.where("own").select("key", F.col("h1").alias("a"))
    hot = cut(own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY))
    n_hot = hot.count()
    small = F.broadcast if n_hot <= BROADCAST_ROWS else (lambda df: df)
    mild = keys.join(small(hot), "key", "left_anti") if n_hot else keys
    meet = mild.where("own").select("key", F.col("h1").alias("a")).join(mild.select("key", F.col("h1").alias("b")), "key").where("a <> b")
    meet = cut(meet.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    crowd = cut(keys.join(small(hot), "key").select("key", "own", F.col("h1").alias("a"), "n").distinct()) if n_hot else None

    wanted = meet.select(F.explode(F.array("a", "b")).alias("h1"))
    if crowd is not None:
        wanted = wanted.unionByName(crowd.select(F.col("a").alias("h1")))
    wanted = cut(wanted.distinct())
    held = F.broadcast if wanted.count() <= BROADCAST_ROWS else (lambda df: df)
    texts = cut(lines.where(F.char_length("line") >= min_chars).join(held(wanted), "h1").groupBy("h1", "h2", "line").agg(F.min("ord").alias("first")))

    named = lambda side: texts.select(F.col("h1").alias(side), F.struct("h1", "h2").alias(f"{side}_id"), F.col("first").alias(f"{side}_first"), F.col("line").alias(f"{side}_line"))
    pairs = meet.join(named("a"), "a").join(named("b"), "b")
    pairs = pairs.select(F.when(F.col("a_first") > F.col("b_first"), F.col("a_id")).otherwise(F.col("b_id")).alias("late"), "a_line", "b_line")
    late = pairs.mapInArrow(_verify(max_edits), "late struct<h1:bigint,h2:bigint>").select("late.h1", "late.h2")
    if crowd is not None:
        probes = crowd.groupBy("key").agg(F.count("*").alias("m"))
        blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        dealt = crowd.join(probes, "key").join(named("a"), "a").withColumns({"ni": blocks("n"), "np": blocks("m"), "h1": F.col("a_id.h1"), "h2": F.col("a_id.h2"), "first": F.col("a_first"), "line": F.col("a_line")})
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        index = dealt.where("own").select("key", F.pmod("a", "ni").alias("ib"), every("np").alias("pb"), F.lit(True).alias("own"), "h1", "h2", "first", "line")
        probe = dealt.select("key", every("ni").alias("ib"), F.pmod("a", "np").alias("pb"), F.lit(False).alias("own"), "h1", "h2", "first", "line")
        late = late.unionByName(index.unionByName(probe).groupBy("key", "ib", "pb").applyInPandas(_block(max_edits), "h1 long, h2 long"))
    return cut(late.distinct())


def _verify(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a_line", "b_line"))
            near = pa.array([is_near(x, y, k) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["late"]).filter(near)

    return run


def _block(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["own"].to_numpy(bool)
        lines = rows["line"].tolist()
        counts = np.stack([_counts(t) for t in lines])
        size = np.array([len(t) for t in lines])
        order = {at: n for n, at in enumerate(sorted(set(rows["first"])))}
        first = np.array([order[at] for at in rows["first"]])
        # An index row and a probe row of one line are the same line here.
        number = pd.factorize(pd.Series(list(zip(rows["h1"], rows["h2"], strict=True))))[0]
        late = np.zeros(len(rows), bool)  # by line
        probes = np.flatnonzero(~own)
        for x in np.flatnonzero(own).tolist():
            reach = probes[np.abs(counts[probes] - counts[x]).sum(axis=1) <= 2 * np.maximum(k, np.maximum(size[probes], size[x]) // STRETCH)]  # an edit changes two counts by one each at most
            later = np.where(first[reach] < first[x], number[x], number[reach])
            asked = ~late[later] & (number[reach] != number[x])
            for j, line in zip(reach[asked].tolist(), later[asked].tolist(), strict=True):
                if not late[line] and is_near(lines[x], lines[j], k):
                    late[line] = True
        found = rows[late[number]]
        return found[["h1", "h2"]].drop_duplicates()

    return run


def _counts(line: str) -> np.ndarray:
    return np.bincount(np.frombuffer(line.encode("utf-32-le"), np.uint32) % 61, minlength=64).astype(np.int32)


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, text_col: str = "text") -> DataFrame:
    """``docs`` with the text of its kept lines, and n_lines, n_removed (of lines with a word)."""
    docs = docs.drop("row", "gone", "n_lines", "n_removed")
    lines = lines_of(docs, text_col)
    found = segment_keys(F.col("line"), max_edits, F.col("length")) + end_keys(F.col("line"), F.col("class"))
    slots = [f"k{i}" for i in range(len(found))]
    each = lines.withColumns({"length": F.char_length("line"), "class": length_class(F.col("line"))})
    each = each.select("h1", "h2", "ord", *(F.when(F.col("length") >= min_chars, k).alias(s) for (_, k), s in zip(found, slots, strict=True)))
    distinct = cut(each.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.count("*").alias("n"), *(F.min(s).alias(s) for s in slots)))
    rows = F.explode(F.array(*(F.struct(F.lit(own).alias("own"), F.col(s).alias("key")) for (own, _), s in zip(found, slots, strict=True)))).alias("k")
    late = late_lines(lines, distinct.where(f"{slots[0]} is not null").select("h1", rows).select("h1", "k.own", "k.key"), max_edits, min_chars)

    verdict = distinct.join(late.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("n > 1 or near")
    verdict = cut(verdict.select("h1", "h2", "first", "n", F.coalesce("near", F.lit(False)).alias("near")))
    gone = join_unique(lines.drop("line"), verdict.drop("n"), ["h1", "h2"], hot=hot_keys(verdict, ["h1", "h2"])).where("near or ord <> first")
    gone = gone.groupBy("row").agg(F.collect_set("no").alias("gone"))

    split = F.split(text_col, "\n", -1)
    kept = F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    n_lines = F.coalesce(F.size(F.filter(split, has_word)), F.lit(0))
    out = docs.withColumn("row", row_key()).join(gone, "row", "left")
    columns = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*columns, F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
