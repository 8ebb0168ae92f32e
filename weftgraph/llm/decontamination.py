"""Benchmark decontamination by spaced-seed hashing.

A fixed mask over consecutive tokens hashes only the tokens it selects, so a
substituted token under an ignored position does not hide a copy. Test and
training texts are hashed with the same masks. A Bloom filter of the test
hashes, whose size is bounded, drops most training hashes where they are made;
the rest are joined with the test hashes exactly. Each hit names a test item
and a diagonal; along the whole of it the tokens are compared: the whole item,
most of which must be equal, or else the best stretch that tolerates
substitutions.

What is found: items of eight tokens or more of which four fifths are equal in
place, and stretches of 12 equal tokens, a substitution costing three. Items
of four to seven tokens are found where they stand unchanged, and items of
fewer where they are all of a document.

Tokens are maximal runs of letters and digits in the lower-cased text; signs
of scripts without spaces are tokens of their own. Null and empty texts have
no tokens; very long texts are read whole, and of a text that holds an item
twice the longer overlap counts, of equal ones the first. Rows equal in id and
text give one result; rows with a null id give results with a null id. Extra
columns are ignored; an empty table of either kind gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, join_unique, slices

#: Selected positions of each mask, six of six to nine. Of ten tokens with any two substituted, one mask or another has its six.
MASKS = ("111111", "1110111", "1011111", "11011011", "110110101", "111000111")
#: Items with fewer tokens are compared for equality only, and with fewer still, with whole documents only.
MIN_MASKED, MIN_INSIDE = 8, 4
#: A stretch is reported from so many equal tokens on (or all of a shorter item).
MIN_TOKENS = 12
#: What an unequal token costs a stretch, in equal tokens.
PENALTY = 3
#: A whole item is reported where so large a share of it, and eight tokens, are equal.
WHOLE_SHARE = 0.8
#: Bytes of text that are hashed together.
SLICE_BYTES = 1 << 19
#: Broadcast a test table of hashes up to so many rows; beyond, it is shuffled.
BROADCAST_ROWS = 500_000
#: Bits of the Bloom filter: 64 for each test hash, four of them set, and 2 ** 27 (16 MB) at most.
MAX_BLOOM_LOG2, PROBES = 27, 4

_CLEAN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_MARKS = re.compile("[\x80-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\u2000-\u206f\u20a0-\u20bf\u2190-\u2bff\u3000-\u3004\u3008-\u3020\ufe30-\ufe4f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(bytes([k]), 7) | 1 for k in range(16)], dtype=np.uint64)


class _Hashes(dict):
    """64-bit hashes of tokens, remembered."""

    def __missing__(self, token: bytes) -> int:
        self[token] = h = xxhash.xxh64_intdigest(token)
        return h


_tokens = _Hashes()


def token_hashes(text: str | None) -> np.ndarray:
    return _hashed([_words(text)])


def _words(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub(" ", text)
        if _UNSPACED.search(text):
            text = _UNSPACED.sub(r" \g<0> ", text)
    return text.encode().translate(_CLEAN).split()


def _hashed(texts: list[list[bytes]]) -> np.ndarray:
    """The hashes of the words of all texts, end to end."""
    if len(_tokens) > 150_000:
        _tokens.clear()
    return np.fromiter(map(_tokens.__getitem__, chain.from_iterable(texts)), np.uint64, sum(map(len, texts)))


def seeds(tokens: np.ndarray, masks: dict[int, str]) -> Iterator[tuple[int, str, np.ndarray]]:
    """(number, mask, hash at each position) for every numbered mask that fits the tokens."""
    mixed = [tokens * m for m in _MULTIPLIERS[: max((m.count("1") for m in masks.values()), default=0)]]
    for number, mask in masks.items():
        n = len(tokens) - len(mask) + 1
        if n > 0:
            h = np.full(n, number + 1, np.uint64)
            for part, at in zip(mixed, (i for i, c in enumerate(mask) if c == "1"), strict=False):
                h += part[at : at + n]
            h ^= h >> np.uint64(32)
            h *= _MULTIPLIERS[15]
            yield number, mask, h


def masks_for(n: int) -> dict[int, str]:
    """The masks of an item with so many tokens: the spaced ones, or one of all its tokens."""
    return dict(enumerate(MASKS)) if n >= MIN_MASKED else {100 + n: "1" * n} if n else {}


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, length, equal tokens) of the stretch with the highest score."""
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -PENALTY))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end - start, int(equal[start:end].sum())


def best_on_diagonal(own: np.ndarray, test: np.ndarray, lo: int, diagonal: int) -> tuple[int, int, int, int] | None:
    """(matched, -length, -doc_start, -item_start) of what a text's tokens from ``lo`` on share with an item laid at ``diagonal``, if that is enough."""
    first, last = max(lo, diagonal, 0), min(lo + len(own), diagonal + len(test))
    equal = own[first - lo : last - lo] == test[first - diagonal : last - diagonal]
    matched = int(np.count_nonzero(equal))
    start, length = 0, len(equal)
    if matched < (max(MIN_MASKED, WHOLE_SHARE * len(test)) if len(test) >= MIN_MASKED else len(test)):
        if matched < MIN_TOKENS:
            return None
        start, length, matched = best_stretch(equal)
        if matched < MIN_TOKENS:
            return None
    return matched, -length, -(first + start), -(first - diagonal + start)


def test_seeds(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, tokens, seeds): the tokens' hashes, and (position, hash) for each mask."""

    def run(batches):
        for batch in batches:
            toks = [token_hashes(t) for t in batch.column(1).to_pylist()]
            rows = [[{"pos": p, "h": h} for _, _, hs in seeds(t, masks_for(len(t))) for p, h in enumerate(hs.view(np.int64).tolist())] for t in toks]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.view(np.int64) for t in toks], pa.list_(pa.int64())), pa.array(rows, pa.list_(pa.struct([("pos", pa.int32()), ("h", pa.int64())])))], ["item", "tokens", "seeds"])

    kind = benchmark.schema[item_col].dataType.simpleString()
    return benchmark.select(item_col, F.col(text_col)).mapInArrow(run, f"item {kind}, tokens array<long>, seeds array<struct<pos:int,h:long>>")


def _bloom(hashes: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(log2 of its bits, its words); the words are gathered, so their number is bounded above."""
    log2 = min(MAX_BLOOM_LOG2, max(16, (64 * n).bit_length()))
    high, low = F.shiftrightunsigned("h", 32), F.col("h").bitwiseAND(2**32 - 1)
    at = F.explode(F.array(*((high + k * low).bitwiseAND((1 << log2) - 1) for k in range(PROBES)))).alias("at")
    rows = hashes.select(at).groupBy(F.shiftright("at", 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(31).cast("int"))).alias("bits")).toArrow()
    words = np.zeros(1 << (log2 - 5), np.uint32)
    words[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return log2, words


def _may_hold(bloom: tuple[int, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the filter lets through."""
    log2, words = bloom
    left = np.arange(len(h))
    for k in range(PROBES):
        at = ((h[left] >> np.uint64(32)) + np.uint64(k) * (h[left] & np.uint64(2**32 - 1))) & np.uint64((1 << log2) - 1)
        left = left[(words[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0]
    return left


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item, doc_start, item_start, length, matched) of the best overlap of each document and test item that share one."""
    spark = docs.sparkSession
    tests = cut(test_seeds(benchmark, item_col))
    hashes = tests.select("item", F.explode("seeds").alias("s")).select("item", "s.pos", "s.h")
    n = hashes.count()
    bloom = spark.sparkContext.broadcast(_bloom(hashes, n))
    sizes = [r["n"] for r in tests.select(F.least(F.size("tokens"), F.lit(MIN_MASKED)).alias("n")).distinct().collect()]  # eight at most
    masks = {k: m for size in sizes for k, m in masks_for(size).items()}
    margin = tests.agg(F.max(F.size("tokens"))).first()[0] or 0  # so that a hit's tokens hold the whole of any item around it

    def regions(batches):
        for batch in batches:
            found, begin, behind = [], 0, 0
            for part in slices(batch, 1, SLICE_BYTES):  # texts end to end, so that few array operations serve many
                begin, behind = behind, behind + len(part)
                words = [_words(t) for t in part.column(1).to_pylist()]
                sizes = np.array([len(w) for w in words])
                ends = np.cumsum(sizes)
                toks = _hashed(words)
                hits = []
                for number, mask, hs in seeds(toks, masks):
                    p = _may_hold(bloom.value, hs)
                    d = np.searchsorted(ends, p, side="right")
                    inside = p + len(mask) <= ends[d]
                    if number >= 100 and len(mask) < MIN_INSIDE:
                        inside &= sizes[d] == len(mask)
                    hits.append((p[inside], hs[p[inside]], d[inside]))
                if not sum(len(p) for p, _, _ in hits):
                    continue
                at, h, doc = (np.concatenate(x) for x in zip(*hits, strict=True))
                order = np.argsort(at, kind="stable")
                at, h, doc = at[order], h[order], doc[order]
                breaks = np.flatnonzero((np.diff(at) > 2 * margin) | (np.diff(doc) > 0)) + 1
                for run in np.split(np.arange(len(at)), breaks):
                    d = int(doc[run[0]])
                    start = int(ends[d] - sizes[d])
                    lo = max(start, int(at[run[0]]) - margin)
                    own = toks[lo : min(int(ends[d]), int(at[run[-1]]) + margin)]
                    found.append((begin + d, lo - start, own.view(np.int64), [{"pos": p, "h": x} for p, x in zip((at[run] - start).tolist(), h[run].view(np.int64).tolist(), strict=True)]))
            rows, lo, own, hit = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lo, pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array(hit, pa.list_(pa.struct([("pos", pa.int32()), ("h", pa.int64())])))], ["id", "lo", "tokens", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, F.col(text_col)).mapInArrow(regions, f"id {kind}, lo int, tokens array<long>, hits array<struct<pos:int,h:long>>")
    key = F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("lo"), F.col("tokens")
    found = cut(found.withColumn("region", F.struct(F.xxhash64(*key).alias("a"), F.xxhash64(F.lit("again"), *key).alias("b"))))

    held = (lambda df: F.broadcast(df)) if n <= BROADCAST_ROWS else (lambda df: df)  # the items' tokens are fewer than their hashes
    hits = found.select("region", F.explode("hits").alias("s")).select("region", F.col("s.pos").alias("at"), "s.h")
    places = hashes.groupBy("h").agg(F.collect_list(F.struct("item", "pos")).alias("places"))
    met = hits.join(F.broadcast(places), "h") if n <= BROADCAST_ROWS else join_unique(hits, cut(places), ["h"])
    lines = met.select("region", "at", F.explode("places").alias("p")).select("region", "p.item", (F.col("at") - F.col("p.pos")).alias("diagonal"))
    lines = lines.groupBy("region", "item").agg(F.collect_set("diagonal").alias("diagonals"))  # no more than the two have tokens
    apart = found.select("region", "id", "lo", "tokens").dropDuplicates(["region"])
    both = lines.join(apart, "region").join(held(tests.select("item", F.col("tokens").alias("test"))), "item")

    def compare(batches):
        for batch in batches:
            out = []
            for lo, diagonals, toks, test in zip(*(batch.column(c).to_pylist() for c in (2, 3)), *(batch.column(c) for c in (4, 5)), strict=True):
                own, test = toks.values.to_numpy(), test.values.to_numpy()
                out.append(max((f for d in sorted(diagonals) if (f := best_on_diagonal(own, test, lo, d)) is not None), default=None))
            found = [None if f is None else (-f[2], -f[3], -f[1], f[0]) for f in out]
            cols = [pa.array([None if f is None else f[k] for f in found], pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["id", "item", "doc_start", "item_start", "length", "matched"])

    item = tests.schema["item"].dataType.simpleString()
    checked = both.select("id", "item", "lo", "diagonals", "tokens", "test").mapInArrow(compare, f"id {kind}, item {item}, doc_start int, item_start int, length int, matched int")
    best = F.max(F.struct("matched", (-F.col("length")).alias("l"), (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("b")
    best = checked.where("matched is not null").groupBy("id", "item").agg(best)
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"), (-F.col("b.l")).alias("length"), F.col("b.matched").alias("matched"))
