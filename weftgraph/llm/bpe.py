"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes its slice of the corpus batch by batch. The distinct pre-tokens
of a batch that it has not met before are laid end to end in one token list.
An inverted index holds, for every merge that is possible somewhere, the
positions where it is; merges are then applied in rank order, each to all its
positions, and only the two neighbours of a merged pair enter the index anew.
Documents are spelled from the encoded pre-tokens. There is no shuffle: rows
are independent of each other, so a hot source or group costs nothing extra.

A null text counts as the empty text; both have no ids. A null or repeated
doc_id is carried through, one output row per input row, and an empty table
gives none. Very long texts are encoded whole, in memory that grows with the
text alone. Of two places where one rank applies, the first comes first. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import slices

#: Encoded pre-tokens that a worker remembers before it keeps only those of the slice at hand.
CACHE_WORDS = 150_000
#: Bytes of text that are encoded together.
SLICE_BYTES = 2 << 20
#: From so many words on, a rank's places are merged together.
MANY_WORDS = 2000
_SHIFT, _SEP, _DEAD = 20, (1 << 20) - 1, (1 << 20) - 2  # ids stay below 2 ** 20 - 2


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The vocabulary file (base64 token and rank on each line) by Spark's text reader."""
    rows = spark.read.text(f"file://{path}" if path.startswith("/") else path).collect()
    return {base64.b64decode(a): int(b) for a, b in (r.value.split(" ") for r in rows if r.value)}


class MergeReplay:
    """Applies the merges of a vocabulary to many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.merged: dict[int, int] = {}
        for t, i in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    self.merged[a << _SHIFT | b] = i
        self.pairs = np.array(sorted(self.merged) or [-1], dtype=np.int64)
        self.pair_ranks = np.array([self.merged.get(k, -1) for k in self.pairs.tolist()], dtype=np.int64)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(words)
        rest = []
        for k, w in enumerate(words):
            if (i := self.ranks.get(w)) is not None:
                out[k] = i.to_bytes(4, "little")
            elif w:
                rest.append(k)
            else:
                out[k] = b""
        if rest:
            ids = self._replay([words[k] for k in rest])
            for k, x in zip(rest, ids, strict=True):
                out[k] = x
        return out  # type: ignore[return-value]

    def _replay(self, words: list[bytes]) -> list[bytes]:
        """Applies each rank's merge to all its positions at once, or where few words are left, one by one."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.concatenate(([0], np.cumsum(lengths + 1)))  # of the separators, one before each word and one at the end
        flat = np.full(int(ends[-1]) + 1, _SEP, dtype=np.int64)
        inside = np.ones(len(flat), dtype=bool)
        inside[ends] = False
        flat[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        odd = self._merge_one_by_one(flat) if len(words) < MANY_WORDS else self._merge_together(flat)
        done = flat[flat != _DEAD]
        cuts = np.flatnonzero(done == _SEP).tolist()
        raw = done.astype("<u4").tobytes()
        out = [raw[4 * a + 4 : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        if len(odd):
            again = np.unique(np.searchsorted(ends, odd) - 1).tolist()
            for k in range(0, len(again), MANY_WORDS - 1):
                some = again[k : k + MANY_WORDS - 1]
                for i, ids in zip(some, self._replay([words[i] for i in some]), strict=True):
                    out[i] = ids
        return out

    def _ranks_of(self, keys: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, or -1."""
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], -1)

    def _merge_together(self, tok: np.ndarray) -> np.ndarray:
        """Merges in place; returns positions in words where a merge made one of lower rank, which are to be done anew.

        ``pair`` holds for every live position the rank of the merge that begins
        there. The index holds the positions of each rank, with some that have
        changed since; ``pair`` tells them apart.
        """
        n = len(tok)
        left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
        pair = np.append(self._ranks_of(tok[:-1] << _SHIFT | tok[1:]), -1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
            for r, a, b in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(heap, r)

        if len(at := np.flatnonzero(pair >= 0)):
            enter(at, pair[at])
        odd = [np.empty(0, np.int64)]
        while heap:
            rank = heapq.heappop(heap)
            p = np.unique(np.concatenate(index.pop(rank)))
            p = p[pair[p] == rank]
            if not len(p):
                continue
            q = right[p]
            over = np.concatenate(([False], q[:-1] == p[1:]))  # shares a token with the place before it
            if over.any():
                step = np.arange(len(p))
                p = p[(step - np.maximum.accumulate(np.where(over, 0, step))) % 2 == 0]
                q = right[p]
            after = right[q]
            if (touch := after[:-1] == p[1:]).any():  # one by one, the first of two would meet the second unmerged
                between = self._ranks_of(rank << _SHIFT | tok[p[1:][touch]])
                odd.append(p[1:][touch][(between >= 0) & (between < rank)])
            tok[p], tok[q], pair[q], right[p], left[after] = rank, _DEAD, -1, after, p
            before = left[p]
            one, two = self._ranks_of(tok[before] << _SHIFT | rank), self._ranks_of(rank << _SHIFT | tok[after])
            pair[before], pair[p] = one, two
            at, new = np.concatenate((before, p)), np.concatenate((one, two))
            known = new >= 0
            if known.any():
                at, new = at[known], new[known]
                enter(at, new)
                if new.min() < rank:
                    odd.append(at[new < rank])
        return np.concatenate(odd)

    def _merge_one_by_one(self, flat: np.ndarray) -> np.ndarray:
        """The same with plain lists; a merge of lower rank interrupts the places of the rank at hand."""
        merged, n = self.merged.get, len(flat)
        ranks = self._ranks_of(flat[:-1] << _SHIFT | flat[1:])
        index: dict[int, list[int]] = {}
        for p in np.flatnonzero(ranks >= 0).tolist():
            index.setdefault(int(ranks[p]), []).append(p)
        tok, left, right = flat.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = list(index)
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            rank = pop(heap)
            if (places := index.pop(rank, None)) is None:
                continue
            places.sort()
            high, lower = rank << _SHIFT, False
            for k, p in enumerate(places):
                q = right[p]
                if merged(tok[p] << _SHIFT | tok[q]) != rank:  # gone, or part of another token by now
                    continue
                before, after = left[p], right[q]
                tok[p], tok[q], right[p], left[after] = rank, _DEAD, after, p
                for at, new in ((before, merged(tok[before] << _SHIFT | rank)), (p, merged(high | tok[after]))):
                    if new is None:
                        continue
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        push(heap, new)
                        lower = lower or new < rank
                if lower:  # such a merge comes before this rank's further places
                    if rest := places[k + 1 :]:
                        index[rank] = rest
                        push(heap, rank)
                    break
        flat[:] = tok
        return np.empty(0, np.int64)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Speller:
    """Spells texts from encoded pre-tokens; remembers a bounded number of them.

    With most patterns each space or line feed begins a pre-token where no two
    spaces meet, so such a text is cut there first and the pattern runs once
    for each distinct piece. Other texts are matched whole, as are all where
    the pattern is of another kind.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_words: int = CACHE_WORDS):
        self.replay = MergeReplay(ranks)
        self.find = regex.compile(pattern).findall
        self.whole = regex.compile(r"\s\s|[^\S \n]").search if self._cuts_at_spaces() else (lambda text: True)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _cuts_at_spaces(self) -> bool:
        """Whether pieces cut at a space or line feed have the same matches as the whole, tried with neighbours of every kind."""
        ends = ["a", "Z", "\u00e9", "\u65e5", "7", "\u00b2", ".", "a.", "_", "'", "'s", "$", ")", "\U0001f600", "e\u0301", "\u0301", "\x00"]
        return all(self.find(x + space + y + after + x) == self.find(x) + self.find(space + y) + self.find(after + x) for x in ends for y in ends for space in " \n" for after in " \n")

    def _kept(self, known: dict[str, bytes], needed: set[str]) -> dict[str, bytes]:
        """``known``, or where it is too large, only what is needed now: mostly the frequent ones."""
        return known if len(known) <= self.cache_words else {x: known[x] for x in needed & known.keys()}

    def spell(self, texts: Iterable[str]) -> list[bytes]:
        cuts = [None if self.whole(t) else t.replace("\n", " \n").split(" ") for t in texts]
        found = [(self.find(t), ()) if c is None else (self.find(c[0]), c[1:]) for t, c in zip(texts, cuts, strict=True)]
        needed = set().union(*(c for _, c in found))
        self.pieces = self._kept(self.pieces, needed)
        spelled = {c: self.find(c if c[:1] == "\n" else " " + c) for c in needed - self.pieces.keys()}
        needed = set().union(*spelled.values(), *(w for w, _ in found))
        self.words = self._kept(self.words, needed)
        words = list(needed - self.words.keys())
        self.words.update(zip(words, self.replay.encode_words([w.encode() for w in words]), strict=True))
        word, piece = self.words.__getitem__, self.pieces.__getitem__
        for c, w in spelled.items():
            self.pieces[c] = word(w[0]) if len(w) == 1 else b"".join(map(word, w))
        return [b"".join(map(word, w)) + b"".join(map(piece, c)) for w, c in found]


_worker: dict[tuple, Speller] = {}  # this Python worker's, for the vocabulary last used


def _speller(key: tuple, ranks: dict[bytes, int], pattern: str) -> Speller:
    if key not in _worker:
        _worker.clear()
        _worker[key] = Speller(ranks, pattern)
    return _worker[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, ids (little-endian unsigned 32-bit integers) and decoded (the bytes that the ids stand for)."""
    shared = docs.sparkSession.sparkContext.broadcast((hash((pattern, frozenset(ranks.items()))), ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table = shared.value
        speller = _speller((key, pattern), table, pattern)
        for batch in batches:
            for part in slices(batch, len(keep), SLICE_BYTES):
                coded = speller.spell([t or "" for t in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(coded, pa.binary()), pa.array(map(speller.replay.decode, coded), pa.binary())], [*keep, "ids", "decoded"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col(text_col).alias("encoded text")).mapInArrow(run, f"{kinds}ids binary, decoded binary")
