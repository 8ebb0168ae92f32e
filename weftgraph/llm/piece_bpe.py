"""SentencePiece encoding and decoding of merge-type (BPE) models by a table of prefixes.

Every prefix of a text has one last token. The table holds it: an automaton
over the pieces gives, for each place, the pieces that end there, and the one
that belongs there is the first that is compatible with the last token of the
prefix before it. Two tokens are compatible if merging their joint text gives
them back, which is told by undoing their merges from the last to the first:
at no time may a piece across the border have come before the next merge on
either side. The ids are then read backwards from the end of the table.

Texts are cut where no piece reaches across: before blanks, and at line feeds
and the like that no piece holds. Each cut's ids are found once a slice, and a
bounded number is remembered by the worker; long ones are not. Rows are
independent, so there is no shuffle and a hot source costs nothing extra. A
lost executor's slices are encoded again.

A null text counts as the empty text: the end id alone, decoded to nothing. A
null or repeated doc_id is carried through, one output row per input row, in
any order; an empty table gives none. Very long texts are encoded whole, in
time and memory that grow with the text alone. Of merges with equal scores the
leftmost comes first. Extra columns are ignored.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import slices

BLANK = "▁"  # stands for a space in pieces
#: Types of pieces, and the type of merging models, as fixed values of the format.
NORMAL, UNKNOWN, CONTROL, BYTE, MERGING = 1, 2, 3, 6, 2
#: Encoded cuts that a worker remembers, of either of two generations; judged pairs that it remembers before it starts anew; the longest cut that is remembered.
CACHE_WORDS, CACHE_PAIRS, CACHE_LENGTH = 250_000, 500_000, 40
#: Bytes of text that are encoded together.
SLICE_BYTES = 2 << 20
_SHIFT = 21
_NEVER = 1 << 62


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


@dataclass(frozen=True)
class Model:
    """Pieces with scores and types, in the order of their ids."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    dummy_prefix: bool = True
    unknown_surface: str = " ⁇ "

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        """A model file. Only merging models that keep texts as they are, but for the blank put first, are taken."""
        pieces, scores, types, merging, dummy, surface = [], [], [], False, True, " ⁇ "
        for number, value in _fields(raw):
            own = dict(_fields(value)) if number in (1, 2, 3) else {}
            if number == 1:
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                types.append(own.get(3, NORMAL))
            elif number == 2:
                merging = own.get(3, 1) == MERGING
                surface = own[44].decode() if 44 in own else surface
            elif number == 3:
                dummy = bool(own.get(3, 1))
                if own.get(2) or own.get(4, 1) or not own.get(5, 1):
                    raise ValueError("models that rewrite texts or drop blanks are not supported")
        if not merging or {*types} - {NORMAL, UNKNOWN, CONTROL, BYTE} or types.count(BYTE) != 256:
            raise ValueError("a merging model with normal pieces and all 256 bytes is needed")
        return cls(pieces, scores, types, dummy, surface)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls.parse(bytes(spark.read.format("binaryFile").load(f"file://{path}" if path.startswith("/") else path).first()["content"]))


@dataclass(frozen=True)
class Merges:
    """How pieces come about. ``time`` is 0 of single characters, else the rank of the score; ``parts`` are what the last merge joins.

    Pieces that merging their own text does not give never stand in a result
    and are left out of ``tokens``. Characters that stand only inside of pieces
    get numbers after the last id.
    """

    tokens: dict[str, int]
    time: list[int]
    left: list[int]
    right: list[int]
    joins: dict[int, int]
    odd: frozenset[int]  # pieces that come about by merges out of the order of their ranks

    @classmethod
    def of(cls, model: Model) -> Merges:
        normal = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == NORMAL}
        inner = {c for p in normal for c in p} - normal.keys()
        number = normal | {c: len(model.pieces) + k for k, c in enumerate(sorted(inner))}
        ranks = {s: 1 + k for k, s in enumerate(sorted({model.scores[i] for p, i in normal.items() if len(p) > 1}, reverse=True))}
        time = [0] * (len(model.pieces) + len(inner))
        for p, i in normal.items():
            time[i] = ranks[model.scores[i]] if len(p) > 1 else 0
        joins = {number[p[:k]] << _SHIFT | number[p[k:]]: time[i] for p, i in normal.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        left, right = [-1] * len(time), [-1] * len(time)
        tokens, odd = {p: i for p, i in number.items() if len(p) == 1}, set()
        for p, i in normal.items():
            if len(p) > 1:
                done, last, ordered = replay(p, number, time)
                if done == [i]:
                    tokens[p], (left[i], right[i]) = i, last
                    if not ordered:
                        odd.add(i)
        return cls(tokens, time, left, right, joins, frozenset(odd))


def replay(text: str, number: dict[str, int], time: list[int]) -> tuple[list[int], tuple[int, int] | None, bool]:
    """Merging by its definition, for short texts: the tokens, what the last merge joined, and whether merges came in the order of their ranks."""
    parts, last, before, ordered = list(text), None, 0, True
    while True:
        found = [(time[number[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in number]
        if not found:
            return [number[p] for p in parts], last, ordered
        t, k = min(found)
        ordered, before = ordered and t >= before, t
        last = number[parts[k]], number[parts[k + 1]]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


class Pieces:
    """Encodes and decodes with a model; remembers a bounded number of cuts."""

    def __init__(self, model: Model, merges: Merges | None = None):
        self.model, m = model, merges or Merges.of(model)
        self.merges, self.time, self.left, self.right, self.join = m, m.time, m.left, m.right, m.joins.get
        self.text = [*model.pieces, *(p for p, i in sorted(m.tokens.items(), key=lambda x: x[1]) if i >= len(model.pieces))]
        self.sizes = [len(t) for t in self.text]
        self.number = {p: i for i, p in enumerate(self.text) if i >= len(model.pieces) or model.types[i] == NORMAL}
        byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == BYTE}
        self.byte = [byte[b] for b in range(256)]
        spelled = [np.array([i], "<u4").tobytes() for i in range(len(model.pieces))]
        self.spelled = [*spelled, *(self._as_bytes(p) for p in self.text[len(model.pieces) :])]
        self.automaton = ahocorasick.Automaton()
        for p, i in m.tokens.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        alone = "".join(c for c in "\n\r\t" if c not in m.tokens)  # no piece holds these
        within = any(a != BLANK and b == BLANK for p in m.tokens for a, b in zip(p, p[1:], strict=False))
        self.cuts = re.compile(f"[^{alone}]+|[{alone}]" if within and alone else "(?s:.+)" if within else f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|[{alone}]" if alone else "")).findall
        self.apart = next(c for c in map(chr, range(1, 1 << 16)) if c not in m.tokens)  # put between cuts
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.end = next((i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if p == "</s>" and t == CONTROL), None)
        shown = {NORMAL: lambda p: p.replace(BLANK, " ").encode(), UNKNOWN: lambda p: model.unknown_surface.encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.shown = [shown[t](p) for p, t in zip(model.pieces, model.types, strict=True)]
        kinds = np.array(model.types)
        self.blank_first = np.array([t == NORMAL and p.startswith(BLANK) for p, t in zip(model.pieces, model.types, strict=True)])
        self.control, self.is_byte = kinds == CONTROL, kinds == BYTE

    def _as_bytes(self, char: str) -> bytes:
        return np.array([self.byte[b] for b in char.encode()], "<u4").tobytes()

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joint text of two tokens gives them back.

        The two histories run side by side in the order of their ranks, equal
        ones from left to right. They are gone through backwards: x and y are
        what stands at either side of the border, until the merge that takes x
        or y on. A join of x and y would come before a later merge on the left,
        and before one of its own rank on the right.
        """
        if a in self.merges.odd or b in self.merges.odd:
            return replay(self.text[a] + self.text[b], self.number, self.time)[0] == [a, b]
        time, x, y, x_ends, y_ends = self.time, a, b, _NEVER, _NEVER
        while True:
            joined = self.join(x << _SHIFT | y)
            if joined is not None and joined < x_ends and joined <= y_ends:
                return False
            if time[x] > time[y]:
                x_ends, x = time[x], self.right[x]
            elif time[y]:
                y_ends, y = time[y], self.left[y]
            else:
                return True

    def _table(self, text: str) -> list[int]:
        """The last token of each prefix; -1 before the text, and after characters that are no piece's."""
        last, done, pairs, sizes = [-1] * (len(text) + 1), -1, self.pairs, self.sizes
        for at, token in self.automaton.iter(text):  # at one place, the longest first
            if at == done:
                continue
            before = last[at + 1 - sizes[token]]
            if before >= 0:
                key = before << _SHIFT | token
                good = pairs.get(key)
                if good is None:
                    if len(pairs) >= CACHE_PAIRS:
                        pairs.clear()
                    good = pairs[key] = self.compatible(before, token)
                if not good:
                    continue
            last[at + 1], done = token, at
        return last

    def encode_cuts(self, cuts: list[str]) -> list[bytes]:
        """The ids of each cut as little-endian unsigned 32-bit integers, from one table over all of them."""
        joined = self.apart.join(cuts)
        last, spelled, sizes = self._table(joined), self.spelled, self.sizes
        out, at = [], len(joined)
        for cut in reversed(cuts):
            ids, begin = [], at - len(cut)
            while at > begin:
                token = last[at]
                if token >= 0:
                    ids.append(spelled[token])
                    at -= sizes[token]
                else:
                    at -= 1
                    ids.append(self._as_bytes(joined[at]))
            ids.reverse()
            out.append(b"".join(ids))
            at -= 1
        out.reverse()
        return out

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, without an end id."""
        first = BLANK if self.model.dummy_prefix else ""
        found = [self.cuts((first + t).replace(" ", BLANK)) if t else [] for t in texts]
        needed = set().union(*found)
        if len(self.words) > CACHE_WORDS:  # what is not asked for until the next time goes
            self.words, self.older = {}, self.words
        new = needed - self.words.keys()
        if again := new & self.older.keys():
            self.words.update((w, self.older[w]) for w in again)
            new -= again
        new = list(new)
        self.words.update(zip(new, self.encode_cuts(new), strict=True))
        out = [b"".join(map(self.words.__getitem__, f)) for f in found]
        for w in new:
            if len(w) > CACHE_LENGTH:
                del self.words[w]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, as UTF-8: blanks are spaces, the first one goes if the model puts one first; bytes that are no character become U+FFFD."""
        said = ids[~self.control[ids]]
        raw = b"".join(map(self.shown.__getitem__, said.tolist()))
        if self.model.dummy_prefix and len(said) and self.blank_first[said[0]]:
            raw = raw[1:]
        return raw.decode(errors=_ONE_BYTE).encode() if self.is_byte[said].any() else raw


_ONE_BYTE = "one mark for each byte"
codecs.register_error(_ONE_BYTE, lambda e: ("�", e.start + 1))
_worker: dict[int, Pieces] = {}  # this Python worker's, for the model last used


def _pieces(key: int, model: Model, merges: Merges) -> Pieces:
    if key not in _worker:
        _worker.clear()
        _worker[key] = Pieces(model, merges)
    return _worker[key]


def encode(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", end: bool = True) -> DataFrame:
    """The ``keep`` columns, ids (array of int, with the end id last if ``end``) and decoded (the text that the ids stand for)."""
    merges = Merges.of(model)
    shared = docs.sparkSession.sparkContext.broadcast((hash((*model.pieces, *model.scores, *model.types)), model, merges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(*shared.value)
        tail = np.array([pieces.end], "<u4").tobytes() if end else b""
        for batch in batches:
            for part in slices(batch, len(keep), SLICE_BYTES):
                coded = [ids + tail for ids in pieces.encode([t or "" for t in part.column(len(keep)).to_pylist()])]
                arrays = [np.frombuffer(ids, "<u4").view("<i4") for ids in coded]
                decoded = pa.array([pieces.decode(ids) for ids in arrays], pa.binary()).cast(pa.string())
                offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, decoded], [*keep, "ids", "decoded"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col(text_col).alias("encoded text")).mapInArrow(run, f"{kinds}ids array<int>, decoded string")
