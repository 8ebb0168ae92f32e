"""Quality classifier: supervised subword embeddings.

A document's features are its words, their character 3- to 5-grams and its
word pairs, hashed into buckets; a word that follows itself is one feature,
whichever word it is. Every bucket has a learned vector; a document is the
average of its features' vectors, and a softmax layer on it gives the label's
probability. Vectors and layer are trained by stochastic gradient descent in
numpy on at most ``per_class`` labelled rows of either label, taken by the
hash of their ids, and of those on as many as have ``most_features`` distinct
features together, so that the driver holds 64 MB of them at most; the texts
that are taken are read whole, as is every text that is scored.

The output is linear in the average, so for scoring each bucket's vector is
multiplied with the layer once, and the model sent to the tasks is one number
a bucket, 1 MB, whatever the input. Scoring needs no shuffle.

An empty or null text has only the constant feature. Null or repeated ids are
scored row by row. Without labels of both kinds every score is the share of
label 1 among those there are, or 0.5. Of rows with one id the text with the
least hash is learned from, and the larger of its labels. Extra columns are
ignored; an empty table of documents gives no scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, slices
from weftgraph.llm.labelled import sample, with_texts
from weftgraph.llm.words import WordValues

LOG2_BUCKETS, DIM, EPOCHS, RATE, PER_CLASS = 18, 8, 8, 2.0, 2000
#: Distinct features of all training rows together, eight bytes each.
MOST_FEATURES = 8_000_000
GRAMS = (3, 4, 5)
_MIX = np.uint64(0x9E3779B97F4A7C15)
CONSTANT, REPEAT = 0, 1  # buckets of the constant feature and of a word after itself


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - LOG2_BUCKETS)).astype(np.int64)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every feature of the words, but their pairs."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.cumsum(codes == 2) - 1
    buckets, owner = [_bucket(word_hashes(words))], [np.arange(len(words))]
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : len(codes) - n + 1 + k]
        inside = of[: len(h)] == of[n - 1 :]
        buckets.append(_bucket(h[inside]))
        owner.append(of[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owner)


def _pairs(h: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbouring words, by the words' hashes."""
    return np.where(h[1:] == h[:-1], REPEAT, _bucket(h[1:] * np.uint64(31) + (h[:-1] ^ (h[:-1] >> np.uint64(31)))))


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, share of the document's features)"""
    words = text.split()
    kinds, number = np.unique(np.array(words, dtype=object), return_inverse=True) if words else (np.empty(0, object), np.empty(0, np.int64))
    buckets, owner = subwords(kinds.tolist())
    times = np.bincount(number, minlength=len(kinds))[owner] if len(kinds) else np.empty(0)
    pairs = _pairs(word_hashes(words))
    which, back = np.unique(np.concatenate(([CONSTANT], buckets, pairs)), return_inverse=True)
    n = np.bincount(back, np.concatenate(([1.0], times, np.ones(len(pairs)))))
    return which, n / n.sum()


@dataclass
class Model:
    table: np.ndarray  # each bucket's part in the logit of label 1


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 1) -> Model:
    """rows: (label, buckets, shares)."""
    kinds = {y for y, _, _ in rows}
    if len(kinds) < 2:
        p = 0.5 if not kinds else float(kinds.pop())
        return Model(np.full(1 << LOG2_BUCKETS, np.log((p + 1e-3) / (1 - p + 1e-3)), np.float32))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << LOG2_BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    done, steps = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            y, at, share = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ vectors[at]
            z = np.exp(mean @ layer - (mean @ layer).max())
            error = z / z.sum()
            error[y] -= 1
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            vectors[at] -= rate * np.outer(share, back)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", most_features: int = MOST_FEATURES) -> Model:
    """``labels`` has (id, y); at most about ``per_class`` rows of either label are used, and ``most_features`` distinct features of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [document_features(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())), pa.array([s.astype(np.float32) for _, s in found], pa.list_(pa.float32())), part.column(2)], ["y", "buckets", "shares", "h"])

    chosen = with_texts(docs, sample(labels, per_class, "quality", id_col), id_col, text_col)
    chosen = chosen.select("y", "text", F.xxhash64(F.lit("order"), id_col).alias("h"))
    rows = cut(chosen.mapInArrow(run, "y int, buckets array<int>, shares array<float>, h long"))
    sizes = sorted((r["h"], r["n"]) for r in rows.select("h", F.size("buckets").alias("n")).collect())  # a row for each of the sample
    room = int(np.searchsorted(np.cumsum([n for _, n in sizes]), most_features, side="right"))
    if room < len(sizes):
        rows = rows.where(F.col("h") < sizes[max(room, 1)][0])
    rows = rows.toArrow()
    kept = [(y, b.values.to_numpy(), s.values.to_numpy()) for y, b, s in zip(rows["y"].to_pylist(), rows["buckets"], rows["shares"], strict=True)]
    return train(sorted(kept, key=lambda r: (r[0], len(r[1]), r[1].tobytes())))


_worker: dict = {}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, hash(model.table.tobytes())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, key = shared.value

        def values(words: list[str]) -> np.ndarray:  # the words' parts, their numbers of features, their hashes
            buckets, owner = subwords(words)
            part = np.bincount(owner, table[buckets], len(words)), np.bincount(owner, minlength=len(words)).astype(float)
            return np.stack([*part, word_hashes(words).view(np.float64)], axis=1)

        if _worker.get("key") != key:
            _worker.update(key=key, words=WordValues(values))
        for batch in batches:
            out = []
            for part in slices(batch, 1):
                texts = [(t or "").split() for t in part.column(1).to_pylist()]
                for rows in _worker["words"].look_up(texts):
                    pairs = _pairs(np.ascontiguousarray(rows[:, 2]).view(np.uint64))
                    logit = (table[CONSTANT] + rows[:, 0].sum() + table[pairs].sum()) / (1 + rows[:, 1].sum() + len(pairs))
                    out.append(1 / (1 + np.exp(-logit)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")
