"""Toxicity by class-conditional Kneser-Ney models.

Two models of the characters of words, one of the toxic and one of the
ordinary labelled documents, are interpolated Kneser-Ney of order five. Their
fives are counted by class; all lower orders are shared: continuation counts
over the fives of both. Counting, discounting and interpolation are grouped
aggregates and joins over all training rows, and grow with them.

For an unseen five after a seen context both models fall back on the same
lower order, so their ratio depends on the context alone. The models therefore
come down to the log ratio of each five and of each context, all of them kept.
Up to ``HELD`` of both together, tasks hold them by the 64-bit hash of their
characters (12 bytes each); beyond, the distinct words of the texts are joined
with them in Spark, and each text with its words, to the same ratios.

A text is scored by the length-normalised log-likelihood ratio of the whole
and the highest one of any window of a few words, so that one expression in a
long text is not averaged away. A logistic function turns them into a score.
It is fitted on a quarter of the labelled rows (``CALIBRATION`` of either label
at most), measured by counts without these; they are counted afterwards.

An empty or null text has ratio zero; texts of any length are read whole. Null
or repeated ids are scored row by row. Of labelled rows with one id the text
with the least hash is counted, with the larger of its labels. Without labels
of both kinds all ratios are zero and the score is that of the label there is,
or 0.5. Extra columns are ignored; an empty table of documents gives no scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, hot_keys, join_unique, releasing, slices
from weftgraph.llm.labelled import sample, with_texts
from weftgraph.llm.words import WordValues

ORDER, DISCOUNT, CALIBRATION = 5, 0.75, 2000
#: Fives and contexts that tasks hold (12 bytes each); more are joined.
HELD = 6_000_000
#: Bytes of text that a task scores at a time, and words whose ratios a worker remembers.
SLICE_BYTES, KNOWN_WORDS = 2 << 20, 200_000
#: Counts that the shared backoff is worth after any context, so that few counts decide little.
PRIOR = 4.0
WINDOWS = (1, 4)  # words
N_FEATURES = 3 + len(WINDOWS)
_START, _END = "\x02", "\x03"


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): how often each run of five characters stands in either class's words, a word once a text; texts has (y, text)."""
    words = texts.select("y", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")).where("word <> ''")
    words = words.groupBy("word").agg(F.sum("y").cast("double").alias("toxic"), F.sum(1 - F.col("y")).cast("double").alias("ordinary"))
    grams = words.select(_fives().alias("gram"), "toxic", "ordinary")
    return grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _fives() -> Column:
    """A row for each run of five characters of a word and its ends."""
    padded = F.concat(F.lit(_START * (ORDER - 1)), "word", F.lit(_END))
    at = F.sequence(F.lit(1), F.char_length("word") + 1)
    return F.explode(F.transform(at, lambda i: F.substring(padded, i, F.lit(ORDER))))


def _head(gram: str = "gram") -> Column:
    return F.substring(F.col(gram), F.lit(1), F.char_length(gram) - 1)


def _tail(gram: str = "gram") -> Column:
    return F.substring(F.col(gram), F.lit(2), F.char_length(gram))


def shared_backoff(grams: DataFrame) -> DataFrame:
    """(gram, p): the lower order's probability of the last character of each run of four after the three before it."""
    levels = [grams.select(_tail().alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))]
    for _ in range(ORDER - 2):
        levels.append(levels[-1].select(_tail().alias("gram")).groupBy("gram").agg(F.count("*").alias("n")))
    single = cut(levels[-1])  # characters; an eighth of their mass is spread evenly
    p = single.select("gram", (0.875 * F.col("n") / single.agg(F.sum("n")).scalar() + 0.125 / single.agg(F.count("*")).scalar()).alias("p"))
    for level in reversed(levels[:-1]):
        level = level.withColumn("context", _head())
        after = level.groupBy("context").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        below = p.select(F.col("gram").alias("tail"), F.col("p").alias("q"))
        level = level.withColumn("tail", _tail()).join(after, "context").join(below, "tail")
        p = level.select("gram", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("q")) / F.col("all")).alias("p"))
    return p


def log_ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio) of the seen fives, and of the contexts where a five is unseen."""
    after = grams.groupBy(_head().alias("context")).agg(*(f(F.when(F.col(c) > 0, v)).alias(f"{n}_{c}") for c in ("toxic", "ordinary") for n, f, v in (("all", F.sum, F.col(c)), ("kinds", F.count, F.lit(1)))))
    after = after.fillna(0)
    rest = {c: (DISCOUNT * F.col(f"kinds_{c}") + PRIOR) / (F.col(f"all_{c}") + PRIOR) for c in ("toxic", "ordinary")}
    lower = shared_backoff(grams).withColumnRenamed("gram", "tail")
    seen = grams.withColumns({"context": _head(), "tail": _tail()}).join(after, "context").join(lower, "tail")
    p = {c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / (F.col(f"all_{c}") + PRIOR) + rest[c] * F.col("p") for c in ("toxic", "ordinary")}
    fives = seen.select("gram", F.log(p["toxic"] / p["ordinary"]).cast("float").alias("ratio"))
    return fives, after.select(F.col("context").alias("gram"), F.log(rest["toxic"] / rest["ordinary"]).cast("float").alias("ratio"))


@dataclass
class Held:
    keys: np.ndarray  # hashes of grams, ascending
    ratios: np.ndarray

    def get(self, keys: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        if not len(self.keys):
            return np.broadcast_to(np.float32(other), keys.shape)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ratios[at], other)


@dataclass
class Model:
    fives: Held | DataFrame  # log ratios of the seen ones
    contexts: Held | DataFrame  # of a five that is unseen after them; zero after others
    weights: np.ndarray  # of the features, the constant last


def _hold(ratios: DataFrame) -> Held:
    got = ratios.select(F.xxhash64("gram").alias("key"), "ratio").toArrow()
    keys, values = got["key"].to_numpy().view(np.uint64), got["ratio"].to_numpy()
    order = np.argsort(keys)
    return Held(keys[order], values[order])


def ratio_model(grams: DataFrame, held: int = HELD) -> Model:
    """The log ratios, without weights of the features."""
    found = [cut(x) for x in log_ratios(grams)]
    if sum(x.count() for x in found) <= held:
        found = [_hold(x) for x in found]
    return Model(*found, np.zeros(N_FEATURES + 1))


def word_ratios(words: list[str], model: Model) -> np.ndarray:
    """(log ratio, characters) of each word, its end included, by a model that is held."""
    h64 = xxhash.xxh64_intdigest
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    padded = [f"{_START * (ORDER - 1)}{w}{_END}" for w in words]
    grams = np.fromiter((h64(p[i : i + ORDER], 42) for p, n in zip(padded, sizes.tolist(), strict=True) for i in range(n)), np.uint64, int(sizes.sum()))
    heads = np.fromiter((h64(p[i : i + ORDER - 1], 42) for p, n in zip(padded, sizes.tolist(), strict=True) for i in range(n)), np.uint64, int(sizes.sum()))
    ratio = model.fives.get(grams, model.contexts.get(heads, 0.0))
    return np.stack([np.bincount(np.repeat(np.arange(len(words)), sizes), ratio, len(words)), sizes.astype(float)], axis=1)


def joined_word_ratios(words: DataFrame, model: Model) -> DataFrame:
    """(word, ratio, size) of each of the distinct words, by a model that is joined; what very many words share is joined where they are."""
    fives, contexts = model.fives.withColumnRenamed("ratio", "own"), model.contexts.select(F.col("gram").alias("head"), F.col("ratio").alias("after"))
    grams = cut(words.select("word", _fives().alias("gram")).withColumn("head", _head()))
    grams = join_unique(cut(join_unique(grams, fives, ["gram"], "left")), contexts, ["head"], "left")
    ratio = F.coalesce("own", "after", F.lit(0.0)).cast("double")
    return grams.groupBy("word").agg(F.sum(ratio).alias("ratio"), F.count("*").cast("double").alias("size"))


def features(rows: np.ndarray) -> list[float]:
    """Mean log ratio a character over the whole text and over its highest windows, the highest of a word, and the log of its words."""
    if not len(rows):
        return [0.0] * N_FEATURES
    total = np.concatenate((np.zeros((1, 2)), np.cumsum(rows, axis=0)))
    out = [float(total[-1, 0] / total[-1, 1])]
    for w in WINDOWS:
        w = min(w, len(rows))
        part = total[w:] - total[:-w]
        out.append(float((part[:, 0] / part[:, 1]).max()))
    return [*out, float(rows[:, 0].max()), float(np.log1p(len(rows)))]


_worker: dict = {}


def measure(docs: DataFrame, model: Model, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, features, and score by the model's weights."""
    held = isinstance(model.fives, Held)
    at, weights = len(keep), model.weights
    rows = docs.select(*keep, F.col(text_col).alias("measured text"))
    if held:
        shared = docs.sparkSession.sparkContext.broadcast((model, hash(tuple(x.tobytes() for t in (model.fives, model.contexts) for x in (t.keys, t.ratios)))))
    else:
        rows = _with_ratios(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            m, key = shared.value
            if _worker.get("key") != key:
                _worker.update(key=key, words=WordValues(lambda words: word_ratios(words, m), KNOWN_WORDS))
        for batch in batches:
            found = []
            for part in slices(batch, at, SLICE_BYTES):
                texts = [(t or "").lower().split() for t in part.column(at).to_pylist()]
                if held:
                    found += [features(rows) for rows in _worker["words"].look_up(texts)]
                    continue
                for words, of in zip(texts, part.column(at + 1), strict=True):
                    ratio = {w["word"]: (w["ratio"], w["size"]) for w in of.as_py() or ()}
                    found.append(features(np.array([ratio[w] for w in words]).reshape(-1, 2)))
            x = np.array(found, dtype=float).reshape(len(found), N_FEATURES)
            p = 1 / (1 + np.exp(-(x @ weights[:-1] + weights[-1])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(list(x), pa.list_(pa.float64())), pa.array(p)], [*keep, "features", "score"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, f"{kinds}features array<double>, score double")


def _with_ratios(rows: DataFrame, model: Model) -> DataFrame:
    """The rows with (word, ratio, size) of each word of their text."""
    rows = rows.withColumns({"measured 1": F.xxhash64("measured text"), "measured 2": F.xxhash64(F.lit("again"), "measured text")})
    key = ["measured 1", "measured 2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                words = [list(set((t or "").lower().split())) for t in part.column(2).to_pylist()]
                row = np.repeat(np.arange(len(words)), [len(w) for w in words])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array([w for t in words for w in t], pa.string())], [*key, "word"])

    pairs = cut(rows.select(*key, "measured text").mapInArrow(run, "`measured 1` long, `measured 2` long, word string").distinct())
    known = cut(joined_word_ratios(pairs.select("word").distinct(), model))
    of = cut(join_unique(pairs, known, ["word"]).groupBy(*key).agg(F.collect_list(F.struct("word", "ratio", "size")).alias("measured words")))
    copies = hot_keys(rows.groupBy(*key).agg(F.count("*").alias("n")), key, share=1e-3)  # a thousand texts at most
    return join_unique(rows, of, key, "left", hot=copies).drop(*key)


def _logistic(x: np.ndarray, y: np.ndarray, share: float, penalty: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, label 1 weighed as so large a share of the rows."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    each = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    w = np.zeros(z.shape[1])
    ridge = penalty * len(y) * np.eye(len(w)) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (each * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> Model:
    """``labels`` has (id, y), all of them counted in the end. Some of a quarter, by the hash of the id, serve to calibrate.

    Some forty shuffles, each of as many files as there are partitions or more, are not all kept to the end.
    """
    with releasing(docs.sparkSession):
        return _fit(docs, labels, id_col, text_col, held)


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, held: int) -> Model:
    labels = cut(labels)
    quarter = F.pmod(F.xxhash64(F.lit("calibrate"), F.col(id_col)), F.lit(4)) == 0
    kept_out = cut(sample(labels.where(quarter), CALIBRATION, "toxicity", id_col))
    rest = labels.join(F.broadcast(kept_out.select(id_col)), id_col, "left_anti")
    chosen = cut(with_texts(docs, kept_out, id_col, text_col))
    grams = cut(count_grams(with_texts(docs, rest, id_col, text_col)))
    model = ratio_model(grams, held)
    rows = measure(chosen, model, ("y",)).select("y", "features").toArrow()
    y = rows["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        model.weights[-1] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    else:
        share = labels.agg(F.avg("y")).first()[0]
        model.weights = _logistic(np.array(rows["features"].to_pylist()), y, share)
    every = grams.unionByName(count_grams(chosen)).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    whole = ratio_model(cut(every), held)
    whole.weights = model.weights
    return whole


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of the toxic label."""
    return measure(docs, model, (id_col,), text_col).drop("features")
