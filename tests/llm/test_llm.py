"""Operators of the llm subpackage against brute-force versions, on small tables with odd rows."""

import base64
import hashlib
import os
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import common as llm_common
from weftgraph.llm import bpe, components, decontamination, labelled, license_scan, line_dedup, quality_classifier, quality_rules, sharding, simhash, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [None, "", " \n\t ", "a", "É x y", "end\n\n\nstart\n", "x" * 30_000, "word " * 5_000, "Same text here.", "Same text here.", "tab\tone\x0btwo\x0cthree\r\nfour"]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD, [*range(len(ODD) - 2), None, 8])


@pytest.fixture(scope="module")
def nothing(spark):
    return docs(spark, [])


# Byte-level BPE


@pytest.fixture(scope="module")
def vocabulary(spark):
    public = pytest.importorskip("public_tokenizers")
    return bpe.load_ranks(spark, public.path("byte_bpe_multi_50k.tiktoken")), public.PATTERN


def test_bpe_equals_the_library(spark, vocabulary, odd, nothing):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = vocabulary
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    pieces = ["a", "A", "1", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "日本", "한", "😀", "'s", "'ll", "_", "...", "<|endoftext|>", "ß", "²", "aaaaaaa", "ababab", " the", " of", "\r\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 50))) for _ in range(300)]
    frame = docs(spark, texts).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000)).withColumn("ids", F.lit("a clashing name"))
    got = bpe.encode(frame, ranks, pattern, keep=("doc_id", "text")).collect()
    assert len(got) == len(texts) + len(ODD)
    for r in got:
        text = r["text"] or ""
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == theirs.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    assert bpe.encode(nothing, ranks, pattern).count() == 0


def test_bpe_matches_whole_where_cuts_would_differ():
    ranks = {bytes([b]): b for b in range(256)} | {b".\n": 300}
    follows = bpe.Speller(ranks, r"\w+|[^\w\s]+\n*|\s+")  # punctuation takes the line feeds after it
    assert follows.whole("a b") and np.frombuffer(follows.spell(["a.\nb"])[0], "<u4").tolist() == [97, 300, 98]
    assert not bpe.Speller(ranks, r" ?\w+| ?[^\w\s]+|\s+(?!\S)|\s+").whole("a b")


@pytest.mark.parametrize("many", [3, 10**9])
def test_bpe_forgets_and_respects_lower_ranks(monkeypatch, many):
    monkeypatch.setattr(bpe, "MANY_WORDS", many)
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 301, b"abc": 256, b"cd": 299, b"abcd": 257}
    speller = bpe.Speller(ranks, r"\w+|\W", cache_words=2)

    def naive(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(1)
    for _ in range(50):
        text = " ".join("".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(4))
        want = [i for w in speller.find(text) for i in ([ranks[w.encode()]] if w.encode() in ranks else naive(w.encode()))]
        assert np.frombuffer(speller.spell([text])[0], "<u4").tolist() == want
    rng = random.Random(5)
    tokens = sorted({"".join(rng.choices("abcd", k=rng.randint(2, 5))).encode() for _ in range(160)}, key=lambda t: rng.random())
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
    replay = bpe.MergeReplay(ranks)
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 16))).encode() for _ in range(4000)]
    for w, ids in zip(words, replay.encode_words(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ([ranks[w]] if w in ranks else naive(w))


# Sharding


def test_sharding_law(spark, odd):
    rng = random.Random(2)
    frame = docs(spark, [prose(rng, 5) for _ in range(500)] + ["hot"] * 300).unionByName(odd)
    rows = sharding.assign(frame).collect()
    assert len(rows) == 800 + len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(8))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {r["doc_id"]: r["text"] for r in frame.where("doc_id > 20").collect()}
    for r in rows:
        if r["doc_id"] in texts:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    again = sharding.assign(frame.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def brute_ring(rows, shards, virtual):
    """(shard, slot) of each (id, text), by walking around the ring row by row; hashes as Spark chains them."""
    import struct

    import xxhash

    chain = lambda *parts: __import__("functools").reduce(lambda seed, x: xxhash.xxh64_intdigest(x, seed), parts, 42)
    points = sorted((chain(b"point", struct.pack("<i", s), struct.pack("<q", c)) >> 48, s, c) for s in range(shards) for c in range(virtual))
    queues = [[] for _ in points]
    for i, text in rows:
        crc, size = zlib.crc32((text or "").encode()), len((text or "").encode()) + 1
        h = chain(*([] if i is None else [struct.pack("<q", i)]), struct.pack("<q", crc))
        at = next((k for k, p in enumerate(points) if p[0] >= h >> 48), 0)
        queues[at].append((h >> 48, h, (i is not None, i or 0), crc, size, (i, text)))
    capacity = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    used, out = [0] * shards, {}
    for k, queue in enumerate(queues):
        order = list(dict.fromkeys(p[1] for p in points[k:] + points[:k]))
        for *_, row in sorted(queue):
            s = next(s for s in order if used[s] < capacity[s])
            out.setdefault(row, []).append((s, used[s]))
            used[s] += 1
    return out


def test_sharding_against_a_walk_around_the_ring(spark):
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(0, 6)) for _ in range(150)] + ["same"] * 60 + [None, "", "\u00e9"]
    rows = [*enumerate(texts), (7, "other text, same id"), (None, "a"), (None, "b"), (3, texts[3]), (3, texts[3])]
    frame = docs(spark, [t for _, t in rows], [i for i, _ in rows]).withColumns({"shard": F.lit("clash"), "cell": F.lit(1), "id": F.lit(2)})
    got = defaultdict(list)
    texts_of = {(i, zlib.crc32((t or "").encode())): t for i, t in rows}
    for r in sharding.assign(frame, 5, 8).collect():
        got[r["doc_id"], texts_of[r["doc_id"], r["text_crc32"]]].append((r["shard"], r["slot"]))
    want = brute_ring(rows, 5, 8)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_sharding_moves_few_rows(spark, nothing):
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    eight = {r["doc_id"]: r["shard"] for r in sharding.assign(frame, 8).collect()}
    nine = {r["doc_id"]: r["shard"] for r in sharding.assign(frame, 9).collect()}
    assert Counter(nine.values()).keys() == set(range(9))
    assert sum(eight[i] != nine[i] for i in eight) / len(eight) < 0.35  # a plain remainder moves 8 of 9
    assert sharding.assign(nothing).count() == 0
    few = sharding.assign(frame.limit(3)).collect()
    assert len({r["shard"] for r in few}) == 3 and {r["slot"] for r in few} == {0}


# Quality classifier and toxicity


def labelled_docs(spark, n=400):
    rng = random.Random(7)
    good = [prose(rng, rng.randint(10, 60)) for _ in range(n)]
    bad = [" ".join(w + rng.choice(["###", "$$$", "!!"]) for w in prose(rng, rng.randint(10, 60)).split()) for _ in range(n)]
    frame = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < n), int(i >= n)) for i in range(2 * n)] + [(None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    return frame, labels


def held_out_accuracy(scored, labels, column, keep):
    rows = scored.join(labels.where("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id").where(keep).select("score", column).collect()
    assert len(rows) > 50
    return sum((r["score"] >= 0.5) == bool(r[column]) for r in rows) / len(rows)


def test_quality_classifier_on_held_out_rows(spark, odd, nothing):
    frame, labels = labelled_docs(spark)
    out = labelled.remainder("doc_id", 5) == 0
    model = quality_classifier.fit(frame, labelled.training_labels(labels, "quality", ~out), per_class=150)
    assert held_out_accuracy(quality_classifier.score(frame, model), labels, "quality", out) > 0.97
    scores = [r["score"] for r in quality_classifier.score(odd, model).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert quality_classifier.score(nothing, model).count() == 0
    # The table of logits gives the same as averaging features one text at a time.
    text = "Alpha alpha alpha beta### x"
    at, share = quality_classifier.document_features(text)
    want = 1 / (1 + np.exp(-(share * model.table[at]).sum()))
    got = quality_classifier.score(docs(spark, [text]), model).first()["score"]
    assert abs(got - want) < 1e-6
    bare = quality_classifier.fit(frame, labelled.training_labels(labels.limit(0), "quality", ~out))
    assert quality_classifier.score(frame.limit(2), bare).first()["score"] == pytest.approx(0.5, abs=1e-3)


def plain_features(text):
    """The classifier's features counted one by one."""
    import xxhash

    bucket = lambda h: (h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - quality_classifier.LOG2_BUCKETS)
    words, n = text.split(), Counter([quality_classifier.CONSTANT])
    for w in words:
        n[bucket(xxhash.xxh64_intdigest(w))] += 1
        marked = f"\x02{w}\x03"
        for size in quality_classifier.GRAMS:
            for i in range(len(marked) - size + 1):
                h = size
                for c in marked[i : i + size]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                n[bucket(h)] += 1
    for a, b in zip(words, words[1:], strict=False):
        x, y = xxhash.xxh64_intdigest(a), xxhash.xxh64_intdigest(b)
        n[quality_classifier.REPEAT if a == b else bucket((y * 31 + (x ^ x >> 31)) % 2**64)] += 1
    return n


def test_quality_scores_against_plain_averages(spark):
    rng = random.Random(31)
    model = quality_classifier.Model(np.random.default_rng(2).normal(size=1 << quality_classifier.LOG2_BUCKETS).astype(np.float32))
    texts = [prose(rng, n) for n in (1, 2, 9, 60)] + ["\u00c9t\u00e9 \u00e9t\u00e9 \u00e9t\u00e9 x", "", None, "\U0001f600 \u65e5\u672c"]
    frame = docs(spark, texts).withColumns({"score": F.lit("clash"), "y": F.lit(1), "h": F.lit(2)})
    for r in quality_classifier.score(frame, model).collect():
        n = plain_features(texts[r["doc_id"]] or "")
        logit = sum(float(model.table[b]) * k for b, k in n.items()) / sum(n.values())
        assert abs(r["score"] - 1 / (1 + np.exp(-logit))) < 1e-5


def test_quality_sample_is_bounded(spark):
    frame, labels = labelled_docs(spark, 60)
    frame = frame.withColumns({"y": F.lit("clash"), "h": F.lit("clash")})
    given = labelled.training_labels(labels, "quality", F.lit(True))
    seen = []
    keep = quality_classifier.train
    quality_classifier.train = lambda rows: seen.append(sum(len(b) for _, b, _ in rows)) or keep(rows)
    try:
        for most in (10**9, 5000, 1):
            quality_classifier.fit(frame, given, most_features=most)
    finally:
        quality_classifier.train = keep
    assert seen[0] > 5000 >= seen[1] > 3000 and 0 < seen[2] < 2000


def test_toxicity_on_held_out_rows(spark, odd, nothing):
    rng = random.Random(9)
    clean = [prose(rng, rng.randint(20, 200)) for _ in range(500)]
    bad = []
    for _ in range(300):
        words = prose(rng, rng.randint(20, 200)).split()
        for _ in range(rng.randint(1, 4)):
            words.insert(rng.randrange(len(words)), "zork" + rng.choice(["ling", "ness", "ov", "ette", "ian", "ful"]))
        bad.append(" ".join(words))
    frame = docs(spark, clean + bad)
    labels = spark.createDataFrame([(i, int(i >= 500)) for i in range(800)], "doc_id long, toxic int")
    out = labelled.remainder("doc_id", 4) == 2
    model = toxicity.fit(frame, labelled.training_labels(labels, "toxic", ~out))
    assert held_out_accuracy(toxicity.score(frame, model), labels, "toxic", out) > 0.97
    scores = [r["score"] for r in toxicity.score(odd, model).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(nothing, model).count() == 0


def test_toxicity_keeps_every_five(spark):
    import itertools

    import xxhash

    bucket = lambda w: xxhash.xxh64_intdigest(w, 42) >> 44
    seen = {bucket(w): w for w in map("".join, itertools.product("abcdef", repeat=5))}
    stranger = next(w for w in map("".join, itertools.product("stuvwx", repeat=5)) if bucket(w) in seen)
    toxic = seen[bucket(stranger)]
    frame = docs(spark, [f"{toxic} mnop"] * 40 + ["mnop ponm"] * 40)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, y int")
    model = toxicity.fit(frame, labels)
    known, unseen, other = toxicity.word_ratios([toxic, stranger, "yyyyy"], model)[:, 0]
    assert known > 0 and unseen == pytest.approx(other)  # a five reads its own ratio or the backoff
    joined = toxicity.fit(frame, labels, held=0)
    more = docs(spark, [toxic, stranger, f"{stranger} {toxic.upper()}  mnop mnop", None, "", toxic, "\u0130 \u00c9"], [0, 1, 2, 3, 4, None, 5])
    a, b = (sorted((str(r["doc_id"]), round(r["score"], 5)) for r in toxicity.score(more, m).collect()) for m in (model, joined))
    assert a == b and len(a) == 7


def test_toxicity_counts_the_calibration_rows(spark):
    ids = [(r["id"], r["q"]) for r in spark.range(80).select("id", (F.pmod(F.xxhash64(F.lit("calibrate"), "id"), F.lit(4)) == 0).alias("q")).orderBy("id").collect()]
    toxic = [i % 2 == 0 for i, _ in ids]
    frame = docs(spark, [("quxzy mnop" if q else "blarg mnop") if y else "mnop ponm" for (_, q), y in zip(ids, toxic, strict=True)])
    model = toxicity.fit(frame, spark.createDataFrame([(i, int(y)) for (i, _), y in zip(ids, toxic, strict=True)], "doc_id long, y int"))
    only, strange = toxicity.word_ratios(["quxzy", "yyyyy"], model)[:, 0]  # quxzy stands in the quarter that calibrates only
    assert only > strange + 1


class PlainKneserNey:
    """The two models by their definition, with dictionaries."""

    def __init__(self, rows):
        self.fives = Counter()
        for y, text in rows:
            for w in set(text.lower().split()):
                padded = "\x02" * 4 + w + "\x03"
                for i in range(len(w) + 1):
                    self.fives[padded[i : i + 5], y] += 1
        levels = [Counter(g[1:] for g in {g for g, _ in self.fives})]
        for _ in range(3):
            levels.append(Counter(g[1:] for g in levels[-1]))
        self.levels = levels[::-1]  # by length of gram, from one
        self.characters = list(self.levels[0])

    def lower(self, gram):
        n = self.levels[len(gram) - 1]
        if len(gram) == 1:
            return 0.875 * n[gram] / n.total() + 0.125 / len(n)
        after = [v for g, v in n.items() if g[:-1] == gram[:-1]]
        if not after:
            return self.lower(gram[1:])
        return (max(n[gram] - 0.75, 0) + 0.75 * len(after) * self.lower(gram[1:])) / sum(after)

    def p(self, gram, y):
        after = [v for (g, c), v in self.fives.items() if c == y and g[:-1] == gram[:-1]]
        return (max(self.fives[gram, y] - 0.75, 0) + (0.75 * len(after) + toxicity.PRIOR) * self.lower(gram[1:])) / (sum(after) + toxicity.PRIOR)


def test_kneser_ney_against_its_definition(spark):
    rng = random.Random(17)
    rows = [(int(rng.random() < 0.4), " ".join("".join(rng.choices("abcd", k=rng.randint(1, 7))) for _ in range(12))) for _ in range(25)] + [(1, "Abra cadabra abra"), (0, "")]
    plain = PlainKneserNey(rows)
    model = toxicity.ratio_model(toxicity.count_grams(spark.createDataFrame(rows, "y int, text string")))
    words = ["abra", "cadabra", "dddd", "bcab", "aaaaaaaaa", "zzz", "abz"] + ["".join(rng.choices("abcd", k=5)) for _ in range(40)]
    for w, (ratio, size) in zip(words, toxicity.word_ratios(words, model), strict=True):
        padded = "\x02" * 4 + w + "\x03"
        assert size == len(w) + 1
        assert ratio == pytest.approx(sum(np.log(plain.p(padded[i : i + 5], 1) / plain.p(padded[i : i + 5], 0)) for i in range(len(w) + 1)), abs=1e-5)
    contexts = {g[:-1] for g, _ in plain.fives}
    for context in sorted(contexts)[:60]:
        for y in (0, 1):
            assert sum(plain.p(context + c, y) for c in plain.characters) == pytest.approx(1, abs=1e-9)


def shuffles_on_disk(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name.split("_")[1] for folder in folders for _, _, names in os.walk(folder.getPath()) for name in names if name.startswith("shuffle_")}


def test_toxicity_does_not_keep_its_shuffles(spark):
    frame = docs(spark, ["quxzy mnop"] * 40 + ["mnop ponm"] * 40)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, y int")
    before, key = shuffles_on_disk(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    toxicity.fit(frame, labels)
    end = time.time() + 20
    while len(left := shuffles_on_disk(spark) - before) > 3 and time.time() < end:  # removed in the background
        time.sleep(0.2)
    assert len(left) <= 3 and spark.conf.get(key) == was


def test_toxicity_with_odd_labels(spark, odd):
    frame = odd.withColumns({"y": F.lit("clash"), "features": F.lit(1), "score": F.lit(2), "measured text": F.lit("clash")})
    kinds = "doc_id long, toxic int"
    for rows in ([(3, 1), (4, 1)], [(3, 0), (3, 1), (None, 1)], [(3, None), (4, None)], [(999, 1)], [(3, 1), (4, 0), (6, 0), (7, 1)]):
        given = labelled.training_labels(spark.createDataFrame(rows, kinds), "toxic", F.lit(True))
        scores = [r["score"] for r in toxicity.score(frame, toxicity.fit(frame, given)).collect()]
        assert len(scores) == len(ODD) and all(0 <= x <= 1 for x in scores)
    assert toxicity.score(frame, toxicity.fit(frame.limit(0), given)).count() == len(ODD)


# Benchmark decontamination


def test_decontamination_finds_copies_with_substitutions(spark, odd, nothing):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (15, 30, 60, 8, 3, 0)]
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    changed = list(items[1])
    for k in (5, 12, 19, 25):
        changed[k] = "other"
    two_changed = list(items[0])
    two_changed[3] = two_changed[12] = "other"
    texts = [noise(100) + items[0] + noise(100), noise(10) + changed + noise(500), items[2][20:45], noise(300), items[0][:6] + noise(40), items[1], items[3] + noise(9), noise(50) + items[4], noise(20) + two_changed + noise(5)]
    frame = docs(spark, [" ".join(t).upper() + "!" for t in texts]).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100))
    benchmark = spark.createDataFrame([(i, ", ".join(t)) for i, t in enumerate(items)] + [(9, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_overlaps(frame, benchmark).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (5, 1), (6, 3), (8, 0)}
    assert (got[0, 0]["doc_start"], got[0, 0]["item_start"], got[0, 0]["length"], got[0, 0]["matched"]) == (100, 0, 15, 15)
    assert (got[1, 1]["length"], got[1, 1]["matched"]) == (30, 26)
    assert (got[8, 0]["doc_start"], got[8, 0]["length"], got[8, 0]["matched"]) == (20, 15, 13)
    assert (got[2, 2]["item_start"], got[2, 2]["length"]) == (20, 25)
    assert decontamination.find_overlaps(nothing, benchmark).count() == 0
    assert decontamination.find_overlaps(frame, benchmark.limit(0)).count() == 0


def exhaustive_overlaps(doc, items):
    """Items that meet the stated rule on some diagonal of the document."""
    found = set()
    for k, item in items.items():
        for diagonal in range(-len(item) + 1, len(doc)):
            first, last = max(diagonal, 0), min(len(doc), diagonal + len(item))
            equal = np.array([doc[i] == item[i - diagonal] for i in range(first, last)], bool)
            if len(item) < 8:
                if equal.all() and len(equal) == len(item) and (len(item) >= 4 or len(doc) == len(item)):
                    found.add(k)
            elif equal.sum() >= max(8, 0.8 * len(item)) or decontamination.best_stretch(equal)[2] >= 12:
                found.add(k)
    return found


def test_decontamination_against_exhaustive_search(spark):
    rng = random.Random(41)
    vocabulary = [f"w{i}" for i in range(3000)]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: pick(n) for k, n in enumerate([*range(1, 26), 30, 40, 60] * 2)}
    rows, expected = [], {}
    for k, item in items.items():
        n = len(item)
        for _ in range(6):
            copy, s = list(item), n - max(8, -(-4 * n // 5)) if n >= 8 else 0
            for i in rng.sample(range(n), rng.randint(0, max(s, 0))):
                copy[i] = "other"
            around = pick(rng.randint(5, 30)) if n >= 4 else []
            doc = around + copy + around[::-1]
            if rng.random() < 0.2 and n > 13:
                doc = pick(4) + item[1:13] + pick(9)
            expected[len(rows)] = exhaustive_overlaps(doc, items)
            rows.append(" ".join(doc))
    frame = docs(spark, rows + rows[:3], [*range(len(rows)), 0, 1, 2]).withColumns({c: F.lit("clash") for c in ("id", "item", "tokens", "region", "item_id")})
    benchmark = spark.createDataFrame([(k, " ".join(t), 1) for k, t in items.items()], "item_id long, text string, id int")
    got = defaultdict(set)
    for r in decontamination.find_overlaps(frame, benchmark).collect():
        got[r["doc_id"]].add(r["item_id"])
    assert all(got[i] <= expected[i] for i in got)
    by_size = defaultdict(list)
    for i, ks in expected.items():
        for k in ks:
            by_size[len(items[k])].append(k in got[i])
    assert sorted(by_size) == [*range(1, 26), 30, 40, 60]
    assert all(np.mean(hits) >= 0.95 for hits in by_size.values()) and np.mean([h for hits in by_size.values() for h in hits]) > 0.99


def test_decontamination_of_long_items_and_unspaced_scripts(spark):
    rng = random.Random(43)
    item = [f"w{rng.randrange(5000)}" for _ in range(400)]
    copy = list(item)
    for i in rng.sample(range(400), 77):
        copy[i] = "x"
    kanji = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(40))
    frame = docs(spark, ["before " + " ".join(copy) + " after", "abc\u3002" + kanji[:18] + "\u3001" + kanji[18:] + "!", "\u00abl'\u00e9t\u00e9\u00bb\u2026"])
    benchmark = spark.createDataFrame([(0, " ".join(item)), (1, kanji), (2, "l \u00e9t\u00e9")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["doc_start"], r["length"], r["matched"]) for r in decontamination.find_overlaps(frame, benchmark).collect()}
    assert got == {(0, 0): (1, 400, 323), (1, 1): (1, 40, 40), (2, 2): (0, 2, 2)}


def test_best_stretch():
    equal = np.array([1, 0, 1, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0, 1], bool)
    assert decontamination.best_stretch(equal) == (2, 9, 8)
    assert decontamination.best_stretch(np.zeros(3, bool))[2] == 0


# Line dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_edit_distance():
    rng = random.Random(0)
    for _ in range(3000):
        a = "".join(rng.choices("abé", k=rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choices("abé", k=rng.randint(0, 1))
        b = "".join(b)
        for k in (1, 2, 3):
            d = edits(a, b)
            assert line_dedup.edit_distance_within(a, b, k) == (d if d <= k else None)


def one_stretch(x, y):
    """Whether a twenty-fifth of the longer one, in one place, makes the difference."""
    rest = max(len(x), len(y)) - max(len(x), len(y)) // 25
    return any(x[:i] == y[:i] and (i == rest or x[-(rest - i) :] == y[-(rest - i) :]) for i in range(rest + 1) if max(i, rest - i) <= min(len(x), len(y)))


def brute_dedup(rows, k, min_chars):
    """rows: (doc_id, text) with distinct ids; the kept text of each."""
    lines = [((i if i is not None else 2**63 - 1, no), x) for i, t in rows if t is not None for no, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
    first = {}
    for at, x in sorted(lines):
        first.setdefault(x, at)
    near = {x for x in first for y in first if x != y and first[y] < first[x] and min(len(x), len(y)) >= min_chars and (one_stretch(x, y) or abs(len(x) - len(y)) <= k and edits(x, y) <= k)}
    kept = {}
    for i, t in rows:
        key = i if i is not None else 2**63 - 1
        kept[i] = None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if not x.strip(" \t\r\x0b\x0c") or (first[x] == (key, no) and x not in near))
    return kept


@pytest.mark.parametrize("k, hot", [(1, 64), (2, 3)])
def test_line_dedup_against_brute_force(spark, monkeypatch, k, hot):
    monkeypatch.setattr(line_dedup, "HOT_KEY", hot)
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    rng = random.Random(k)
    base = [prose(rng, rng.randint(3, 8)) for _ in range(12)] + [prose(rng, 40) for _ in range(6)]

    def line():
        x = list(rng.choice(base))
        if len(x) > 200 and rng.random() < 0.7:  # a changed word
            i = rng.randrange(len(x))
            x[i : i + rng.randint(0, 12)] = rng.choices("abc", k=rng.randint(0, 12))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            i = rng.randrange(len(x))
            x[i : i + rng.randint(0, 1)] = rng.choices("abc", k=rng.randint(0, 1))
        return "".join(x)

    texts = ["\n".join([line() for _ in range(rng.randint(0, 5))] + rng.choice([[], [""], ["ok"], ["  "]])) for _ in range(40)] + [None, "", "ok\nok", base[0]]
    ids = [*range(len(texts) - 1), None]
    frame = docs(spark, texts, ids).withColumn("gone", F.lit(1)).withColumn("n_lines", F.lit(-1))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame, k).collect()}
    assert got == brute_dedup(list(zip(ids, texts, strict=True)), k, line_dedup.MIN_CHARS)
    assert all(line_dedup.is_near(x, y, k) == (one_stretch(x, y) or edits(x, y) <= k) for x, y in [(line(), line()) for _ in range(400)])


def test_line_dedup_of_nothing_and_odd_rows(spark, odd, nothing):
    assert line_dedup.dedup_lines(nothing).count() == 0
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == len(ODD)
    same = [r for r in rows if r["n_lines"] == 1 and r["n_removed"] == 1]
    assert len(same) == 1 and same[0]["doc_id"] is None and same[0]["text"] == ""  # the equal text whose id is null comes last


def test_line_dedup_of_rows_that_share_an_id(spark):
    line = "One line that stands in several documents."
    texts = [f"{line}\nfirst words of one", f"{line}\nsecond words, of two", f"{line}\nthird: words of three", f"{line}\nand a fourth one here"]
    frame = docs(spark, texts, [None, None, 5, 5]).withColumns({"row": F.lit(1), "no": F.lit(2), "h1": F.lit(3), "ord": F.lit(4), "near": F.lit(5)})
    rows = line_dedup.dedup_lines(frame).collect()
    assert sum(line in r["text"] for r in rows) == 1 and sum(r["n_removed"] for r in rows) == 3
    assert next(r["doc_id"] for r in rows if line in r["text"]) == 5 and {r["near"] for r in rows} == {5}


# SimHash


def brute_fingerprint(text):
    xxhash = pytest.importorskip("xxhash")
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    rng = random.Random(6)
    for t in [*ODD, "one", "one two", "one two three", *(prose(rng, n) for n in range(1, 40))]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    # Spark's own xxhash64 is the same function with the same seed.
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == brute_fingerprint("a b c")


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("node_rows", [20_000, 5])
def test_links_join_what_brute_force_joins(spark, node_rows):
    rng = np.random.default_rng(1)
    fps = rng.integers(-(2**63), 2**63, 20).tolist()
    for f in list(fps[:12]):
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                f ^= (1 << b) if b < 63 else -(2**63)
            fps.append(f)
    fps = list(dict.fromkeys([*fps, 0, -1, 1, 7, 15]))
    frame = spark.createDataFrame([(f,) for f in fps] * 2, "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(frame, node_rows=node_rows)).collect()}
    want = brute_components(fps)
    groups = lambda of: sorted(sorted(f for f in fps if of(f) == r) for r in {of(f) for f in fps})
    assert groups(lambda f: roots.get(f, f)) == groups(want.__getitem__)


def test_near_duplicates_of_odd_rows(spark, odd, nothing):
    rng = random.Random(5)
    long_text = prose(rng, 300)
    frame = odd.unionByName(docs(spark, [long_text, long_text + " more", prose(rng, 300)], [50, 51, 52]))
    rows = simhash.near_duplicates(frame).collect()
    assert len(rows) == len(ODD) + 3
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert got[50] == got[51] == 50 and got[52] == 52
    assert got[0] == got[1] == got[2] == 0
    assert got[None] == 8 and got[8] == 8  # the text with a null id is linked to its equal
    assert simhash.near_duplicates(nothing).count() == 0


def five_word_similarity(a, b):
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("node_rows", [20_000, 30])
def test_similar_documents_against_brute_force(spark, monkeypatch, odd, nothing, node_rows):
    monkeypatch.setattr(simhash.wide_links, "__defaults__", (simhash.WIDE_BUDGET, simhash.RECALL, node_rows))
    rng = random.Random(19)
    texts = []
    for size in (60, 150, 400):
        for _ in range(8):
            base = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(size)]
            for rate in (0, 0, 0.004, 0.01, 0.02, 0.1):
                texts.append(" ".join(rng.choice(WORDS) if rng.random() < rate else w for w in base))
    frame = docs(spark, texts).withColumns({"w0": F.lit("clash"), "node": F.lit(1), "root": F.lit(1), "component_id": F.lit("clash")})
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame).collect()}
    near = [(i, j, five_word_similarity(texts[i], texts[j])) for j in range(len(texts)) for i in range(j)]
    hits = [got[i] == got[j] for i, j, s in near if s >= 0.8]
    assert len(hits) > 100 and np.mean(hits) > 0.97
    assert not any(got[i] == got[j] for i, j, s in near if s < 0.4)
    assert all(c <= i for i, c in got.items())
    rows = simhash.similar_documents(odd).collect()
    assert len(rows) == len(ODD) and {r["doc_id"]: r["component_id"] for r in rows}[None] == 8
    assert simhash.similar_documents(nothing).count() == 0


def test_connect_joins_what_all_pairs_join():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, (12, simhash.WIDE)).astype(np.uint64)
    wide = centres[rng.integers(0, 12, 700)]
    for _ in range(25):
        flips = np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)
        wide[np.arange(700), rng.integers(0, simhash.WIDE, 700)] ^= flips
    far = np.bitwise_count(wide[:, None, :] ^ wide[None, :, :]).sum(axis=2)
    for budget in (20, 30, 84):
        a, b = np.nonzero(np.triu(far <= budget, 1))
        for block in (10, 1000):
            x, y = simhash.connect(wide, budget, block)
            assert (far[x, y] <= budget).all()
            roots = []
            for p, q in ((a, b), (x, y)):
                root = np.arange(700)
                node, to = simhash.forest(p, q, 700)
                root[node] = to
                roots.append(root)
            assert (roots[0] == roots[1]).all()


def test_near_duplicates_beside_clashing_columns(spark):
    frame = docs(spark, ["a b c d", "A  B C D", "x y z w"]).withColumns({c: F.lit("clash") for c in ("fp", "n", "least", "root", "component_id", "id")})
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


# Quality rules


def brute_base(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_quality_rules(spark, odd, nothing):
    rng = random.Random(11)
    clean = "\n".join(prose(rng, 12) for _ in range(5))
    shouting = "\n".join(f"{w.upper()}!!" for w in prose(rng, 60).split())
    menu = " | ".join(prose(rng, 40).split())
    half = clean + "\n" + "Licensed under the Apache License, Version 2.0."
    texts = [clean, shouting, menu, half, clean + "\n" + clean, "too short", " ".join(f"{w}###" for w in prose(rng, 50).split())]
    frame = docs(spark, texts).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100)).withColumn("kept", F.lit("clash"))
    known = {r["doc_id"]: r["text"] for r in frame.collect()}
    rows = quality_rules.apply_rules(frame).collect()
    assert len(rows) == len(texts) + len(ODD)
    for r in rows:
        if r["doc_id"] not in (None, 108):  # 108 is there twice
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_base(known[r["doc_id"]])
            assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(ODD[-1], quality_rules.Rules())[:6] == brute_base(ODD[-1])
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert kept == {0, 3}
    cleaned = quality_rules.clean_documents(docs(spark, texts).withColumn("kept", F.lit("clash"))).collect()
    assert {(r["doc_id"], r["text"], r["kept"]) for r in cleaned} == {(0, clean, "clash"), (3, clean, "clash")}
    assert quality_rules.clean_documents(docs(spark, texts), quality_rules.Rules(min_words=1)).count() == 3
    assert quality_rules.clean_documents(nothing).count() == 0
    assert quality_rules.apply_rules(nothing).count() == 0


def test_lines_that_fail():
    def kept(text):
        return quality_rules.judge(text, quality_rules.Rules(max_lost=1.0, min_words=0))[7]

    body = "A sentence of several words that ends well.\nAnd another one here, \u00e9t\u00e9 too!"
    for bad in ("Home\nAbout us\n\nContact", "https://a.example/x www.b.example", "Tous droits r\u00e9serv\u00e9s 2020", "Impressum und mehr dazu", "--==++**//\\ x", "Home | News | More"):
        assert kept(f"{body}\n{bad}").strip() == body, bad
    for good in ("Home\nAbout us", "See https://a.example/x for all of the details.", "Yes.\nNo.\nMaybe."):
        assert kept(f"{body}\n{good}") == f"{body}\n{good}", good


# URL filters


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.NET", "http://a.net/x", "https://x.example.net/en/1?q", "http://example.com/de/#f", "https://w.org/fr/1", "http://bad.site.com/p", "http://site.com.evil/p", "http://one.page/a/?utm_source=x&b=2&a=1#t", "http://one.page/a?a=1&b=2", "http://one.page/a", "ftp://u:p@h:21/x?y"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)] + [(None, urls[4], "")], "page_id long, url string, rule string")
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    listed = spark.createDataFrame([("site.com/",), ("one.page/a?a=1&b=2",), (None,), ("w.org/",)], "url string")
    rows = url_filter.judge(pages, rules, listed).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows if r["page_id"] is not None}
    assert len(rows) == 15
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.net", "", None, "allow") and got[4] == ("a.net", "/x", "net/", "block")
    assert got[5] == ("x.example.net", "/en/1", "example.net/en/", "allow")
    assert got[6] == ("example.com", "/de/", "example.com/de/", "block")
    assert got[7] == ("w.org", "/fr/1", "org/fr/", "allow")
    assert [got[i][3] for i in (8, 9, 10, 11, 12, 13)] == ["block", "allow", "block", "block", "allow", "allow"]
    assert got[13][:2] == ("u:p@h:21", "/x")
    assert url_filter.judge(pages.limit(0), rules, listed).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, [], listed.limit(0)).collect()} == {"allow"}


def test_url_filter_with_a_small_filter_and_a_hot_url(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_WORDS", 64)
    listed = spark.range(2000).select(F.concat(F.lit("h.example/"), F.col("id")).alias("url"))
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.example/"), F.col("id")).alias("url"))
    pages = pages.unionByName(spark.range(500).select(F.col("id").alias("page_id"), F.lit("http://h.example/7").alias("url")))
    pages = pages.withColumns({"id": F.lit("clash"), "host": F.lit("clash"), "listed": F.lit("clash")})
    small = url_filter.Listed(listed, 64)
    assert pages.where(small.may_hold(F.col("url"))).count() > 3000  # the filter is full, the exact join decides
    got = url_filter.judge(pages, [("block", "example/3")], listed).groupBy("verdict").count().collect()
    blocked = sum(i < 2000 and not str(i).startswith("3") for i in range(4000))
    blocked_or_ruled = blocked + sum(str(i).startswith("3") for i in range(4000)) + 500
    assert {r["verdict"]: r["count"] for r in got} == {"block": blocked_or_ruled, "allow": 4500 - blocked_or_ruled}


def test_bloom_passes_all_that_is_listed(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h.example/"), F.col("id")).alias("url"))
    pages = spark.range(6000).select(F.concat(F.lit("http://h.example/"), F.col("id")).alias("url"))
    assert url_filter.listed_urls(pages, listed).count() == 3000


# License scans


def test_license_scan(spark):
    rows = [
        (0, "r/LICENSE", "Released under the MIT License."),
        (1, "r/a.py", "code"),
        (2, "r/sub/b.py", "code\n# Licensed under the Apache License, Version 2.0\nmore"),
        (3, "r/sub/deep/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."),
        (4, "r/sub/deep/c.py", None),
        (5, "r/sub/deep/er/d.py", ""),
        (6, "other/e.py", "nothing at all"),
        (7, None, "All rights reserved."),
        (8, "r2/f.py", "I sell licence plates and driving licences of every kind"),
        (None, "r/g.py", "x"),
        (6, "other/e.py", "nothing at all"),
    ]
    files = spark.createDataFrame(rows, "id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r["id"]: (r["license"], r["origin"]) for r in license_scan.scan(files).collect()}
    assert got == {0: ("MIT", "file"), 1: ("MIT", "inherited"), 2: ("Apache-2.0", "header"), 3: ("GPL-3.0", "file"), 4: ("GPL-3.0", "inherited"), 5: ("GPL-3.0", "inherited"), 6: (None, None), 7: ("Proprietary", "header"), 8: (None, None), None: ("MIT", "inherited")}
    assert license_scan.scan(files).count() == len(rows)
    assert license_scan.scan(files.limit(0)).count() == 0


def test_license_scan_of_common_texts(spark):
    mit = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.
"""
    apache = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
package x; // many other words of code follow here and go on for a while
"""
    bsd = """Copyright 2001 Some Body. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.
"""
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.

import os
"""
    rng = random.Random(21)
    rows = [(0, "a/LICENSE", mit), (1, "b/x.java", apache), (2, "c/LICENSE.txt", bsd), (3, "d/x.py", gpl), (4, "e/x.rs", "// SPDX-License-Identifier: MIT\nfn main() {}"), (5, "a/deep/er/y.c", "int x;"), (6, "c/y.c", "int y;"), (7, "f/long.txt", "\n".join([prose(rng, 30) for _ in range(200)] + ["Released under the MIT License.", "He lost his driving license."]))]
    rows += [(100 + i, f"g/{i}.txt", prose(rng, 50)) for i in range(50)]
    got = {r["id"]: (r["license"], r["origin"]) for r in license_scan.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert [got[i] for i in range(8)] == [("MIT", "file"), ("Apache-2.0", "header"), ("BSD-3-Clause", "file"), ("GPL-3.0", "header"), ("MIT", "header"), ("MIT", "inherited"), ("BSD-3-Clause", "inherited"), ("MIT", "header")]
    assert all(got[100 + i] == (None, None) for i in range(50))


def test_license_scan_of_a_large_directory(spark):
    rows = [(i, "r/big/LICENSE" if i == 0 else f"r/big/{i}.txt", "Released under the MIT License." if i == 0 else None) for i in range(300)] + [(7, "r/big/7.txt", "same")] * 100
    got = license_scan.scan(spark.createDataFrame(rows, "id long, path string, text string")).groupBy("license", "origin").count().collect()
    assert {(r["license"], r["origin"], r["count"]) for r in got} == {("MIT", "file", 1), ("MIT", "inherited", 399)}


# Components


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 200)] + [(7, 7), (300, 299)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 200)) and got[299] == got[300] == 299
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_hub(spark):
    hub = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    other = spark.range(1, 3000).select(F.lit(10_000).cast("long").alias("a"), (F.col("id") + 10_000).alias("b"))
    got = components.components(hub.unionByName(other).unionByName(hub.limit(5))).groupBy("root").count().collect()
    assert {(r["root"], r["count"]) for r in got} == {(0, 3000), (10_000, 3000)}


def test_hot_keys_are_joined_by_broadcast(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, F.lit(7)).otherwise(F.col("id")).alias("k"), "id").cache()
    unique = spark.range(0, 2000, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = llm_common.join_unique(rows, unique, ["k"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(unique, "k", how).select(*got.columns).collect()))
    assert [r["k"] for r in llm_common.hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), ["k"]).collect()] == [7]


# Pipeline


def test_pipeline_against_brute_force(spark, tmp_path, vocabulary):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(13)
    text = lambda: "\n".join(prose(rng, 30) for _ in range(3))
    one = text()
    item = [f"q{rng.randrange(300)}" for _ in range(40)]
    texts = [one, one, text(), text() + "\n" + " ".join(item) + ".", "short", None, " | ".join(prose(rng, 40).split()), text() + "\nReleased under the MIT License."]
    leaky = 3
    shared = prose(rng, 30)
    texts += [shared + "\n" + text(), shared + "\n" + text()]
    ids = [*range(len(texts) - 1), None]
    docs(spark, texts, ids).withColumn("row", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(got) == corpus_pipeline.run(spark, str(tmp_path)).count()

    cleaned = []
    for i, t in zip(ids, texts, strict=True):
        judged = quality_rules.judge(t, quality_rules.Rules(min_words=1))
        if judged[6]:
            cleaned.append((i, judged[7]))
    kept = {i: t for i, t in brute_dedup(cleaned, line_dedup.MAX_EDITS, line_dedup.MIN_CHARS).items() if t.strip()}
    order = sorted(kept, key=lambda i: (i is None, i or 0))
    wide = {i: simhash.wide_fingerprint(kept[i]) for i in kept}
    seen, last = [], {}
    for i in order:
        if all(sum((x ^ y).bit_count() for x, y in zip(wide[i], wide[j], strict=True)) > simhash.WIDE_BUDGET for j in seen) and i != leaky:
            last[i] = kept[i]
        seen.append(i)
    assert {i: r["text"] for i, r in got.items()} == last
    assert {0, 2, 4, 7, 8, None} <= set(got) and not {1, 3, 5, 6} & set(got)
    for r in got.values():
        assert r["n_chars"] == len(r["text"]) and r["n_tokens"] * 4 == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_pipeline_of_empty_tables(spark, tmp_path, nothing, vocabulary):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    nothing.write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    docs(spark, ["One text of some words.", None, ""]).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/b").collect()] == [0]


def test_long_runs_of_short_lines_take_time_in_proportion():
    began = time.process_time()
    judged = quality_rules.judge("\n".join(f"word{k}" for k in range(200_000)), quality_rules.Rules())
    assert judged[0] == 200_000 and not judged[6] and judged[7] == "" and time.process_time() - began < 5
    mixed = "A whole sentence stands here, before the list of items.\n\none\n\ntwo\nthree\nAnother whole sentence stands here, behind it.\nfour\nfive"
    assert quality_rules.judge(mixed, quality_rules.Rules())[7] == "\n".join(x for x in mixed.split("\n") if x not in ("one", "two", "three"))


def test_decontamination_of_one_word_many_times(spark):
    item = spark.createDataFrame([(1, "again " * 60)], "item_id long, text string")
    frame = docs(spark, ["again " * 20_000, "again " * 59 + "and once more", "once"])
    began = time.time()
    got = {r["doc_id"]: r for r in decontamination.find_overlaps(frame, item).collect()}
    assert set(got) == {0, 1} and (got[0]["matched"], got[0]["doc_start"]) == (60, 0) and got[1]["matched"] >= 59 and time.time() - began < 30


def test_license_scan_tells_relatives_apart(spark):
    lines = {
        "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
        "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0",
        "Licensed under CC BY 4.0": "CC-BY-4.0",
        "Licensed under CC BY 3.0": None,
        "Licensed under the Apache License, Version 1.1": "Apache-1.1",
        "Licensed under the Apache License, Version 2.0": "Apache-2.0",
        "Released under the WTFPL License": "WTFPL",
        "This file is not licensed under the Apache License, Version 2.0": None,
        "// SPDX-License-Identifier: MIT OR Apache-2.0": "MIT OR Apache-2.0",
        "<!-- SPDX-License-Identifier: LGPL-2.1-or-later -->": "LGPL-2.1-or-later",
        "# SPDX-License-Identifier: EPL-2.0": "EPL-2.0",
        "/* SPDX-License-Identifier: Zlib */": "Zlib",
        "SPDX-License-Identifier: BSL-1.0": "BSL-1.0",
        "SPDX-License-Identifier: 0BSD": "0BSD",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "LGPL-2.1",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": "GPL-2.0",
        "Copyright 2019-2020\nReleased under the MIT License": "MIT",
        "Licensed under the BSD 3-Clause License": "BSD-3-Clause",
    }
    files = spark.createDataFrame([(i, f"d{i}/f.txt", line) for i, line in enumerate(lines)], "id long, path string, text string")
    got = {r["id"]: r["license"] for r in license_scan.scan(files).collect()}
    assert [got[i] for i in range(len(lines))] == list(lines.values())


def test_lines_carry_no_text_of_their_document_along(spark):
    """Keys of a document are made once a document, below the explode, and lengths once a line."""
    docs = spark.createDataFrame([(1, "a b\n \t\r\n\x0b\x0c\n\u00a0\nc")], "doc_id long, text string")
    lines = line_dedup.lines_of(docs)
    assert [(r["no"], r["line"]) for r in lines.orderBy("ord").collect()] == [(0, "a b"), (3, "\u00a0"), (4, "c")]
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    tops = lines._jdf.queryExecution().optimizedPlan().toString().split("Generate")
    assert len(tops) == 2 and "text#" not in tops[0]
    assert "RLIKE" not in plan


def test_line_dedup_pairs_grow_with_lines_and_not_with_their_square(spark, monkeypatch):
    """Forty variants of a line that share its first half are compared in blocks; few of their pairs are made by the join."""
    made = spark.sparkContext.accumulator(0)
    verify = line_dedup._verify

    def counting(k):
        def run(batches):
            def seen():
                for batch in batches:
                    made.add(len(batch))
                    yield batch

            yield from verify(k)(seen())

        return run

    monkeypatch.setattr(line_dedup, "_verify", counting)
    head = "the same first half of every line here "
    tail = lambda i: "".join(random.Random(i).choices("abcdefghijklmnop", k=len(head)))
    docs = spark.createDataFrame([(i, head + tail(i)) for i in range(40)], "doc_id long, text string")
    out = line_dedup.dedup_lines(docs).collect()
    assert all(r["n_removed"] == 0 for r in out) and made.value <= 40 * 16
