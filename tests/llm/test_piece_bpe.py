"""SentencePiece encoding against the library, and against merging by its definition for vocabularies of odd ranks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import piece_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BITS = ["a", "b", "the", " ", "  ", "   ", "\n", "\t", "▁", "▁▁", "é", "日本", "語", "😀", "</s>", "<s>", "<0x0A>", "ing", " of", "aaaa", "abab", "\x00", "​", "ß", "1234", "...", " = ", "\r\n", "ﬀ", "한국", "é"]
ODD = [None, "", " ", "  two", "trailing \n", "x" * 30_000, "word " * 5_000, "日" * 5_000, " " * 4_001, "same", "same"]


@pytest.fixture(scope="module")
def library():
    public, sentencepiece = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model(spark):
    public = pytest.importorskip("public_tokenizers")
    return piece_bpe.Model.load(spark, public.path("piece_bpe_32k.model"))


def test_the_model_is_read_whole(library, model):
    n = library.get_piece_size()
    assert model.pieces == [library.id_to_piece(i) for i in range(n)]
    assert model.scores == [library.get_score(i) for i in range(n)]
    assert [t == piece_bpe.BYTE for t in model.types] == [library.is_byte(i) for i in range(n)]


def test_encoding_equals_the_library(spark, library, model):
    rng = random.Random(3)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 40))) for _ in range(500)] + ODD
    ids = [*range(len(texts) - 2), None, 7]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)
    got = piece_bpe.encode(frame.withColumn("ids", F.lit("a clashing name")), model, keep=("doc_id", "text")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i in ids)
    for r in got:
        want = library.encode(r["text"] or "", add_eos=True)
        assert r["ids"] == want and r["decoded"] == library.decode(want)
    assert piece_bpe.encode(frame.limit(0), model).count() == 0
    assert all(r["ids"][-1:] != [2] for r in piece_bpe.encode(frame, model, end=False).collect())


def test_decoding_of_any_ids_equals_the_library(library, model):
    pieces, rng = piece_bpe.Pieces(model), random.Random(4)
    for _ in range(2000):
        ids = [rng.randrange(len(model.pieces) if rng.random() < 0.5 else 270) for _ in range(rng.randint(0, 8))]
        assert pieces.decode(np.array(ids, np.int32)).decode() == library.decode(ids)


def test_a_small_memory_changes_nothing(monkeypatch, library, model):
    monkeypatch.setattr(piece_bpe, "CACHE_WORDS", 3), monkeypatch.setattr(piece_bpe, "CACHE_PAIRS", 5)
    pieces, rng = piece_bpe.Pieces(model), random.Random(5)
    for _ in range(30):
        texts = ["".join(rng.choices(BITS, k=20)) for _ in range(5)]
        assert [np.frombuffer(x, "<u4").tolist() for x in pieces.encode(texts)] == library.encode(texts)


@pytest.mark.parametrize("seed", range(6))
def test_any_ranks_against_merging_by_its_definition(seed):
    """Vocabularies without an order, with equal scores, pieces that never come about and characters that are no pieces."""
    rng = random.Random(seed)
    pieces = sorted({"".join(rng.choices("ab▁c", k=rng.randint(1, 5))) for _ in range(60)} - {"c"})
    own = [f"<0x{b:02X}>" for b in range(256)]
    scores = [0.0] * 256 + [float(-rng.randint(1, 12 if seed % 2 else 10**6)) for _ in pieces]
    model = piece_bpe.Model(own + pieces, scores, [piece_bpe.BYTE] * 256 + [piece_bpe.NORMAL] * len(pieces), dummy_prefix=False)
    found = piece_bpe.Pieces(model)
    number = found.number | {c: 10_000 + ord(c) for c in "abc▁" if c not in found.number}
    time = {i: found.time[i] for i in found.number.values()}
    for _ in range(300):
        text = "".join(rng.choices("ab▁c", k=rng.randint(1, 14)))
        want = piece_bpe.replay(text, number, time)[0]
        spelled = [b for i in want for b in ([x for x in chr(i - 10_000).encode()] if i >= 10_000 else [i] if i < len(model.pieces) else found.text[i].encode())]
        assert np.frombuffer(found.encode([text])[0], "<u4").tolist() == spelled
