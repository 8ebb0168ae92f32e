"""The Merkle manifest against a plain recursive one."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import manifest
from weftgraph.llm.queries import op13_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def entry(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return sha(*map(entry, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(leaves):
    """(root, [siblings of each leaf, level by level])"""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            begin = at[k] // 8 * 8
            run = nodes[begin : begin + 8]
            path.append((run[: at[k] - begin], run[at[k] - begin + 1 :]))
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], paths


def plain(rows):
    """Rows as the query gives them."""
    langs = defaultdict(list)
    for r in rows:
        langs[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda x: x[:3])
        trees[lang] = tree([x[2] for x in langs[lang]])
    root, upper = tree([trees[lang][0] for lang in order])
    out = []
    for lang, above in zip(order, upper, strict=True):
        for (_, _, own, r), path in zip(langs[lang], trees[lang][1], strict=True):
            text, i = r["text"], r["doc_id"]
            if text is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            d = leaf(r, text)
            for left, right in path + above:
                d = sha(*left, d, *right)
            proof = sha(*(s for left, right in path + above for s in left + right))
            out.append((i, own, trees[lang][0], root, proof, d, d == root))
    return out


def rows_of(spark, rows, tmp_path, n=4):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("slot", F.lit("a clashing name")).withColumn("g", F.lit(1))
    frame.repartition(n).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_merkle_manifest(spark, str(tmp_path)).collect()
    given = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain(given), key=key)
    return got


def test_trees_of_several_passes(spark, tmp_path):
    rows = [(i * 7 % 6007, f"Text {i} É" if i % 5 else "same", "en" if i % 9 else "de", "s", i) for i in range(6007)]
    got = rows_of(spark, rows, tmp_path)
    assert any(r["verified"] for r in got) and any(not r["verified"] for r in got)


def test_wide_and_negative_ids(spark, tmp_path):
    rng = np.random.default_rng(1)
    ids = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 300)] + [-(2**63), 2**63 - 1, -1, 0, 4095, 4096]
    rows_of(spark, [(i, "Word", ["en", "zz", "ä"][k % 3], None, None) for k, i in enumerate(ids)], tmp_path)


def test_odd_rows(spark, tmp_path):
    texts = [None, "", "A" * 50_000, "b", "b", " \n", "Zoë"]
    rows = [(None if k % 4 == 0 else k % 5, texts[k % 7], [None, "", "en", "eñ"][k % 3], [None, "", "s"][k % 3], k % 2) for k in range(120)]
    rows_of(spark, rows + rows[:40] + [(900, "alone", "one", "s", 1)], tmp_path)


def test_one_row_many_copies_and_nothing(spark, tmp_path):
    rows_of(spark, [(5, "Only", "en", "s", 1)], tmp_path / "a", 1)
    rows_of(spark, [(5, "Only", "en", "s", 1)] * 700 + [(k, "x", "en", "s", 1) for k in range(9)], tmp_path / "b")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/c/documents.parquet")
    assert op13_merkle_manifest(spark, f"{tmp_path}/c").count() == 0


@pytest.mark.parametrize("n", [0, 1, 200, 256, 4096])
def test_bitmaps_are_packed_and_unpacked(n):
    low = np.sort(np.random.default_rng(n).choice(4096, n, replace=False)).astype(np.uint16)
    raw = manifest.packed(low)
    assert np.flatnonzero(manifest.unpacked(raw)).tolist() == low.tolist() and len(raw) <= 512
