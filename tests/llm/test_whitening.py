"""Whitening against numpy's eigenvectors and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import whitening
from weftgraph.llm.queries import op12_whitening


@pytest.mark.parametrize("trial", range(30))
def test_counts_and_leading_eigenvalues(trial):
    rng = np.random.default_rng(trial)
    d, n = int(rng.integers(1, 40)), int(rng.integers(1, 80))
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 100, size=d)
    if trial % 5 == 0:
        x = np.repeat(x[:, :1], d, axis=1)
    a = np.cov(x.T, bias=True).reshape(d, d)
    e, _ = np.linalg.eigh(a)
    for shift in rng.uniform(-1, e.max() * 1.1 + 1, size=4):
        assert whitening.count_below(a, shift) == (e < shift).sum()
    got, want = whitening.leading(a, 8), e[::-1][:8]
    assert len(got) == (want > 1e-11 * max(1, want[0])).sum()
    for (value, v), w in zip(got, want, strict=False):
        assert abs(value - w) < 1e-12 * want[0] and np.linalg.norm(a @ v - value * v) < 1e-12 * want[0]
    vectors = np.array([v for _, v in got]).reshape(len(got), d)
    assert np.abs(vectors @ vectors.T - np.eye(len(got))).max(initial=0) < 1e-8


def test_equal_eigenvalues_and_none():
    for a in (np.eye(6), np.diag([3.0, 3.0, 1.0, 1.0, 0.0])):
        got = whitening.leading(a, 4)
        assert [round(e, 9) for e, _ in got] == sorted(np.diag(a), reverse=True)[:4]
        v = np.array([v for _, v in got])
        assert np.abs(v @ v.T - np.eye(4)).max() < 1e-9
    assert whitening.leading(np.zeros((3, 3)), 2) == []


def test_products_are_exact():
    y = np.random.default_rng(2).integers(-(2**31), 2**31, size=(300, 4))
    assert whitening.exact_products(y) == [[sum(int(p) * int(q) for p, q in zip(y[:, i], y[:, j], strict=True)) for j in range(4)] for i in range(4)]


def test_whitening_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(3)
    c = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(c)]
    odd = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] + [0.0] * 11), (903, [float("-inf")] * 12), (904, []), (905, [1.0, 2.0]), (None, rows[0][1]), (3, rows[3][1])]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("z", F.lit("a clashing name")).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_whitening(spark, str(tmp_path)).collect()
    kept = rows + odd[-2:]
    x = [[math.floor(1024 * v) + 100_000 for v in r] for _, r in kept]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    by_id = {k: sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for (k, _), r in zip(kept, x, strict=True)}
    assert all(r["deviation"] == by_id[r["vec_id"]] for r in got)
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(r, sums, strict=True)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    for k in range(8):
        want = {i: row @ v[:, -1 - k] / math.sqrt(e[-1 - k]) for (i, _), row in zip(kept, centred, strict=True)}
        own = [r for r in got if r["component"] == k + 1]
        sign = np.sign(own[0]["whitened"] * want[own[0]["vec_id"]])
        assert max(abs(r["whitened"] - sign * want[r["vec_id"]]) for r in own) < 1e-9
        assert all(abs(r["explained"] - e[-1 - k] / e.sum()) < 1e-9 for r in own)
    assert len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] < 1e-9


def test_few_vectors(spark, tmp_path):
    kind = "vec_id long, embedding array<float>"
    for name, rows, components in (("none", [], 0), ("one", [(1, [1.0, 2.0])], 0), ("equal", [(k, [1.0, 2.0]) for k in range(5)], 0), ("two", [(1, [1.0, 2.0]), (2, [1.0, 3.0])], 1)):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert op12_whitening(spark, f"{tmp_path}/{name}").count() == components * len(rows)


def test_too_large_entries_raise(spark):
    rows = spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="an entry is over"):
        whitening.usable(rows).collect()
