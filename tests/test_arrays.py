"""Files written by numpy, read in several partitions."""

import json

import numpy as np
import pytest

from weftgraph.sources import arrays, text


def csr(path, n, pairs, compressed):
    order = sorted(pairs)
    indptr = np.zeros(n + 1, np.int32)
    for a, _ in order:
        indptr[a + 1 :] += 1
    save = np.savez_compressed if compressed else np.savez
    save(path, indices=np.array([b for _, b in order], np.int32), indptr=indptr, data=np.ones(len(order)), shape=np.array([n, n]), format=np.array(b"csr"))


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("block", [64, 8 << 20])
def test_sparse_matrices_are_edges(spark, tmp_path, monkeypatch, compressed, block):
    monkeypatch.setattr(arrays, "BLOCK", block)
    rng = np.random.default_rng(1)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 50, (400, 2))} | {(7, b) for b in range(50)}
    pairs = {(a, b) for a, b in pairs if a not in (0, 20, 49)}  # rows without entries
    csr(f"{tmp_path}/adj.npz", 50, pairs, compressed)
    got = arrays.read_csr(spark, f"file://{tmp_path}/adj.npz", partitions=5)
    assert sorted(map(tuple, got.collect())) == sorted(pairs) and got.rdd.getNumPartitions() == 5
    parts = [list(arrays._CsrReader({"path": f"{tmp_path}/adj.npz", "partitions": "7"}).read(p)) for p in arrays._ranges(len(pairs), 7)]
    assert sorted(x for p in parts for b in p for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) == sorted(pairs)
    csr(f"{tmp_path}/none.npz", 3, set(), compressed)
    assert arrays.read_csr(spark, f"{tmp_path}/none.npz").count() == 0


def test_matrices_are_rows(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(103, 4)).astype(np.float32)
    np.save(f"{tmp_path}/x.npy", x), np.savez_compressed(f"{tmp_path}/x.npz", feats=x, one=np.arange(5)), np.save(f"{tmp_path}/f.npy", np.asfortranarray(x))
    for path, member in ((f"{tmp_path}/x.npy", None), (f"{tmp_path}/x.npz", "feats")):
        got = arrays.read_npy(spark, path, member, partitions=4)
        assert got.rdd.getNumPartitions() == 4
        assert [r["values"] for r in got.orderBy("row").collect()] == x.astype(float).tolist()
    assert [r["values"] for r in arrays.read_npy(spark, f"{tmp_path}/x.npz", "one", 2).orderBy("row").collect()] == [[float(k)] for k in range(5)]
    with pytest.raises(Exception, match="C order"):
        arrays.read_npy(spark, f"{tmp_path}/f.npy").count()


def test_a_folder_of_arrays_loads_as_its_tables(spark, tmp_path):
    x = np.arange(18, dtype=np.float64).reshape(6, 3) ** 1.5
    full, train = {(0, 1), (1, 2), (2, 0), (3, 4), (5, 5)}, {(0, 1), (1, 2)}
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "class_map.json").write_text(json.dumps({str(k): [k % 2, 1] for k in range(5)}))
        (tmp_path / name / "role.json").write_text(json.dumps({"tr": [0, 1, 2], "va": [3], "te": [4, 5]}))
    np.save(f"{tmp_path}/a/feats.npy", x)
    csr(f"{tmp_path}/a/adj_full.npz", 6, full, True), csr(f"{tmp_path}/a/adj_train.npz", 6, train, True)
    spark.createDataFrame([(k, [float(np.float32(v)) for v in r]) for k, r in enumerate(x)], "node_id long, features array<float>").write.parquet(f"{tmp_path}/b/nodes.parquet")
    for name, pairs in (("adj_full", full), ("adj_train", train)):
        spark.createDataFrame(sorted(pairs), "src long, dst long").write.parquet(f"{tmp_path}/b/{name}.parquet")
    own, tables = (text.load_multilabel(spark, f"{tmp_path}/{n}", 2) for n in "ab")
    rows = lambda g: (sorted(map(tuple, g.edges.select("src", "dst").collect())), sorted((r["node_id"], tuple(np.round(r["features"], 6)), tuple(r["labels"]), r["train_mask"]) for r in g.nodes.collect()))
    assert rows(own) == rows(tables)
