import os

import pytest

import __spark_entry__ as e

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_entry_gives_rows(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", ["edges_distinct_bidirected", "node_class_dih", "swap_candidates", "sage_two_layer_forward", "cross_entropy_loss", "text_roundtrip"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("part", "supplier", "customer", "orders", "lineitem", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = e.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    cursor = db.execute(e.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == want


def test_folders_are_shared_ones(spark, tmp_path, monkeypatch):
    from weftgraph import common

    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")

    class Cluster:
        conf = type("", (), {"get": staticmethod(lambda name, other: other)})()
        sparkContext = type("", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(Cluster())
    (tmp_path / "stage").mkdir()
    common.discard(spark, f"{tmp_path}/stage")
    assert not (tmp_path / "stage").exists()
