"""Hops dealt by blocks of ids: right for any ids, and vectors go once to a block of destinations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import aggregate as agg

DENSE, UNEVEN = list(range(60)), [*range(50), -7, 10**6, *(10**15 + i for i in range(8))]


def made(spark, ids):
    rng = np.random.default_rng(1)
    pairs = sorted({(ids[int(a)], ids[int(b)]) for a, b in rng.integers(0, len(ids), (300, 2))})
    x = {i: [float(k), float(-k * k % 11)] for k, i in enumerate(ids)}
    return pairs, x, spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame(list(x.items()), "node_id long, x array<double>")


@pytest.mark.parametrize("ids", [DENSE, UNEVEN])
def test_means_and_sequences_for_any_ids(spark, ids):
    pairs, x, edges, h = made(spark, ids)
    near = {d: sorted(s for s, t in pairs if t == d) for _, d in pairs}
    got = {r["node_id"]: r["a"] for r in agg.neighbour_mean(h, edges, 2).collect()}
    assert got.keys() == near.keys() and all(np.allclose(got[d], np.mean([x[s] for s in near[d]], axis=0)) for d in near)
    rows = agg._sequences(edges, h, 2, agg.Reach()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    seen = {}
    for r in rows:
        assert r["x"] == x[r["src"]]
        seen.setdefault(r["dst"], []).append((r["at"], r["src"]))
    assert {d: [s for _, s in v] for d, v in seen.items()} == near
    assert all(len({a >> 33 for a, _ in v}) == 1 for v in seen.values())  # one partition


def test_blocks_are_ranges_unless_ids_are_uneven(spark):
    def numbers(ids):
        nodes = spark.createDataFrame([(i,) for i in ids], "node_id long")
        return [r[0] for r in nodes.select(agg.blocks(nodes)(F.col("node_id"))).collect()]

    many = numbers(range(640))
    assert many == sorted(many) and max(many.count(b) for b in many) == 40
    uneven = numbers([*range(640), 10**15])  # by ranges all but one would be together
    assert max(uneven.count(b) for b in uneven) < 100
    assert numbers([]) == [] and numbers([5]) == [0]


def test_edges_and_vectors_meet_by_blocks(spark):
    """Before, both were dealt by single sources, and an LSTM's edges went to their destinations with a vector each."""
    _, _, edges, h = made(spark, DENSE)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    mean = plan(agg.neighbour_mean(h, edges, 2, agg.Reach(None, True)))
    assert mean.count("hashpartitioning(block") == 2 and "hashpartitioning(src" not in mean
    assert "hashpartitioning(dst" not in plan(agg._sequences(edges, h, 2, agg.Reach(None, True)))


def test_edges_are_sorted_before_they_have_vectors(spark):
    """A sort after the join would hold a vector for each edge, in memory and on disk."""
    _, _, edges, h = made(spark, DENSE)
    rows = agg._sequences(edges, h, 2, agg.Reach(None, True))
    rows.collect()
    lines = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    sorts, joins = ([k for k, line in enumerate(lines) if name in line] for name in ("Sort [dst", "ShuffledHashJoin [block"))
    assert len(sorts) == 1 and joins and joins[0] < sorts[0]
