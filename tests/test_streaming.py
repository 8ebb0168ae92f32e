from weftgraph.sources.fixtures import karate
from weftgraph.streaming.degrees import follow


def test_running_degrees_equal_batch_degrees(spark, tmp_path):
    graph = karate(spark)
    seen = {}

    def sink(changed, _):
        seen.update({r["node_id"]: (r["din"], r["dout"]) for r in changed.collect()})

    for k in (0, 1):
        graph.edges.where(f"src % 2 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/edges")
        follow(spark, f"{tmp_path}/edges", f"{tmp_path}/state", sink).awaitTermination()
    assert seen == {r["node_id"]: (r["din"], r["dout"]) for r in graph.degrees().collect()}
