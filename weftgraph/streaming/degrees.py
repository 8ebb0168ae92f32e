"""Degrees of a growing edge list, by Structured Streaming.

Beyond the batch library: an edge file that arrives adds to running counts, in
state kept by node and direction. Each trigger writes the changed nodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def edge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst) from the Parquet files that arrive in a folder."""
    return spark.readStream.schema("src long, dst long").parquet(folder)


def running_degrees(edges: DataFrame) -> DataFrame:
    """(node_id, din, dout) of a stream of edges, each edge counted once for either end."""
    ends = F.array(
        F.struct(F.col("dst").alias("node_id"), F.lit(1).cast("long").alias("din"), F.lit(0).cast("long").alias("dout")),
        F.struct(F.col("src").alias("node_id"), F.lit(0).cast("long").alias("din"), F.lit(1).cast("long").alias("dout")),
    )
    return edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("node_id").agg(F.sum("din").alias("din"), F.sum("dout").alias("dout"))


def follow(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], available_now: bool = True) -> StreamingQuery:
    """Runs ``sink(changed rows, batch number)`` for each batch of files."""
    writer = running_degrees(edge_stream(spark, folder)).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
