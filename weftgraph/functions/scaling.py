"""Standard scaling fitted on some rows and applied to all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standard_scale(nodes: DataFrame, fit_on: DataFrame, column: str = "features") -> DataFrame:
    """(x - mean) / population deviation by component, over the nodes in ``fit_on``; a deviation of zero counts as one."""
    rows = nodes.join(fit_on.select("node_id").distinct(), "node_id", "left_semi")
    long = rows.select(F.posexplode(column).alias("j", "v"))
    stats = long.groupBy("j").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    stats = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "mean", F.coalesce(F.nullif("std", F.lit(0.0)), F.lit(1.0)).alias("std")))), lambda s: F.struct(s["mean"].alias("mean"), s["std"].alias("std"))).alias("stats"))
    fitted = stats.scalar()  # one entry a component
    kind = "float" if "float" in dict(nodes.dtypes)[column] else "double"
    scaled = F.zip_with(F.col(column), F.col("__stats"), lambda v, s: ((v - s["mean"]) / s["std"]).cast(kind))
    return nodes.withColumn("__stats", fitted).withColumn(column, scaled).drop("__stats")
