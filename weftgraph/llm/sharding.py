"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in SQL functions only.

Every shard has ``virtual`` points on a ring of 65,536 cells; a row belongs to
the first point at or after the cell of its hash. A shard takes rows only up
to its capacity, which is the row count shared out evenly, so counts are at
most one apart; what a full shard can't take continues clockwise to the next
shard that has room. Points are served in ring order and a point's rows in
the order of (hash, doc_id, text_crc32, size), so a change moves few rows.

Only the ring and the rows per cell decide, so the walk around it runs over
that table, whose size does not depend on the input, as one fold in one row.
Rows then find their shard by their rank below their point: the rank of the
cell before them, plus their own in the cell, which is the one shuffle (of
ids and digests, not of texts). Cells are hashed from id and text digest, so
neither a hot source nor many equal texts or null ids gather in one of them;
only rows that repeat in both do.

A null text has size 1 and the CRC of no bytes; texts of any length count by
their bytes and digest alone. Rows equal in everything are interchangeable and
get a slot each. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import cut

SHARDS, VIRTUAL, CELL_BITS = 8, 128, 16


def _cell(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - CELL_BITS).cast("int")


def ring(spark: SparkSession, shards: int = SHARDS, virtual: int = VIRTUAL) -> tuple[DataFrame, DataFrame]:
    """(point, clockwise) of each point, all shards in the order met from it; and (cell, point), the point that serves each cell."""
    points = spark.range(shards * virtual).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("copy"))
    points = points.select(F.struct(_cell(F.lit("point"), "shard", "copy").alias("cell"), "shard", "copy").alias("p"))
    points = points.agg(F.sort_array(F.collect_list("p")).alias("all"))  # shards * virtual entries
    each = points.select("all", F.posexplode("all").alias("point", "p"))
    order = F.transform("all", lambda p: p["shard"])
    clockwise = F.array_distinct(F.concat(F.slice(order, F.col("point") + 1, shards * virtual), F.slice(order, 1, F.col("point"))))
    before = F.when(F.col("point") == 0, F.lit(-1)).otherwise(F.get("all", F.col("point") - 1)["cell"])
    own = F.when(F.col("p.cell") > before, F.sequence(before + 1, F.col("p.cell"))).otherwise(F.array().cast("array<int>"))
    last = F.get("all", F.size("all") - 1)["cell"]
    over = F.when((F.col("point") == 0) & (last < 2**CELL_BITS - 1), F.sequence(last + 1, F.lit(2**CELL_BITS - 1))).otherwise(F.array().cast("array<int>"))
    cells = each.select("point", F.concat(own, over).alias("cells"))
    return each.select("point", clockwise.alias("clockwise")), cells.select("point", F.explode("cells").alias("cell"))


def _serve(points: DataFrame, shards: int) -> DataFrame:
    """(point, lo, hi, shard, slot): the ranks of a point's rows that each shard takes, from which slot on."""
    served = points.agg(F.sort_array(F.collect_list(F.struct("point", "n", "clockwise"))).alias("points"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    capacity = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(F.col("total") / shards) + F.when(s < F.col("total") % shards, 1).otherwise(0))
    step = "struct<point:int,lo:bigint,hi:bigint,shard:int,slot:bigint>"
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), shards).alias("used"), F.array().cast(f"array<{step}>").alias("out"))

    def point(state, p):
        def shard(inner, s):
            room = F.get("capacity", s) - F.get(inner["used"], s)
            take = F.least(p["n"] - inner["at"], room)
            entry = F.struct(p["point"].alias("point"), inner["at"].alias("lo"), (inner["at"] + take).alias("hi"), s.alias("shard"), F.get(inner["used"], s).alias("slot"))
            return F.when(take > 0, F.struct(
                (inner["at"] + take).alias("at"),
                F.transform(inner["used"], lambda u, i: F.when(i == s, u + take).otherwise(u)).alias("used"),
                F.concat(inner["out"], F.array(entry.cast(step))).alias("out"))).otherwise(inner)

        begin = F.struct(F.lit(0).cast("bigint").alias("at"), state["used"].alias("used"), state["out"].alias("out"))
        return F.aggregate(p["clockwise"], begin, shard, lambda x: F.struct(x["used"].alias("used"), x["out"].alias("out")))

    served = served.withColumn("capacity", capacity)
    return served.select(F.explode(F.aggregate("points", start, point, lambda x: x["out"])).alias("t")).select("t.*")


def assign(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; slot counts a shard's rows from 0 without gaps."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    rows = cut(rows.withColumn("hash", F.xxhash64("id", "crc")).withColumn("cell", F.shiftrightunsigned("hash", 64 - CELL_BITS).cast("int")))
    points, ring_cells = ring(docs.sparkSession, shards, virtual)
    cells = rows.groupBy("cell").agg(F.count("*").alias("n")).join(F.broadcast(ring_cells), "cell")
    cells = cut(cells)  # 65,536 rows at most
    served = _serve(cells.groupBy("point").agg(F.sum("n").alias("n")).join(F.broadcast(points), "point"), shards)
    taken = served.groupBy("point").agg(F.collect_list(F.struct("lo", "hi", "shard", "slot")).alias("taken"))
    below = F.sum("n").over(Window.partitionBy("point").orderBy("cell")) - F.col("n")
    places = cells.select("cell", "point", below.alias("below"))  # 65,536 rows at most
    own = F.row_number().over(Window.partitionBy("cell").orderBy("hash", "id", "crc", "size")) - 1
    ranked = rows.withColumn("own", own).join(F.broadcast(places), "cell").join(F.broadcast(taken), "point").withColumn("rank", F.col("below") + F.col("own"))
    hit = F.get(F.filter("taken", lambda t: (F.col("rank") >= t["lo"]) & (F.col("rank") < t["hi"])), F.lit(0))
    placed = ranked.select("id", "size", "crc", "rank", hit.alias("t"))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("t.shard").alias("shard"), (F.col("t.slot") + F.col("rank") - F.col("t.lo")).alias("slot"))
