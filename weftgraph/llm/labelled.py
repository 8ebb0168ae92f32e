"""Labelled rows for training: joined with the documents, or a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut

#: Broadcast the labels up to so many rows (a long and an int each); beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000


def remainder(id_col: str, of: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def training_labels(labels: DataFrame, label_col: str, keep: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, y) for the ids with a label for which ``keep`` holds; an id labelled twice has the larger label."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & keep)
    return rows.groupBy(id_col).agg(F.max(F.col(label_col)).cast("int").alias("y"))


def sample(labels: DataFrame, per_class: int, salt: str, id_col: str = "doc_id") -> DataFrame:
    """About ``per_class`` rows of either label at most, by the hash of the id."""
    n = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    part = F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.lit(1 << 31)) / (1 << 31)
    bound = F.lit(0.0)
    for y, rows in n.items():
        bound = F.when(F.col("y") == y, F.lit(min(1.0, per_class / rows))).otherwise(bound)
    return labels.where(part < bound)


def with_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text) of each labelled document; of rows with the same id, the one whose text has the least hash."""
    labels = cut(labels)
    held = F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(held, id_col)
    return rows.groupBy(id_col, "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
