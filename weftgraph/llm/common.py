"""What the operators here share; reading tables and cutting lineage are the library's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.common import cut, hot_keys, join_unique, releasing, table

__all__ = ["DOCUMENT_COLUMNS", "cut", "hot_keys", "join_unique", "releasing", "row_key", "slices", "table"]

#: The columns of ``documents``, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Bytes of text that a task works on at a time, or else one text.
SLICE_BYTES = 6 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many bytes of text, or of one text."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(batch):
        spent = int(total[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, spent + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def row_key() -> Column:
    """A key that tells rows apart by id and text, null ids included; 128 bits, so that no two of very many rows meet."""
    columns = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("null"))
    return F.struct(F.xxhash64(*columns, F.col("text").isNull()).alias("a"), F.xxhash64(F.lit("again"), *columns, F.col("text").isNull()).alias("b"))

