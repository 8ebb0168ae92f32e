"""Numpy's own files as tables: ``.npy`` matrices by ranges of rows, and sparse matrices in ``.npz`` as edges.

Each task reads its own range. A member of an ``.npz`` that is compressed has
to be gone through from its beginning, which takes time but holds no more than
a block. The folder must be one that the executors mount, as these readers open
files themselves; a ``file:`` before the path is allowed.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that a task reads at a time.
BLOCK = 8 << 20


class NpyStream:
    """An array in C order, read forwards from an open file."""

    def __init__(self, file):
        self.file = file
        version = np.lib.format.read_magic(file)
        self.shape, fortran, self.dtype = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version](file)
        if fortran and len(self.shape) > 1 or self.dtype.hasobject:
            raise ValueError("an array of numbers in C order is needed")
        self.width = int(np.prod(self.shape[1:], dtype=np.int64))  # items of a row

    def skip(self, rows: int) -> None:
        left = rows * self.width * self.dtype.itemsize
        if not isinstance(self.file, zipfile.ZipExtFile):
            self.file.seek(left, 1)
            return
        while left:
            left -= len(self.file.read(min(left, BLOCK)))

    def rows(self, count: int) -> Iterator[np.ndarray]:
        """Blocks of the next rows."""
        size = self.width * self.dtype.itemsize
        most = max(1, BLOCK // max(1, size))
        while count > 0:
            now = min(count, most)
            yield np.frombuffer(self.file.read(now * size), self.dtype).reshape(now, self.width)
            count -= now


@contextmanager
def opened(path: str, member: str | None = None):
    path = path.removeprefix("file://").removeprefix("file:")
    if member is None:
        with open(path, "rb") as f:
            yield NpyStream(f)
    else:
        with zipfile.ZipFile(path) as z, z.open(f"{member}.npy") as f:
            yield NpyStream(f)


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


def _ranges(n: int, parts: int) -> list[Range]:
    bounds = [n * k // parts for k in range(parts + 1)]
    return [Range(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b > a] or [Range(0, 0)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.member, self.parts = options["path"], options.get("member"), int(options.get("partitions", 8))


class _NpyReader(_Reader):
    def partitions(self) -> list[Range]:
        with opened(self.path, self.member) as a:
            return _ranges(a.shape[0], self.parts)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        at = partition.low
        with opened(self.path, self.member) as a:
            a.skip(partition.low)
            for block in a.rows(partition.high - partition.low):
                offsets = pa.array(np.arange(len(block) + 1) * a.width, pa.int32())
                values = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(block, np.float64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(block))), values], ["row", "values"])
                at += len(block)


class NpySource(DataSource):
    """(row, values) of a one- or two-dimensional array; options path, member (of an npz) and partitions."""

    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return "row long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


class _CsrReader(_Reader):
    def partitions(self) -> list[Range]:
        """Ranges with some equal numbers of entries, of whatever rows."""
        with opened(self.path, "indices") as a:
            return _ranges(a.shape[0], self.parts)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with opened(self.path, "indptr") as pointers, opened(self.path, "indices") as entries:
            rows, held = self._rows(pointers, partition), np.empty(0, np.int64)
            entries.skip(partition.low)
            for block in entries.rows(partition.high - partition.low):
                while len(held) < len(block):
                    held = np.concatenate((held, next(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(held[: len(block)]), pa.array(block.reshape(-1).astype(np.int64))], ["src", "dst"])
                held = held[len(block) :]

    def _rows(self, pointers: NpyStream, partition: Range) -> Iterator[np.ndarray]:
        """Row numbers of the range's entries, in blocks."""
        n, before, number = pointers.shape[0], 0, -1
        for block in pointers.rows(n):
            ends = np.concatenate(([before], block.reshape(-1).astype(np.int64)))
            low, high = np.clip(ends[:-1], partition.low, partition.high), np.clip(ends[1:], partition.low, partition.high)
            for a in range(0, len(low), 1 << 16):
                counts = high[a : a + (1 << 16)] - low[a : a + (1 << 16)]
                yield from _repeated(number + a + np.flatnonzero(counts), counts[counts > 0])
            before, number = int(ends[-1]), number + len(block)
            if before >= partition.high:
                return


def _repeated(rows: np.ndarray, counts: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Each row number as often as it counts, no block of much more than ``most``."""
    total = np.cumsum(counts)
    begin = 0
    while begin < len(rows):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, side="right")))
        if end == begin + 1:
            left = int(counts[begin])
            while left:
                now = min(left, most)
                yield np.full(now, rows[begin])
                left -= now
        else:
            yield np.repeat(rows[begin:end], counts[begin:end])
        begin = end


class CsrSource(DataSource):
    """(src, dst) of the entries of a sparse matrix that was saved by rows; options path and partitions."""

    @classmethod
    def name(cls) -> str:
        return "csr_edges"

    def schema(self) -> str:
        return "src long, dst long"

    def reader(self, schema) -> DataSourceReader:
        return _CsrReader(self.options)


def read_npy(spark: SparkSession, path: str, member: str | None = None, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(NpySource)
    reader = spark.read.format("npy_rows").option("path", path).option("partitions", str(partitions))
    return (reader.option("member", member) if member else reader).load()


def read_csr(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(CsrSource)
    return spark.read.format("csr_edges").option("path", path).option("partitions", str(partitions)).load()
