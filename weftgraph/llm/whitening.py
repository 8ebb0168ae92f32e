"""Whitening of embeddings along the leading eigenvectors of their covariance, found by slicing the spectrum.

Components become integers, x = floor(1024 c) + 100000, so that sums and
products over all vectors are exact whatever the order of tasks. One pass
counts the vectors and sums them; a second one centres them by the nearest
integers to the means, multiplies, and sums in tasks and then by a grouped sum
of as many rows as the covariance has entries; what the rounding of the means
left is taken off exactly. Only that matrix, of the vectors' width, comes to
the driver.

There, the number of negative pivots of a shifted matrix's LDLᵀ says how many
eigenvalues lie below the shift. Bisection by such counts isolates each leading
eigenvalue, Rayleigh quotient iteration from the middle of its interval
converges to it, and two more counts right beside it certify its number. A
third pass writes each vector's components and exact deviation; the covariance
of what was written is computed from that table.

Vectors that are null, hold a null or a non-finite entry, or are not as wide as
most vectors (of equally frequent widths, the narrower) are dropped; all others
are the fit list and get rows. A null or repeated vec_id is carried through. No
remaining vectors give no rows, and directions without variance (one vector,
equal vectors, fewer dimensions than asked for) are no components. Equal
eigenvalues have any orthogonal vectors of their space. Extra columns are
ignored. Entries c of up to 2 ** 20 in size are exact; larger ones raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut

SCALE, OFFSET, LARGEST = 1024, 100_000, 1 << 20
#: Vectors multiplied at a time: centred entries below 2 ** 31 or so are split in two, so products of so many are exact in doubles.
ROWS = 1 << 12
_HALF = 1 << 16


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, z): z = floor(1024 c) of the vectors that remain, of any width."""
    x = F.col(vector_col).cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf)
    rows = vectors.select(F.col(id_col).alias("vec_id"), x.alias("c")).where(F.col("c").isNotNull()).where(~F.exists("c", bad))
    small = lambda v: F.when(F.abs(v) > LARGEST, F.raise_error(F.lit(f"an entry is over {LARGEST}")).cast("double")).otherwise(v)
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(small(v) * SCALE)).alias("z"))


@dataclass(frozen=True)
class Moments:
    """Of x: the number of vectors, their sums, and n times the covariance's numerator, all exact."""

    n: int
    sums: list[int]
    scatter: list[list[int]]  # sum over vectors of (n x - S)(n x - S)ᵀ, divided by n

    def covariance(self) -> np.ndarray:
        return np.array([[v / (self.n * self.n) for v in row] for row in self.scatter])


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def exact_products(y: np.ndarray) -> list[list[int]]:
    """yᵀ y of integers below 2 ** 31, exactly: entries are split in two and multiplied as doubles."""
    high, low = np.floor_divide(y, _HALF).astype(np.float64), np.remainder(y, _HALF).astype(np.float64)
    top, cross, bottom = high.T @ high, high.T @ low, low.T @ low
    return [[int(top[i, j]) * _HALF * _HALF + int(cross[i, j] + cross[j, i]) * _HALF + int(bottom[i, j]) for j in range(y.shape[1])] for i in range(y.shape[1])]


def _summed(rows: DataFrame, run) -> dict[int, int]:
    """The sums by key of what each task emits; as many rows as there are keys."""
    found = rows.mapInArrow(run, "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    return {r["k"]: int(r["v"]) for r in found.collect()}


def _emit(values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], ["k", "v"])


def moments(rows: DataFrame) -> Moments | None:
    """Of ``usable`` rows of one width."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, 0
        for batch in batches:
            if len(batch):
                n, sums = n + len(batch), sums + _rows(batch.column(0)).sum(axis=0)
        if n:
            yield _emit([n, *map(int, sums)])

    found = _summed(rows.select("z"), totals)
    if not found:
        return None
    n, width = found[0], len(found) - 1
    means = [(2 * found[1 + j] + n) // (2 * n) for j in range(width)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * width for _ in range(width)]
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                own = exact_products(_rows(batch.column(0).slice(at, ROWS)) - np.array(means))
                total = [[a + b for a, b in zip(r, s, strict=True)] for r, s in zip(total, own, strict=True)]
        yield _emit([total[i][j] for i in range(width) for j in range(i, width)])

    second = _summed(rows.select("z"), products)
    rest = [found[1 + j] - n * means[j] for j in range(width)]
    scatter, k = [[0] * width for _ in range(width)], 0
    for i in range(width):
        for j in range(i, width):
            scatter[i][j] = scatter[j][i] = n * second[k] - rest[i] * rest[j]
            k += 1
    return Moments(n, [found[1 + j] + n * OFFSET for j in range(width)], scatter)


def count_below(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are below the shift: the negative pivots of its LDLᵀ, of one or two rows each."""
    m, below, bound = a - shift * np.eye(len(a)), 0, (1 + math.sqrt(17)) / 8
    while len(m):
        column = np.abs(m[:, 0])
        column[0] = 0.0
        r, pivot = int(np.argmax(column)), 1
        largest = column[r]
        if max(largest, abs(m[0, 0])) == 0.0:  # a zero pivot is not below
            m = m[1:, 1:]
            continue
        if abs(m[0, 0]) < bound * largest:
            other = np.abs(m[:, r])
            other[r] = 0.0
            sigma = other.max()
            if abs(m[0, 0]) * sigma < bound * largest * largest:
                pivot, to = (1, 0) if abs(m[r, r]) >= bound * sigma else (2, 1)
                if to != r:
                    order = np.arange(len(m))
                    order[to], order[r] = r, to
                    m = m[np.ix_(order, order)]
        if pivot == 1:
            below += m[0, 0] < 0
            m = m[1:, 1:] - np.outer(m[1:, 0], m[0, 1:] / m[0, 0])
        else:
            top, side = m[:2, :2], m[2:, :2]
            det = top[0, 0] * top[1, 1] - top[0, 1] * top[1, 0]
            below += 1 if det < 0 else 2 * int(top[0, 0] + top[1, 1] < 0)
            m = m[2:, 2:] - side @ np.linalg.solve(top, side.T)
    return int(below)


def leading(a: np.ndarray, most: int) -> list[tuple[float, np.ndarray]]:
    """The largest eigenvalues of a positive semidefinite matrix, falling, with unit vectors; those that are no more than rounding are left out."""
    d, norm = len(a), float(np.abs(a).sum(axis=1).max(initial=0.0))
    above = lambda shift: d - count_below(a, shift)
    tiny, out = norm * (d + 1) * np.finfo(float).eps, []
    if norm == 0.0:
        return out
    for k in range(1, min(most, d) + 1):
        low, high = 0.0, norm * (1 + 1e-9) + tiny
        while high - low > tiny:  # until one eigenvalue is between, or they are as good as equal
            if above(low) == k and above(high) == k - 1 and (found := _iterate(a, low, high, tiny, out)):
                if above(found[0] - tiny) >= k > above(found[0] + tiny):
                    break
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= k else (low, middle)
        else:
            found = _iterate(a, low, high, tiny, out, bounded=False)
        if found[0] <= 4 * tiny:
            break
        out.append(found)
    return out


def _iterate(a: np.ndarray, low: float, high: float, tiny: float, before: list[tuple[float, np.ndarray]], bounded: bool = True) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of an interval, square to the vectors found before; nothing if it leaves the interval or does not settle.

    Unbounded, for an eigenvalue as good as equal to one before it, the values found before are taken out of the matrix.
    """
    d = len(a)
    held = np.array([v for _, v in before]).reshape(len(before), d)
    if not bounded:
        a = a - sum((e * np.outer(v, v) for e, v in before), np.zeros((d, d)))
    v = np.cos(np.arange(1, d + 1) ** 2 + len(before))
    shift, best = (low + high) / 2, None
    for step in range(40):
        v = v - held.T @ (held @ v)
        v = v / np.linalg.norm(v)
        if step > 1:  # the first steps only turn the vector towards the interval
            shift = float(v @ a @ v)
            if bounded and not low - tiny <= shift <= high + tiny:
                return None
            left = float(np.linalg.norm(a @ v - shift * v))
            if best is not None and left >= best[0] / 2 and best[0] <= 8 * tiny:
                return best[1], best[2]
            if best is None or left < best[0]:
                best = left, shift, v
        try:
            w = np.linalg.solve(a - shift * np.eye(d), v)
        except np.linalg.LinAlgError:
            w = np.linalg.solve(a - (shift + 4 * tiny) * np.eye(d), v)
        v = w if np.isfinite(w).all() else v
    return None if bounded else (best[1], best[2])


@dataclass(frozen=True)
class Whitening:
    moments: Moments
    values: list[float]
    vectors: np.ndarray  # a row for each component

    @property
    def explained(self) -> list[float]:
        trace = sum(self.moments.scatter[i][i] for i in range(len(self.moments.sums))) / self.moments.n**2
        return [e / trace for e in self.values]


def common_width(rows: DataFrame) -> int | None:
    """The width of most vectors, of equals the least."""
    found = rows.groupBy(F.size("z").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    return None if found is None else found["w"]


def fit(rows: DataFrame, most: int = 8) -> Whitening | None:
    """Of ``usable`` rows of one width."""
    m = moments(rows)
    if m is None:
        return None
    found = leading(m.covariance(), most)
    return Whitening(m, [e for e, _ in found], np.array([v for _, v in found]).reshape(len(found), len(m.sums)))


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, w): the exact sum of (n x - S)², and the whitened components."""
    m = model.moments
    n, width = m.n, len(m.sums)
    own = [s - n * OFFSET for s in m.sums]
    means = np.array([(2 * s + n) // (2 * n) for s in own])
    rest = [s - n * int(c) for s, c in zip(own, means, strict=True)]
    square, shift = sum(r * r for r in rest), np.array([r / n for r in rest])
    to = (model.vectors / np.sqrt(np.array(model.values))[:, None]).T if model.values else np.zeros((width, 0))
    high, low = np.array([r // _HALF for r in rest], dtype=np.int64), np.array([r % _HALF for r in rest], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            y = _rows(batch.column(1)) - means
            squares, ups, downs = ((y * y).sum(axis=1).tolist(), (y @ high).tolist(), (y @ low).tolist())
            deviation = [Decimal(n * n * s - 2 * n * (u * _HALF + v) + square) for s, u, v in zip(squares, ups, downs, strict=True)]
            w = (y - shift) @ to
            offsets = pa.array(np.arange(len(batch) + 1) * to.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.decimal128(38, 0)), pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1)))], ["vec_id", "deviation", "w"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "z").mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), w array<double>")


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of the whitened components minus the identity, from the table itself."""
    if not components:
        return 0.0
    of = lambda j: F.col("w")[j]
    means = whitened.agg(*(F.avg(of(j)).alias(f"m{j}") for j in range(components))).first()
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = whitened.agg(*(F.avg((of(i) - F.lit(means[i])) * (of(j) - F.lit(means[j]))).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each remaining vector and component."""
    rows = usable(vectors, id_col, vector_col)
    width = common_width(rows)
    model = fit(rows := rows.where(F.size("z") == width), most) if width else None
    if model is None:
        empty = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {empty}")
    done = cut(apply(rows, model))
    error = identity_error(done, len(model.values))
    explained = F.array(*map(F.lit, model.explained)) if model.values else F.array().cast("array<double>")
    long = done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.moments.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
