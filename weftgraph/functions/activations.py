"""Activations as Column -> Column, and small value helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAK = 0.2


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = LEAK) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def identity(x: Column) -> Column:
    return x


def each(x: Column, f) -> Column:
    """A scalar function on every component of an array column."""
    return F.transform(x, f)


#: The largest prime below 2 ** 31; products of two residues fit a long.
_PRIME = 2147483647


def draw(key: Column, i: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on key, position and seed alone, by plain arithmetic, the same in every engine."""
    at = (i + 1).cast("long")
    a = (F.pmod(key, F.lit(_PRIME)) * 1103515245 + at * 12345677 + seed * 7919 + 1) % _PRIME
    b = (a * a + at * 40503) % _PRIME
    return (b * b + a) % _PRIME / _PRIME


def dropout_factor(key: Column, i: Column, p: float, seed: int) -> Column:
    """Zero with probability p, else what keeps the mean."""
    return F.when(draw(key, i, seed) < p, 0.0).otherwise(1 / (1 - p))


def dropout(x: Column, p: float, seed: int, training: bool = True) -> Column:
    """Zeroes an array's components with probability p and scales the rest; the draw depends on node, component and seed."""
    if not training or p == 0:
        return x
    return F.transform(x, lambda v, i: v * dropout_factor(F.col("node_id"), i, p, seed))


def argmax(x: Column) -> Column:
    """Position of an array's largest component, the first of equals."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def threshold(x: Column) -> Column:
    return F.transform(x, lambda v: (v > 0).cast("int"))
