"""Numeric functions on columns and arrays."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps, 93 of which serve any two longs."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.nullif(s["y"], F.lit(0).cast("long"))).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step)["x"]


def power(x: Column, n: Column) -> Column:
    """x to a whole power; 1e200 stands for a negative power of 0."""
    return F.when((x == 0) & (n < 0), F.lit(1e200)).otherwise(F.pow(x, n))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def argmax(x: Column) -> Column:
    """0-based position of the first greatest element."""
    return F.array_position(x, F.array_max(x)) - 1


def simpson(f: Callable[[Column], Column], a: Column, b: Column, parts: int) -> Column:
    """Integral of f by Simpson's rule over 2 * parts subintervals."""
    n = 2 * parts
    h = (b - a) / n
    weight = lambda i: F.when((i == 0) | (i == n), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0.0), lambda s, i: s + weight(i) * f(a + i * h)) * h / 3


def simpson2d(f: Callable[[Column, Column], Column], a: Column, b: Column, c: Column, d: Column, parts: int) -> Column:
    """Integral of f over [a, b] x [c, d]."""
    return simpson(lambda x: simpson(lambda y: f(x, y), c, d, parts), a, b, parts)


def bivariate_normal(x: Column, y: Column, mx: Column, my: Column, sx: Column, sy: Column, rho: Column) -> Column:
    """Density of two correlated normal variables."""
    u, v = (x - mx) / sx, (y - my) / sy
    rest = 1 - rho * rho
    return F.exp(-(u * u - 2 * rho * u * v + v * v) / (2 * rest)) / (2 * math.pi * sx * sy * F.sqrt(rest))


def conditional_normal(x: Column, y: Column, mx: Column, my: Column, sx: Column, sy: Column, rho: Column) -> Column:
    """Density of y given x."""
    sd = sy * F.sqrt(1 - rho * rho)
    z = (y - (my + rho * sy / sx * (x - mx))) / sd
    return F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def overlaps(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Whether [a, b] and [x, y] share a point."""
    return (a <= y) & (x <= b)


def within_closed(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Whether [a, b] lies in [x, y]; the ends may meet."""
    return (a >= x) & (b <= y)


def within_open(a: Column, b: Column, x: Column, y: Column) -> Column:
    return (a > x) & (b < y)


@F.pandas_udf(DoubleType())
def determinant(rows: pd.Series) -> pd.Series:
    """Determinant of a square matrix, given as rows after each other; matrices of one size are worked out together."""
    out = np.empty(len(rows))
    sizes = rows.map(len).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        side = math.isqrt(int(size))
        out[at] = np.linalg.det(np.stack([np.asarray(rows.iloc[k], float) for k in at]).reshape(-1, side, side))
    return pd.Series(out)


@F.pandas_udf(ArrayType(IntegerType()))
def next_permutation(values: pd.Series) -> pd.Series:
    """The next permutation in lexicographic order; the first after the last."""

    def advance(v: np.ndarray) -> list[int]:
        v = list(map(int, v))
        rising = [i for i, (a, b) in enumerate(pairwise(v)) if a < b]
        if not rising:
            return v[::-1]
        i = rising[-1]
        j = max(k for k in range(i + 1, len(v)) if v[k] > v[i])
        v[i], v[j] = v[j], v[i]
        return v[: i + 1] + v[i + 1 :][::-1]

    return values.map(advance)


_LOW = (1 << 32) - 1


def _add(a: Column, b: Column) -> Column:
    """Sum of two longs on 64 bits that wrap, by halves that can't overflow."""
    low = a.bitwiseAND(_LOW) + b.bitwiseAND(_LOW)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(_LOW))


def shift_xor_hash(letters: Column) -> Column:
    """Hash that starts at the length and, for each letter (a byte), turns by 5 and 27 bits on 64 that wrap; a signed long."""
    step = lambda h, x: F.shiftleft(h, 5).bitwiseXOR(F.shiftrightunsigned(h, 27)).bitwiseXOR(x.cast("long").bitwiseAND(255))
    return F.aggregate(letters, F.size(letters).cast("long"), step)


def one_at_a_time_hash(letters: Column) -> Column:
    """Jenkins's one-at-a-time hash of letters (bytes) on 64 bits that wrap; a signed long."""

    def step(h: Column, x: Column) -> Column:
        h = _add(h, x.cast("long").bitwiseAND(255))
        h = _add(h, F.shiftleft(h, 10))
        return h.bitwiseXOR(F.shiftrightunsigned(h, 6))

    def finish(h: Column) -> Column:
        h = _add(h, F.shiftleft(h, 3))
        h = h.bitwiseXOR(F.shiftrightunsigned(h, 11))
        return _add(h, F.shiftleft(h, 15))

    return F.aggregate(letters, F.lit(0).cast("long"), step, finish)


def nearest_distance(x: Column, y: Column) -> Column:
    """(distance, which): the least distance between members of two arrays, and the place in x of the first such member.

    Pairs go by y, then x. An empty or null array gives 0 and null.
    """
    pairs = F.flatten(F.transform(y, lambda b, k: F.transform(x, lambda a, n: F.struct(F.abs(a - b).alias("d"), k.alias("k"), n.alias("n")))))
    least = F.array_min(pairs)
    return F.struct(F.coalesce(least["d"], F.lit(0).cast("long")).alias("distance"), least["n"].alias("which"))
