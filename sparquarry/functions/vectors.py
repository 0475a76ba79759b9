"""Vector expressions: distances on array columns, sign sketches, Hamming distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2")


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column, metric: str) -> Column:
    """Smaller is nearer: 1 - cosine, minus the inner product, or the squared Euclidean distance."""
    a, b = as_doubles(a), as_doubles(b)
    if metric == "cosine":
        return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))
    if metric == "dot":
        return -dot(a, b)
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    raise ValueError(f"unknown metric {metric}")


def usable(v: Column, dim: int) -> Column:
    """Whether a vector has the dimension and only finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad, F.lit(False))


def sign_sketch(v: Column, dim: int) -> Column:
    """array<bigint>: one bit a component, set where it is at least 0, lowest bit first."""
    words = []
    for start in range(0, dim, 64):
        bits = [F.when(v[i] >= 0, F.shiftleft(F.lit(1).cast("long"), i - start)).otherwise(F.lit(0).cast("long")) for i in range(start, min(dim, start + 64))]
        word = bits[0]
        for b in bits[1:]:
            word = word.bitwiseOR(b)
        words.append(word)
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
