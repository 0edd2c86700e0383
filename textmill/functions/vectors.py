"""Vector expressions over arrays of numbers; sums run left to right in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if a side is null, empty or of no length, or if they differ in size."""
    na, nb = norm(a), norm(b)
    none = a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0) | (na == 0) | (nb == 0)
    return F.when(none, F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def l2_normalize(a: Column) -> Column:
    """Single precision; a vector of zeros stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: F.lit(0.0).cast("float"))).otherwise(F.transform(a, lambda x: (x / n).cast("float")))


def to_bytes(a: list[float]) -> bytes:
    """Little-endian single precision, as external stores keep vectors."""
    import struct

    return struct.pack(f"<{len(a)}f", *a)


def from_bytes(data: bytes) -> list[float]:
    import struct

    return list(struct.unpack(f"<{len(data) // 4}f", data))
