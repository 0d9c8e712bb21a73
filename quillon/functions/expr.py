"""Scalar column expressions: geometry, clipping, closeness, bits, vectors, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str, alias: str | None = None) -> Box:
    """The four columns prefix + x0, y0, x1, y1."""
    at = f"{alias}." if alias else ""
    return tuple(F.col(f"{at}{prefix}{k}") for k in ("x0", "y0", "x1", "y1"))


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def area(b: Box) -> Column:
    return F.greatest(F.lit(0), b[2] - b[0]) * F.greatest(F.lit(0), b[3] - b[1])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union has no area."""
    common = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = area(a) + area(b) - common
    return F.when(union > 0, common.cast("double") / union).otherwise(0.0)


def center_inside(a: Box, b: Box) -> Column:
    """Is the center of a inside b, borders included?"""
    cx, cy = (a[0] + a[2]) / 2.0, (a[1] + a[3]) / 2.0
    return (cx >= b[0]) & (cx <= b[2]) & (cy >= b[1]) & (cy <= b[3])


def near_center(b: Box, width: Column, height: Column) -> Column:
    """Is the center of b within a third of the crop's size from the crop's center, strictly?"""
    return (F.abs((b[0] + b[2]) / 2.0 - width / 2.0) < width / 3.0) & (F.abs((b[1] + b[3]) / 2.0 - height / 2.0) < height / 3.0)


def expand(b: Box, margin: float) -> list[Column]:
    """b, larger on each side by margin times its size, cut towards zero."""
    mx, my = ((b[2] - b[0]) * F.lit(margin)).cast("int"), ((b[3] - b[1]) * F.lit(margin)).cast("int")
    return [b[0] - mx, b[1] - my, b[2] + mx, b[3] + my]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol * |b|: not symmetric, b is the reference."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for vectors of different length or of norm 0."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(z, -30.0, 30.0)))


def short_id(text: Column, size: int = 12) -> Column:
    """The first hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, size)


def valid_tags(tags: Column) -> Column:
    """Do all keys and values of a map fit the tag pattern?"""
    fits = lambda x: x.rlike(r"^[A-Za-z0-9_.:+/=-]{1,64}$")
    return F.forall(F.map_keys(tags), fits) & F.forall(F.map_values(tags), fits)
