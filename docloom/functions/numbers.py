"""Numeric expressions: vectors, axes, ranges and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for null, empty, unequal lengths and zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(F.coalesce(fits, F.lit(False)), dot(a, b) / norm).otherwise(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def hash_slot(token: Column, dim: int) -> Column:
    """First byte of the token's SHA-256, modulo the dimension."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 2), 16, 10).cast("int") % dim).cast("int")


def log_scale(low_positive: Column, high_positive: Column, n_positive: Column) -> Column:
    """Whether an axis is logarithmic: two positive ticks or more, over two decades."""
    return (n_positive >= 2) & (high_positive / low_positive >= 100)


def overlap_ratio(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Shared part of the span of two ranges; negative where they lie apart."""
    shared = F.least(a_high, b_high) - F.greatest(a_low, b_low)
    return F.try_divide(shared, F.greatest(a_high, b_high) - F.least(a_low, b_low))


def number_text(x: Column) -> Column:
    """Six significant digits as text: integers without a point, no trailing zeros, halves rounded to even."""
    scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(x))))
    tie = F.bround(x * scale) != F.round(x * scale)
    even = F.when(F.coalesce(tie & (x != 0), F.lit(False)), F.bround(x * scale) / scale).otherwise(x)
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", even), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x.isNull(), "").when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("string")).otherwise(short)
