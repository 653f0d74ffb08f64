"""Column expressions: parsing, clipping, stable pseudo-random numbers, model arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\r\x0b\x0c"
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"


def trimmed(c: Column) -> Column:
    """Without leading and trailing white space (tabs and line ends too); null becomes empty."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACE))


def to_long(c: Column) -> Column:
    """A whole decimal number, else null."""
    c = trimmed(c)
    return F.when(c.rlike(INTEGER), c.try_cast("bigint"))


def to_double(c: Column) -> Column:
    """A decimal number, infinity or NaN, else null; suffixes such as 1.5d are not numbers."""
    c = trimmed(c)
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def null_aware_double(c: Column) -> Column:
    """``to_double`` for which "null" in any case is a null like the empty string."""
    return F.when(F.lower(trimmed(c)).isin("", "null"), F.lit(None).cast("double")).otherwise(to_double(c))


def to_flag(c: Column) -> Column:
    """True for "true" in any case and for "1"."""
    c = trimmed(c)
    return (F.lower(c) == "true") | (c == "1")


def normalized(c: Column) -> Column:
    return F.lower(trimmed(c))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def contains_ci(c: Column, part: str) -> Column:
    """Contains, ignoring case; false for null."""
    return F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))


def count_non_null(cs: Sequence[Column]) -> Column:
    total = F.lit(0)
    for c in cs:
        total = total + c.isNotNull().cast("int")
    return total.cast("bigint")


def uniform(seed: int | str, name: str, key: Column) -> Column:
    """A number of [0, 1) that depends on seed, name and key only, not on partitions or retries."""
    digest = F.md5(F.concat(F.lit(f"{seed}|{name}|"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed: int | str, name: str, key: Column) -> Column:
    """A standard normal number (Box-Muller) from two such uniforms."""
    radius = F.sqrt(-2 * F.ln(1 - uniform(seed, name + ".r", key)))
    return radius * F.cos(2 * pi * uniform(seed, name + ".a", key))


def sigmoid(z: Column) -> Column:
    """Logistic function that does not overflow on either side."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def dot(weights: Sequence[float | Column], xs: Sequence[Column]) -> Column:
    """weights[0] + sum of weights[i + 1] * xs[i]."""
    total = _lit(weights[0])
    for w, x in zip(weights[1:], xs, strict=True):
        total = total + _lit(w) * x
    return total


def _lit(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def one_hot(c: Column, categories: Sequence[str], fallback: str) -> list[Column]:
    """One double column a category, in the order given; unknown and null count as ``fallback``."""
    known = [x for x in categories if x != fallback]
    out = []
    for x in categories:
        hit = c == x if x != fallback else ~F.coalesce(c.isin(known), F.lit(False))
        out.append(F.coalesce(hit, F.lit(False)).cast("double"))
    return out


def log_loss(p: Column, y: Column, eps: float = 1e-12) -> Column:
    p = clip(p, eps, 1 - eps)
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def feature_key(cs: Sequence[Column]) -> Column:
    """Hash of all features of a row (json keeps types, nulls and borders apart)."""
    return F.sha2(F.to_json(F.struct(*cs), {"ignoreNullFields": "false"}), 256)
